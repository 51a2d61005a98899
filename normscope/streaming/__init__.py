"""Scoring of arriving descriptors against a fixed bank."""
