"""Whole flows (rebuild, inspect, status) and the registered queries."""
