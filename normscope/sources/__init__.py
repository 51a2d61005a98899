"""Image sources, descriptor sources and the detector store."""
