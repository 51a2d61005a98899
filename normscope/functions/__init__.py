"""Column expressions: distances, quantiles, rasters, ids and checks."""
