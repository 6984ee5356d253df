"""Column expressions: colour, random draws, names, thresholds, geometry."""
