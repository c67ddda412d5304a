"""Column-level helpers: time model, period labels, exact ratios and shares."""
