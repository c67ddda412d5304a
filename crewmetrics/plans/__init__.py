"""Reports composed from the operators, and the catalogue of named parameter sets."""
