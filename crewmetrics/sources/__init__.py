"""Source schemas and the adapters that give the driver tables those shapes."""
