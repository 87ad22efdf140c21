"""Column functions: box geometry, label maps, parsing of names and values."""
