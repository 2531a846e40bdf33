"""Column functions: text scalars and similarities."""
