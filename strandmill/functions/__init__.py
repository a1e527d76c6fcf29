"""Column functions on sequences and qualities."""
