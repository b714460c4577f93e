"""Column functions and distributed running aggregates."""
