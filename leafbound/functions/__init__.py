"""Column and frame functions that several operators share."""
