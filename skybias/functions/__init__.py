"""Column functions: no shuffles, no state."""
