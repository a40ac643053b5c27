"""Notes that keep arriving."""
