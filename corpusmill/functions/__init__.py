"""Column-level functions (no DataFrame in, Column out)."""
