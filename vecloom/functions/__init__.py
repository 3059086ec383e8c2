"""Column-level functions: vectors, text, names, JSON."""
