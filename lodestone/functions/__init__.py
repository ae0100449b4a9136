"""Column functions: vectors, text, paths."""
