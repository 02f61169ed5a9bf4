"""Column-to-Column helpers."""
