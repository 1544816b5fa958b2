"""Column expressions: paths, methods, segments."""
