"""Column expressions: text, time, maps."""
