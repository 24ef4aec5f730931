"""Column expressions: names, text, privacy outcomes, geometry."""
