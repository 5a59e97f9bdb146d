"""Column builders: text, answer matching and vector metrics."""
