"""Column expressions: text, url, token and score functions."""
