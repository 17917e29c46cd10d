"""Column builders for text, identifiers and vectors."""
