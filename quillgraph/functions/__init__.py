"""Column functions: identifiers and months, text, vectors."""
