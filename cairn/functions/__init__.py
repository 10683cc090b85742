"""Column expressions: identifiers, text, vectors."""
