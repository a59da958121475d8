"""Column expressions: URIs, literals, path functions, terms."""
