"""Column functions: normalization, tokens, personal data, terms, vectors, chunks."""
