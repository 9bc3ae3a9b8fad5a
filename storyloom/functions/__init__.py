"""Column functions: listing grammar, text search, vectors."""
