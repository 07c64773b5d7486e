"""Column expressions: vocabulary, text, vectors."""
