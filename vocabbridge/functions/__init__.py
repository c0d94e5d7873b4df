"""Column expressions: text, hashing, sequences and dense vectors."""
