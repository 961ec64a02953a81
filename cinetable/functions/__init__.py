"""Column expressions: time text, transcript text, JSON, vectors."""
