"""Column expressions and small plan helpers shared by operators and sources."""
