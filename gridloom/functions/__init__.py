"""Column functions: text, clauses, statistics."""
