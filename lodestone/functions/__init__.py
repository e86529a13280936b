"""Column functions: text rules, statistics, vectors."""
