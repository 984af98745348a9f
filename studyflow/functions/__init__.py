"""Column expressions that several operators share."""
