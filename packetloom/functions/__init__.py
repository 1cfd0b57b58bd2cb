"""Column expressions over packet and connection tables."""
