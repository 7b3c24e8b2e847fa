"""Column expressions and their driver-side counterparts."""
