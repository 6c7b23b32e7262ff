"""Column expressions and fixed constants shared by the operators."""
