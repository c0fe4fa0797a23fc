"""Column expressions and window helpers shared by operators."""
