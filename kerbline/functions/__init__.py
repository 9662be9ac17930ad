"""Column expressions and numpy kernels."""
