"""Column functions: pure expressions, no shuffles, no Python on the executors."""
