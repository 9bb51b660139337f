"""Column functions, also registered as SQL functions."""
