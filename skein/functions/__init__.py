"""Column functions: paths, text lines and search patterns."""
