"""Column functions and code tables."""
