"""Composed queries and the derived read set."""
