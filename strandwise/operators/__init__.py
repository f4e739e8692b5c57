"""Relational and per-read operators."""
