"""Relational operators that work on any DataFrame."""
