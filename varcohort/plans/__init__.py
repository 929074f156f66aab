"""Queries over the given tables, with SQL twins."""
