"""Queries over the given tables, and SQL that gives the same rows."""
