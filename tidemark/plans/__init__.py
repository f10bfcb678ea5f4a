"""Queries over published datasets, and the SQL of the same results."""

from .catalog import ORACLE_SQL, QUERIES, entry

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
