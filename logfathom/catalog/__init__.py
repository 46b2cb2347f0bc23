"""Registered queries over the given tables and the SQL each is checked against."""

from logfathom.catalog.oracles import ORACLES
from logfathom.catalog.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
