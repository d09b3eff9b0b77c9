"""Registered queries: importing this package fills the registry."""

from . import gazetteer, mapping, scalars, sources, staging
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "gazetteer", "mapping", "scalars", "sources", "staging"]
