"""All registered queries of the library."""

from ..model import ORACLE_SQL, QUERIES
from . import basic_queries, curve_queries, more_queries, rank_sql, space_queries, surface_sql  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
