"""All registered queries of the record engine."""

from tabulon.queries import analysis, catalog, details, personal, search, states, stores
from tabulon.queries.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analysis", "catalog", "details", "personal", "search", "states", "stores"]
