"""All registered queries of the engine and the SQL that says the same."""

from . import queries_plans, queries_store  # noqa: F401  they register their queries
from .queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
