"""All registered queries."""

from tideledger.plans import model_queries, series_queries, source_queries, table_queries  # noqa: F401
from tideledger.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
