"""Labelled transaction descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideledger.schemas import CATEGORY_TEXT
from tideledger.sources.tabular import SourceError

COLUMNS = CATEGORY_TEXT.fieldNames()
REQUIRED = set(COLUMNS)
FLAGS = ("categorization_only",)


def to_table(df: DataFrame) -> DataFrame:
    """The four columns, without rows that lack text or category, each distinct row once."""
    missing = sorted(REQUIRED - set(df.columns))
    if missing:
        raise SourceError(f"Missing columns: {missing}")
    return df.select(*COLUMNS).dropna(subset=["transaction_description", "category"]).dropDuplicates()
