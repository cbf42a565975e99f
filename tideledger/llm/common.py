"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideledger.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def checked(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A side of a join, written and counted: up to ``most`` narrow rows it is broadcast, beyond that it is shuffled."""
    written = stage(df)
    return F.broadcast(written) if written.count() <= most else written


def mixed(values: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value for each 64-bit value (the finaliser of splitmix64, fixed values)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
