"""Writing tables and run artifacts, and reading them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideledger.operators.ordered import ranked


def write_table(df: DataFrame, path: str, by_month: bool = False) -> str:
    """Parquet with zstd. ``by_month`` makes one folder per month: rows are brought together by month in tasks of
    even size, so a month with very many rows is written by several tasks."""
    if by_month:
        df = df.hint("rebalance", F.col("month"))
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy("month") if by_month else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def write_run(root: str, run_id: str, predictions: DataFrame, metrics: DataFrame, parameters: dict) -> None:
    """Artifacts of one run, as partitions ``run_id=…`` of three tables."""
    spark = predictions.sparkSession
    part = f"run_id={run_id}"
    predictions.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/predictions/{part}")
    metrics.write.mode("errorifexists").json(f"{root}/metrics/{part}")
    text = json.dumps(parameters, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "parameters string").write.mode("errorifexists").json(f"{root}/parameters/{part}")


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """Inverse of ``write_run``; only the folders of that run are read."""
    mine = F.col("run_id") == run_id
    return {
        "predictions": spark.read.parquet(f"{root}/predictions").where(mine),
        "metrics": spark.read.json(f"{root}/metrics").where(mine),
        "parameters": spark.read.json(f"{root}/parameters").where(mine),
    }


def preview(tables: dict[str, DataFrame | None], limit: int = 100, order: list[str] = ()) -> DataFrame:
    """First rows of the first table there is: canonical, categories, series."""
    if not 1 <= limit <= 1000:
        raise ValueError("A preview shows 1 to 1000 rows")
    for name in ("canonical", "categories", "series"):
        table = tables.get(name)
        if table is not None:
            return (table.orderBy(*order) if order else table).limit(limit)
    raise ValueError("There is no table to show")


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` in the order of ``keys``, each with the total number of rows.

    Ranks are computed in parallel, so a late page does not pull the earlier ones through one task.
    """
    numbered = ranked(df, [], [F.col(name).asc() for name in keys], "_row")
    wanted = numbered.where((F.col("_row") > offset) & (F.col("_row") <= offset + limit))
    return wanted.drop("_row").withColumn("total_rows", F.lit(numbered.count()))


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> str:
    """A table for pages: sorted by ``keys`` over its parts, every row with its place in its part, and beside it an index
    of the parts' row counts. One sort, whatever the number of pages read later."""
    order = [F.col(name).asc() for name in keys]
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)
    placed = spread.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
    placed.write.mode("errorifexists").option("compression", "zstd").partitionBy("_part").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.groupBy("_part").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/_index")
    return path


def read_page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """``page`` of a table of ``write_ordered``: only the parts that hold its rows are opened."""
    parts = spark.read.parquet(f"{path}/_index").orderBy("_part").collect()  # a row a part
    wanted, before = F.lit(False), 0
    for part in parts:
        first, last = max(offset - before, 0), min(offset + limit - before, part["rows"])
        if first < last:
            wanted = wanted | ((F.col("_part") == part["_part"]) & F.col("_place").between(first, last - 1))
        before += part["rows"]
    return spark.read.parquet(path).where(wanted).drop("_part", "_place").withColumn("total_rows", F.lit(before).cast("long"))


def newest_first(runs: DataFrame, created: str = "created_at", limit: int = 100, tie: str = "run_id") -> DataFrame:
    """Latest runs first."""
    return runs.orderBy(F.desc(created), F.desc(tie)).limit(limit)
