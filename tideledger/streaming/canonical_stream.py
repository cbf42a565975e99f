"""Canonical aggregation over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tideledger.functions.flags import ADAPTER_FLAGS
from tideledger.operators.canonical import canonical_monthly
from tideledger.schemas import CANONICAL_COLUMNS

#: Columns of an arriving transaction row: canonical columns plus the time it happened.
EVENT_TIME = "moment"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def partial_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    flags: tuple[str, ...] = ADAPTER_FLAGS,
    scale: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Sum every micro-batch to partial canonical rows and append them below ``path``.

    The aggregation is associative, so no state is kept across batches and nothing is ever late. Each batch writes
    its own folder and overwrites it when retried, so a repeated batch counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial = canonical_monthly(batch.select(*CANONICAL_COLUMNS), flags, scale)
        partial.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_canonical(
    spark: SparkSession, path: str, flags: tuple[str, ...] = ADAPTER_FLAGS, scale: int | None = None
) -> DataFrame:
    """Canonical table of everything the stream has written: partial rows added up."""
    return canonical_monthly(spark.read.parquet(path).select(*CANONICAL_COLUMNS), flags, scale)


def daily_stream(rows: DataFrame, path: str, checkpoint: str, delay: str = "7 days", **trigger) -> StreamingQuery:
    """Day-level canonical sums with bounded state: a day is written once the watermark has passed it.

    Rows later than ``delay`` are dropped by the watermark; use ``partial_stream`` where none may be lost.
    """
    keys = [name for name in CANONICAL_COLUMNS if not name.endswith(("_sum", "_count"))]
    sums = [name for name in CANONICAL_COLUMNS if name not in keys]
    summed = (
        rows.withWatermark(EVENT_TIME, delay)
        .groupBy(F.window(EVENT_TIME, "1 day"), *keys)
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
    flat = summed.select(F.col("window.start").alias("day"), *CANONICAL_COLUMNS)
    writer = flat.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).format("parquet").option("path", path).start()
