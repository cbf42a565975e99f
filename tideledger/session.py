"""Session set-up, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings the operators are written for. AQE sizes and splits the shuffle partitions at run time, so the initial
#: number is an upper bound, not a tuning knob.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
}


def open_session(app: str = "tideledger", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the defaults above; keyword settings use ``__`` for the dots of a Spark key."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. Only a local master may fall back to a temp folder."""
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tideledger-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives the loss of any executor, and unlike a row checkpoint is compressed, columnar and of
    known size, so later passes read only their columns and joins are planned on real numbers.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Row count up to which the small side of a lookup is broadcast. Rows are a few fixed-width columns, so this stays
#: near 50 MB; beyond it the join is an ordinary shuffled one.
BROADCAST_ROWS = 500_000


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that broadcasts ``small`` only after counting it; a larger one is left to the planner.

    Null keys match each other, so no row is lost. ``small`` is staged, so counting and joining compute it once.
    """
    small = stage(small)
    renamed = small.withColumnsRenamed({name: f"_{name}_" for name in on})
    if small.count() <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    same = reduce(and_, [big[name].eqNullSafe(renamed[f"_{name}_"]) for name in on])
    return big.join(renamed, same, how).drop(*[f"_{name}_" for name in on])
