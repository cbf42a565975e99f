"""Sharding by weighted rendezvous hashing.

Every record scores each shard with a hash of (record key, shard) and goes to the shard with the highest score. Key,
shard list and weights alone decide, so any machine finds the same place, and a further shard only draws records to
itself: a record moves exactly if the new shard's score beats its old best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideledger.session import stage

#: Parts into which a shard is cut for numbering. A part is the unit that one task sorts; the table of part sizes has
#: at most shards x SLICES rows.
SLICES = 4096
_STEPS = 2.0**52


def _fraction(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts joined by colons; other engines can recompute it."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / _STEPS


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Score of one shard for a key. Its chance to be the highest is the shard's part of all weights."""
    if weight <= 0:
        raise ValueError("A shard's weight must be positive")
    return F.lit(-float(weight)) / F.log(_fraction(F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the highest score, of equal scores the smaller shard."""
    scores = [F.struct(shard_score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["i"]


def assign(
    df: DataFrame, key: str, text: str, weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0
) -> DataFrame:
    """Shard, gapless slot and the shard after one more is added, for every row.

    Returns ``<key>, size, text_crc32, law, shard, slot, grown_shard``; size is the text's UTF-8 bytes plus 1. Other
    columns of ``df`` are ignored. A null text has size 1 and CRC 0, as an empty one; a null key is placed as an empty
    key. Repeated rows share a shard and get different slots. Slots follow (slice, key, size, CRC), so they don't
    depend on how the input is split. An empty table gives an empty result.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(key), (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content).alias("text_crc32"))
    best = shard_of(F.col(key), weights)
    new, old = len(weights), [F.struct(shard_score(F.col(key), i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    moves = shard_score(F.col(key), new, grown_weight) > F.array_max(F.array(*old))["s"]
    slices = F.floor(
        _fraction(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"), F.lit("slice"))
        * SLICES
    )
    # Narrow from here on: the texts are read once.
    placed = stage(
        rows.withColumn("shard", best.cast("int"))
        .withColumn("grown_shard", F.when(moves, F.lit(new)).otherwise(F.col("shard")).cast("int"))
        .withColumn("_slice", slices.cast("int"))
    )
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("shard", "_slice").orderBy(key, "size", "text_crc32")
    numbered = placed.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "_slice"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_place")).cast("long").alias("slot"), "grown_shard",
    )
