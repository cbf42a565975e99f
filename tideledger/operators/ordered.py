"""Exact ranks and running sums over groups too large for one task.

A window without a small partition key sends its whole group to one task. Here the rows are range-partitioned by
(group, order) instead, so a hot group or a hot value spreads over many tasks; each row's place inside its partition
plus the sizes of the earlier partitions gives its exact rank. The order must be total: add a key as tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideledger.session import lookup_join, stage


def _placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    keys = [F.col(name).asc() for name in group] + list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Staged because partition number and place must be the same in every later use.
    return stage(
        spread.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    )


def _before(group: list[str]):
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "row_number") -> DataFrame:
    """Adds the 1-based row number of each row in its group."""
    placed = _placed(df, group, order)
    runs = placed.groupBy("_part", *group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per (partition, group): few, however many rows there are.
    shifts = runs.select(
        "_part", *group, (F.coalesce(F.sum("_rows").over(_before(group)), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    joined = lookup_join(placed, shifts, ["_part", *group])
    return joined.withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums ``{new column: source column}`` in the given order."""
    placed = _placed(df, group, order)
    within = Window.partitionBy("_part", *group).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_part", *group).agg(*[F.sum(source).alias(f"_{new}") for new, source in sums.items()])
    earlier = totals.select(
        "_part", *group, *[F.coalesce(F.sum(f"_{new}").over(_before(group)), F.lit(0)).alias(f"_{new}") for new in sums]
    )
    local = placed.select("*", *[F.sum(source).over(within).alias(new) for new, source in sums.items()])
    joined = lookup_join(local, earlier, ["_part", *group])
    kept = [name for name in df.columns]
    return joined.select(*kept, *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums])


def with_percentile(df: DataFrame, group: list[str], value: str, tie: list[str]) -> DataFrame:
    """Adds ``row_number`` (value descending, then ``tie``) and ``percentile``: the share of the group at or below."""
    # Read three times, but written once: ranks are a join of the placed rows with one row per partition and group.
    rows = ranked(df, group, [F.col(value).desc(), *[F.col(name).asc() for name in tie]])
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    # Only values that occur more than once need the first rank of their tie.
    ties = (
        rows.groupBy(*group, value)
        .agg(F.min("row_number").alias("_tie"), F.count(F.lit(1)).alias("_count"))
        .filter("_count > 1")
        .drop("_count")
    )
    joined = lookup_join(lookup_join(rows, sizes, group), ties, [*group, value], "left")
    above = F.coalesce(F.col("_tie"), F.col("row_number")) - 1
    return joined.withColumn("percentile", (F.col("_size") - above) / F.col("_size")).drop("_size", "_tie")


def kth_greatest(df: DataFrame, value: str, k: int, bins: int = 4096) -> tuple[float, int, int] | None:
    """(the k-th greatest value, rows above it, rows with it) by counting, without a sort; None beyond the last value.

    Every pass counts the values between two bounds in bins of equal width and goes on with the bin that holds the
    k-th one, within the least and greatest value that really stand there, until these are the same. Nulls and NaN
    are no values.
    """
    number = F.col(value).cast("double")
    rows = df.select(number.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    low, high, count = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not 1 <= k <= count:
        return None
    above = 0
    while low != high:
        width = (high / bins - low / bins) or 5e-324
        place = F.least(F.greatest(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))
        found = rows.where(F.col("v").between(low, high)).groupBy(place.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):  # a row a bin
            if above + r["n"] >= k:
                low, high, count = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    return low, above, count


def greatest(df: DataFrame, value: str, k: int, tie: list[str]) -> DataFrame:
    """The k rows with the greatest values; of those with the last value the first ones in the order of ``tie``.

    Only rows with the last value are put in order. Rows without a value come last. ``df`` is read a few times: it
    should be stored and narrow.
    """
    bound = kth_greatest(df, value, k)
    number = F.col(value).cast("double")
    missing = number.isNull() | F.isnan(number)
    if bound is None:
        valued = df.where(~missing)
        rest = max(0, k - valued.count())
        return valued.unionByName(_first_rows(df.where(missing), rest, tie))
    last, above, count = bound
    ties = df.where(~missing & (number == F.lit(last)))
    return df.where(~missing & (number > F.lit(last))).unionByName(ties if above + count == k else _first_rows(ties, k - above, tie))


def _first_rows(df: DataFrame, n: int, tie: list[str]) -> DataFrame:
    placed = ranked(df, [], [F.col(name).asc() for name in tie], "_row")
    return placed.where(F.col("_row") <= n).drop("_row")
