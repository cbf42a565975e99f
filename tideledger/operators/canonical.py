"""The canonical monthly table: aggregation, validation, monthly balances."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideledger.functions.flags import flag_mask, mask_flags, union_flags
from tideledger.functions.scalars import label
from tideledger.schemas import CANONICAL_COLUMNS, CANONICAL_KEYS, LIQUIDITY_COLUMNS, MEASURES

MONTH_PATTERN = "^[0-9]{4}-[0-9]{2}$"


def canonical_rows(df: DataFrame, dataset: str, provider: str, **columns: Column) -> DataFrame:
    """Project transactions to the 11 canonical columns; missing ones get their neutral value."""
    neutral = {
        "debit_sum": F.lit(0.0),
        "credit_sum": F.lit(0.0),
        "debit_nonzero_count": F.lit(0).cast("long"),
        "credit_nonzero_count": F.lit(0).cast("long"),
        "source_dataset": F.lit(dataset),
        "source_provider": F.lit(provider),
        "currency": F.lit(None).cast("string"),
        "data_quality_flags": F.lit(None).cast("string"),
    }
    values = {**neutral, **columns}
    return df.select(*[values[name].alias(name) for name in CANONICAL_COLUMNS])


def _total(name: str, scale: int | None) -> Column:
    if name.endswith("_count"):
        return F.sum(F.col(name).cast("long")).cast("long").alias(name)
    value = F.col(name) if scale is None else F.col(name).cast(f"decimal(18,{scale})")
    return F.sum(value).cast("double").alias(name)


def canonical_monthly(df: DataFrame, flags: tuple[str, ...] | None = None, scale: int | None = None) -> DataFrame:
    """One row per client, month, label, dataset, provider and currency (null is a currency of its own).

    ``flags`` names the possible quality flags; they are then united as bit masks, which keeps the aggregation a pure
    hash aggregate with map-side partial sums. Without it any flag text is accepted and united as sets.
    ``scale`` sums the amounts as exact decimals of that many digits, so the result does not depend on row order.
    """
    rows = df.withColumn("transaction_label", label("transaction_label"))
    totals = [_total(name, scale) for name in MEASURES]
    if flags is None:
        grouped = rows.groupBy(*CANONICAL_KEYS).agg(
            *totals, union_flags(F.col("data_quality_flags")).alias("data_quality_flags")
        )
        return grouped.select(*CANONICAL_COLUMNS)
    masked = rows.withColumn("_mask", flag_mask(F.col("data_quality_flags"), flags))
    grouped = masked.groupBy(*CANONICAL_KEYS).agg(*totals, F.bit_or("_mask").alias("_mask"))
    return grouped.withColumn("data_quality_flags", mask_flags(F.col("_mask"), flags)).select(*CANONICAL_COLUMNS)


def combine(parts: list[DataFrame], flags: tuple[str, ...] | None = None, scale: int | None = None) -> DataFrame:
    """Canonical table of several parts; the aggregation is associative, so the parts may be partial already."""
    return canonical_monthly(combine_rows(parts), flags, scale)


def combine_rows(parts: list[DataFrame]) -> DataFrame:
    """Union of same-schema parts by column name."""
    return reduce(DataFrame.unionByName, parts)


def _checks() -> dict[str, Column]:
    def bad_amount(name: str) -> Column:
        value = F.col(name).try_cast("double")
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    def negative(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double") < 0, F.lit(False))

    return {
        "null_client": F.col("client_id").isNull(),
        "bad_month": F.coalesce(~F.col("month").rlike(MONTH_PATTERN), F.lit(True)),
        "non_finite": bad_amount(MEASURES[0]) | bad_amount(MEASURES[1]) | bad_amount(MEASURES[2]) | bad_amount(MEASURES[3]),
        "negative_amount": negative("debit_sum") | negative("credit_sum"),
        "negative_count": negative("debit_nonzero_count") | negative("credit_nonzero_count"),
    }


def _require_columns(df: DataFrame, wanted: list[str]) -> None:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def violations(df: DataFrame) -> DataFrame:
    """One row: how many rows break each canonical rule, and how many rows there are."""
    _require_columns(df, CANONICAL_COLUMNS)
    counts = [F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias(name) for name, bad in _checks().items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def validated(df: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical columns and types. A row that breaks a rule stops the job (``strict``) or is marked in ``problems``."""
    _require_columns(df, CANONICAL_COLUMNS)
    problems = F.concat_ws("|", *[F.when(bad, name) for name, bad in _checks().items()])
    casts = {
        "transaction_label": label("transaction_label"),
        **{name: F.col(name).try_cast("long" if name.endswith("_count") else "double") for name in MEASURES},
    }
    columns = [casts.get(name, F.col(name).cast("string")).alias(name) for name in CANONICAL_COLUMNS]
    if not strict:
        return df.select(*columns, problems.alias("problems"))
    # The guard sits in a column the caller reads, so it cannot be pruned away.
    guarded = F.when(problems == "", F.col("client_id").cast("string")).otherwise(
        F.raise_error(F.concat(F.lit("Canonical row breaks: "), problems)).cast("string")
    )
    return df.filter(guarded.isNotNull()).select(*columns)


def liquidity_violations(df: DataFrame) -> DataFrame:
    """One row: liquidity rows with a negative observation count or a breach flag other than 0 and 1."""
    _require_columns(df, LIQUIDITY_COLUMNS)
    checks = {
        "negative_count": F.col("balance_observations_count") < 0,
        "bad_proxy": ~F.col("balance_breach_proxy").isin(0, 1),
    }
    counts = [F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias(name) for name, bad in checks.items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def currency_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("currency").alias("currencies"))


def require_single_currency(df: DataFrame, combine_currencies: bool, fx: DataFrame | None = None) -> DataFrame:
    """Refuse to merge several currencies without a rate table; the frame itself is returned unchanged."""
    if combine_currencies and fx is None:
        # Two different values are enough to decide, so at most two rows travel.
        seen = df.select("currency").where("currency is not null").distinct().limit(2).count()
        if seen > 1:
            raise ValueError("Several currencies cannot be combined without a table of exchange rates")
    return df


def packed_order(moment: Column, kind: Column | None = None, place: Column | None = None) -> Column:
    """One fixed-width number that orders observations by moment, kind (0-9) and place (any non-negative int), exactly."""
    zero = F.lit(0).cast("decimal(11,0)")
    kinds = F.coalesce(kind.cast("decimal(1,0)"), zero) if kind is not None else zero
    places = place.cast("decimal(10,0)") if place is not None else zero
    micros = F.unix_micros(moment.cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit(Decimal(10**11)) + (kinds * F.lit(Decimal(10**10)) + places)).cast("decimal(30,0)")


def observed_ends(observations: DataFrame, keys: list[str], order: str, first: str = "balance", last: str = "balance") -> DataFrame:
    """Per group of ``keys`` the first and last balance and what lies between, exactly, by two hash aggregates.

    ``opening, closing, first_order, last_order, low, high, n``. Observations of one place in the order are put
    together first: of equal places the smallest ``first`` opens and the greatest ``last`` closes.
    """
    low = F.least(F.min(first), F.min(last)) if first != last else F.min(first)
    high = F.greatest(F.max(first), F.max(last)) if first != last else F.max(first)
    places = observations.groupBy(*keys, order).agg(
        F.min(first).alias("_first"), F.max(last).alias("_last"), low.alias("low"), high.alias("high"), F.count(last).alias("n")
    )
    return places.groupBy(*keys).agg(*_ends(order))


def _ends(order: str) -> list[Column]:
    return [
        F.min_by("_first", order).alias("opening"),
        F.max_by("_last", order).alias("closing"),
        F.min(order).alias("first_order"),
        F.max(order).alias("last_order"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n").alias("n"),
    ]


def merged_ends(ends: DataFrame, keys: list[str]) -> DataFrame:
    """``observed_ends`` of coarser groups from those of finer ones (of a client from those of its accounts)."""
    # Either end of a group is one observation; the rest counts with the first.
    own, none = ends.schema["opening"].dataType, F.lit(None)
    opening = F.struct(F.col("first_order").alias("_order"), F.col("opening").alias("_first"), none.cast(own).alias("_last"), "low", "high", "n")
    closing = F.struct(F.col("last_order").alias("_order"), none.cast(own).alias("_first"), F.col("closing").alias("_last"), "low", "high", F.lit(0).cast("long").alias("n"))
    rows = ends.select(*keys, F.inline(F.array(opening, closing)))
    places = rows.groupBy(*keys, "_order").agg(*[f(c).alias(c) for f, c in ((F.min, "_first"), (F.max, "_last"), (F.min, "low"), (F.max, "high"), (F.sum, "n"))])
    return places.groupBy(*keys).agg(*_ends("_order"))


def balances_of(ends: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Monthly liquidity from the ends of every client-month."""
    named = {"opening": "opening_balance", "closing": "closing_balance", "low": "minimum_observed_balance", "high": "maximum_observed_balance"}
    rows = ends.select("client_id", "month", *[F.col(c).cast("double").alias(name) for c, name in named.items()], F.col("n").alias("balance_observations_count"))
    breach = F.when(F.col("minimum_observed_balance") < threshold, 1).otherwise(0).alias("balance_breach_proxy")
    return rows.select("*", breach)


def monthly_balances(
    observations: DataFrame, order: list[str], first: str = "balance", last: str = "balance", threshold: float = 0.0
) -> DataFrame:
    """Monthly liquidity from balance observations.

    ``first`` is the balance before and ``last`` the balance after an observation (the same column for plain
    readings). One ``order`` column of fixed width makes this two hash aggregates; several are compared as a struct.
    """
    if len(order) == 1:
        return balances_of(observed_ends(observations, ["client_id", "month"], order[0], first, last), threshold)
    key = F.struct(*order)
    grouped = observations.groupBy("client_id", "month").agg(
        F.min_by(first, key).alias("opening"),
        F.max_by(last, key).alias("closing"),
        F.least(F.min(first), F.min(last)).alias("low"),
        F.greatest(F.max(first), F.max(last)).alias("high"),
        F.count(last).alias("n"),
    )
    return balances_of(grouped, threshold)


def merge_balances(parts: DataFrame, order: str) -> DataFrame:
    """Combine partial liquidity rows of the same client-month, in the order of ``order``."""
    return (
        parts.groupBy("client_id", "month")
        .agg(
            F.min_by("opening_balance", order).alias("opening_balance"),
            F.max_by("closing_balance", order).alias("closing_balance"),
            F.min("minimum_observed_balance").alias("minimum_observed_balance"),
            F.max("maximum_observed_balance").alias("maximum_observed_balance"),
            F.sum("balance_observations_count").alias("balance_observations_count"),
            F.max("balance_breach_proxy").alias("balance_breach_proxy"),
        )
        .select(*LIQUIDITY_COLUMNS)
    )


def quality_flags(df: DataFrame) -> DataFrame:
    """Distinct quality flags of a table, sorted."""
    distinct = df.select("data_quality_flags").distinct()
    names = distinct.select(F.explode(F.split("data_quality_flags", "[|]")).alias("flag")).where("flag <> ''")
    return names.distinct().orderBy("flag")
