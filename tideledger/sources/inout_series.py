"""One aggregate series of inflows and outflows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tideledger.functions.scalars import field_number, flag, inflow, moment_of, month_of, outflow
from tideledger.operators.canonical import canonical_rows
from tideledger.sources.tabular import SourceError, column_containing

FLAGS = ("aggregate_series", "not_client_level")
SERIES_ID = "AGGREGATE"


def discover(columns: list[str]) -> dict[str, str | None]:
    """Which columns hold date, inflow, outflow and net flow."""
    return {
        "date": column_containing(columns, ("date",), ("month",)),
        "inflow": column_containing(columns, ("inflow",), ("receipt",)),
        "outflow": column_containing(columns, ("outflow",), ("payment",)),
        "net_flow": column_containing(columns, ("net", "flow")),
    }


def is_series(columns: list[str]) -> bool:
    found = discover(columns)
    return bool(found["date"] and (found["inflow"] or found["outflow"] or found["net_flow"]))


def days(df: DataFrame) -> DataFrame:
    """``day``: the dates of a table, as text."""
    return df.select(F.col(discover(df.columns)["date"]).cast("string").alias("day"))


def to_series(df: DataFrame, series_id: str = SERIES_ID, scale: int | None = None, day_first: bool = False) -> DataFrame:
    """series_id, date, inflow, outflow, net_flow with one row per date.

    A net column is split by sign only where neither side is given. ``scale`` sums exact decimals.
    """
    found = discover(df.columns)
    if not is_series(df.columns):
        raise SourceError("A date column and an inflow, outflow or net-flow column are needed")

    def value(name: str):
        return F.coalesce(field_number(df, found[name]).cast("double"), F.lit(0.0)) if found[name] else F.lit(0.0)

    received, spent = value("inflow"), F.abs(value("outflow"))
    if found["net_flow"] and not (found["inflow"] or found["outflow"]):
        received, spent = inflow(value("net_flow")), outflow(value("net_flow"))
    if scale is not None:
        received, spent = (side.cast(f"decimal(18,{scale})") for side in (received, spent))
    rows = df.select(
        F.lit(series_id).alias("series_id"),
        moment_of(df, found["date"], day_first).alias("date"),
        received.alias("inflow"),
        spent.alias("outflow"),
    ).where("date is not null")
    daily = rows.groupBy("series_id", "date").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    net = F.col("inflow") - F.col("outflow")
    return daily.select(
        "series_id",
        "date",
        F.col("inflow").cast("double").alias("inflow"),
        F.col("outflow").cast("double").alias("outflow"),
        net.cast("double").alias("net_flow"),
    )


def total(parts: list[DataFrame]) -> DataFrame:
    """One series from several (see ``to_series``), such as the files it is spread over: dates they share are summed."""
    if len(parts) == 1:
        return parts[0]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("series_id", "date").agg(*[F.sum(name).alias(name) for name in ("inflow", "outflow", "net_flow")])


def to_canonical(series: DataFrame, dataset: str, provider: str) -> DataFrame:
    """An INFLOW and an OUTFLOW row per date of a series (see ``to_series``)."""
    zero = F.lit(0.0)
    lines = F.array(
        F.struct(F.lit("INFLOW").alias("kind"), zero.alias("debit"), F.col("inflow").alias("credit")),
        F.struct(F.lit("OUTFLOW").alias("kind"), F.col("outflow").alias("debit"), zero.alias("credit")),
    )
    sides = series.select("series_id", "date", F.inline(lines))
    return canonical_rows(
        sides,
        dataset,
        provider,
        client_id=F.col("series_id"),
        month=month_of(F.col("date")),
        transaction_label=F.col("kind"),
        debit_sum=F.col("debit"),
        credit_sum=F.col("credit"),
        debit_nonzero_count=flag(F.col("debit") != 0),
        credit_nonzero_count=flag(F.col("credit") != 0),
        data_quality_flags=F.lit("|".join(FLAGS)),
    )
