"""Daily-ledger liquidity: running balances, shortfalls, deferred payments, targets.

Recursions such as ``balance = max(previous + credit - debit, -overdraft)`` have a closed form over running sums and
running maxima, so each is a window expression over (client, day). Transactions are summed per day first; a client
then has at most one row per day, however many transactions it made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideledger.functions.scalars import flag, month_of
from tideledger.functions.windows import per, up_to_now
from tideledger.schemas import LABELS, LIQUIDITY_COLUMNS

def client_days():
    return per("client_id", order="date")


def client_months():
    return per("client_id", order="month")


def daily_flows(rows: DataFrame) -> DataFrame:
    """Sum transactions (client_id, date, credit, debit) per client and day; decimals stay exact."""
    return rows.groupBy("client_id", "date").agg(
        F.sum("credit").alias("credit"),
        F.sum("debit").alias("debit"),
        F.sum(flag(F.col("credit") > 0)).alias("credit_nonzero_count"),
        F.sum(flag(F.col("debit") > 0)).alias("debit_nonzero_count"),
    )


def running_balance(daily: DataFrame) -> DataFrame:
    """Overdraft-floored balance and the amount missing each day.

    Needs ``client_id, date, credit, debit, opening, overdraft`` with ``opening >= -overdraft``, both constant per
    client. Adds ``opening_balance, closing_balance, cash_gap_amount, cash_gap``.
    """
    unfloored = daily.withColumn(
        "_free", F.col("opening") + F.sum(F.col("credit") - F.col("debit")).over(up_to_now(client_days()))
    )
    # Everything the floor has ever absorbed: the deepest point of the free balance below the overdraft limit.
    absorbed = unfloored.withColumn(
        "_absorbed",
        F.greatest(F.max(-F.col("overdraft") - F.col("_free")).over(up_to_now(client_days())), F.lit(0).cast("decimal(1,0)")),
    )
    balance = F.col("_free") + F.col("_absorbed")
    previous = F.lag("_absorbed").over(client_days())
    gap = F.col("_absorbed") - F.coalesce(previous, F.lit(0).cast("decimal(1,0)"))
    with_gap = absorbed.withColumn("closing_balance", balance).withColumn("cash_gap_amount", gap)
    opening = F.coalesce(F.lag("closing_balance").over(client_days()), F.col("opening"))
    return with_gap.select(
        *daily.columns,
        opening.alias("opening_balance"),
        "closing_balance",
        "cash_gap_amount",
        (F.col("cash_gap_amount") > 0).cast("int").alias("cash_gap"),
    )


def deferral_schedule(daily: DataFrame) -> DataFrame:
    """Payments a solvent client can make each day; what is not covered is carried to the next day.

    Same input as ``running_balance``. Adds ``balance, carried, paid``.
    """
    zero = F.lit(0).cast("decimal(1,0)")
    planned = daily.withColumn(
        "_plan", F.col("opening") + F.sum(F.col("credit") - F.col("debit")).over(up_to_now(client_days()))
    )
    settled = planned.withColumn("balance", F.greatest(F.col("_plan"), -F.col("overdraft")))
    before = F.coalesce(F.lag("balance").over(client_days()), F.col("opening"))
    return settled.select(
        *daily.columns,
        "balance",
        F.greatest(-F.col("overdraft") - F.col("_plan"), zero).alias("carried"),
        (before + F.col("credit") - F.col("balance")).alias("paid"),
    )


def available_liquidity(opening: Column, credit: Column, overdraft: Column) -> Column:
    """What can be paid today: balance, receipts and overdraft, never below zero."""
    total = opening + credit + overdraft
    return F.when(total > 0, total).otherwise(F.lit(0))


def monthly_gaps(balances: DataFrame) -> DataFrame:
    """Per client and month: was there a shortfall, and how large was the sum of shortfalls."""
    return balances.groupBy("client_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.max("cash_gap").alias("cash_gap_current_month"), F.sum("cash_gap_amount").alias("cash_gap_amount")
    )


def gap_target(gaps: DataFrame) -> DataFrame:
    """Adds the next observed month's flag as the target; a client's last month has none."""
    following = F.lead("cash_gap_current_month").over(client_months())
    return gaps.withColumn("cash_gap_next_month", following)


def target_summary(target: DataFrame) -> DataFrame:
    return target.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("cash_gap_next_month").alias("model_observations"),
        F.avg("cash_gap_next_month").alias("target_rate"),
    )


def monthly_liquidity(balances: DataFrame) -> DataFrame:
    """Daily balances to monthly liquidity.

    The breach flag asks whether the lowest closing balance lies below the overdraft limit. Balances that are floored
    at that limit never do; the flag matters for ledgers whose balances were observed, not floored.
    """
    lowest = F.min("closing_balance")
    return (
        balances.groupBy("client_id", month_of(F.col("date")).alias("month"))
        .agg(
            F.min_by("opening_balance", "date").cast("double").alias("opening_balance"),
            F.max_by("closing_balance", "date").cast("double").alias("closing_balance"),
            lowest.cast("double").alias("minimum_observed_balance"),
            F.max("closing_balance").cast("double").alias("maximum_observed_balance"),
            F.count(F.lit(1)).alias("balance_observations_count"),
            (lowest + F.max("overdraft") < 0).cast("int").alias("balance_breach_proxy"),
        )
        .select(*LIQUIDITY_COLUMNS)
    )


def category_rollup(daily: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Daily rows with a credit and a debit category to one row per client, month and label.

    Every label appears for every client-month, with zeros where nothing happened. A label outside the list stops
    the job. The zero fill comes from exploding the aggregated row, not from joining a list of labels.
    """

    def known(name: str) -> Column:
        stop = F.raise_error(F.concat(F.lit("Label outside the list: "), F.col(name))).cast("string")
        return F.when(F.col(name).isin(labels), F.col(name)).otherwise(stop)

    def side(place: int, direction: str) -> list[Column]:
        chosen = F.col(f"_{direction}") == labels[place]
        return [
            F.sum(F.when(chosen, F.col(f"{direction}_sum")).otherwise(0)).alias(f"_{direction}_sum_{place}"),
            F.sum(F.when(chosen, F.col(f"{direction}_nonzero_count")).otherwise(0)).alias(f"_{direction}_count_{place}"),
        ]

    sums = [c for place in range(len(labels)) for direction in ("debit", "credit") for c in side(place, direction)]
    wide = (
        daily.withColumns({"_debit": known("debit_category"), "_credit": known("credit_category")})
        .groupBy("client_id", month_of(F.col("date")).alias("month"))
        .agg(*sums)
    )
    lines = [
        F.struct(
            F.lit(name).alias("transaction_label"),
            F.col(f"_debit_sum_{place}").alias("debit_sum"),
            F.col(f"_credit_sum_{place}").alias("credit_sum"),
            F.col(f"_debit_count_{place}").alias("debit_nonzero_count"),
            F.col(f"_credit_count_{place}").alias("credit_nonzero_count"),
        )
        for place, name in enumerate(labels)
    ]
    return wide.select("client_id", "month", F.inline(F.array(*lines)))
