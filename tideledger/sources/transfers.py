"""Transfers between accounts that pay and receive in different currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideledger.functions.scalars import composite_key, field_amount, flag, label, moment_of, month_of
from tideledger.operators.canonical import canonical_rows, require_single_currency
from tideledger.sources.tabular import read_by_header

# The columns as files mostly order them. The header repeats "Account"; the second is the receiver's.
COLUMNS = [
    "Timestamp",
    "From Bank",
    "Account",
    "To Bank",
    "Account.1",
    "Amount Received",
    "Receiving Currency",
    "Amount Paid",
    "Payment Currency",
    "Payment Format",
    "Is Laundering",
]
REQUIRED = set(COLUMNS)
MAPPING = {
    "From Bank + Account": "sender client_id, debit in the payment currency",
    "To Bank + Account.1": "receiver client_id, credit in the receiving currency",
    "Payment Format": "transaction_label",
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, so bank codes keep their zeros. The header says which column is which."""
    return read_by_header(spark, path, COLUMNS)


def to_canonical(
    df: DataFrame, dataset: str, provider: str, combine_currencies: bool = False, fx: DataFrame | None = None, day_first: bool = False
) -> DataFrame:
    """Canonical rows: a debit row for the sender and a credit row for the receiver, from one scan."""
    paid, received = (field_amount(df, name).cast("double") for name in ("Amount Paid", "Amount Received"))
    sender = F.struct(
        composite_key(":", "From Bank", "Account").alias("client_id"),
        F.col("`Payment Currency`").cast("string").alias("currency"),
        paid.alias("debit"),
        F.lit(0.0).alias("credit"),
    )
    receiver = F.struct(
        composite_key(":", "To Bank", F.col("`Account.1`")).alias("client_id"),
        F.col("`Receiving Currency`").cast("string").alias("currency"),
        F.lit(0.0).alias("debit"),
        received.alias("credit"),
    )
    sides = df.select(
        month_of(moment_of(df, "Timestamp", day_first)).alias("month"),
        label(F.col("`Payment Format`")).alias("kind"),
        F.inline(F.array(sender, receiver)),
    ).where("month is not null")
    rows = canonical_rows(
        sides,
        dataset,
        provider,
        client_id=F.col("client_id"),
        month=F.col("month"),
        transaction_label=F.col("kind"),
        debit_sum=F.col("debit"),
        credit_sum=F.col("credit"),
        debit_nonzero_count=flag(F.col("debit") > 0),
        credit_nonzero_count=flag(F.col("credit") > 0),
        currency=F.col("currency"),
    )
    return require_single_currency(rows, combine_currencies, fx)
