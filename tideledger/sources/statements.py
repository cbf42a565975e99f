"""Nested bank statements from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tideledger.functions.scalars import category_of, category_text, flag, month_of, parse_moment, parse_number, truthy
from tideledger.operators.canonical import canonical_rows, monthly_balances, packed_order
from tideledger.sources.tabular import LINES, suffix

TEXT = T.StringType()
TRANSACTION = T.StructType(
    [T.StructField(name, TEXT) for name in ("date", "transaction_date", "description", "debit", "credit", "balance")]
    + [T.StructField("failed", TEXT)]  # true, 1 or "true", as the bank writes it
)
STATEMENT_FIELDS = [
    T.StructField(name, TEXT)
    for name in (
        "customer_id",
        "account_number",
        "accountNumber",
        "currency",
        "opening_balance",
        "closing_balance",
        "start_date",
        "end_date",
    )
] + [
    T.StructField("transactions", T.ArrayType(TRANSACTION)),
    T.StructField("transaction_details", T.ArrayType(TRANSACTION)),
]
STATEMENT = T.StructType(STATEMENT_FIELDS)
WRAPPERS = ("statements", "accounts", "data")
DOCUMENT = T.StructType(STATEMENT_FIELDS + [T.StructField(name, T.ArrayType(STATEMENT)) for name in WRAPPERS])
FAILED = "failed_excluded"
MAPPING = {
    "customer_id, account_number": "client_id",
    "transactions.date": "month",
    "transactions.debit, credit": "debit_sum, credit_sum",
    "transactions.description": "transaction_label by rule",
    "transactions.failed": "amounts left out, row kept and flagged",
    "balances": "monthly liquidity",
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of JSON lines or JSON documents; an array gives one row per element."""
    reader = spark.read.schema(DOCUMENT)
    return reader.json(path) if suffix(path) in LINES else reader.option("multiLine", True).json(path)


def statements(payloads: DataFrame) -> DataFrame:
    """One row per statement: a payload is a statement, or holds a list of them under one of the wrapper names."""
    own = F.array(F.struct(*[F.col(field.name) for field in STATEMENT_FIELDS]))
    wrapped = F.coalesce(*[F.col(name) for name in WRAPPERS if name in payloads.columns], own)
    return payloads.select(F.explode(wrapped).alias("statement")).where("statement is not null").select("statement.*")


def _text(name: str) -> Column:
    """Text of a field; empty text counts as missing."""
    return F.nullif(F.col(name), F.lit(""))


def _client() -> Column:
    return F.coalesce(
        _text("customer_id"), _text("account_number"), _text("accountNumber"), F.lit("UNKNOWN_ACCOUNT")
    ).alias("client_id")


def _chosen() -> Column:
    """The statement's transactions, under either of the two names."""
    empty = F.array().cast(T.ArrayType(TRANSACTION))
    return F.when(F.size(F.coalesce("transactions", empty)) > 0, F.col("transactions")).otherwise(
        F.coalesce("transaction_details", empty)
    )


def transactions(df: DataFrame, day_first: bool = False, unreadable: bool = False) -> DataFrame:
    """One row per transaction with a readable date (or ``unreadable``: without), in statement order (``place``)."""
    flat = df.select(_client(), "currency", F.posexplode(_chosen()).alias("place", "item")).where("item is not null")
    day = F.coalesce(F.nullif(F.col("item.date"), F.lit("")), F.col("item.transaction_date"))
    parts = flat.select(
        "client_id",
        "currency",
        "place",
        day.alias("day"),
        category_text("item.description").alias("text"),
        truthy("item.failed").alias("failed"),
        F.col("item.debit").alias("debit"),
        F.col("item.credit").alias("credit"),
        F.nullif(F.col("item.balance"), F.lit("")).alias("balance_text"),
    )

    def value(name: str) -> Column:
        # A failed transaction stays visible but moves no money.
        return F.when(F.col("failed"), F.lit(0.0)).otherwise(F.abs(parse_number(name))).alias(name)

    return parts.select(
        "client_id",
        "currency",
        "place",
        parse_moment("day", day_first).alias("moment"),
        category_of(F.col("text")).alias("kind"),
        "failed",
        value("debit"),
        value("credit"),
        "balance_text",
    ).where("moment is null" if unreadable else "moment is not null")


def days(df: DataFrame) -> DataFrame:
    """``day``: every date text of statements and their transactions, as it stands in the file."""
    own = F.transform(_chosen(), lambda item: F.coalesce(F.nullif(item["date"], F.lit("")), item["transaction_date"]))
    return df.select(F.explode(F.concat(own, F.array("start_date", "end_date"))).alias("day")).where("day is not null")


def to_canonical(df: DataFrame, dataset: str, provider: str, day_first: bool = False) -> DataFrame:
    """Canonical rows of statements (see ``statements``)."""
    return canonical_rows(
        transactions(df, day_first),
        dataset,
        provider,
        client_id=F.col("client_id"),
        month=month_of(F.col("moment")),
        transaction_label=F.col("kind"),
        debit_sum=F.col("debit"),
        credit_sum=F.col("credit"),
        debit_nonzero_count=flag(F.col("debit") != 0),
        credit_nonzero_count=flag(F.col("credit") != 0),
        currency=F.col("currency"),
        data_quality_flags=F.when(F.col("failed"), FAILED),
    )


def failed_operations(df: DataFrame, day_first: bool = False) -> DataFrame:
    """Failed transactions per client and month."""
    return (
        transactions(df, day_first)
        .groupBy("client_id", month_of(F.col("moment")).alias("month"))
        .agg(F.sum(flag(F.col("failed"))).alias("failed_operations"))
        .where("failed_operations > 0")
    )


def to_liquidity(df: DataFrame, threshold: float = 0.0, day_first: bool = False) -> DataFrame:
    """Monthly balances: after each transaction, and the opening and closing balances of each statement.

    On the same day transactions come first, then openings, then closings.
    """

    def end(kind: int, day: str, text: str) -> Column:
        return F.struct(F.col(day).alias("day"), F.lit(kind).alias("kind"), F.lit(0).alias("place"), F.col(text).alias("text"))

    def move(item: Column, place: Column) -> Column:
        day = F.coalesce(F.nullif(item["date"], F.lit("")), item["transaction_date"])
        return F.struct(day.alias("day"), F.lit(0).alias("kind"), place.alias("place"), F.nullif(item["balance"], F.lit("")).alias("text"))

    # Transactions and both ends of a statement from one scan.
    ends = F.array(end(1, "start_date", "opening_balance"), end(2, "end_date", "closing_balance"))
    flat = df.select(_client(), F.inline(F.concat(F.transform(_chosen(), move), ends))).where("day is not null and text is not null")
    seen = flat.select(
        "client_id", parse_moment("day", day_first).alias("moment"), "kind", "place", parse_number("text").alias("balance")
    ).where("moment is not null")
    ordered = seen.select(
        "client_id",
        month_of(F.col("moment")).alias("month"),
        "balance",
        packed_order(F.col("moment"), F.col("kind"), F.col("place")).alias("order"),
    )
    return monthly_balances(ordered, ["order"], threshold=threshold)
