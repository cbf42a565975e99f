"""Two-sided ledger with old and new balances on both sides of every transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideledger.functions.scalars import field_amount, field_number, flag, is_client, label, month_of, step_time
from tideledger.operators.canonical import canonical_rows, monthly_balances

REQUIRED = {
    "step",
    "type",
    "amount",
    "nameOrig",
    "oldbalanceOrg",
    "newbalanceOrig",
    "nameDest",
    "oldbalanceDest",
    "newbalanceDest",
}
MAPPING = {
    "step": "month = base date + step hours",
    "nameOrig, nameDest": "client_id: C clients, M merchants on request",
    "old and new balances": "debit or credit by the sign of the change",
    "type": "transaction_label",
}
# Transaction types that move money out of, or into, the origin.
OUT_TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT"]
IN_TYPES = ["CASH_IN", "CREDIT"]
FALLBACK = "balance_delta_fallback"


def _sides(df: DataFrame, include_merchants: bool) -> DataFrame:
    """Both sides of each transaction as rows, from one scan."""

    def side(number: int, client: str, old: str, new: str) -> Column:
        return F.struct(
            F.lit(number).alias("side"),
            F.col(client).cast("string").alias("client_id"),
            field_number(df, old).cast("double").alias("old"),
            field_number(df, new).cast("double").alias("new"),
        )

    both = F.array(
        side(0, "nameOrig", "oldbalanceOrg", "newbalanceOrig"), side(1, "nameDest", "oldbalanceDest", "newbalanceDest")
    )
    return df.select("*", F.inline(both)).where(is_client(F.col("client_id"), include_merchants))


def to_canonical(
    df: DataFrame, dataset: str, provider: str, base_date: str = "2023-01-01", include_merchants: bool = False
) -> DataFrame:
    """Canonical rows, one per transaction and admitted side.

    The balance change decides direction and amount. Where a balance is missing, or nothing changed although an
    amount was paid, the transaction type decides and the row is flagged.
    """
    rows = _sides(df, include_merchants).select(
        "client_id",
        "side",
        month_of(step_time(field_number(df, "step"), base_date, "hour")).alias("month"),
        label("type", upper=True).alias("kind"),
        field_amount(df, "amount").cast("double").alias("paid"),
        (F.col("new") - F.col("old")).alias("change"),
    )
    usable = F.col("change").isNotNull() & (F.abs("change") != float("inf"))
    by_type = ~usable | ((F.col("change") == 0) & (F.col("paid") > 0))
    origin = F.col("side") == 0
    outgoing, incoming = F.col("kind").isin(OUT_TYPES), F.col("kind").isin(IN_TYPES)
    pays = (origin & outgoing) | (~origin & incoming)
    receives = (origin & incoming) | (~origin & outgoing)

    def flow(sign: int, typed: Column) -> Column:
        change = F.col("change") * sign
        return (
            F.when(by_type & typed, F.col("paid")).when(usable & (change > 0), change).otherwise(F.lit(0.0))
        )

    valued = rows.select("*", by_type.alias("by_type"), flow(-1, pays).alias("debit"), flow(1, receives).alias("credit"))
    return canonical_rows(
        valued,
        dataset,
        provider,
        client_id=F.col("client_id"),
        month=F.col("month"),
        transaction_label=F.col("kind"),
        debit_sum=F.col("debit"),
        credit_sum=F.col("credit"),
        debit_nonzero_count=flag(F.col("debit") > 0),
        credit_nonzero_count=flag(F.col("credit") > 0),
        data_quality_flags=F.when(F.col("by_type"), FALLBACK),
    )


def to_liquidity(
    df: DataFrame,
    base_date: str = "2023-01-01",
    include_merchants: bool = False,
    threshold: float = 0.0,
    sequence: list[str] = (),
) -> DataFrame:
    """Monthly balances from rows with both balances known.

    First and last follow the step, then the ``sequence`` columns, origin before destination, and last the balances
    themselves, so the result never depends on how files are split.
    """
    rows = (
        _sides(df, include_merchants)
        .where("old is not null and new is not null")
        .select(
            "client_id",
            month_of(step_time(field_number(df, "step"), base_date, "hour")).alias("month"),
            field_number(df, "step").cast("double").alias("step"),
            *sequence,
            "side",
            "old",
            "new",
        )
    )
    return monthly_balances(rows, ["step", *sequence, "side", "old", "new"], "old", "new", threshold)
