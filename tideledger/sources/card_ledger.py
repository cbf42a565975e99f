"""Card ledger that knows debits only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideledger.functions.scalars import field_amount, field_number, flag, label, month_of, step_time
from tideledger.operators.canonical import canonical_rows

REQUIRED = {"step", "customer", "category", "amount", "fraud"}
MAPPING = {"step": "month = base date + step days", "customer": "client_id", "category": "transaction_label", "amount": "debit_sum"}


def to_canonical(df: DataFrame, dataset: str, provider: str, base_date: str = "2023-01-01") -> DataFrame:
    spent = field_amount(df, "amount").cast("double")
    return canonical_rows(
        df,
        dataset,
        provider,
        client_id=F.col("customer").cast("string"),
        month=month_of(step_time(field_number(df, "step"), base_date, "day")),
        transaction_label=label("category"),
        debit_sum=spent,
        debit_nonzero_count=flag(spent > 0),
        data_quality_flags=F.lit("debit_only"),
    )
