"""Table schemas and the fixed names the operators share."""

from __future__ import annotations

import re

from pyspark.sql import types as T

STRING, DOUBLE, LONG = T.StringType(), T.DoubleType(), T.LongType()

CANONICAL = T.StructType(
    [
        T.StructField("client_id", STRING, False),
        T.StructField("month", STRING, False),
        T.StructField("transaction_label", STRING, False),
        T.StructField("debit_sum", DOUBLE, False),
        T.StructField("credit_sum", DOUBLE, False),
        T.StructField("debit_nonzero_count", LONG, False),
        T.StructField("credit_nonzero_count", LONG, False),
        T.StructField("source_dataset", STRING, False),
        T.StructField("source_provider", STRING, False),
        T.StructField("currency", STRING, True),
        T.StructField("data_quality_flags", STRING, True),
    ]
)

LIQUIDITY = T.StructType(
    [
        T.StructField("client_id", STRING, False),
        T.StructField("month", STRING, False),
        T.StructField("opening_balance", DOUBLE),
        T.StructField("closing_balance", DOUBLE),
        T.StructField("minimum_observed_balance", DOUBLE),
        T.StructField("maximum_observed_balance", DOUBLE),
        T.StructField("balance_observations_count", LONG),
        T.StructField("balance_breach_proxy", T.IntegerType()),
    ]
)

DAILY = T.StructType(
    [
        T.StructField("client_id", STRING, False),
        T.StructField("date", T.DateType(), False),
        T.StructField("client_type", STRING),
        T.StructField("credit_sum", DOUBLE),
        T.StructField("debit_sum", DOUBLE),
        T.StructField("credit_nonzero_count", LONG),
        T.StructField("debit_nonzero_count", LONG),
        T.StructField("credit_category", STRING),
        T.StructField("debit_category", STRING),
        T.StructField("opening_balance", DOUBLE),
        T.StructField("closing_balance", DOUBLE),
        T.StructField("available_overdraft", DOUBLE),
        T.StructField("cash_gap_amount", DOUBLE),
        T.StructField("cash_gap", T.IntegerType()),
    ]
)

CATEGORY_TEXT = T.StructType(
    [
        T.StructField("transaction_description", STRING),
        T.StructField("category", STRING),
        T.StructField("country", STRING),
        T.StructField("currency", STRING),
    ]
)

CANONICAL_COLUMNS = CANONICAL.fieldNames()
LIQUIDITY_COLUMNS = LIQUIDITY.fieldNames()
MEASURES = ["debit_sum", "credit_sum", "debit_nonzero_count", "credit_nonzero_count"]
CANONICAL_KEYS = ["client_id", "month", "transaction_label", "source_dataset", "source_provider", "currency"]

# The standard transaction labels, in their standard order.
LABELS = [
    "CUSTOMER_PAYMENTS",
    "ACQUIRING",
    "SALARY",
    "TAX",
    "SUPPLIERS",
    "RENT",
    "LOAN_PAYMENT",
    "LOAN_INFLOW",
    "INTERNAL_TRANSFER",
    "OTHER",
]

# Column names (lower case, letters and digits only) that must never become a cash-gap target.
FORBIDDEN_TARGETS = {
    "isfraud",
    "fraud",
    "isflaggedfraud",
    "islaundering",
    "amllabel",
    "amllabels",
    "transactionanomaly",
    "transactionanomalylabel",
    "balancebreachproxy",
}
FORBIDDEN_PARTS = ("fraud", "launder", "aml")

# Accepted spellings of a model target and the column each one names.
TARGET_ALIASES = {
    "credit": "total_credit_sum",
    "debit": "total_debit_sum",
    "net": "net_flow",
    "net_flow": "net_flow",
    "total_credit_sum": "total_credit_sum",
    "total_debit_sum": "total_debit_sum",
    "cash_gap_next_month": "cash_gap_next_month",
}
FLOW_TARGETS = ("total_credit_sum", "total_debit_sum", "net_flow")


def normalize_name(name: str) -> str:
    """Lower case, ASCII letters and digits only."""
    return re.sub("[^a-z0-9]+", "", name.lower())


def is_forbidden_target(name: str) -> bool:
    plain = normalize_name(name)
    return plain in FORBIDDEN_TARGETS or any(part in plain for part in FORBIDDEN_PARTS)


def check_target_name(name: str) -> None:
    """Refuse fraud, laundering and anomaly labels as a cash-gap target."""
    if is_forbidden_target(name):
        raise ValueError(f"Column {name!r} carries a fraud, laundering or anomaly label; it is no cash-gap target")


def invalid_target_columns(df) -> list[str]:
    return [name for name in df.columns if is_forbidden_target(name)]


def resolve_target(name: str) -> str:
    """Canonical column for a target spelling; the label guard runs first."""
    check_target_name(name)
    if name not in TARGET_ALIASES:
        raise ValueError(f"Target {name!r} is not one of {sorted(TARGET_ALIASES)}")
    return TARGET_ALIASES[name]
