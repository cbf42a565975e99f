"""Daily-ledger operators against plain loops."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import rows
from tideledger.operators import ledger

SCHEMA = "client_id string, date date, credit decimal(18,2), debit decimal(18,2), opening decimal(18,2), overdraft decimal(18,2)"


def daily(spark, seed=3, clients=4, days=60):
    rng = np.random.default_rng(seed)
    records = []
    for c in range(clients):
        opening, overdraft = Decimal(int(rng.integers(0, 500))), Decimal(int(rng.integers(0, 2)) * 300)
        for d in range(days):
            credit, debit = (Decimal(int(x)) / 4 for x in rng.integers(0, 900, 2))
            records.append((f"c{c}", np.datetime64("2023-01-01") + d, credit, debit, opening, overdraft))
    fixed = [(c, d.astype(object), k, b, o, v) for c, d, k, b, o, v in records]
    return spark.createDataFrame(fixed, SCHEMA), fixed


def test_running_balance_is_the_floored_recursion(spark):
    df, records = daily(spark)
    found = {(r["client_id"], r["date"]): r for r in ledger.running_balance(df).collect()}
    balance = {}
    for client, day, credit, debit, opening, overdraft in records:
        before = balance.get(client, opening)
        free = before + credit - debit
        balance[client] = max(free, -overdraft)
        row = found[(client, day)]
        assert (row["opening_balance"], row["closing_balance"]) == (before, balance[client])
        assert row["cash_gap_amount"] == max(-(free + overdraft), 0)
        assert row["cash_gap"] == int(free + overdraft < 0)


def test_deferral_is_the_payment_recursion(spark):
    df, records = daily(spark, seed=5)
    found = {(r["client_id"], r["date"]): r for r in ledger.deferral_schedule(df).collect()}
    state = {}
    for client, day, credit, debit, opening, overdraft in records:
        before, carried = state.get(client, (opening, Decimal(0)))
        due = debit + carried
        paid = min(due, max(before + credit + overdraft, 0))
        state[client] = (before + credit - paid, due - paid)
        row = found[(client, day)]
        assert (row["balance"], row["carried"], row["paid"]) == (*state[client], paid)


def test_gap_target_has_no_last_month(spark):
    df, _ = daily(spark)
    target = ledger.gap_target(ledger.monthly_gaps(ledger.running_balance(df)))
    assert target.where("cash_gap_next_month is null").count() == 4
    summary = ledger.target_summary(target).first()
    assert summary["rows"] - summary["model_observations"] == 4


def test_rollup_fills_every_label(spark):
    df = spark.createDataFrame(
        [("c", "2023-01-02", 5.0, 2.0, 1, 1, "A", "B"), ("c", "2023-01-03", 1.0, 0.0, 1, 0, "A", "A")],
        "client_id string, date string, credit_sum double, debit_sum double, credit_nonzero_count long, debit_nonzero_count long, "
        "credit_category string, debit_category string",
    ).withColumn("date", F.col("date").cast("date"))
    found = rows(ledger.category_rollup(df, ["A", "B", "C"]))
    assert found == [
        ("c", "2023-01", "A", 0.0, 6.0, 0, 2),
        ("c", "2023-01", "B", 2.0, 0.0, 1, 0),
        ("c", "2023-01", "C", 0.0, 0.0, 0, 0),
    ]
    with pytest.raises(PySparkException, match="Label outside"):
        ledger.category_rollup(df, ["A", "C"]).collect()


def test_floored_balances_never_breach(spark):
    df, _ = daily(spark)
    monthly = ledger.monthly_liquidity(ledger.running_balance(df))
    assert monthly.where("balance_breach_proxy = 1").count() == 0
    assert monthly.count() == 4 * 3
