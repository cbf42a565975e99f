"""Aggregation, validation, flags, targets and eligibility."""

import math
from functools import reduce

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import monthly, plan, rows, short
from tideledger import schemas
from tideledger.operators import canonical as can, quality
from tideledger.sources import registry


def full(spark, *records):
    return spark.createDataFrame(list(records), schemas.CANONICAL)


def row(debit=10.0, credit=0.0, n=1, m=0, flags=None, currency=None, client="C", month="2023-01", label="X"):
    return (client, month, label, debit, credit, n, m, "d", "p", currency, flags)


def test_same_keys_add_up(spark):
    table = full(spark, row(), row(5.0, 2.0, 1, 1, "fallback"))
    for flags in (None, ("fallback",)):
        assert short(can.canonical_monthly(table, flags)) == [("C", "2023-01", "X", 15.0, 2.0, 2, 1, None, "fallback")]


def test_flags_unite_as_sets(spark):
    table = full(spark, row(flags="b|a"), row(flags="a||c|"), row(flags=""), row(flags=None), row(flags="", client="D"))
    known = ("a", "b", "c")
    for flags in (None, known):
        found = rows(can.canonical_monthly(table, flags), "client_id", "data_quality_flags")
        assert found == [("C", "a|b|c"), ("D", None)]
    with pytest.raises(PySparkException, match="Unknown quality flag"):
        can.canonical_monthly(table, ("a",)).collect()


def test_null_currency_is_its_own_group(spark):
    assert can.canonical_monthly(full(spark, row(currency=None), row(currency="USD"), row(currency=None))).count() == 2


def test_combining_parts_equals_the_whole(spark):
    table = full(spark, *[row(debit=float(i), flags="ab"[i % 2], client=f"C{i % 3}") for i in range(30)])
    numbered = table.withColumn("part", F.pmod(F.xxhash64("debit_sum"), F.lit(4)))
    parts = [can.canonical_monthly(numbered.where(F.col("part") == i).drop("part")) for i in range(4)]
    assert short(can.combine(parts)) == short(can.canonical_monthly(table))


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf, -1.0])
def test_bad_amounts_are_rejected(spark, bad):
    table = full(spark, row(), row(debit=bad))
    counts = can.violations(table).first()
    assert counts["rows"] == 2 and counts["non_finite" if not math.isfinite(bad) else "negative_amount"] == 1
    with pytest.raises(PySparkException, match="Canonical row breaks"):
        can.validated(table).collect()
    marked = can.validated(table, strict=False)
    assert marked.where("problems <> ''").count() == 1


def test_strict_validation_fails_even_for_a_count(spark):
    with pytest.raises(PySparkException, match="bad_month"):
        can.validated(full(spark, row(month="2023-1"))).count()


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="currency"):
        can.violations(full(spark, row()).drop("currency"))


@pytest.mark.parametrize(
    "name",
    ["isFraud", "fraud", "isFlaggedFraud", "Is Laundering", "AML labels", "transaction_anomaly_label", "balance_breach_proxy"],
)
def test_forbidden_targets(name):
    with pytest.raises(ValueError):
        schemas.check_target_name(name)


def test_target_names():
    schemas.check_target_name("cash_gap_next_month")
    assert schemas.resolve_target("debit") == "total_debit_sum"
    with pytest.raises(ValueError):
        schemas.resolve_target("profit")


def test_mixed_currencies(spark):
    table = full(spark, row(currency="USD"), row(currency="EUR"), row())
    assert can.require_single_currency(table, False) is table
    assert can.require_single_currency(table.where("currency = 'USD'"), True) is not None
    with pytest.raises(ValueError):
        can.require_single_currency(table, True)


def test_eligibility(spark):
    facts = {"clients": 1, "months": 12, "has_debit": 1, "has_credit": 1, "has_balance": 1, "has_cash_gap_target": 0}
    report = quality.task_eligibility(facts, registry.SOURCES["company_ledger"])
    assert (report.classification, report.forecasting, report.proxy) == (False, True, True)
    assert len(report.reasons) == 2
    table = spark.createDataFrame([facts])
    assert tuple(quality.eligibility_table(table, registry.SOURCES["company_ledger"]).first()) == (0, 1, 1, 0)


def test_profile_of_an_empty_table(spark):
    facts = quality.profile(full(spark, row()).where("false")).first()
    assert (facts["rows"], facts["clients"], facts["has_debit"], facts["missing_percent"]) == (0, 0, 0, 0.0)


def test_model_eligibility():
    model = quality.ModelSpec("m", "cash_flow_forecasting", frozenset({"net_flow"}))
    assert quality.model_eligibility(model, {"months": 7}, "net") == []
    assert quality.model_eligibility(model, {"months": 6}, "net") != []
    assert quality.model_eligibility(model, {"months": 9}, "isFraud") != []
    assert quality.model_eligibility(model, {"months": 9}, "credit") != []


def test_external_target_is_guarded(spark):
    frame = monthly(spark, [("C", "2023-01", "X", 1, 2)])
    target = spark.createDataFrame([("C", "2023-01", 1), ("D", "2023-01", None)], "client_id string, month string, gap int")
    assert quality.attach_target(frame, target, "gap").count() == 1
    with pytest.raises(ValueError):
        quality.attach_target(frame, target.withColumnRenamed("gap", "fraud"), "fraud")


def test_known_flags_keep_one_hash_aggregate(spark):
    text = plan(can.canonical_monthly(full(spark, row()), ("a",)))
    assert text.count("Exchange") == 1 and "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_balances_follow_the_order(spark):
    seen = spark.createDataFrame(
        [("C", "2023-01", 2, 5.0), ("C", "2023-01", 1, 9.0), ("C", "2023-01", 3, -1.0)], "client_id string, month string, at int, balance double"
    )
    assert rows(can.monthly_balances(seen, ["at"])) == [("C", "2023-01", 9.0, -1.0, -1.0, 9.0, 3, 1)]
    halves = [can.monthly_balances(seen.where(c), ["at"]).withColumn("part", F.lit(i)) for i, c in enumerate(("at < 2", "at >= 2"))]
    merged = can.merge_balances(reduce(lambda a, b: a.unionByName(b), halves), "part")
    assert rows(merged) == [("C", "2023-01", 9.0, -1.0, -1.0, 9.0, 3, 1)]
