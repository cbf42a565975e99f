"""The feature frame: width, point in time, plan, values against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import monthly, months, plan
from tideledger.operators import features
from tideledger.schemas import LABELS


def history(spark, clients=3, count=14):
    rng = np.random.default_rng(7)
    records = [
        (f"c{c}", month, label, round(float(rng.integers(0, 900)), 2), round(float(rng.integers(0, 900)), 2))
        for c in range(clients)
        for month in months(count)
        for label in ("RENT", "SALARY")
        if rng.random() > 0.1
    ]
    return monthly(spark, records)


def test_standard_labels_give_211_features(spark):
    frame = features.feature_frame(history(spark))
    assert len(features.feature_columns(frame)) == 211
    assert "credit_sum__TAX" in frame.columns


def test_extra_labels_become_columns(spark):
    table = history(spark)
    assert features.discover_labels(table) == ["RENT", "SALARY"]
    other = table.withColumn("transaction_label", F.when(F.col("transaction_label") == "RENT", "New one").otherwise(F.lit(None)))
    named, found = features.feature_frame(other, extra_labels=["New one"]), features.feature_frame(other)
    assert len(features.feature_columns(named)) == 215 and named.columns == found.columns
    total, own = found.agg(F.sum("total_credit"), F.sum("`credit_sum__New one`")).first()
    assert 0 < own < total


def test_point_in_time(spark):
    table = history(spark)
    changed = table.withColumn("credit_sum", F.when(F.col("month") == "2020-09", F.col("credit_sum") * 100).otherwise(F.col("credit_sum")))
    before, after = (
        features.feature_frame(t).where("month < '2020-09'").orderBy("client_id", "month").toPandas() for t in (table, changed)
    )
    pd.testing.assert_frame_equal(before, after)


def test_values_against_pandas(spark):
    table = history(spark)
    ours = features.feature_frame(table).orderBy("client_id", "month").toPandas()
    base = table.toPandas().groupby(["client_id", "month"])[["debit_sum", "credit_sum"]].sum().reset_index()
    grouped = base.groupby("client_id")["credit_sum"]
    np.testing.assert_allclose(ours["total_credit_lag_3"], grouped.shift(3))
    np.testing.assert_allclose(ours["total_credit_mean_6"], grouped.transform(lambda s: s.rolling(6, min_periods=1).mean()))
    np.testing.assert_allclose(ours["total_credit_std_3"], grouped.transform(lambda s: s.rolling(3, min_periods=2).std()))
    streaks = []
    for _, part in base.groupby("client_id"):
        run = 0
        for net in part["credit_sum"] - part["debit_sum"]:
            run = run + 1 if net < 0 else 0
            streaks.append(run)
    assert list(ours["negative_flow_streak"]) == streaks


def test_target_months_only(spark):
    table = history(spark, clients=1)
    target = spark.createDataFrame(
        [("c0", "2020-05", 1.0), ("c0", "2020-06", None), ("zz", "2020-05", 0.0)], "client_id string, month string, cash_gap_next_month double"
    )
    frame = features.feature_frame(table, target).collect()
    assert [(r["month"], r["cash_gap_next_month"]) for r in frame] == [("2020-05", 1)]
    # Months without a target still count as history.
    assert frame[0]["total_credit_lag_3"] is not None
    with pytest.raises(ValueError):
        features.feature_frame(table, target, target_name="isFraud")


def test_plan_has_two_exchanges_and_one_sort_for_all_windows(spark):
    text = plan(features.feature_frame(history(spark)))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Sort [client_id") == 1
    assert "Python" not in text and "Arrow" not in text


def test_standard_labels():
    assert len(LABELS) == 10
