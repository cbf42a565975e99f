"""Ranks, thresholds and metrics against brute force, with heavy ties."""

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tideledger.operators import explain, ordered, scoring


def scored(spark, pairs):
    return spark.createDataFrame([(i, "2023-01", float(p), int(y)) for i, (y, p) in enumerate(pairs)], "id long, month string, score double, label int")


def hot(spark, count=3000, seed=1):
    """A third of the rows share one score, a third of the groups' rows are in one month."""
    rng = np.random.default_rng(seed)
    records = [
        (i, f"2023-{1 if rng.random() < 0.33 else int(rng.integers(1, 9)):02d}", 0.5 if rng.random() < 0.33 else round(float(rng.random()), 2), int(rng.random() < 0.3))
        for i in range(count)
    ]
    return spark.createDataFrame(records, "id long, month string, score double, label int").repartition(6), records


def test_perfect_ranking(spark):
    table = scored(spark, zip([0, 0, 0, 1, 1, 1], [0.05, 0.15, 0.30, 0.55, 0.75, 0.95]))
    curve = scoring.score_curve(table)
    assert scoring.best_threshold(curve).first()["threshold"] == 0.55
    metrics = scoring.classification_metrics(table, 0.55, ["id"])
    assert metrics["pr_auc"] == 1.0 and metrics["roc_auc"] == 1.0
    assert metrics["confusion_matrix"] == [[3, 0], [0, 3]]
    assert metrics["precision_at_top_10"] == 1.0 and metrics["test_rows"] == 6


def test_one_class_and_no_rows(spark):
    table = scored(spark, [(0, 0.2), (0, 0.4)])
    metrics = scoring.classification_metrics(table, 0.3, ["id"])
    assert metrics["pr_auc"] is None and metrics["roc_auc"] is None
    assert (metrics["precision"], metrics["recall"], metrics["f1"], metrics["recall_at_top_10"]) == (0, 0, 0, 0)
    assert scoring.best_threshold(scoring.score_curve(table.where("false"))).first()["threshold"] == 0.5


def test_ranks_and_percentiles_with_hot_scores(spark):
    table, records = hot(spark)
    found = {r["id"]: r for r in ordered.with_percentile(table, ["month"], "score", ["id"]).collect()}
    assert len(found) == len(records)
    for month in {m for _, m, _, _ in records}:
        group = [(i, s) for i, m, s, _ in records if m == month]
        for place, (i, score) in enumerate(sorted(group, key=lambda x: (-x[1], x[0])), 1):
            assert found[i]["row_number"] == place
            below = sum(s <= score for _, s in group)
            assert found[i]["percentile"] == pytest.approx(below / len(group))


def test_running_sums_with_hot_values(spark):
    table, records = hot(spark, seed=4)
    found = sorted(ordered.running(table, [], [F.col("score").asc(), F.col("id").asc()], {"total": "label"}).collect(), key=lambda r: (r["score"], r["id"]))
    expected = np.cumsum([y for _, _, s, y in sorted(records, key=lambda r: (r[2], r[0]))])
    assert [r["total"] for r in found] == list(expected)


def test_metrics_against_brute_force(spark):
    table, records = hot(spark, count=400, seed=2)
    y, p = np.array([r[3] for r in records]), np.array([r[2] for r in records])
    metrics = scoring.ranking_metrics(scoring.score_curve(table)).first()
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert metrics["roc_auc"] == pytest.approx(np.mean(wins))
    precision, last = 0.0, 0
    for s in sorted(set(p), reverse=True):
        hits = y[p >= s].sum()
        precision += (hits - last) / y.sum() * hits / (p >= s).sum()
        last = hits
    assert metrics["pr_auc"] == pytest.approx(precision)
    f1 = {s: 2 * y[p >= s].sum() / ((p >= s).sum() + y.sum()) for s in set(p)}
    best = min(s for s in f1 if f1[s] == max(f1.values()))
    assert scoring.best_threshold(scoring.score_curve(table)).first()["threshold"] == best


def test_top_share_rounds_up(spark):
    table = scored(spark, [(i % 2, 0.5) for i in range(11)])
    assert rows(scoring.top_share(table, ["id"]), "id") == [(0,), (1,)]
    assert scoring.top_share(scored(spark, [(1, 0.1)]), ["id"]).count() == 1


def test_temporal_split():
    months = [f"2023-{m:02d}" for m in range(1, 13)]
    parts = scoring.split_months(months)
    assert [len(parts[k]) for k in ("train", "validation", "test")] == [7, 2, 3]
    assert parts["train"] + parts["validation"] + parts["test"] == months
    assert [len(v) for v in scoring.split_months(months[:11]).values()] == [6, 2, 3]
    assert [len(v) for v in scoring.split_months(months[:6]).values()] == [3, 1, 2]
    with pytest.raises(ValueError):
        scoring.split_months(months[:5])


def test_reasons_fill_up_and_contribute(spark):
    table = spark.createDataFrame(
        [("quiet", 0.0, 0, 0.0, [0.0, 0.0]), ("falling", -0.5, 6, 0.1, [3.0, -1.0])],
        "client_id string, total_credit_change_pct double, negative_flow_streak int, credit_volatility_6 double, parts array<double>",
    )
    found = {r["client_id"]: tuple(r)[-3:] for r in explain.with_reasons(table).collect()}
    assert found["quiet"] == ("no_negative_signal", "stable_trend", "low_volatility")
    assert found["falling"] == ("negative_streak", "credit_decline", "credit_volatility")
    names = ["total_debit_change", "net_flow"]
    found = {r["client_id"]: tuple(r)[-3:] for r in explain.with_reasons(table, "parts", names).collect()}
    assert found["falling"] == ("negative_streak", "debit_growth", "credit_decline")
    texts = explain.with_reasons(table, texts=True).where("client_id = 'quiet'").first()
    assert texts["top_reason_1"] == explain.FALLBACKS["no_negative_signal"]


def test_greatest_rows_by_counting(spark):
    from tideledger.operators import ordered

    rng = random.Random(4)
    values = [rng.choice([0.25, 0.5, rng.random(), 1e-9 * rng.random(), -3e8]) for _ in range(600)] + [None, float("nan"), None]
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, score double").repartition(4)
    real = sorted(((-v, i) for i, v in rows if v is not None and v == v))
    late = [i for i, v in rows if v is None or v != v]
    full = [i for _, i in real] + late
    for k in (1, 2, 60, 200, 333, 599, 600, 601, 603, 700):
        assert sorted(r["id"] for r in ordered.greatest(df, "score", k, ["id"]).collect()) == sorted(full[:k])
    assert ordered.kth_greatest(df, "score", 3, bins=4)[0] == -real[2][0]
    assert ordered.kth_greatest(df.limit(0), "score", 1) is None
