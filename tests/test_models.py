"""Classifiers, categorizer, stream and artifacts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import months, monthly, rows, short
from tideledger.operators import boosting, canonical as can, classify, compare, features, text
from tideledger.session import scratch, shared_dir, stage
from tideledger.sources import sinks
from tideledger.streaming import canonical_stream


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    records, target = [], []
    for c in range(30):
        for month in months(12):
            debit, credit = float(rng.integers(50, 900)), float(rng.integers(50, 900))
            records.append((f"c{c:02d}", month, "RENT", debit, credit))
            target.append((f"c{c:02d}", month, int(debit > credit + 150)))
    wanted = spark.createDataFrame(target, "client_id string, month string, cash_gap_next_month int")
    return stage(features.feature_frame(monthly(spark, records), wanted, ["RENT"]))


@pytest.mark.parametrize(
    "name, chosen",
    [
        ("prior", {}),
        ("logistic_regression", {"max_iter": 20}),
        ("random_forest", {"n_estimators": 5, "max_depth": 4}),
        ("boosted_trees", {"iterations": 3, "depth": 2}),
        ("boosted_leaves", {"n_estimators": 3, "max_depth": 2}),
    ],
)
def test_classifier_contract(spark, frame, name, chosen):
    result = classify.train_classifier(frame, name, {**chosen, "nonsense": 1})
    assert "nonsense" not in result.parameters
    found = result.predictions().collect()
    assert len(found) == 30 * 3 == result.metrics["test_rows"]
    assert {r["risk_group"] for r in found} <= {"high", "medium", "low"}
    for month in {r["scoring_month"] for r in found}:
        assert sorted(r["risk_rank"] for r in found if r["scoring_month"] == month) == list(range(1, 31))
    assert all(0 <= r["risk_score"] <= 1 and r["top_reason_3"] for r in found)
    assert result.importance.count() <= 50
    if name == "prior":
        assert len({r["risk_score"] for r in found}) == 1
    else:
        assert result.metrics["roc_auc"] > 0.8
        result.save(scratch(spark, "model"))


def test_boosting_stops_and_keeps_the_best_rounds(spark, frame):
    whole = classify.train_classifier(frame, "boosted_trees", {"iterations": 12, "depth": 2, "early_stopping": False, "engine": "histogram"})
    best = classify.train_classifier(frame, "boosted_trees", {"iterations": 12, "depth": 2, "engine": "histogram"})
    kept = len(best.model.trees)
    assert len(whole.model.trees) == 12 and 1 <= kept <= 12
    assert best.model.losses.index(min(best.model.losses)) == kept
    path = scratch(spark, "trees")
    best.save(path)
    again = boosting.Boosted.load(spark, path)
    assert again.trees == best.model.trees and again.base == best.model.base
    with pytest.raises(ValueError):
        classify.train_classifier(frame, "prior", {"strategy": "stratified"})


def test_mllib_boosting_keeps_the_best_rounds(frame):
    assert classify.best_rounds([5.0, 4.0, 3.0, 3.5, 2.0]) == 5
    assert classify.best_rounds([5.0, 4.0, 6.0, 6.0, 6.0, 1.0], patience=3) == 2
    whole = classify.train_classifier(frame, "boosted_trees", {"iterations": 12, "depth": 2, "early_stopping": False})
    shorter = classify.first_rounds(whole.model, 5)
    assert whole.model.getNumTrees == 12 and shorter.getNumTrees == 5 and shorter.treeWeights == whole.model.treeWeights[:5]


def test_signed_parts_add_up_to_the_score(frame):
    result = classify.train_classifier(frame, "boosted_leaves", {"n_estimators": 4, "min_child_samples": 5, "engine": "histogram"})
    found = result.scored.withColumn("parts", result.contributions()).select("parts", "risk_score").collect()
    for row in found:
        assert result.model.bias + sum(row["parts"]) == pytest.approx(np.log(row["risk_score"] / (1 - row["risk_score"])), abs=1e-9)
    assert any(abs(x) > 0 for row in found for x in row["parts"])


def test_unknown_model(frame):
    with pytest.raises(ValueError):
        classify.train_classifier(frame, "oracle")


def test_balanced_weights(frame):
    weight, count, rate = classify.class_weights(frame, {"class_weight": "balanced"})
    total = frame.select(F.sum(weight)).first()[0]
    assert total == pytest.approx(count) and 0 < rate < 1


def describe(spark, count=60):
    words = {"FOOD": "coffee bread lunch", "TRAVEL": "bus train flight", "HOME": "rent power water"}
    return spark.createDataFrame(
        [(f"{w.split()[i % 3]} shop {i}", k, i) for i in range(count) for k, w in words.items()],
        "transaction_description string, category string, id long",
    )


def test_categorizer(spark, data):
    table = describe(spark)
    result = text.train_categorizer(table, "id", {"max_iter": 20})
    assert result.metrics["accuracy"] > 0.9 and result.metrics["test_rows"] == 36
    new = spark.createDataFrame([("night bus",), ("bread",)], "transaction_description string")
    assert rows(result.categorize(new)) == [("bread", "FOOD"), ("night bus", "TRAVEL")]
    small = spark.read.option("header", True).csv(data("categories.csv"))
    with pytest.raises(ValueError):
        text.train_categorizer(small)


def test_stratified_split_is_stable_and_exact(spark):
    table = describe(spark, 7)
    first, second = (rows(text.stratified_split(table.repartition(n), "id"), "id", "category", "split") for n in (1, 5))
    assert first == second
    assert sum(s == "test" for _, _, s in first) == 3 * 2


def test_text_weights(spark):
    counting = text._counting(100).fit(describe(spark))
    rarity = counting.stages[-1]
    counts = counting.transform(describe(spark))
    assert rarity.numDocs == counts.count()
    grams = counts.first()["grams"]
    assert "shop" in grams and any(" " in gram for gram in grams)


def transactions(spark):
    table = monthly(spark, [(f"c{i % 4}", f"2023-{i % 3 + 1:02d}", "X", float(i), 1.0) for i in range(60)])
    return table.withColumn("data_quality_flags", F.when(F.col("debit_sum") % 2 == 0, "debit_only")).repartition(6)


def test_stream_equals_batch(spark):
    arrived = scratch(spark, "arrivals")
    table = transactions(spark)
    table.write.parquet(arrived)
    partial, state = scratch(spark, "partials"), scratch(spark, "progress")

    def drain():
        rows_in = canonical_stream.read_stream(spark, arrived, table.schema, files_per_trigger=2)
        canonical_stream.partial_stream(rows_in, partial, state).awaitTermination()
        return short(canonical_stream.read_canonical(spark, partial))

    assert drain() == short(can.canonical_monthly(table))
    # Later files add to the same result; files seen before do not count again.
    table.write.mode("append").parquet(arrived)
    assert drain() == short(can.canonical_monthly(table.unionByName(table)))


def test_daily_stream_with_watermark(spark):
    arrived = scratch(spark, "events")
    table = transactions(spark).withColumn("moment", F.to_timestamp(F.concat("month", F.lit("-05"))))
    table.coalesce(1).write.parquet(arrived)
    out, state = scratch(spark, "days"), scratch(spark, "state")
    rows_in = canonical_stream.read_stream(spark, arrived, table.schema)
    canonical_stream.daily_stream(rows_in, out, state).awaitTermination()
    # The newest day stays open until the watermark passes it.
    assert rows(spark.read.parquet(out).selectExpr("date_format(day, 'yyyy-MM') AS m").distinct()) == [("2023-01",), ("2023-02",)]


def test_artifacts_round_trip(spark):
    root, table = scratch(spark, "runs"), transactions(spark)
    metrics = spark.createDataFrame([(1.5, 3)], "mae double, test_rows long")
    for run in ("a", "b"):
        sinks.write_run(root, run, table, metrics, {"model": run, "horizon": 2})
    back = sinks.read_run(spark, root, "b")
    assert back["predictions"].count() == table.count()
    assert tuple(back["metrics"].select("mae", "test_rows").first()) == (1.5, 3)
    assert '"model": "b"' in back["parameters"].first()["parameters"]


def test_pages_and_previews(spark):
    table = spark.range(95).withColumnRenamed("id", "k").repartition(7)
    found = sinks.page(table, ["k"], 30, 20).orderBy("k").collect()
    assert [r["k"] for r in found] == list(range(30, 50)) and found[0]["total_rows"] == 95
    assert sinks.preview({"canonical": None, "series": table}, 5, ["k"]).count() == 5
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            sinks.preview({"series": table}, bad)
    runs = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "run_id string, created_at int")
    assert [r["run_id"] for r in sinks.newest_first(runs).collect()] == ["b", "c", "a"]


def test_pages_of_an_ordered_table(spark):
    table = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("k"), F.lit("x").alias("v")).repartition(9)
    path = sinks.write_ordered(table, scratch(spark, "ordered"), ["k"])
    for offset, limit in ((0, 10), (995, 30), (3990, 50), (5000, 10)):
        found = sinks.read_page(spark, path, offset, limit)
        assert sorted(r["k"] for r in found.collect()) == list(range(4000))[offset : offset + limit]
        assert {r["total_rows"] for r in found.collect()} <= {4000}
    plan = sinks.read_page(spark, path, 3990, 10)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "_place" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_shared_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_dir(spark)


def test_classifiers_under_one_contract(frame):
    contract = compare.Contract("cash_gap_next_month", task=compare.CLASSIFICATION)

    def broken(data, contract, parameters):
        raise RuntimeError("no such luck")

    registry = {**compare.MODELS, "broken": (compare.CLASSIFICATION, broken)}
    wanted = ["prior", "broken", "logistic_regression", "prior"]
    done = compare.run_benchmark(frame, wanted, contract, {"logistic_regression": {"max_iter": 20}}, registry)
    assert list(done.failures) == ["broken"] and "no such luck" in done.failures["broken"]
    counts = {r["model_id"]: r["count"] for r in done.predictions.groupBy("model_id").count().collect()}
    assert counts == {"prior": 90, "logistic_regression": 90}
    table = {r["model_id"]: r for r in compare.compare(done.metrics, names=compare.CLASSIFIER_METRICS).collect()}
    assert table["prior"]["roc_auc"] == 0.5 and table["logistic_regression"]["roc_auc"] > 0.8
    assert {r["risk_rank"] for r in done.predictions.filter("model_id = 'prior'").collect()} == set(range(1, 31))
    with pytest.raises(ValueError):
        compare.run_benchmark(frame, ["seasonal_naive"], contract)
    with pytest.raises(RuntimeError):
        compare.run_benchmark(frame, ["broken"], contract, registry=registry)
