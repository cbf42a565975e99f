"""Series preparation, naive forecasts against a loop, models and benchmarks."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import monthly, months, plan, rows
from tideledger.operators import compare, forecast, lagmodels, seriesmodels
from tideledger.operators.compare import Contract


def table(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    return monthly(
        spark,
        [
            (f"s{i}", month, "X", float(rng.integers(0, 500)), float(rng.integers(0, 500)))
            for i, length in enumerate(lengths)
            for month in months(length)
        ],
    )


def naive_loop(history, horizon, season):
    values = list(history)
    for _ in range(horizon):
        values.append(values[-season] if len(values) >= season else values[-1])
    return values[len(history) :]


@pytest.mark.parametrize("season", [1, 2, 3, 5, 12])
@pytest.mark.parametrize("horizon", [1, 3])
def test_seasonal_naive_is_the_recursion(spark, season, horizon):
    canonical = table(spark, [7, 9, 11, 12, 13, 14, 15, 24])
    prepared = forecast.prepare_forecast(canonical, "net_flow", horizon=horizon, min_history=4)
    found = forecast.seasonal_naive(prepared, "net_flow", horizon, season).orderBy("series_id", "date").collect()
    values = forecast.series_totals(canonical).orderBy("series_id", "month").toPandas().groupby("series_id")["net_flow"]
    for series, group in values:
        mine = [r for r in found if r["series_id"] == series]
        history = group.to_list()[:-horizon]
        assert [r["forecast"] for r in mine] == naive_loop(history, horizon, season)
        assert [r["actual"] for r in mine] == group.to_list()[-horizon:]
        assert mine[0]["upper_bound"] - mine[0]["forecast"] == pytest.approx(np.std(np.diff(history)) * 1.28)


def test_repeating_pattern_is_forecast_exactly(spark):
    pattern = [5.0, 1.0, 7.0, 3.0, 9.0, 2.0] * 4
    series = spark.createDataFrame([("T", m, v) for m, v in zip(months(24), pattern)], "series_id string, month string, value double")
    found = forecast.seasonal_naive_total(forecast.split_series(series, 4), season=6).collect()
    assert len(found) == 4 and all(r["forecast"] == r["actual"] for r in found)
    with pytest.raises(PySparkException, match="six rows"):
        forecast.split_series(series.limit(5)).collect()


def test_preparation_rules(spark):
    canonical = table(spark, [6, 7, 8])
    prepared = forecast.prepare_forecast(canonical, "net_flow", horizon=1, min_history=6)
    assert rows(prepared.groupBy("series_id", "split").count()) == [
        ("s1", "context", 6), ("s1", "test", 1), ("s2", "context", 7), ("s2", "test", 1)
    ]
    for bad in ({"target": "profit"}, {"target": "net_flow", "horizon": 4}, {"target": "net_flow", "level": "bank"}):
        with pytest.raises(ValueError):
            forecast.prepare_forecast(canonical, **bad)
    with pytest.raises(ValueError):
        forecast.require_series(forecast.prepare_forecast(canonical, "net_flow", min_history=50))
    poisoned = canonical.withColumn("credit_sum", F.lit(float("nan")))
    with pytest.raises(PySparkException, match="NaN"):
        forecast.prepare_forecast(poisoned, "net_flow").collect()
    assert "Python" not in plan(forecast.seasonal_naive(prepared, "net_flow", 1))


def test_array_features_equal_window_features(spark):
    canonical = table(spark, [9, 12], seed=3)
    prepared = forecast.prepare_forecast(canonical, "net_flow", horizon=1)
    last = forecast.lag_features(prepared.select("series_id", "month", "value", "split")).where("split = 'test'")
    states = lagmodels._states(prepared, ["value"])
    arrays = states.select("series_id", *lagmodels.array_features("past_value", F.element_at("months", 1)))
    for a, b in zip(rows(last, "series_id", *forecast.LAG_FEATURES), rows(arrays)):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_pooled_lags_keep_net_consistent(spark):
    prepared = forecast.prepare_forecast(table(spark, [14] * 20), "net_flow", horizon=2)
    found = lagmodels.pooled_lag_forecast(prepared, "net_flow", 2, {"iterations": 3, "depth": 2}).collect()
    assert len(found) == 40
    for r in found:
        assert r["forecast"] == pytest.approx(r["predicted_credit"] - r["predicted_debit"]) and np.isfinite(r["forecast"])
        assert r["predicted_credit"] >= 0 and r["lower_bound"] <= r["forecast"] <= r["upper_bound"]
    with pytest.raises(ValueError):
        short = forecast.prepare_forecast(table(spark, [6, 6]), "net_flow", horizon=1, min_history=4)
        lagmodels.pooled_lag_forecast(short, "net_flow", 1)


def test_recursive_lags_on_a_short_series(spark):
    series = spark.createDataFrame([("T", m, float(i % 3)) for i, m in enumerate(months(9))], "series_id string, month string, value double")
    found = lagmodels.recursive_lag_forecast(forecast.split_series(series, 2), {"n_estimators": 3}).collect()
    assert len(found) == 2 and all(r["lower_bound"] <= r["forecast"] <= r["upper_bound"] for r in found)


def test_series_models_follow_a_line(spark):
    line = spark.createDataFrame(
        [("T", m, 10.0 + 3 * i) for i, m in enumerate(months(20))], "series_id string, month string, value double"
    )
    split = forecast.split_series(line, 3)
    for model in (seriesmodels.exponential_smoothing, seriesmodels.autoregression):
        for r in model(split).collect():
            assert r["forecast"] == pytest.approx(r["actual"], rel=0.02)
            assert r["lower_bound"] <= r["forecast"] <= r["upper_bound"]


def test_trend_season_bounds(spark):
    prepared = forecast.prepare_forecast(table(spark, [20, 12]), "net_flow", horizon=2)
    for r in seriesmodels.trend_season_forecast(prepared, "net_flow").collect():
        assert r["lower_bound"] == r["forecast"] == r["upper_bound"]
        assert r["forecast"] == pytest.approx(r["predicted_credit"] - r["predicted_debit"])
    for r in seriesmodels.trend_season_forecast(prepared, "total_credit_sum").collect():
        assert r["lower_bound"] < r["upper_bound"] and r["forecast"] >= 0


def test_quantile_scorers(spark):
    prepared = forecast.prepare_forecast(table(spark, [10] * 7), "net_flow", horizon=2).repartition(1)
    found = seriesmodels.quantile_forecast(prepared, "net_flow", 2).collect()
    assert len(found) == 14 and all(r["lower_bound"] <= r["median"] <= r["upper_bound"] for r in found)

    def picky(histories, horizon):
        if any(history[0] == first for history in histories):
            raise RuntimeError("cannot score")
        return np.stack([np.tile([h[-1] - 1, h[-1], h[-1] + 1], (horizon, 1)) for h in histories])

    values = forecast.series_totals(table(spark, [10] * 7)).where("series_id = 's3'").orderBy("month").first()
    first = values["net_flow"]
    partial = seriesmodels.quantile_forecast(prepared, "net_flow", 2, picky, batch=1)
    counts = forecast.coverage(partial, prepared.where("split = 'context'")).first()
    assert (counts["processed_series"], counts["failed_series"]) == (6, 1)

    # In one batch with six others the bad series costs none of them, and says why it failed.
    whole = seriesmodels.quantile_scores(prepared, 2, picky, batch=16).collect()
    assert sum(r["error"] is None for r in whole) == 12
    assert [(r["series_id"], r["error"]) for r in whole if r["error"]] == [("s3", "RuntimeError: cannot score")]

    def never(histories, horizon):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError, match="made up"):
        seriesmodels.require_predictions(seriesmodels.quantile_forecast(prepared, "net_flow", 2, never))


def test_metrics_against_numpy(spark):
    prepared = forecast.prepare_forecast(table(spark, [15, 16, 20], seed=8), "net_flow", horizon=3)
    found = forecast.forecast_metrics(forecast.seasonal_naive(prepared, "net_flow", 3), prepared)
    both = forecast.seasonal_naive(prepared, "net_flow", 3).toPandas()
    error = (both["actual"] - both["forecast"]).abs()
    assert found["mae"] == pytest.approx(error.mean())
    assert found["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert found["wape"] == pytest.approx(error.sum() / both["actual"].abs().sum())
    context = prepared.where("split = 'context'").orderBy("series_id", "month").toPandas()
    scales = context.groupby("series_id")["value"].apply(lambda v: np.abs(np.diff(v)).mean())
    assert found["mase"] == pytest.approx((error.groupby(both["series_id"]).mean() / scales).mean())
    flat = both.assign(actual=0.0)
    assert forecast.pooled_metrics(spark.createDataFrame(flat)).first()["wape"] is None


def test_benchmark_isolates_failures(spark):
    def broken(data, contract, parameters):
        raise ValueError("broken")

    registry = {**compare.MODELS, "broken": (compare.FORECASTING, broken), "gap": (compare.CLASSIFICATION, broken)}
    canonical, contract = table(spark, [12, 13]), Contract("net", horizon=2)
    result = compare.run_benchmark(canonical, ["seasonal_naive", "broken", "quantiles", "seasonal_naive"], contract, registry=registry)
    assert list(result.failures) == ["broken"]
    assert rows(result.predictions.groupBy("model_id").count()) == [("quantiles", 4), ("seasonal_naive", 4)]
    assert compare.compare(result.metrics).count() == 2
    with pytest.raises(RuntimeError):
        compare.run_benchmark(canonical, ["broken"], contract, registry=registry)
    with pytest.raises(ValueError):
        compare.run_benchmark(canonical, ["seasonal_naive", "gap"], contract, registry=registry)
    with pytest.raises(ValueError):
        compare.run_benchmark(canonical, ["seasonal_naive"], Contract("isFraud"), registry=registry)


def test_runs_and_tasks(spark):
    runs = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "run_id string, task string")
    wanted = spark.createDataFrame([(["c", "zz", "a"],)], "run_ids array<string>")
    assert [r["run_id"] for r in compare.in_request_order(runs, wanted).collect()] == ["c", "a"]
    assert compare.same_task(runs).first()[0] == 0 and compare.same_task(runs.where("task = 't'")).first()[0] == 1
