"""Several models under one contract, and the comparison of their runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideledger.operators import classify
from tideledger.operators.forecast import forecast_metrics, prepare_forecast, require_series, seasonal_naive
from tideledger.operators.lagmodels import pooled_lag_forecast
from tideledger.operators.scoring import score_table
from tideledger.operators.seriesmodels import quantile_forecast, require_predictions, trend_season_forecast
from tideledger.schemas import resolve_target
from tideledger.session import stage

#: Columns of every classifier's predictions; reasons and groups belong to a single run.
SCORED = ["client_id", "scoring_month", "risk_score", "actual_cash_gap_next_month", "predicted_cash_gap", "risk_rank"]
COMMON = ["series_id", "date", "actual", "forecast", "lower_bound", "upper_bound", "target"]
FORECASTING, CLASSIFICATION = "cash_flow_forecasting", "cash_gap_classification"


@dataclass(frozen=True)
class Contract:
    """What every model of a benchmark is asked for."""

    target: str
    horizon: int = 1
    level: str = "client"
    min_history: int = 6
    task: str = FORECASTING
    train_ratio: float = 0.6
    validation_ratio: float = 0.2

    def prepared(self, canonical: DataFrame, scale: int | None = None) -> DataFrame:
        return prepare_forecast(
            canonical, resolve_target(self.target), self.level, self.horizon, self.min_history, scale
        )


def _classifier(name: str) -> Callable:
    return lambda data, contract, parameters: classify.train_prepared(data, name, parameters)


#: model id → (task, function(prepared, contract, parameters) → predictions, of a classifier the trained model)
MODELS: dict[str, tuple[str, Callable]] = {
    "seasonal_naive": (
        FORECASTING,
        lambda data, c, p: seasonal_naive(data, resolve_target(c.target), c.horizon, int(p.get("season_length", 12))),
    ),
    "pooled_lags": (
        FORECASTING,
        lambda data, c, p: pooled_lag_forecast(data, resolve_target(c.target), c.horizon, p),
    ),
    "trend_season": (FORECASTING, lambda data, c, p: trend_season_forecast(data, resolve_target(c.target))),
    "quantiles": (
        FORECASTING,
        lambda data, c, p: quantile_forecast(
            data, resolve_target(c.target), c.horizon, **{k: p[k] for k in ("scorer", "batch") if k in p}
        ),
    ),
    **{name: (CLASSIFICATION, _classifier(name)) for name in classify.DEFAULTS},
}


@dataclass
class Benchmark:
    predictions: DataFrame
    metrics: DataFrame
    failures: dict[str, str] = field(default_factory=dict)


def unique_models(requested: list[str]) -> list[str]:
    """Requested models, each once, in order."""
    return list(dict.fromkeys(requested))


def run_benchmark(
    table: DataFrame,
    models: list[str],
    contract: Contract,
    parameters: dict[str, dict] | None = None,
    registry: dict[str, tuple[str, Callable]] | None = None,
    scale: int | None = None,
) -> Benchmark:
    """Run several models on the same prepared data: forecasters on a canonical table, classifiers on a feature frame.

    The preparation (the series, or the temporal split of the frame) is staged once for all models. A failing model is
    reported; only all failing is an error, and so is a model of another task.
    """
    registry = registry or MODELS
    models = unique_models(models)
    foreign = [name for name in models if name not in registry or registry[name][0] != contract.task]
    if foreign:
        raise ValueError(f"Not models for {contract.task}: {foreign}")
    if contract.task == CLASSIFICATION:
        prepared = classify.prepare_training(table, contract.train_ratio, contract.validation_ratio)
        one = _classified
    else:
        prepared = stage(contract.prepared(table, scale))
        require_series(prepared)
        one = _forecast
    parts, rows, failures = [], [], {}
    for place, name in enumerate(models):
        try:
            # Staged here, so a model fails inside its own try and is never computed twice.
            result, measured = one(registry[name][1], prepared, contract, (parameters or {}).get(name, {}))
        except Exception as problem:  # any failure of one model must not stop the others
            failures[name] = f"{type(problem).__name__}: {problem}"
            continue
        parts.append(result.select(F.lit(name).alias("model_id"), *result.columns))
        rows += [(name, place, metric, None if v is None else float(v)) for metric, v in measured.items()]
    if not parts:
        raise RuntimeError(f"Every model failed: {failures}")
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    metrics = table.sparkSession.createDataFrame(rows, "model_id string, position int, metric string, value double")
    return Benchmark(predictions, metrics, failures)


def _forecast(model: Callable, prepared: DataFrame, contract: Contract, parameters: dict) -> tuple[DataFrame, dict]:
    result = require_predictions(stage(model(prepared, contract, parameters).select(*COMMON)))
    return result, forecast_metrics(result, prepared)


def _classified(model: Callable, prepared: classify.Prepared, contract: Contract, parameters: dict) -> tuple[DataFrame, dict]:
    began = perf_counter()
    trained = model(prepared, contract, parameters)
    seconds = perf_counter() - began
    ranked = score_table(trained.scored.select(*classify.KEYS, classify.TARGET, "risk_score"), trained.threshold)
    named = {"month": "scoring_month", classify.TARGET: "actual_cash_gap_next_month"}
    result = stage(ranked.withColumnsRenamed(named).select(*SCORED))
    return result, {k: v for k, v in trained.metrics.items() if k != "confusion_matrix"} | {"training_seconds": seconds}


CLASSIFIER_METRICS = ["pr_auc", "roc_auc", "precision", "recall", "f1", "brier_score", "precision_at_top_10", "recall_at_top_10", "threshold", "test_rows"]
METRICS = ["mae", "rmse", "wape", "mase", "processed_series", "failed_series", "error_rate", "test_rows"]


def metrics_table(predictions: DataFrame, by: str = "model_id") -> DataFrame:
    """Pooled metrics of many runs at once, in long form (run, metric, value)."""
    error = F.abs(F.col("actual") - F.col("forecast"))
    sums = predictions.groupBy(by).agg(
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.sum(F.abs("actual")) > 0, F.sum(error) / F.sum(F.abs("actual"))).alias("wape"),
        F.count(F.lit(1)).cast("double").alias("test_rows"),
    )
    return sums.unpivot([by], ["mae", "rmse", "wape", "test_rows"], "metric", "value")


def compare(metrics: DataFrame, by: str = "model_id", names: list[str] = METRICS) -> DataFrame:
    """One row per run, one column per metric."""
    return metrics.groupBy(by).pivot("metric", names).agg(F.first("value"))


def in_request_order(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Runs of a benchmark in the order of its ``run_ids`` array; missing runs are left out."""
    wanted = requested.select(F.posexplode("run_ids").alias("position", "run_id"))
    return runs.join(wanted, "run_id").orderBy("position")


def same_task(runs: DataFrame) -> DataFrame:
    """Whether all runs share one task."""
    return runs.agg((F.count_distinct("task") <= 1).cast("int").alias("same_task"))


def latest(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of all stored runs."""
    return spark.read.json(f"{root}/metrics")
