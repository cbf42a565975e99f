"""Per-series statistical forecasts in Arrow batches, and batched quantile scoring.

Only the small numeric fit of one short series is Python; Spark groups the series and spreads them over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from tideledger.operators.forecast import BAND
from tideledger.operators.lagmodels import _states

FORECAST = "series_id string, month string, step int, actual double, forecast double, lower_bound double, upper_bound double"


def _per_series(split: DataFrame, fit: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Apply ``fit(history, horizon) -> (points, half-widths)`` to every series of a split frame."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        past, test = rows[rows["split"] == "context"], rows[rows["split"] == "test"]
        points, widths = fit(past["value"].to_numpy(float), len(test))
        return pd.DataFrame(
            {
                "series_id": key[0],
                "month": test["month"].to_numpy(),
                "step": np.arange(1, len(test) + 1, dtype=np.int32),
                "actual": test["value"].to_numpy(float),
                "forecast": points,
                "lower_bound": points - widths,
                "upper_bound": points + widths,
            }
        )

    needed = split.select("series_id", "month", "value", "split")
    return needed.groupBy("series_id").applyInPandas(run, FORECAST)


def _smooth(y: np.ndarray, horizon: int, alpha: float, beta: float, trended: bool):
    """One pass of (trended) exponential smoothing: sum of squared errors and the forecasts."""
    level, slope, loss = y[0], (y[1] - y[0] if trended and len(y) > 1 else 0.0), 0.0
    for value in y[1:]:
        ahead = level + slope
        loss += (value - ahead) ** 2
        moved = ahead + alpha * (value - ahead)
        slope = slope + alpha * beta * (value - ahead) if trended else 0.0
        level = moved
    return loss, level + slope * np.arange(1, horizon + 1)


def exponential_smoothing(split: DataFrame, season: int | None = None) -> DataFrame:
    """Exponential smoothing: level, trend, and additive season where two seasons are seen.

    The weights come from a grid and the form from the corrected Akaike criterion; the band is 80% of a normal error.
    """

    def fit(y: np.ndarray, horizon: int):
        length = season or int(min(12, max(1, len(y) // 2)))
        best = None
        for seasonal in {False, length > 1 and len(y) >= 2 * length}:
            pattern = np.zeros(length)
            if seasonal:
                centred = y - y.mean()
                pattern = np.array([centred[i::length].mean() for i in range(length)])
                pattern -= pattern.mean()
            plain = y - pattern[np.arange(len(y)) % length]
            for trended in (False, True):
                for alpha in np.linspace(0.1, 0.9, 9):
                    for beta in np.linspace(0.05, 0.5, 4) if trended else (0.0,):
                        loss, ahead = _smooth(plain, horizon, alpha, beta, trended)
                        errors, used = max(len(y) - 1, 1), 2 + 2 * trended + seasonal * (length - 1)
                        if errors - used - 1 <= 0:
                            continue
                        score = errors * np.log(max(loss / errors, 1e-12)) + 2 * used * errors / (errors - used - 1)
                        if best is None or score < best[0]:
                            later = pattern[(len(y) + np.arange(horizon)) % length]
                            best = (score, ahead + later, np.sqrt(loss / errors), alpha)
        if best is None:
            return np.full(horizon, y[-1]), np.zeros(horizon)
        _, points, deviation, alpha = best
        return points, BAND * deviation * np.sqrt(1 + np.arange(horizon) * alpha**2)

    return _per_series(split, fit)


def autoregression(split: DataFrame, most: int = 6) -> DataFrame:
    """Autoregressive forecast: differences 0 or 1 and order by the Akaike criterion, fitted by least squares.

    There is no moving-average part. The band is 80% of a normal error, accumulated over the steps.
    """

    def fit(y: np.ndarray, horizon: int):
        best = None
        for differenced in (False, True):
            z = np.diff(y) if differenced else y
            for order in range(1, min(most, (len(z) - 2) // 2) + 1):
                rows = np.column_stack([np.ones(len(z) - order)] + [z[order - k : -k] for k in range(1, order + 1)])
                coefficients, *_ = np.linalg.lstsq(rows, z[order:], rcond=None)
                loss = float(((z[order:] - rows @ coefficients) ** 2).sum())
                score = len(rows) * np.log(max(loss / len(rows), 1e-12)) + 2 * (order + 2 + differenced)
                score /= len(rows)
                if best is None or score < best[0]:
                    best = (score, differenced, order, coefficients, np.sqrt(loss / len(rows)))
        if best is None:
            return np.full(horizon, y[-1]), np.zeros(horizon)
        _, differenced, order, coefficients, deviation = best
        z = list(np.diff(y) if differenced else y)
        for _step in range(horizon):
            z.append(float(coefficients[0] + sum(c * z[-k] for k, c in enumerate(coefficients[1:], 1))))
        points = np.array(z[-horizon:])
        if differenced:
            points = y[-1] + np.cumsum(points)
        return points, BAND * deviation * np.sqrt(np.arange(1, horizon + 1))

    return _per_series(split, fit)


def _trend_season(y: np.ndarray, months: np.ndarray, later: np.ndarray):
    """Least-squares line, with a yearly wave where at least 18 months are seen; 80% half-width."""

    def design(at: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(at)), at - months[0]]
        if len(y) >= 18:
            for wave in (1, 2):
                columns += [np.sin(2 * np.pi * wave * at / 12), np.cos(2 * np.pi * wave * at / 12)]
        return np.column_stack(columns)

    rows = design(months)
    coefficients, *_ = np.linalg.lstsq(rows, y, rcond=None)
    spare = max(len(y) - rows.shape[1], 1)
    deviation = float(np.sqrt(((y - rows @ coefficients) ** 2).sum() / spare))
    return design(later) @ coefficients, BAND * deviation


def trend_season_forecast(prepared: DataFrame, target: str) -> DataFrame:
    """Trend and yearly season per series and direction; at least 0, net is credit minus debit with no band."""
    sides = {"total_credit_sum": "predicted_credit", "total_debit_sum": "predicted_debit"}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        index = rows["month"].str[:4].astype(int) * 12 + rows["month"].str[5:7].astype(int) - 1
        past, test = (rows["split"] == "context").to_numpy(), (rows["split"] == "test").to_numpy()
        result = pd.DataFrame(
            {
                "series_id": key[0],
                "date": rows.loc[test, "month"].to_numpy() + "-01",
                "actual": rows.loc[test, "value"].to_numpy(float),
            }
        )
        widths = {}
        for name, shown in sides.items():
            when = index.to_numpy(float)
            points, widths[name] = _trend_season(rows.loc[past, name].to_numpy(float), when[past], when[test])
            result[shown], result[f"_{name}"] = np.maximum(points, 0.0), points
        result["predicted_net_flow"] = result["predicted_credit"] - result["predicted_debit"]
        shown = sides.get(target, "predicted_net_flow")
        middle = result[f"_{target}"] if target in sides else result["predicted_net_flow"]
        result["forecast"] = result[shown]
        result["lower_bound"] = middle - widths.get(target, 0.0)
        result["upper_bound"] = middle + widths.get(target, 0.0)
        result["target"] = target
        return result.drop(columns=[f"_{name}" for name in sides])

    schema = (
        "series_id string, date string, actual double, predicted_credit double, predicted_debit double, "
        "predicted_net_flow double, forecast double, lower_bound double, upper_bound double, target string"
    )
    needed = prepared.select("series_id", "month", "value", *sides, "split")
    return needed.groupBy("series_id").applyInPandas(run, schema)


QUANTILES = (0.1, 0.5, 0.9)
Scorer = Callable[[list[np.ndarray], int], np.ndarray]


def empirical_quantiles(histories: list[np.ndarray], horizon: int) -> np.ndarray:
    """Default scorer: last value plus the quantiles of past changes over as many months. Shape (series, horizon, 3)."""
    result = np.empty((len(histories), horizon, len(QUANTILES)))
    for place, history in enumerate(histories):
        for step in range(1, horizon + 1):
            changes = history[step:] - history[:-step]
            moves = np.quantile(changes, QUANTILES) if len(changes) else np.zeros(len(QUANTILES))
            result[place, step - 1] = history[-1] + moves
    return result


def quantile_scores(prepared: DataFrame, horizon: int, scorer: Scorer = empirical_quantiles, batch: int = 16) -> DataFrame:
    """Quantiles of every series and month, and one row with ``error`` (and no values) for each series that can't be scored.

    Series are scored in batches; if a batch fails, each of its series is scored alone, so one bad series costs no other.
    """

    def scored(part: pd.DataFrame) -> pd.DataFrame:
        scores = np.asarray(scorer([np.asarray(h, dtype=float) for h in part["history"]], horizon), dtype=float)
        return pd.DataFrame(
            {
                "series_id": np.repeat(part["series_id"].to_numpy(), horizon),
                "date": [f"{month}-01" for months in part["months"] for month in months],
                "actual": [float(value) for values in part["actuals"] for value in values],
                "lower_bound": scores[:, :, 0].ravel(),
                "median": scores[:, :, 1].ravel(),
                "upper_bound": scores[:, :, 2].ravel(),
                "error": None,
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    yield scored(part)
                    continue
                except Exception as problem:  # a scorer is foreign code
                    last = problem
                for i in range(len(part)):
                    try:
                        if len(part) == 1:
                            raise last
                        yield scored(part.iloc[i : i + 1])
                    except Exception as problem:
                        row = dict.fromkeys(columns) | {"series_id": part["series_id"].iloc[i], "error": f"{type(problem).__name__}: {problem}"}
                        yield pd.DataFrame([row], dtype=object)

    columns = ["series_id", "date", "actual", "lower_bound", "median", "upper_bound", "error"]
    states = _states(prepared, ["value"]).select("series_id", F.col("past_value").alias("history"), "months", "actuals")
    return states.mapInPandas(run, "series_id string, date string, actual double, lower_bound double, median double, upper_bound double, error string")


def quantile_forecast(
    prepared: DataFrame, target: str, horizon: int, scorer: Scorer = empirical_quantiles, batch: int = 16
) -> DataFrame:
    """Forecasts of a pluggable model that returns the quantiles .1, .5, .9 (see ``quantile_scores``).

    A series whose scoring fails has no rows, and nothing is made up for it; ``forecast.coverage`` counts it.
    """
    return quantile_scores(prepared, horizon, scorer, batch).where("error IS NULL").select(
        "series_id", "date", "actual", F.col("median").alias("forecast"), "lower_bound", "median", "upper_bound",
        F.lit(target).alias("target"),
    )


def require_predictions(predictions: DataFrame) -> DataFrame:
    """Refuse a result without any row."""
    if predictions.isEmpty():
        raise RuntimeError("No series could be scored; no values were made up")
    return predictions
