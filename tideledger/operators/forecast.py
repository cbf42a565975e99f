"""Monthly series, hold-out splits, seasonal-naive forecasts and forecast metrics.

A series has at most one row per month, so its windows are small; all of it is windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideledger.functions.scalars import season_angle
from tideledger.functions.windows import before, per
from tideledger.schemas import FLOW_TARGETS

BAND = 1.28
LAGS = (1, 2, 3, 6)
NEEDED = max(LAGS)


def by_month():
    return per("series_id", order="month")


def whole():
    return Window.partitionBy("series_id")


def series_totals(canonical: DataFrame, level: str = "client", scale: int | None = None) -> DataFrame:
    """Credit, debit and net flow per series and month; a series is a client or a client's label."""
    if level == "client":
        series, keys = F.col("client_id"), ["client_id", "month"]
    elif level == "client_category":
        series, keys = F.concat("client_id", F.lit("::"), "transaction_label"), ["client_id", "transaction_label", "month"]
    else:
        raise ValueError(f"Unknown series level {level!r}; use client or client_category")

    def total(name: str) -> Column:
        return F.sum(F.col(name) if scale is None else F.col(name).cast(f"decimal(18,{scale})"))

    sums = canonical.groupBy(*keys).agg(total("credit_sum").alias("_credit"), total("debit_sum").alias("_debit"))
    return sums.select(
        series.alias("series_id"),
        *keys,
        F.col("_credit").cast("double").alias("total_credit_sum"),
        F.col("_debit").cast("double").alias("total_debit_sum"),
        (F.col("_credit") - F.col("_debit")).cast("double").alias("net_flow"),
    )


def hold_out(series: DataFrame, horizon: int, min_history: int) -> DataFrame:
    """Series long enough, with ``split`` (context, test), ``step`` in the test and ``history`` (context length)."""
    newest_first = Window.partitionBy("series_id").orderBy(F.desc("month"))
    sized = series.select(
        "*", F.count(F.lit(1)).over(whole()).alias("_months"), F.row_number().over(newest_first).alias("_back")
    ).where(F.col("_months") >= min_history + horizon)
    in_test = F.col("_back") <= horizon
    return sized.select(
        *series.columns,
        F.when(in_test, "test").otherwise("context").alias("split"),
        F.when(in_test, horizon + 1 - F.col("_back")).cast("int").alias("step"),
        (F.col("_months") - horizon).cast("int").alias("history"),
    )


def prepare_forecast(
    canonical: DataFrame,
    target: str,
    level: str = "client",
    horizon: int = 1,
    min_history: int = 6,
    scale: int | None = None,
) -> DataFrame:
    """Series of a canonical table, split for a forecast of ``target``; the target is also in ``value``."""
    if target not in FLOW_TARGETS:
        raise ValueError(f"Unknown forecast target {target!r}; there are {FLOW_TARGETS}")
    if horizon not in (1, 2, 3):
        raise ValueError("The horizon is 1, 2 or 3 months")
    totals = series_totals(canonical, level, scale)
    sound = F.abs("total_credit_sum") + F.abs("total_debit_sum") < float("inf")
    stop = F.raise_error(F.lit("Forecast data holds NaN or infinity")).cast("double")
    guarded = totals.withColumn("value", F.when(sound, F.col(target)).otherwise(stop))
    return hold_out(guarded, horizon, min_history)


def require_series(prepared: DataFrame) -> int:
    """Number of series; none is an error."""
    count = prepared.select("series_id").distinct().count()
    if not count:
        raise ValueError("No series is long enough")
    return count


def series_batches(prepared: DataFrame, batches: int) -> DataFrame:
    """Distinct series with a stable batch number."""
    ids = prepared.select("series_id").distinct()
    return ids.withColumn("batch", F.pmod(F.xxhash64("series_id"), F.lit(batches)).cast("int"))


def prediction_columns(target: str) -> list[Column]:
    return [
        F.col("series_id"),
        F.concat("month", F.lit("-01")).alias("date"),
        F.col("value").alias("actual"),
        F.col("forecast"),
        F.col("lower_bound"),
        F.col("upper_bound"),
        F.lit(target).alias("target"),
    ]


def seasonal_naive(prepared: DataFrame, target: str, horizon: int, season: int = 12) -> DataFrame:
    """The value one season back; forecasts serve as history for later steps, short histories repeat the last value.

    Each test step looks back a fixed number of rows of its own series, so no join or loop is needed: a step beyond
    one season goes back whole seasons until it meets an observed month.
    """
    context = F.col("split") == "context"
    change = F.col("value") - F.lag("value").over(by_month())
    spread = F.coalesce(F.stddev_pop(F.when(context, F.col("_change"))).over(whole()), F.lit(0.0)) * BAND

    point = None
    for step in range(1, horizon + 1):
        first = (step - 1) % season + 1
        # Rows back to the same place of the last observed season, and to the last observed month.
        back, last = step - first + season, step
        enough = F.col("history") + first - 1 >= season
        value = F.when(enough, F.lag("value", back).over(by_month())).otherwise(F.lag("value", last).over(by_month()))
        point = F.when(F.col("step") == step, value) if point is None else point.when(F.col("step") == step, value)
    scored = prepared.withColumn("_change", change).select("*", point.alias("forecast"), spread.alias("_spread"))
    return (
        scored.where("split = 'test'")
        .withColumns(
            {
                "lower_bound": F.col("forecast") - F.col("_spread"),
                "upper_bound": F.col("forecast") + F.col("_spread"),
            }
        )
        .select(*prediction_columns(target))
    )


def lag_features(series: DataFrame, value: str = "value") -> DataFrame:
    """Features of each month from the months before it: lags, means, last change of three, spread and season.

    A history shorter than a lag gives its first value. ``prior`` counts the months before.
    """
    first = F.first(value).over(by_month().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lags = [F.coalesce(F.lag(value, back).over(by_month()), F.col("_first")).alias(f"lag_{back}") for back in LAGS]
    three, six = before(by_month(), 3), before(by_month(), 6)
    sine, cosine = season_angle(F.substring("month", 6, 2).cast("int"))
    return (
        series.withColumn("_first", first)
        .select(
            "*",
            (F.row_number().over(by_month()) - 1).alias("prior"),
            *lags,
            F.avg(value).over(three).alias("mean_3"),
            F.avg(value).over(six).alias("mean_6"),
            (F.last(value).over(three) - F.first(value).over(three)).alias("change_3"),
            F.stddev_pop(value).over(six).alias("std_6"),
            sine.alias("month_sin"),
            cosine.alias("month_cos"),
        )
        .drop("_first")
        .where("prior > 0")
    )


LAG_FEATURES = [f"lag_{back}" for back in LAGS] + ["mean_3", "mean_6", "change_3", "std_6", "month_sin", "month_cos"]


def training_rows(series: DataFrame, value: str = "value") -> DataFrame:
    """Months with a full set of lags behind them."""
    return lag_features(series, value).where(F.col("prior") >= NEEDED)


def naive_scale(context: DataFrame) -> DataFrame:
    """Mean absolute month-to-month change per series."""
    changes = context.select("series_id", (F.col("value") - F.lag("value").over(by_month())).alias("change"))
    return changes.groupBy("series_id").agg(F.coalesce(F.avg(F.abs("change")), F.lit(0.0)).alias("scale"))


def naive_spread(context: DataFrame) -> DataFrame:
    """Half-width of the naive band per series: population deviation of the changes times 1.28."""
    changes = context.select("series_id", (F.col("value") - F.lag("value").over(by_month())).alias("change"))
    return changes.groupBy("series_id").agg(
        (F.coalesce(F.stddev_pop("change"), F.lit(0.0)) * BAND).alias("spread")
    )


def pooled_metrics(predictions: DataFrame) -> DataFrame:
    """MAE, RMSE, WAPE (null where all actuals are 0) and rows over all series."""
    error = F.abs(F.col("actual") - F.col("forecast"))
    sums = predictions.agg(
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error).alias("_error"),
        F.sum(F.abs("actual")).alias("_actual"),
        F.count(F.lit(1)).alias("test_rows"),
    )
    wape = F.when(F.col("_actual") > 0, F.col("_error") / F.col("_actual"))
    return sums.select("mae", "rmse", wape.alias("wape"), "test_rows")


def mase(predictions: DataFrame, context: DataFrame) -> DataFrame:
    """Mean over series of their MAE divided by their naive scale; series without change are left out."""
    errors = predictions.groupBy("series_id").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("error"))
    scales = naive_scale(context).where("scale > 0")
    return errors.join(scales, "series_id").agg(F.avg(F.col("error") / F.col("scale")).alias("mase"))


def coverage(predictions: DataFrame, context: DataFrame) -> DataFrame:
    """Series attempted, processed and failed."""
    attempted = context.select("series_id").distinct().select("series_id", F.lit(0).alias("done"))
    processed = predictions.select("series_id").distinct().select("series_id", F.lit(1).alias("done"))
    state = attempted.unionByName(processed).groupBy("series_id").agg(F.max("done").alias("done"))
    counts = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("done"), F.lit(0)).alias("processed_series"))
    failed = F.col("n") - F.col("processed_series")
    return counts.select(
        "processed_series",
        failed.alias("failed_series"),
        F.when(F.col("n") > 0, failed / F.col("n")).otherwise(F.lit(0.0)).alias("error_rate"),
    )


def forecast_metrics(predictions: DataFrame, prepared: DataFrame) -> dict:
    """All forecast metrics of one model; no predictions at all is an error."""
    context = prepared.where("split = 'context'")
    parts = [pooled_metrics(predictions), mase(predictions, context), coverage(predictions, context)]
    result = {name: value for part in parts for name, value in part.first().asDict().items()}
    if not result["test_rows"]:
        raise ValueError("The model produced no predictions")
    return result


# Series of the whole data set ------------------------------------------------------------------------------------


def total_series(canonical: DataFrame, scale: int | None = None) -> DataFrame:
    """One series over all clients: net flow where both sides occur, else the side that does (column ``kind``)."""

    def total(name: str) -> Column:
        return F.sum(F.col(name) if scale is None else F.col(name).cast(f"decimal(18,{scale})"))

    # Few rows from here on: one per month.
    months = canonical.groupBy("month").agg(total("debit_sum").alias("debit"), total("credit_sum").alias("credit"))
    everything = Window.partitionBy(F.lit(0))
    sided = months.select(
        "month",
        F.col("debit").cast("double").alias("debit"),
        F.col("credit").cast("double").alias("credit"),
        (F.col("credit") - F.col("debit")).cast("double").alias("net"),
        F.max(F.col("debit") > 0).over(everything).alias("any_debit"),
        F.max(F.col("credit") > 0).over(everything).alias("any_credit"),
    )
    both, debit = F.col("any_debit") & F.col("any_credit"), F.col("any_debit")
    return sided.select(
        F.lit("TOTAL").alias("series_id"),
        "month",
        F.when(both, F.col("net")).when(debit, F.col("debit")).otherwise(F.col("credit")).alias("value"),
        F.when(both, "net_flow").when(debit, "debit_flow").otherwise("credit_flow").alias("kind"),
    )


def stored_series(series: DataFrame) -> DataFrame:
    """Stored (date, inflow, net_flow…) rows as forecast input: net flow if there, else inflow, summed per date."""
    value = "net_flow" if "net_flow" in series.columns else "inflow"
    return series.groupBy("date").agg(F.sum(value).alias("value")).select(
        F.lit("TOTAL").alias("series_id"), "date", "value", F.lit(value).alias("kind")
    )


def split_series(series: DataFrame, horizon: int | None = None, order: str = "month") -> DataFrame:
    """Hold-out of each whole series: ``horizon`` rows or a fifth (at least 2), leaving at least 4; needs 6 rows."""
    sized = series.select(
        "*",
        F.count(F.lit(1)).over(whole()).alias("_rows"),
        F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(order))).alias("_back"),
    )
    wished = F.lit(horizon) if horizon else F.greatest(F.lit(2), F.ceil(F.col("_rows") * 0.2))
    stop = F.raise_error(F.lit("A forecast needs at least six rows")).cast("int")
    size = F.when(F.col("_rows") >= 6, F.least(wished, F.col("_rows") - 4).cast("int")).otherwise(stop)
    placed = sized.withColumn("_size", size)
    in_test = F.col("_back") <= F.col("_size")
    return placed.select(
        *series.columns,
        F.when(in_test, "test").otherwise("context").alias("split"),
        F.when(in_test, F.col("_size") + 1 - F.col("_back")).cast("int").alias("step"),
        (F.col("_rows") - F.col("_size")).cast("int").alias("history"),
    )


def seasonal_naive_total(split: DataFrame, season: int | None = None) -> DataFrame:
    """Seasonal-naive forecast of a split whole series with an 80% band.

    The season defaults to 12 or half the history. The band grows with the square root of the number of seasons ahead.
    """
    length = F.lit(season) if season else F.least(F.lit(12), F.greatest(F.lit(1), F.floor(F.col("history") / 2)))
    # The histories have one row per month, so keeping each as one array is small.
    history = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("split") == "context", F.struct("month", "value"))).over(whole())),
        lambda item: item["value"],
    )
    based = split.select("*", length.cast("int").alias("_season"), history.alias("_past")).where("split = 'test'")
    cycle = F.floor((F.col("step") - 1) / F.col("_season"))
    place = F.col("history") - F.col("_season") + (F.col("step") - 1) % F.col("_season") + 1
    differences = F.transform(
        F.sequence(F.col("_season") + 1, F.col("history")),
        lambda i: F.element_at("_past", i) - F.element_at("_past", i - F.col("_season")),
    )
    mean_square = F.aggregate(differences, F.lit(0.0), lambda total, d: total + d * d) / F.size(differences)
    deviation = F.when(F.col("history") > F.col("_season"), F.sqrt(mean_square)).otherwise(F.lit(0.0))
    scored = based.select(
        "*",
        F.element_at("_past", place.cast("int")).alias("forecast"),
        (deviation * F.sqrt(cycle + 1) * BAND).alias("_spread"),
    )
    return scored.select(
        "series_id",
        "month",
        "step",
        F.col("value").alias("actual"),
        "forecast",
        (F.col("forecast") - F.col("_spread")).alias("lower_bound"),
        (F.col("forecast") + F.col("_spread")).alias("upper_bound"),
    )
