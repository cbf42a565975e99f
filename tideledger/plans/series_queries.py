"""Queries over windows, sorts and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.functions import scalars as S
from tideledger.operators import compare, explain, features, forecast, lagmodels, ledger, ordered, scoring, seriesmodels
from tideledger.plans import testbed as tb
from tideledger.plans.catalog import query, with_sql
from tideledger.plans.table_queries import PREPARED_SQL, TOTAL_SERIES_SQL, TOTALS_SQL, prepared
from tideledger.sources import sinks

# Feature windows -------------------------------------------------------------------------------------------------

_AMOUNTS = [f"{side}_sum__{label}" for side in ("debit", "credit") for label in tb.LABELS]


def _pivoted(side: str, label: str) -> str:
    return f"""CAST(coalesce(sum(CAST({side}_sum AS DECIMAL(18,2))) FILTER (WHERE transaction_label = '{label}'), 0) AS DOUBLE) AS "{side}_sum__{label}" """


FEATURES_SQL = f"""base AS (SELECT client_id, month, CAST(sum(CAST(debit_sum AS DECIMAL(18,2))) AS DOUBLE) AS total_debit,
    CAST(sum(CAST(credit_sum AS DECIMAL(18,2))) AS DOUBLE) AS total_credit, CAST(sum(debit_nonzero_count) AS DOUBLE) AS debit_count,
    CAST(sum(credit_nonzero_count) AS DOUBLE) AS credit_count,
    {', '.join(_pivoted(side, label) for side in ('debit', 'credit') for label in tb.LABELS)}
    FROM canonical GROUP BY client_id, month),
  ratios AS (SELECT *, total_credit - total_debit AS net_flow, total_credit / greatest(credit_count, 1) AS avg_credit_operation,
    total_debit / greatest(debit_count, 1) AS avg_debit_operation, total_credit / greatest(total_debit, 1) AS credit_to_debit_ratio,
    credit_count / greatest(debit_count, 1) AS credit_to_debit_count_ratio FROM base)"""
_W = "WINDOW w AS (PARTITION BY client_id ORDER BY month)"


def _history(spark, sf_dir):
    return features.feature_frame(tb.canonical(spark, sf_dir), labels=tb.LABELS, scale=2)


#: Added before rounding means on both sides: a mean of few cent amounts can lie exactly between two rounded values,
#: where the last bit of a sum would decide.
OFF_TIES = "0.000000137"


def _rounded(frame, digits: int, names: list[str], shift: str = "0"):
    """Client, month and the named features, rounded so both engines agree on the last bit."""
    shown = [f"round(`{name}` + {shift}D, {digits}) + 0D AS `{name}`" for name in names]
    return frame.selectExpr("client_id", "month", *shown)


_LAGGED = [(name, back) for back in features.LAGS for name in features.CORE + _AMOUNTS]
_LAGS_SQL = ", ".join(f'round(lag("{name}", {back}) OVER w, 6) + 0.0 AS "{name}_lag_{back}"' for name, back in _LAGGED)


@query("G01_lags", with_sql(tb.CANONICAL_SQL, FEATURES_SQL, f"SELECT client_id, month, {_LAGS_SQL} FROM ratios {_W}"))
def lags(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 6, [f"{name}_lag_{back}" for name, back in _LAGGED])


_ROLLED = [(name, span) for span in features.SPANS for name in features.CORE]


def _rolling_sql(function: str, suffix: str, digits: int, shift: str = "0") -> str:
    columns = ", ".join(
        f"""round({function}({name}) OVER (PARTITION BY client_id ORDER BY month ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)
              + CAST({shift} AS DOUBLE), {digits})
            + 0.0 AS {name}_{suffix}_{span}"""
        for name, span in _ROLLED
    )
    return with_sql(tb.CANONICAL_SQL, FEATURES_SQL, f"SELECT client_id, month, {columns} FROM ratios")


@query("G02_rolling_means", _rolling_sql("avg", "mean", 5, OFF_TIES))
def rolling_means(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 5, [f"{name}_mean_{span}" for name, span in _ROLLED], OFF_TIES)


@query("G03_rolling_deviations", _rolling_sql("stddev_samp", "std", 4))
def rolling_deviations(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 4, [f"{name}_std_{span}" for name, span in _ROLLED])


_CHANGES_SQL = ", ".join(
    f"""round({name} - lag({name}) OVER w, 5) + 0.0 AS {name}_change,
        round(({name} - lag({name}) OVER w) / greatest(abs(lag({name}) OVER w), 1), 6) + 0.0 AS {name}_change_pct"""
    for name in features.CHANGES
)


@query("G04_changes", with_sql(tb.CANONICAL_SQL, FEATURES_SQL, f"SELECT client_id, month, {_CHANGES_SQL} FROM ratios {_W}"))
def changes(spark, sf_dir):
    frame = _history(spark, sf_dir)
    return frame.select(
        "client_id",
        "month",
        *[(F.round(f"{name}_change", 5) + 0.0).alias(f"{name}_change") for name in features.CHANGES],
        *[(F.round(f"{name}_change_pct", 6) + 0.0).alias(f"{name}_change_pct") for name in features.CHANGES],
    )


@query(
    "G05_trends",
    with_sql(
        tb.CANONICAL_SQL,
        FEATURES_SQL,
        f"""SELECT client_id, month, round((total_credit - lag(total_credit, 2) OVER w) / 2, 4) + 0.0 AS credit_trend_3,
              round((total_debit - lag(total_debit, 2) OVER w) / 2, 4) + 0.0 AS debit_trend_3 FROM ratios {_W}""",
    ),
)
def trends(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 4, ["credit_trend_3", "debit_trend_3"])


@query(
    "G06_negative_months",
    with_sql(
        tb.CANONICAL_SQL,
        FEATURES_SQL,
        """SELECT client_id, month, CAST(sum(CASE WHEN net_flow < 0 THEN 1 ELSE 0 END)
             OVER (PARTITION BY client_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS DOUBLE) AS negative_flow_months_6 FROM ratios""",
    ),
)
def negative_months(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 6, ["negative_flow_months_6"])


@query(
    "G07_negative_streak",
    with_sql(
        tb.CANONICAL_SQL,
        FEATURES_SQL,
        f"""runs AS (SELECT client_id, month, net_flow, sum(CASE WHEN net_flow >= 0 THEN 1 ELSE 0 END) OVER w AS run FROM ratios {_W})""",
        """SELECT client_id, month, CAST(count(*) FILTER (WHERE net_flow < 0) OVER (PARTITION BY client_id, run ORDER BY month) AS DOUBLE)
             AS negative_flow_streak FROM runs""",
    ),
)
def negative_streak(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 6, ["negative_flow_streak"])


@query(
    "G08_volatility",
    with_sql(
        tb.CANONICAL_SQL,
        FEATURES_SQL,
        """moved AS (SELECT *, (credit_count - lag(credit_count) OVER w) / greatest(abs(lag(credit_count) OVER w), 1) AS credits,
             (debit_count - lag(debit_count) OVER w) / greatest(abs(lag(debit_count) OVER w), 1) AS debits,
             stddev_samp(total_credit) OVER six / greatest(abs(avg(total_credit) OVER six), 1) AS volatility
             FROM ratios WINDOW w AS (PARTITION BY client_id ORDER BY month),
               six AS (PARTITION BY client_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""",
        """SELECT client_id, month, CASE WHEN credits IS NOT NULL THEN round(greatest(-credits, 0), 6) + 0.0 END AS credit_count_decline,
             CASE WHEN debits IS NOT NULL THEN round(greatest(debits, 0), 6) + 0.0 END AS debit_count_growth,
             round(volatility, 6) + 0.0 AS credit_volatility_6 FROM moved""",
    ),
)
def volatility(spark, sf_dir):
    return _rounded(_history(spark, sf_dir), 6, ["credit_count_decline", "debit_count_growth", "credit_volatility_6"])


# Series windows --------------------------------------------------------------------------------------------------

_PREPARED = (tb.CANONICAL_SQL, TOTALS_SQL, PREPARED_SQL)
_PREPARED_COLUMNS = ["series_id", "month", "value", "split", "step", "history"]


@query("G09_series_length", with_sql(*_PREPARED, "SELECT series_id, count(*) AS months FROM prepared GROUP BY series_id"))
def series_length(spark, sf_dir):
    return prepared(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("months"))


@query("G10_holdout", with_sql(*_PREPARED, f"SELECT {', '.join(_PREPARED_COLUMNS)} FROM prepared"))
def holdout(spark, sf_dir):
    return prepared(spark, sf_dir).select(*_PREPARED_COLUMNS)


@query(
    "G11_risk_rank",
    with_sql(tb.SCORES_SQL, "SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY score DESC, id) AS risk_rank FROM scores"),
)
def risk_rank(spark, sf_dir):
    order = [F.col("score").desc(), F.col("id").asc()]
    return ordered.ranked(tb.scores(spark, sf_dir), ["month"], order, "risk_rank").select("id", "month", "risk_rank")


@query(
    "G12_risk_percentile",
    with_sql(
        tb.SCORES_SQL,
        """placed AS (SELECT id, month, cume_dist() OVER (PARTITION BY month ORDER BY score) AS percentile FROM scores)""",
        """SELECT id, round(percentile, 9) AS percentile,
             CASE WHEN percentile >= 0.9 THEN 'high' WHEN percentile >= 0.6 THEN 'medium' ELSE 'low' END AS risk_group FROM placed""",
    ),
)
def risk_percentile(spark, sf_dir):
    placed = ordered.with_percentile(tb.scores(spark, sf_dir), ["month"], "score", ["id"])
    return placed.select(
        "id", F.round("percentile", 9).alias("percentile"), S.risk_group(F.col("percentile")).alias("risk_group")
    )


@query(
    "G13_next_month",
    with_sql(tb.GAPS_SQL, "SELECT client_id, month, cash_gap_current_month, cash_gap_next_month FROM target WHERE cash_gap_next_month IS NOT NULL"),
)
def next_month(spark, sf_dir):
    target = ledger.gap_target(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)))
    return target.drop("cash_gap_amount").where("cash_gap_next_month is not null")


_CHANGE_SQL = """changes AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY month) AS change
  FROM prepared WHERE split = 'context')"""


@query("G14_naive_scale", with_sql(*_PREPARED, _CHANGE_SQL, "SELECT series_id, round(avg(abs(change)), 4) AS scale FROM changes GROUP BY series_id"))
def naive_scale(spark, sf_dir):
    context = prepared(spark, sf_dir).where("split = 'context'")
    return forecast.naive_scale(context).select("series_id", F.round("scale", 4).alias("scale"))


@query(
    "G15_naive_spread",
    with_sql(*_PREPARED, _CHANGE_SQL, "SELECT series_id, round(stddev_pop(change) * 1.28, 4) AS spread FROM changes GROUP BY series_id"),
)
def naive_spread(spark, sf_dir):
    context = prepared(spark, sf_dir).where("split = 'context'")
    return forecast.naive_spread(context).select("series_id", F.round("spread", 4).alias("spread"))


_LAG_FEATURES_SQL = """SELECT series_id, month, place - 1 AS prior, round(coalesce(lag(value, 1) OVER w, earliest), 4) + 0.0 AS lag_1,
  round(coalesce(lag(value, 2) OVER w, earliest), 4) + 0.0 AS lag_2, round(coalesce(lag(value, 3) OVER w, earliest), 4) + 0.0 AS lag_3,
  round(coalesce(lag(value, 6) OVER w, earliest), 4) + 0.0 AS lag_6,
  round(avg(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 5) + 0.0 AS mean_3,
  round(avg(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 5) + 0.0 AS mean_6,
  round(lag(value) OVER w - first_value(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) + 0.0 AS change_3,
  round(stddev_pop(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) + 0.0 AS std_6,
  round(sin(2 * pi() * CAST(substr(month, 6, 2) AS INT) / 12), 6) + 0.0 AS month_sin,
  round(cos(2 * pi() * CAST(substr(month, 6, 2) AS INT) / 12), 6) + 0.0 AS month_cos
  FROM (SELECT *, first_value(value) OVER (PARTITION BY series_id ORDER BY month) AS earliest FROM prepared)
  WINDOW w AS (PARTITION BY series_id ORDER BY month) QUALIFY place > 1"""
_LAG_DIGITS = {"mean_3": 5, "mean_6": 5, "month_sin": 6, "month_cos": 6}


@query("G16_lag_features", with_sql(*_PREPARED, _LAG_FEATURES_SQL))
def lag_features(spark, sf_dir):
    rows = forecast.lag_features(prepared(spark, sf_dir))
    shown = [(F.round(name, _LAG_DIGITS.get(name, 4)) + 0.0).alias(name) for name in forecast.LAG_FEATURES]
    return rows.select("series_id", "month", F.col("prior").cast("long").alias("prior"), *shown)


@query(
    "G17_balance_window",
    with_sql(
        tb.BALANCES_SQL,
        "SELECT client_id, date, CAST(closing_balance AS DOUBLE) AS closing_balance, CAST(cash_gap_amount AS DOUBLE) AS cash_gap_amount FROM balances WHERE cash_gap = 1",
    ),
)
def balance_window(spark, sf_dir):
    rows = tb.stressed_balances(spark, sf_dir).where("cash_gap = 1")
    return rows.select(
        "client_id",
        "date",
        F.col("closing_balance").cast("double").alias("closing_balance"),
        F.col("cash_gap_amount").cast("double").alias("cash_gap_amount"),
    )


@query(
    "G18_deferral_window",
    with_sql(
        tb.DAYS_SQL,
        """planned AS (SELECT client_id, date, overdraft, opening + sum(credit - debit) OVER (PARTITION BY client_id ORDER BY date) AS plan FROM days)""",
        """SELECT client_id, strftime(date, '%Y-%m') AS month, CAST(max(greatest(-overdraft - plan, 0)) AS DOUBLE) AS most_carried
           FROM planned GROUP BY 1, 2""",
    ),
)
def deferral_window(spark, sf_dir):
    rows = ledger.deferral_schedule(tb.stressed_days(spark, sf_dir))
    return rows.groupBy("client_id", S.month_of(F.col("date")).alias("month")).agg(
        F.max("carried").cast("double").alias("most_carried")
    )


# Sorts and limits ------------------------------------------------------------------------------------------------


@query("H01_sorted_series", with_sql(tb.CANONICAL_SQL, TOTALS_SQL, "SELECT series_id, month, net_flow FROM totals ORDER BY series_id, month"))
def sorted_series(spark, sf_dir):
    totals = forecast.series_totals(tb.canonical(spark, sf_dir), scale=2)
    return totals.select("series_id", "month", "net_flow").orderBy("series_id", "month")


@query("H02_prediction_order", with_sql(tb.SCORES_SQL, "SELECT id, month, score FROM scores ORDER BY score DESC, month DESC"))
def prediction_order(spark, sf_dir):
    return tb.scores(spark, sf_dir).select("id", "month", "score").orderBy(F.desc("score"), F.desc("month"))


@query(
    "H03_top_tenth",
    with_sql(
        tb.SCORES_SQL,
        """SELECT id, score FROM scores QUALIFY row_number() OVER (ORDER BY score DESC, id)
             <= (SELECT greatest(1, CAST(ceil(count(*) * 0.10) AS BIGINT)) FROM scores)""",
    ),
)
def top_tenth(spark, sf_dir):
    return scoring.top_share(tb.scores(spark, sf_dir), ["id"]).select("id", "score")


@query("H04_top_fifty", "SELECT c_name AS feature, c_acctbal AS importance FROM customer ORDER BY importance DESC, feature LIMIT 50")
def top_fifty(spark, sf_dir):
    table = tb.table(spark, sf_dir, "customer").select(F.col("c_name").alias("feature"), F.col("c_acctbal").alias("importance"))
    return table.orderBy(F.desc("importance"), "feature").limit(50)


_SEVERITY_SQL = """strength AS (SELECT *, (total_credit - lag(total_credit) OVER w) / greatest(abs(lag(total_credit) OVER w), 1) AS credits,
    (total_debit - lag(total_debit) OVER w) / greatest(abs(lag(total_debit) OVER w), 1) AS debits,
    net_flow / greatest(abs(avg(total_credit) OVER six), 1) AS net,
    (credit_count - lag(credit_count) OVER w) / greatest(abs(lag(credit_count) OVER w), 1) AS counts,
    (avg_debit_operation - lag(avg_debit_operation) OVER w) / greatest(abs(lag(avg_debit_operation) OVER w), 1) AS sizes,
    stddev_samp(total_credit) OVER six / greatest(abs(avg(total_credit) OVER six), 1) AS volatility,
    sum(CASE WHEN net_flow >= 0 THEN 1 ELSE 0 END) OVER w AS run
    FROM ratios WINDOW w AS (PARTITION BY client_id ORDER BY month),
      six AS (PARTITION BY client_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
  streaks AS (SELECT *, count(*) FILTER (WHERE net_flow < 0) OVER (PARTITION BY client_id, run ORDER BY month) AS streak FROM strength),
  severities AS (SELECT client_id, month, unnest(['credit_decline', 'debit_growth', 'negative_flow', 'negative_streak',
      'credit_count_decline', 'average_debit_growth', 'credit_volatility']) AS reason, unnest([1, 2, 3, 4, 5, 6, 7]) AS place,
    unnest([greatest(-coalesce(credits, 0), 0), greatest(coalesce(debits, 0), 0), greatest(-coalesce(net, 0), 0), streak / 3.0,
      greatest(-coalesce(counts, 0), 0), greatest(coalesce(sizes, 0), 0), coalesce(volatility, 0)]) AS severity FROM streaks),
  placed AS (SELECT *, row_number() OVER (PARTITION BY client_id, month ORDER BY severity DESC, place) AS rank FROM severities),
  reasons AS (SELECT client_id, month, list(reason ORDER BY rank) FILTER (WHERE severity > 0 AND rank <= 3) AS names FROM placed GROUP BY 1, 2),
  filled AS (SELECT client_id, month, list_concat(coalesce(names, []), ['no_negative_signal', 'stable_trend', 'low_volatility']) AS names FROM reasons)"""
_REASONS = with_sql(
    tb.CANONICAL_SQL,
    FEATURES_SQL,
    _SEVERITY_SQL,
    "SELECT client_id, month, names[1] AS top_reason_1, names[2] AS top_reason_2, names[3] AS top_reason_3 FROM filled",
)


@query("H05_top_reasons", _REASONS)
def top_reasons(spark, sf_dir):
    explained = explain.with_reasons(_history(spark, sf_dir))
    return explained.select("client_id", "month", "top_reason_1", "top_reason_2", "top_reason_3")


@query(
    "H06_newest_first",
    "SELECT o_orderkey AS run_id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, run_id DESC LIMIT 20",
)
def newest_first(spark, sf_dir):
    runs = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return sinks.newest_first(runs, limit=20, tie="run_id")


# Forecasts -------------------------------------------------------------------------------------------------------


@query(
    "K01_prepared_series",
    with_sql(*_PREPARED, "SELECT series_id, month, total_credit_sum, total_debit_sum, net_flow, split FROM prepared"),
)
def prepared_series(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return rows.select("series_id", "month", "total_credit_sum", "total_debit_sum", "net_flow", "split")


_SPLIT_SQL = """ends AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY month DESC) AS back,
    row_number() OVER (ORDER BY month) AS place FROM total_series), sizes AS (
  SELECT *, least(greatest(2, CAST(ceil(n * 0.2) AS INT)), n - 4) AS size FROM ends), split AS (
  SELECT series_id, month, value, kind, place, CASE WHEN back <= size THEN 'test' ELSE 'context' END AS split,
    CASE WHEN back <= size THEN CAST(size + 1 - back AS INT) END AS step, CAST(n - size AS INT) AS history FROM sizes)"""


def _total_split(spark, sf_dir):
    return forecast.split_series(forecast.total_series(tb.canonical(spark, sf_dir), scale=2))


@query(
    "K02_whole_series_split",
    with_sql(tb.CANONICAL_SQL, TOTAL_SERIES_SQL, _SPLIT_SQL, "SELECT series_id, month, value, split, step, history FROM split"),
)
def whole_series_split(spark, sf_dir):
    return _total_split(spark, sf_dir).select("series_id", "month", "value", "split", "step", "history")


_NAIVE_SQL = """changes AS (SELECT series_id, stddev_pop(change) * 1.28 AS spread FROM (
    SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY month) AS change FROM prepared WHERE split = 'context')
    GROUP BY series_id), naive AS (
  SELECT t.series_id, t.month || '-01' AS date, t.value AS actual, c.value AS forecast,
    c.value - s.spread AS lower_bound, c.value + s.spread AS upper_bound, 'net_flow' AS target
  FROM prepared t JOIN changes s USING (series_id) JOIN prepared c ON c.series_id = t.series_id
    AND c.place = CASE WHEN t.history + t.step - 1 >= 12 THEN t.history + t.step - 12 ELSE t.history END
  WHERE t.split = 'test')"""


def _naive(spark, sf_dir):
    return forecast.seasonal_naive(prepared(spark, sf_dir), "net_flow", 3)


@query(
    "K03_seasonal_naive",
    with_sql(
        *_PREPARED,
        _NAIVE_SQL,
        "SELECT series_id, date, actual, forecast, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, target FROM naive",
    ),
)
def seasonal_naive(spark, sf_dir):
    rows = _naive(spark, sf_dir)
    return rows.withColumns({name: F.round(name, 4) for name in ("lower_bound", "upper_bound")})


@query(
    "K04_seasonal_naive_total",
    with_sql(
        tb.CANONICAL_SQL,
        TOTAL_SERIES_SQL,
        _SPLIT_SQL,
        """seasoned AS (SELECT *, least(12, greatest(1, history // 2)) AS season FROM split),
           seasonal AS (SELECT sqrt(avg((a.value - b.value) * (a.value - b.value))) AS deviation FROM seasoned a
             JOIN seasoned b ON b.place = a.place - a.season WHERE a.split = 'context')""",
        """SELECT t.series_id, t.month, t.step, t.value AS actual, c.value AS forecast,
             round(c.value - 1.28 * deviation * sqrt((t.step - 1) // t.season + 1), 3) AS lower_bound,
             round(c.value + 1.28 * deviation * sqrt((t.step - 1) // t.season + 1), 3) AS upper_bound
           FROM seasoned t JOIN seasoned c ON c.place = t.history - t.season + (t.step - 1) % t.season + 1, seasonal WHERE t.split = 'test'""",
    ),
)
def seasonal_naive_total(spark, sf_dir):
    rows = forecast.seasonal_naive_total(_total_split(spark, sf_dir))
    return rows.withColumns({name: F.round(name, 3) for name in ("lower_bound", "upper_bound")})


@query("K05_exponential_smoothing")
def exponential_smoothing(spark, sf_dir):
    return seriesmodels.exponential_smoothing(prepared(spark, sf_dir))


@query("K06_autoregression")
def autoregression(spark, sf_dir):
    return seriesmodels.autoregression(prepared(spark, sf_dir))


@query("K07_recursive_lags")
def recursive_lags(spark, sf_dir):
    split = forecast.split_series(forecast.total_series(tb.canonical(spark, sf_dir), scale=2), horizon=3)
    return lagmodels.recursive_lag_forecast(split)


@query("K08_pooled_lags")
def pooled_lags(spark, sf_dir):
    return lagmodels.pooled_lag_forecast(prepared(spark, sf_dir), "net_flow", 3)


@query("K09_trend_season")
def trend_season(spark, sf_dir):
    return seriesmodels.trend_season_forecast(prepared(spark, sf_dir), "net_flow")


@query(
    "K10_quantiles",
    with_sql(
        *_PREPARED,
        """moves AS (SELECT a.series_id, b.place - a.place AS step, b.value - a.value AS change FROM prepared a
             JOIN prepared b ON a.series_id = b.series_id AND b.place - a.place BETWEEN 1 AND 3 WHERE a.split = 'context' AND b.split = 'context'),
           spread AS (SELECT series_id, step, quantile_cont(change, 0.1) AS low, quantile_cont(change, 0.5) AS middle, quantile_cont(change, 0.9) AS high
             FROM moves GROUP BY series_id, step)""",
        """SELECT t.series_id, t.month || '-01' AS date, round(t.value, 4) AS actual, round(c.value + middle, 4) AS forecast,
             round(c.value + low, 4) AS lower_bound, round(c.value + middle, 4) AS median, round(c.value + high, 4) AS upper_bound, 'net_flow' AS target
           FROM prepared t JOIN prepared c ON c.series_id = t.series_id AND c.place = t.history
           JOIN spread q ON q.series_id = t.series_id AND q.step = t.step WHERE t.split = 'test'""",
    ),
)
def quantiles(spark, sf_dir):
    rows = seriesmodels.quantile_forecast(prepared(spark, sf_dir), "net_flow", 3)
    return rows.withColumns({name: F.round(name, 4) for name in ("actual", "forecast", "lower_bound", "median", "upper_bound")})


@query(
    "K11_pooled_metrics",
    with_sql(
        *_PREPARED,
        _NAIVE_SQL,
        """SELECT round(avg(abs(actual - forecast)), 4) AS mae, round(sqrt(avg((actual - forecast) * (actual - forecast))), 4) AS rmse,
             round(sum(abs(actual - forecast)) / sum(abs(actual)), 9) AS wape, count(*) AS test_rows FROM naive""",
    ),
)
def pooled_metrics(spark, sf_dir):
    metrics = forecast.pooled_metrics(_naive(spark, sf_dir))
    return metrics.select(
        F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("wape", 9).alias("wape"), "test_rows"
    )


@query(
    "K12_mase",
    with_sql(
        *_PREPARED,
        _NAIVE_SQL,
        """scales AS (SELECT series_id, avg(abs(change)) AS scale FROM (
             SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY month) AS change FROM prepared WHERE split = 'context')
             GROUP BY series_id), errors AS (SELECT series_id, avg(abs(actual - forecast)) AS error FROM naive GROUP BY series_id)""",
        "SELECT round(avg(error / scale), 9) AS mase FROM errors JOIN scales USING (series_id) WHERE scale > 0",
    ),
)
def mase(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    measured = forecast.mase(_naive(spark, sf_dir), rows.where("split = 'context'"))
    return measured.select(F.round("mase", 9).alias("mase"))


@query(
    "K13_coverage",
    with_sql(
        *_PREPARED,
        """SELECT count(DISTINCT series_id) FILTER (WHERE history % 2 = 0) AS processed_series,
             count(DISTINCT series_id) FILTER (WHERE history % 2 <> 0) AS failed_series,
             round(count(DISTINCT series_id) FILTER (WHERE history % 2 <> 0) / count(DISTINCT series_id), 9) AS error_rate FROM prepared""",
    ),
)
def coverage(spark, sf_dir):
    """A model that only manages series with an even history."""
    rows = prepared(spark, sf_dir)
    done = rows.where("split = 'test' and history % 2 = 0")
    return forecast.coverage(done, rows.where("split = 'context'")).withColumn("error_rate", F.round("error_rate", 9))


_LAST_VALUE_SQL = """last_value_model AS (SELECT t.series_id, t.value AS actual, c.value AS forecast FROM prepared t
  JOIN prepared c ON c.series_id = t.series_id AND c.place = t.history WHERE t.split = 'test')"""


def _last_value(data, contract, parameters):
    """Seasonal-naive forecast with a season of one month."""
    return forecast.seasonal_naive(data, contract.target, contract.horizon, season=1)


def _benchmark(spark, sf_dir):
    contract = compare.Contract("net_flow", horizon=3)
    registry = {"naive": compare.MODELS["seasonal_naive"], "last_value": (compare.FORECASTING, _last_value)}
    return compare.run_benchmark(tb.canonical(spark, sf_dir), ["naive", "last_value", "naive"], contract, registry=registry, scale=2)


@query(
    "K14_benchmark",
    with_sql(
        *_PREPARED,
        _NAIVE_SQL,
        _LAST_VALUE_SQL,
        """SELECT 'naive' AS model_id, series_id, actual, forecast FROM naive
           UNION ALL SELECT 'last_value', series_id, actual, forecast FROM last_value_model""",
    ),
)
def benchmark(spark, sf_dir):
    return _benchmark(spark, sf_dir).predictions.select("model_id", "series_id", "actual", "forecast")


@query(
    "K15_comparison",
    with_sql(
        *_PREPARED,
        _NAIVE_SQL,
        _LAST_VALUE_SQL,
        """every AS (SELECT 'naive' AS model_id, actual, forecast FROM naive
             UNION ALL SELECT 'last_value', actual, forecast FROM last_value_model)""",
        """SELECT model_id, round(avg(abs(actual - forecast)), 4) AS mae, round(sum(abs(actual - forecast)) / sum(abs(actual)), 9) AS wape,
             CAST(count(*) AS DOUBLE) AS test_rows, CAST(0 AS DOUBLE) AS failed_series FROM every GROUP BY model_id""",
    ),
)
def comparison(spark, sf_dir):
    table = compare.compare(_benchmark(spark, sf_dir).metrics)
    return table.select(
        "model_id", F.round("mae", 4).alias("mae"), F.round("wape", 9).alias("wape"), "test_rows", "failed_series"
    )


@query(
    "K16_stored_series",
    with_sql(
        tb.LINES_SQL,
        "SELECT 'TOTAL' AS series_id, date, CAST(sum(credit) - sum(debit) AS DOUBLE) AS value, 'net_flow' AS kind FROM lines GROUP BY date",
    ),
)
def stored_series(spark, sf_dir):
    flows = tb.lines(spark, sf_dir).select("date", (F.col("credit") - F.col("debit")).alias("net_flow"))
    return forecast.stored_series(flows).withColumn("value", F.col("value").cast("double"))
