"""Point-in-time features per client and month.

One wide hash aggregation gives totals, activity and the label pivot together; one window per client gives every lag,
rolling and streak column. No feature looks at a later month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideledger.functions.scalars import flag, guarded_ratio
from tideledger.schemas import LABELS, MEASURES, check_target_name

KEYS = ["client_id", "month"]
TARGET = "cash_gap_next_month"
TOTALS = {
    "debit_sum": "total_debit",
    "credit_sum": "total_credit",
    "debit_nonzero_count": "debit_count",
    "credit_nonzero_count": "credit_count",
}
CORE = [
    "total_debit",
    "total_credit",
    "net_flow",
    "debit_count",
    "credit_count",
    "avg_credit_operation",
    "avg_debit_operation",
    "credit_to_debit_ratio",
]
CHANGES = ["total_credit", "total_debit", "credit_count", "debit_count", "avg_debit_operation"]
LAGS = (1, 2, 3, 6)
SPANS = (3, 6)


def discover_labels(canonical: DataFrame) -> list[str]:
    """Labels present in a table. They become columns, so they are few by nature: all of them come to the driver."""
    return sorted(row[0] for row in canonical.select("transaction_label").dropna().distinct().collect())


def pivot_labels(canonical: DataFrame, labels: list[str] | None = None, extra_labels: list[str] = ()) -> list[str]:
    """Labels to pivot: the given ones and the extra ones, or all standard ones and every other one in the table."""
    base = list(LABELS) + discover_labels(canonical) if labels is None else list(labels)
    return list(dict.fromkeys(base + list(extra_labels)))


def pivot_columns(labels: list[str]) -> list[str]:
    return [f"{measure}__{label}" for measure in MEASURES for label in labels]


def quoted(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col(f"`{name}`")


def _sum(value: Column, scale: int | None) -> Column:
    return F.sum(value if scale is None else value.cast(f"decimal(18,{scale})")).cast("double")


def monthly_totals(
    canonical: DataFrame, labels: list[str] | None = None, extra_labels: list[str] = (), scale: int | None = None
) -> DataFrame:
    """Totals, ratios, activity and label pivot per client-month, from one aggregation.

    Without ``labels`` every label in the table gets its columns, found by one pass over the label column.
    """
    every = pivot_labels(canonical, labels, extra_labels)

    def total(measure: str, condition: Column | None = None) -> Column:
        value = F.col(measure) if condition is None else F.when(condition, F.col(measure)).otherwise(0)
        if measure.endswith("_count"):
            return F.sum(value.cast("long")).cast("double")
        return _sum(value, scale)

    sums = [total(measure).alias(name) for measure, name in TOTALS.items()]
    active = F.sum(flag(F.col("debit_sum") + F.col("credit_sum") > 0)).alias("active_categories")
    pivot = [
        total(measure, F.col("transaction_label") == label).alias(f"{measure}__{label}")
        for measure in MEASURES
        for label in every
    ]
    grouped = canonical.groupBy(*KEYS).agg(*sums, active, *pivot)
    ratios = [
        (F.col("total_credit") - F.col("total_debit")).alias("net_flow"),
        guarded_ratio(F.col("total_credit"), F.col("credit_count")).alias("avg_credit_operation"),
        guarded_ratio(F.col("total_debit"), F.col("debit_count")).alias("avg_debit_operation"),
        guarded_ratio(F.col("total_credit"), F.col("total_debit")).alias("credit_to_debit_ratio"),
        guarded_ratio(F.col("credit_count"), F.col("debit_count")).alias("credit_to_debit_count_ratio"),
    ]
    return grouped.select(
        *KEYS, *TOTALS.values(), *ratios, "active_categories", *[quoted(name) for name in pivot_columns(every)]
    )


MONTHS = "PARTITION BY client_id ORDER BY month"


def _over(back: int | None = None) -> str:
    """Window text over the client's months: the whole order, or the last ``back`` rows up to this one."""
    rows = "" if back is None else f" ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW"
    return f"OVER ({MONTHS}{rows})"


def add_history(totals: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Lag, rolling, change, trend and streak columns; all share one window order, hence one sort.

    Written as SQL text: with some two hundred columns, one string per column plans much faster than column objects.
    """
    amounts = [f"{direction}_sum__{label}" for direction in ("debit", "credit") for label in labels]
    lags = [f"lag(`{name}`, {back}) {_over()} AS `{name}_lag_{back}`" for back in LAGS for name in CORE + amounts]
    rolling = [
        f"{function}({name}) {_over(span)} AS {name}_{suffix}_{span}"
        for span in SPANS
        for name in CORE
        for function, suffix in (("avg", "mean"), ("stddev_samp", "std"))
    ]
    runs = [
        f"sum(if(net_flow < 0, 1L, 0L)) {_over(6)} AS negative_flow_months_6",
        # Length of the run of negative months: this row's place less the place of the latest other month.
        f"_place - coalesce(max(if(net_flow < 0, NULL, _place)) {_over()}, 0) AS negative_flow_streak",
    ]
    # The place is numbered first, while rows are narrow.
    placed = totals.selectExpr("*", f"row_number() {_over()} AS _place")
    windowed = placed.selectExpr("*", *lags, *rolling, *runs).drop("_place")

    changes = []
    for name in CHANGES:
        change = f"{name} - {name}_lag_1"
        changes.append(f"{change} AS {name}_change")
        changes.append(f"({change}) / greatest(abs({name}_lag_1), 1D) AS {name}_change_pct")
    trends = [f"(total_{side} - total_{side}_lag_2) / 2 AS {side}_trend_3" for side in ("credit", "debit")]
    moved = windowed.selectExpr("*", *changes, *trends)
    # A missing change stays missing; greatest() alone would turn it into 0.
    return moved.selectExpr(
        "*",
        "if(credit_count_change_pct IS NULL, NULL, greatest(-credit_count_change_pct, 0D)) AS credit_count_decline",
        "if(debit_count_change_pct IS NULL, NULL, greatest(debit_count_change_pct, 0D)) AS debit_count_growth",
        "total_credit_std_6 / greatest(abs(total_credit_mean_6), 1D) AS credit_volatility_6",
    )


def feature_frame(
    canonical: DataFrame,
    target: DataFrame | None = None,
    labels: list[str] | None = None,
    extra_labels: list[str] = (),
    target_name: str = TARGET,
    scale: int | None = None,
) -> DataFrame:
    """Features of every client-month; with a ``target``, only months whose target is known.

    The target joins before the window, while rows are still narrow and already partitioned by (client, month); rows
    without a target stay in the history and are dropped at the end.
    """
    totals = monthly_totals(canonical, labels, extra_labels, scale)
    labels = LABELS if labels is None else labels  # these have lags too; further labels have their sums
    if target is None:
        return _only_finite(add_history(totals, labels), [])
    check_target_name(target_name)
    agreed = target.select(*KEYS, F.col(target_name).cast("int").alias(target_name))
    history = add_history(totals.join(agreed, KEYS, "left"), labels)
    return _only_finite(history.where(F.col(target_name).isNotNull()), [target_name])


def _only_finite(frame: DataFrame, target: list[str]) -> DataFrame:
    """NaN and infinite features become null."""
    infinite = "double('infinity')"
    features = [
        f"if(isnan(`{name}`) OR abs(`{name}`) = {infinite}, NULL, `{name}`) AS `{name}`"
        for name in frame.columns
        if name not in (*KEYS, *target)
    ]
    return frame.selectExpr(*KEYS, *features, *target)


def feature_columns(frame: DataFrame, target_name: str = TARGET) -> list[str]:
    return [name for name in frame.columns if name not in (*KEYS, target_name)]
