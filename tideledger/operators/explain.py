"""Reasons behind a risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.ml.functions import vector_to_array

# Reason codes in order, with the text shown to users.
REASONS = {
    "credit_decline": "снижение поступлений",
    "debit_growth": "рост расходов",
    "negative_flow": "отрицательный денежный поток",
    "negative_streak": "несколько отрицательных месяцев подряд",
    "credit_count_decline": "снижение количества входящих операций",
    "average_debit_growth": "рост среднего исходящего платежа",
    "credit_volatility": "высокая волатильность поступлений",
}
# What fills up the three reasons where fewer apply.
FALLBACKS = {
    "no_negative_signal": "нет выраженного негативного сигнала",
    "stable_trend": "стабильная динамика",
    "low_volatility": "низкая текущая волатильность",
}
# Parts of feature names whose contributions count towards a reason.
REASON_FEATURES = {
    "credit_decline": ("total_credit_change", "credit_trend", "credit_sum__"),
    "debit_growth": ("total_debit_change", "debit_trend", "debit_sum__"),
    "negative_flow": ("net_flow",),
    "negative_streak": ("negative_flow_months", "negative_flow_streak"),
    "credit_count_decline": ("credit_count_change", "credit_count_decline"),
    "average_debit_growth": ("avg_debit_operation_change",),
    "credit_volatility": ("credit_volatility", "total_credit_std"),
}
SEVERITY_INPUTS = (
    "total_credit_mean_6",
    "total_credit_change_pct",
    "total_debit_change_pct",
    "net_flow",
    "negative_flow_streak",
    "credit_count_change_pct",
    "avg_debit_operation_change_pct",
    "credit_volatility_6",
)


def severities(columns: list[str]) -> dict[str, Column]:
    """How strongly each reason applies, from the features of the same month; a missing feature counts as 0."""

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)

    def rise(signed: Column) -> Column:
        return F.greatest(signed, F.lit(0.0))

    scale = F.greatest(F.abs(value("total_credit_mean_6")), F.lit(1.0))
    return {
        "credit_decline": rise(-value("total_credit_change_pct")),
        "debit_growth": rise(value("total_debit_change_pct")),
        "negative_flow": rise(-value("net_flow") / scale),
        "negative_streak": value("negative_flow_streak") / 3.0,
        "credit_count_decline": rise(-value("credit_count_change_pct")),
        "average_debit_growth": rise(value("avg_debit_operation_change_pct")),
        "credit_volatility": value("credit_volatility_6"),
    }


def linear_contributions(scaled: str, coefficients: list[float]) -> Column:
    """Signed contribution of every feature of a linear model: standardized value times coefficient."""
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    return F.zip_with(vector_to_array(F.col(scaled)), weights, lambda x, c: x * c)


def contribution_scores(contributions: Column, feature_names: list[str]) -> dict[str, Column]:
    """Positive contributions per reason, divided by the largest of the row."""

    def collected(parts: tuple[str, ...]) -> Column:
        places = [i for i, name in enumerate(feature_names) if any(part in name for part in parts)]
        if not places:
            return F.lit(0.0)
        picked = F.transform(F.array(*[F.lit(i + 1) for i in places]), lambda i: F.element_at(contributions, i))
        return F.aggregate(picked, F.lit(0.0), lambda total, x: total + F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))

    raw = {reason: collected(parts) for reason, parts in REASON_FEATURES.items()}
    largest = F.greatest(*raw.values())
    return {reason: score / F.when(largest > 0, largest).otherwise(F.lit(1.0)) for reason, score in raw.items()}


def with_reasons(
    df: DataFrame, contributions: str | None = None, feature_names: list[str] | None = None, texts: bool = False
) -> DataFrame:
    """Adds ``top_reason_1..3``: the reasons with the greatest positive severity, in reason order where equal.

    ``contributions`` names an array column of signed contributions in the order of ``feature_names``. Codes are
    written unless ``texts`` asks for the user texts.
    """
    strength = severities(df.columns)
    if contributions is not None and feature_names is not None:
        extra = contribution_scores(F.col(contributions), feature_names)
        strength = {reason: strength[reason] + extra[reason] for reason in strength}
    shown = REASONS if texts else {code: code for code in REASONS}
    entries = F.array(
        *[
            F.struct((-strength[reason]).alias("minus"), F.lit(place).alias("place"), F.lit(shown[reason]).alias("reason"))
            for place, reason in enumerate(REASONS)
        ]
    )
    positive = F.filter(F.array_sort(entries), lambda entry: entry["minus"] < 0)
    fallback = F.array(*[F.lit(text if texts else code) for code, text in FALLBACKS.items()])
    names = F.concat(F.transform(positive, lambda entry: entry["reason"]), fallback)
    # With fewer than three reasons the fallbacks follow in their own order, starting with the first.
    return df.withColumn("_reasons", names).select(
        *df.columns, *[F.element_at("_reasons", place).alias(f"top_reason_{place}") for place in (1, 2, 3)]
    )
