"""Scoring and evaluation: temporal split, ranks, thresholds, ranking metrics.

Everything that depends on the order of scores works on the distinct scores first, so a score shared by a third of
all rows is one row, and walks the order with range-partitioned running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideledger.functions.scalars import flag, risk_group
from tideledger.operators.ordered import greatest, running, with_percentile
from tideledger.session import stage


def split_months(months: list[str], train: float = 0.6, validation: float = 0.2) -> dict[str, list[str]]:
    """Ordered months cut into train, validation and test; at least two months are left for the test."""
    count = len(months)
    if count < 6:
        raise ValueError("A temporal split needs at least six months")
    first = max(2, int(count * train))
    second = min(max(first + 2, int(count * (train + validation))), count - 2)
    return {"train": months[:first], "validation": months[first:second], "test": months[second:]}


def with_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, month: str = "month") -> DataFrame:
    """Adds ``split``. Only the list of distinct months comes to the driver."""
    months = sorted(row[0] for row in df.select(month).distinct().collect())
    parts = split_months(months, train, validation)
    in_train, in_validation = F.col(month).isin(parts["train"]), F.col(month).isin(parts["validation"])
    return df.withColumn("split", F.when(in_train, "train").when(in_validation, "validation").otherwise("test"))


def score_table(
    scored: DataFrame, threshold: float, score: str = "risk_score", month: str = "month", client: str = "client_id"
) -> DataFrame:
    """Adds predicted class, rank within the month (1 = riskiest) and risk group."""
    placed = with_percentile(scored, [month], score, [client])
    return placed.select(
        *scored.columns,
        flag(F.col(score) >= threshold).alias("predicted_cash_gap"),
        F.col("row_number").alias("risk_rank"),
        "percentile",
        risk_group(F.col("percentile")).alias("risk_group"),
    )


def score_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score: rows and positives with exactly, and with at least, that score."""
    distinct = df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positives")
    )
    return running(distinct, [], [F.col("score").desc()], {"rows_above": "rows", "positives_above": "positives"})


def best_threshold(curve: DataFrame, default: float = 0.5) -> DataFrame:
    """Lowest of the thresholds with the greatest F1 (one row: threshold, f1); the default without any score."""
    positives = curve.agg(F.coalesce(F.sum("positives"), F.lit(0))).first()[0]
    f1 = F.when(
        F.col("positives_above") > 0, 2.0 * F.col("positives_above") / (F.col("rows_above") + F.lit(positives))
    ).otherwise(F.lit(0.0))
    # Greatest F1 first, then the lowest score: one reduction instead of a sort.
    best = curve.select(F.struct(f1.alias("f1"), (-F.col("score")).alias("minus")).alias("pick")).agg(
        F.max("pick").alias("pick")
    )
    return best.select(
        F.coalesce(-F.col("pick.minus"), F.lit(default)).alias("threshold"), F.col("pick.f1").alias("f1")
    )


def ranking_metrics(curve: DataFrame) -> DataFrame:
    """Average precision (step-wise) and ROC-AUC (ties count half); null unless both classes occur."""
    totals = curve.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("positives"), F.lit(0)).alias("p")
    ).first()
    positives, negatives = totals["p"], totals["n"] - totals["p"]
    both = positives > 0 and negatives > 0
    step = F.col("positives") * (F.col("positives_above") / F.col("rows_above"))
    # Every negative at this score is outranked by the positives above it, and ties with half of those beside it.
    won = (F.col("rows") - F.col("positives")) * (F.col("positives_above") - F.col("positives") / 2.0)
    return curve.agg(
        (F.sum(step) / float(positives or 1)).alias("pr_auc"),
        (F.sum(won) / (float(positives or 1) * float(negatives or 1))).alias("roc_auc"),
    ).select(*[(F.col(name) if both else F.lit(None).cast("double")).alias(name) for name in ("pr_auc", "roc_auc")])


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """True/false negatives and positives at a threshold."""
    above, positive = F.col(score) >= threshold, F.col(label) == 1
    cells = {"tn": ~above & ~positive, "fp": above & ~positive, "fn": ~above & positive, "tp": above & positive}
    return df.agg(*[F.coalesce(F.sum(flag(cell)), F.lit(0)).alias(name) for name, cell in cells.items()])


def threshold_metrics(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall, F1 (0 where undefined), Brier score, positive rate and rows."""
    above, positive = F.col(score) >= threshold, F.col(label) == 1

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    sums = df.agg(
        F.sum(flag(above & positive)).alias("tp"),
        F.sum(flag(above)).alias("marked"),
        F.sum(flag(positive)).alias("real"),
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier_score"),
        F.avg(F.col(label).cast("double")).alias("test_positive_rate"),
        F.count(F.lit(1)).alias("test_rows"),
    )
    return sums.select(
        ratio(F.col("tp"), F.col("marked")).alias("precision"),
        ratio(F.col("tp"), F.col("real")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("marked") + F.col("real")).alias("f1"),
        "brier_score",
        "test_positive_rate",
        "test_rows",
    )


def top_share(df: DataFrame, tie: list[str], share: float = 0.10, score: str = "score") -> DataFrame:
    """The ``ceil(share * n)`` best-scored rows, at least one; equal scores are taken in the order of ``tie``."""
    rows = stage(df)
    count = rows.count()
    return greatest(rows, score, max(1, -int(-count * share // 1)), tie) if count else rows


def top_metrics(df: DataFrame, tie: list[str], share: float = 0.10, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall among the best-scored share; recall is 0 without positives."""
    positives = df.agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()[0]
    hits = F.sum(F.col(label).cast("long"))
    recall = hits / F.lit(float(positives)) if positives else F.lit(0.0)
    return top_share(df.select(score, label, *tie), tie, share, score).agg(
        F.avg(F.col(label).cast("double")).alias("precision_at_top_10"), recall.alias("recall_at_top_10")
    )


def classification_metrics(
    df: DataFrame, threshold: float, tie: list[str], score: str = "score", label: str = "label"
) -> dict:
    """All metrics of one scored test set; only the one-row results come to the driver."""
    curve = stage(score_curve(df, score, label))
    parts = [
        ranking_metrics(curve),
        threshold_metrics(df, threshold, score, label),
        top_metrics(df, tie, 0.10, score, label),
        confusion(df, threshold, score, label),
    ]
    result = {name: value for part in parts for name, value in part.first().asDict().items()}
    cells = [result.pop(name) for name in ("tn", "fp", "fn", "tp")]
    return {**result, "confusion_matrix": [cells[:2], cells[2:]], "threshold": threshold}
