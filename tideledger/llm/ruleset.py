"""Quality classifier as a sparse rule ensemble.

Trees grown over text statistics give their paths as rules, conjunctions of bounds. A logistic regression with an L1
penalty weighs rules and clipped statistics and sets most weights to zero. What is left is compiled into one Spark
column expression, so scoring needs no model object and no library.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

STATISTICS = [
    "words", "word_length", "long_words", "distinct_words", "repeats", "upper", "digits", "symbols", "stops", "pipes", "lines", "same_lines", "wide", "spaces",
]
#: Labelled rows the classifier is fitted on: all, or about so many chosen by a hash of the key if there are more.
TRAINING_ROWS = 100_000
TREES, DEPTH = 16, 3

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"!#$%&*+<=>@\\^_`{|}~"
_STOPS = b".,;:?"
_SPACES = b" \t\r\n\x0b\x0c"


def measure(text: str | None) -> tuple[float, ...]:
    """Statistics of a text, in the order of STATISTICS; all zero for a null or blank text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    size, n = len(data), len(words)
    part = lambda kinds: (size - len(data.translate(None, kinds))) / size
    inside = sum(map(len, words))
    lines = data.split(b"\n")
    return (
        math.log1p(n), inside / n, max(map(len, words)) / 100.0, len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, part(_UPPER), part(_DIGITS), part(_SYMBOLS), part(_STOPS),
        data.count(b"|") / n, len(lines) / n, 1 - len(set(lines)) / len(lines), 1 - len(text or "") / size, part(_SPACES),
    )


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>`` and one double per statistic, over whole texts."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([measure(t) for t in batch], columns=STATISTICS)

    made = F.pandas_udf(work, ", ".join(f"{name} double" for name in STATISTICS))
    return docs.select(F.col(key), made(F.col(text).cast("string")).alias("_s")).select(key, "_s.*")


Rule = tuple[tuple[str, float, float], ...]  # (statistic, above, up to), sorted by statistic


@dataclass
class Ensemble:
    """Intercept, weights of rules, and weights of statistics with the bounds they are clipped to."""

    intercept: float
    rules: dict[Rule, float] = field(default_factory=dict)
    linear: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules.items():
            total = total + F.when(condition(rule), weight).otherwise(0.0)
        for name, (weight, low, high) in self.linear.items():
            total = total + F.lit(weight) * clipped(name, low, high)
        return 1 / (1 + F.exp(-total))


def condition(rule: Rule) -> Column:
    found = F.lit(True)
    for name, above, most in rule:
        if above > -math.inf:
            found = found & (F.col(name) > above)
        if most < math.inf:
            found = found & (F.col(name) <= most)
    return found


def clipped(name: str, low: float, high: float) -> Column:
    return F.greatest(F.least(F.col(name), F.lit(high)), F.lit(low))


def paths(node, names: list[str], bounds: dict[str, tuple[float, float]] | None = None) -> Iterator[Rule]:
    """Rules of all nodes below a node of a fitted tree."""
    bounds = bounds or {}
    if bounds:
        yield tuple(sorted((name, *ends) for name, ends in bounds.items()))
    if not hasattr(node, "split") or node.getClass().getSimpleName() != "InternalNode":
        return
    name, at = names[node.split().featureIndex()], node.split().threshold()
    low, high = bounds.get(name, (-math.inf, math.inf))
    yield from paths(node.leftChild(), names, bounds | {name: (low, min(high, at))})
    yield from paths(node.rightChild(), names, bounds | {name: (max(low, at), high)})


def fit(labelled: DataFrame, label: str = "label", key: str = "doc_id", penalty: float = 0.002, seed: int = 7) -> Ensemble:
    """Fit on rows of statistics with a 0/1 label. Without both labels the score is the smoothed share of label 1."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    total, ones = sum(counts.values()), counts.get(1, 0)
    if not ones or ones == total:
        return Ensemble(math.log((ones + 0.5) / (total - ones + 0.5)))
    part = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * min(1.0, TRAINING_ROWS / total) + 0.5)
    rows = labelled.filter(part).select(*STATISTICS, F.col(label).cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=10, subsamplingRate=0.7, featureSubsetStrategy="sqrt", seed=seed)
        grown = forest.fit(rows.select(array_to_vector(F.array(*STATISTICS)).alias("features"), "label"))
        rules = sorted({rule for tree in grown.trees for rule in paths(tree._call_java("rootNode"), STATISTICS)})
        ends = rows.select(*[F.percentile_approx(n, [0.025, 0.975], 1000).alias(n) for n in STATISTICS]).first()
        made = [F.when(condition(r), 1.0).otherwise(0.0) for r in rules] + [clipped(n, *ends[n]) for n in STATISTICS]
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60)
        model = lasso.fit(rows.select(array_to_vector(F.array(*made)).alias("features"), "label").persist(StorageLevel.MEMORY_AND_DISK))
    finally:
        rows.unpersist()
    weights = [float(w) for w in model.coefficients.toArray()]
    return Ensemble(
        float(model.intercept),
        {r: w for r, w in zip(rules, weights) if w},
        {n: (w, *ends[n]) for n, w in zip(STATISTICS, weights[len(rules) :]) if w},
    )


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One 0/1 label per key: the more frequent one, 1 if both are as frequent. Null keys and labels are left out."""
    kept = labels.select(F.col(key), F.col(label).cast("int").alias("label")).dropna()
    return kept.groupBy(key).agg(F.when(F.avg("label") >= 0.5, 1).otherwise(0).alias("label"))


def score(measured: DataFrame, ensemble: Ensemble, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """``<key>, score, predicted`` for rows of statistics.

    A null or blank text has all statistics zero and gets the score of those. Repeated rows get the same score each.
    """
    return measured.select(key, ensemble.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
