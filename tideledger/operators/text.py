"""Categorization of transaction descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IDF,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from tideledger.operators.ordered import ranked
from tideledger.session import lookup_join, stage

# Fixed value: a token is two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
DEFAULTS = {"max_features": 30_000, "max_iter": 500}
TEXT, CATEGORY = "transaction_description", "category"


def category_counts(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[TEXT, CATEGORY]).groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("rows"))


def category_gate(df: DataFrame) -> DataFrame:
    """One row: rows, categories, the smallest category, and whether training may start (20 rows, 2 categories)."""
    counts = category_counts(df).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("categories"),
        F.min("rows").alias("smallest"),
    )
    return counts.withColumn("trainable", ((F.col("rows") >= 20) & (F.col("categories") >= 2)).cast("int"))


def stratified_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """Adds ``split``: in every category the first ``ceil(share * rows)`` rows in hash order are the test.

    Hash order over a unique key is the same on every run. Ranks are computed over range partitions, so a category
    with most of the rows does not end in one task.
    """
    group = [CATEGORY] if stratify else []
    mixed = df.withColumn("_mix", F.xxhash64(F.lit(seed), F.col(key)))
    placed = stage(ranked(mixed, group, [F.col("_mix").asc(), F.col(key).asc()]))
    if stratify:
        sizes = placed.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("_size"))
        placed = lookup_join(placed, sizes, [CATEGORY])
    else:
        placed = placed.withColumn("_size", F.lit(placed.count()))
    in_test = F.col("row_number") <= F.ceil(F.col("_size") * share)
    return placed.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_mix", "row_number", "_size")


def tokens(column: str = TEXT):
    """Lower-case tokens of a text, as an expression."""
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(f"({TOKEN})"), 1)


def frequent_grams(shredded: DataFrame, most: int) -> list[str]:
    """The ``most`` words and word pairs that occur most often, ties by text; counted by one hash aggregate."""
    counts = shredded.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return [r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(most).select("gram").collect()]


class GramCounter(Estimator):
    """MLlib's count vectors over ``frequent_grams``."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        grams = frequent_grams(dataset, self.most)
        if not grams:
            raise ValueError("No text has a token")
        return CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="counts")


def _counting(max_features: int) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=TEXT, outputCol="words", pattern=TOKEN, gaps=False, toLowercase=True),
            NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
            GramCounter(max_features),
            IDF(inputCol="counts", outputCol="rarity"),
        ]
    )


@dataclass
class Categorizer:
    """A fitted categorizer with its test predictions."""

    model: PipelineModel
    predictions: DataFrame
    metrics: dict

    def categorize(self, df: DataFrame) -> DataFrame:
        """Predicted category of any number of descriptions."""
        return self.model.transform(df).select(*df.columns, "predicted_category")


def text_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and macro F1 over all categories that are actual or predicted."""
    cells = predictions.groupBy("actual_category", "predicted_category").agg(F.count(F.lit(1)).alias("rows"))
    hit = F.when(F.col("actual_category") == F.col("predicted_category"), F.col("rows")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("actual_category").alias("category"), F.col("rows").alias("mass"), hit.alias("hit")),
        F.struct(F.col("predicted_category").alias("category"), F.col("rows").alias("mass"), F.lit(0).cast("long").alias("hit")),
    )
    per_category = (
        cells.select(F.inline(sides)).groupBy("category").agg(F.sum("mass").alias("mass"), F.sum("hit").alias("hit"))
    )
    # F1 of a category is twice its hits over the rows that are, plus the rows that are called, that category.
    return per_category.agg(
        (F.sum("hit") / (F.sum("mass") / 2.0)).alias("accuracy"),
        F.avg(2.0 * F.col("hit") / F.col("mass")).alias("f1_macro"),
        (F.sum("mass") / 2).cast("long").alias("test_rows"),
    )


def train_categorizer(df: DataFrame, key: str = TEXT, requested: dict | None = None) -> Categorizer:
    """TF-IDF of words and word pairs with a balanced multinomial logistic regression; a fifth of the rows is the test."""
    params = {**DEFAULTS, **{k: v for k, v in (requested or {}).items() if k in DEFAULTS}}
    clean = stage(df.dropna(subset=[TEXT, CATEGORY]))
    gate = category_gate(clean).first()
    if not gate["trainable"]:
        raise ValueError("Training needs at least 20 rows and two categories")
    rows = stage(stratified_split(clean, key, stratify=gate["smallest"] >= 2))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    per_class = train.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("_rows"))
    count, classes = train.count(), per_class.count()
    balanced = (F.lit(count / classes) / F.col("_rows")).alias("weight")
    weighted = lookup_join(train, per_class, [CATEGORY]).select(TEXT, CATEGORY, balanced)

    labels = StringIndexer(inputCol=CATEGORY, outputCol="label", stringOrderType="alphabetAsc").fit(weighted)
    *stages, rarities = _counting(params["max_features"]).getStages()
    counting = Pipeline(stages=stages).fit(weighted)
    # Counts are read twice, texts once.
    counted = stage(labels.transform(counting.transform(weighted)).select("counts", "label", "weight"))
    idf = rarities.fit(counted)
    # MLlib's rarity is ln((1 + n) / (1 + df)); the weight wanted here is that plus one.
    rarity = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="counts", outputCol="weighted")
    scaling = [rarity, Normalizer(inputCol="weighted", outputCol="features", p=2.0)]
    shaping = [*counting.stages, *scaling]
    ready = PipelineModel(scaling).transform(counted).select("features", "label", "weight")
    fitted = LogisticRegression(
        maxIter=params["max_iter"], regParam=1.0 / count, standardization=False, weightCol="weight", family="multinomial"
    ).fit(stage(ready))
    back = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=labels.labels)
    model = PipelineModel([*shaping, fitted, back])
    scored = model.transform(test.select(TEXT, CATEGORY))
    predictions = stage(scored.select(TEXT, F.col(CATEGORY).alias("actual_category"), "predicted_category"))
    return Categorizer(model, predictions, text_metrics(predictions).first().asDict())
