"""Queries over classification, scoring metrics, text categorization, streaming and extension points."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tideledger.functions.flags import union_flags
from tideledger.operators import classify, compare, explain, features, forecast, ledger, scoring, text
from tideledger.plans import testbed as tb
from tideledger.plans.catalog import query, with_sql
from tideledger.plans.series_queries import _history, _PREPARED, FEATURES_SQL, _REASONS, _SEVERITY_SQL
from tideledger.plans.table_queries import prepared
from tideledger.session import scratch, stage
from tideledger.sources import registry, sinks
from tideledger.streaming import canonical_stream


def frame(spark, sf_dir):
    """Features of all client-months with a known next-month shortfall flag."""
    target = ledger.gap_target(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)))
    return features.feature_frame(tb.canonical(spark, sf_dir), target, tb.LABELS, scale=2)


_MONTHS_SQL = """numbered AS (SELECT month, row_number() OVER (ORDER BY month) AS place, count(*) OVER () AS n
    FROM (SELECT DISTINCT month FROM scores)), cuts AS (
  SELECT *, greatest(2, CAST(floor(n * 0.6) AS INT)) AS train_end,
    least(greatest(greatest(2, CAST(floor(n * 0.6) AS INT)) + 2, CAST(floor(n * (0.6 + 0.2)) AS INT)), n - 2) AS validation_end FROM numbered),
  parts AS (SELECT month, CASE WHEN place <= train_end THEN 'train' WHEN place <= validation_end THEN 'validation' ELSE 'test' END AS split FROM cuts)"""


@query(
    "J01_temporal_split",
    with_sql(tb.SCORES_SQL, _MONTHS_SQL, "SELECT id, month, split FROM scores JOIN parts USING (month)"),
)
def temporal_split(spark, sf_dir):
    return scoring.with_split(tb.scores(spark, sf_dir)).select("id", "month", "split")


@query(
    "J02_prior_classifier",
    with_sql(
        tb.GAPS_SQL,
        """scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)""",
        _MONTHS_SQL,
        """SELECT client_id, month AS scoring_month, round((SELECT avg(cash_gap_next_month) FROM scores JOIN parts USING (month) WHERE split = 'train'), 9) AS risk_score
           FROM scores JOIN parts USING (month) WHERE split = 'test'""",
    ),
)
def prior_classifier(spark, sf_dir):
    result = classify.train_classifier(frame(spark, sf_dir), "prior")
    return result.scored.select("client_id", F.col("month").alias("scoring_month"), F.round("risk_score", 9).alias("risk_score"))


@query("J03_logistic_regression")
def logistic_regression(spark, sf_dir):
    return classify.train_classifier(frame(spark, sf_dir), "logistic_regression").predictions()


@query("J04_random_forest")
def random_forest(spark, sf_dir):
    return classify.train_classifier(frame(spark, sf_dir), "random_forest").predictions()


@query("J05_boosted_trees")
def boosted_trees(spark, sf_dir):
    return classify.train_classifier(frame(spark, sf_dir), "boosted_trees").predictions()


@query("J06_boosted_leaves")
def boosted_leaves(spark, sf_dir):
    return classify.train_classifier(frame(spark, sf_dir), "boosted_leaves").predictions()


@query(
    "J08_training_split",
    with_sql(
        tb.GAPS_SQL,
        "scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)",
        _MONTHS_SQL,
        "SELECT split, count(*) AS rows, CAST(sum(cash_gap_next_month) AS BIGINT) AS positives FROM scores JOIN parts USING (month) GROUP BY split",
    ),
)
def training_split(spark, sf_dir):
    rows = scoring.with_split(frame(spark, sf_dir).select("client_id", "month", "cash_gap_next_month"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("cash_gap_next_month").alias("positives"))


def _classifiers(spark, sf_dir):
    contract = compare.Contract("cash_gap_next_month", task=compare.CLASSIFICATION)
    return compare.run_benchmark(frame(spark, sf_dir), ["prior", "logistic_regression", "prior"], contract)


@query(
    "K14_classifier_benchmark",
    with_sql(
        tb.GAPS_SQL,
        "scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)",
        _MONTHS_SQL,
        """parted AS (SELECT * FROM scores JOIN parts USING (month)),
           prior AS (SELECT client_id, month AS scoring_month, CAST(cash_gap_next_month AS INT) AS actual_cash_gap_next_month,
             round((SELECT avg(cash_gap_next_month) FROM parted WHERE split = 'train'), 9) AS risk_score,
             row_number() OVER (PARTITION BY month ORDER BY client_id) AS risk_rank FROM parted WHERE split = 'test')""",
        """SELECT 'prior' AS model_id, * FROM prior
           UNION ALL SELECT 'logistic_regression', client_id, scoring_month, actual_cash_gap_next_month, NULL, NULL FROM prior""",
    ),
)
def classifier_benchmark(spark, sf_dir):
    """Two classifiers on one split; of the fitted one only what doesn't depend on its weights."""
    found = _classifiers(spark, sf_dir).predictions
    of_prior = lambda c: F.when(F.col("model_id") == "prior", c)
    return found.select(
        "model_id", "client_id", "scoring_month", "actual_cash_gap_next_month",
        of_prior(F.round("risk_score", 9)).alias("risk_score"), of_prior(F.col("risk_rank")).alias("risk_rank"),
    )


@query(
    "K15_classifier_comparison",
    with_sql(
        tb.GAPS_SQL,
        "scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)",
        _MONTHS_SQL,
        """test AS (SELECT cash_gap_next_month AS label, (SELECT avg(cash_gap_next_month) FROM scores JOIN parts USING (month) WHERE split = 'train') AS rate
             FROM scores JOIN parts USING (month) WHERE split = 'test'),
           models AS (SELECT unnest(['prior', 'logistic_regression']) AS model_id)""",
        """SELECT model_id, CAST(count(*) AS DOUBLE) AS test_rows, CASE WHEN model_id = 'prior' THEN round(avg((rate - label) * (rate - label)), 9) END AS brier_score,
             CASE WHEN model_id = 'prior' THEN 0.5 END AS roc_auc, true AS better_than_prior FROM test, models GROUP BY model_id""",
    ),
)
def classifier_comparison(spark, sf_dir):
    """The metrics table of the same two; the fitted one ranks no worse than the base rate does."""
    table = compare.compare(_classifiers(spark, sf_dir).metrics, names=compare.CLASSIFIER_METRICS)
    of_prior = lambda c: F.when(F.col("model_id") == "prior", F.round(c, 9)).alias(c)
    return table.select("model_id", "test_rows", of_prior("brier_score"), of_prior("roc_auc"), (F.col("roc_auc") >= 0.5).alias("better_than_prior"))


@query(
    "J03_invariants",
    with_sql(
        tb.GAPS_SQL,
        "scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)",
        _MONTHS_SQL,
        """SELECT month AS scoring_month, count(*) AS rows, count(*) AS ranks, CAST(count(*) AS BIGINT) AS last_rank, CAST(sum(cash_gap_next_month) AS BIGINT) AS positives,
             true AS in_order FROM scores JOIN parts USING (month) WHERE split = 'test' GROUP BY month""",
    ),
)
def logistic_invariants(spark, sf_dir):
    """What holds for any fitted model: ranks are a permutation of each month's rows, in the order of the scores."""
    found = classify.train_classifier(frame(spark, sf_dir), "logistic_regression").predictions()
    ahead = F.lag("risk_score").over(Window.partitionBy("scoring_month").orderBy("risk_rank"))
    return (
        found.withColumn("_fits", F.coalesce(ahead >= F.col("risk_score"), F.lit(True)) & F.col("risk_score").between(0, 1))
        .groupBy("scoring_month")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("risk_rank").alias("ranks"), F.max("risk_rank").cast("long").alias("last_rank"),
            F.sum("actual_cash_gap_next_month").alias("positives"), F.every("_fits").alias("in_order"),
        )
    )


_CURVE_SQL = """distinct_scores AS (SELECT score, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM scores GROUP BY score),
  curve AS (SELECT *, CAST(sum(rows) OVER (ORDER BY score DESC) AS BIGINT) AS rows_above,
    CAST(sum(positives) OVER (ORDER BY score DESC) AS BIGINT) AS positives_above FROM distinct_scores)"""


@query("J09_score_curve", with_sql(tb.SCORES_SQL, _CURVE_SQL, "SELECT * FROM curve"))
def score_curve(spark, sf_dir):
    return scoring.score_curve(tb.scores(spark, sf_dir))


@query(
    "J09_best_threshold",
    with_sql(
        tb.SCORES_SQL,
        _CURVE_SQL,
        """SELECT score AS threshold, round(2.0 * positives_above / (rows_above + (SELECT sum(positives) FROM curve)), 9) AS f1
           FROM curve ORDER BY 2.0 * positives_above / (rows_above + (SELECT sum(positives) FROM curve)) DESC, score LIMIT 1""",
    ),
)
def best_threshold(spark, sf_dir):
    best = scoring.best_threshold(stage(scoring.score_curve(tb.scores(spark, sf_dir))))
    return best.withColumn("f1", F.round("f1", 9))


@query(
    "J10_ranking_metrics",
    with_sql(
        tb.SCORES_SQL,
        _CURVE_SQL,
        "totals AS (SELECT CAST(sum(positives) AS DOUBLE) AS p, CAST(sum(rows) - sum(positives) AS DOUBLE) AS n FROM curve)",
        """SELECT round(sum(positives * (positives_above / rows_above)) / any_value(p), 9) AS pr_auc,
             round(sum((rows - positives) * (positives_above - positives / 2.0)) / (any_value(p) * any_value(n)), 9) AS roc_auc FROM curve, totals""",
    ),
)
def ranking_metrics(spark, sf_dir):
    metrics = scoring.ranking_metrics(stage(scoring.score_curve(tb.scores(spark, sf_dir))))
    return metrics.select(F.round("pr_auc", 9).alias("pr_auc"), F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "J11_threshold_metrics",
    with_sql(
        tb.SCORES_SQL,
        """sums AS (SELECT count(*) FILTER (WHERE score >= 0.4 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.4) AS marked,
             sum(label) AS real, avg((score - label) * (score - label)) AS brier, avg(label) AS rate, count(*) AS n FROM scores)""",
        """SELECT round(tp / marked, 9) AS precision, round(tp / real, 9) AS recall, round(2 * tp / (marked + real), 9) AS f1,
             round(brier, 9) AS brier_score, round(rate, 9) AS test_positive_rate, n AS test_rows FROM sums""",
    ),
)
def threshold_metrics(spark, sf_dir):
    metrics = scoring.threshold_metrics(tb.scores(spark, sf_dir), 0.4)
    rounded = ["precision", "recall", "f1", "brier_score", "test_positive_rate"]
    return metrics.select(*[F.round(name, 9).alias(name) for name in rounded], "test_rows")


@query(
    "J12_top_metrics",
    with_sql(
        tb.SCORES_SQL,
        """top AS (SELECT * FROM scores QUALIFY row_number() OVER (ORDER BY score DESC, id)
             <= (SELECT greatest(1, CAST(ceil(count(*) * 0.10) AS BIGINT)) FROM scores))""",
        """SELECT round(avg(label), 9) AS precision_at_top_10, round(sum(label) / (SELECT sum(label) FROM scores), 9) AS recall_at_top_10 FROM top""",
    ),
)
def top_metrics(spark, sf_dir):
    metrics = scoring.top_metrics(tb.scores(spark, sf_dir), ["id"])
    return metrics.select(*[F.round(name, 9).alias(name) for name in metrics.columns])


@query("J13_feature_importance")
def feature_importance(spark, sf_dir):
    return classify.train_classifier(frame(spark, sf_dir), "logistic_regression").importance


@query("J14_contributions")
def contributions(spark, sf_dir):
    """Signed contributions per reason group of a logistic regression, as shares of the row's largest."""
    result = classify.train_classifier(frame(spark, sf_dir), "logistic_regression")
    signed = result.scored.withColumn("signed", explain.linear_contributions("inputs", result.coefficients))
    shares = explain.contribution_scores(F.col("signed"), result.features)
    return signed.select("client_id", "month", *[share.alias(reason) for reason, share in shares.items()])


@query(
    "J14_tree_contributions",
    with_sql(
        tb.GAPS_SQL,
        "scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)",
        _MONTHS_SQL,
        "SELECT client_id, month, CAST(0 AS DOUBLE) AS difference FROM scores JOIN parts USING (month) WHERE split = 'test'",
    ),
)
def tree_contributions(spark, sf_dir):
    """Base and signed contributions of boosted trees add up to every row's score (as log-odds)."""
    result = classify.train_classifier(frame(spark, sf_dir), "boosted_leaves", {"n_estimators": 12, "engine": "histogram"})
    parts = F.aggregate(result.contributions(), F.lit(result.model.bias), lambda total, x: total + x)
    log_odds = F.log(F.col("risk_score") / (1 - F.col("risk_score")))
    return result.scored.select("client_id", "month", F.abs(F.round(parts - log_odds, 6)).alias("difference"))


@query("J15_reasons", _REASONS)
def reasons(spark, sf_dir):
    explained = explain.with_reasons(_history(spark, sf_dir))
    return explained.select("client_id", "month", "top_reason_1", "top_reason_2", "top_reason_3")


@query(
    "J16_score_table",
    with_sql(
        tb.SCORES_SQL,
        """placed AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, id) AS risk_rank,
             cume_dist() OVER (PARTITION BY month ORDER BY score) AS percentile FROM scores)""",
        """SELECT id AS client_id, month, score AS risk_score, CAST(score >= 0.55 AS BIGINT) AS predicted_cash_gap, risk_rank,
             CASE WHEN percentile >= 0.9 THEN 'high' WHEN percentile >= 0.6 THEN 'medium' ELSE 'low' END AS risk_group FROM placed""",
    ),
)
def score_table(spark, sf_dir):
    scored = tb.scores(spark, sf_dir).select(F.col("id").alias("client_id"), "month", F.col("score").alias("risk_score"))
    return scoring.score_table(scored, 0.55).drop("percentile")


@query(
    "F09_predictions_with_reasons",
    with_sql(
        tb.GAPS_SQL,
        tb.CANONICAL_SQL.removeprefix(f"{tb.LINES_SQL}, "),
        FEATURES_SQL,
        _SEVERITY_SQL,
        "scores AS (SELECT * FROM target WHERE cash_gap_next_month IS NOT NULL)",
        _MONTHS_SQL,
        """parted AS (SELECT * FROM scores JOIN parts USING (month))""",
        """SELECT client_id, month AS scoring_month, round((SELECT avg(cash_gap_next_month) FROM parted WHERE split = 'train'), 9) AS risk_score,
             CAST(cash_gap_next_month AS INT) AS actual_cash_gap_next_month,
             CAST((SELECT sum(cash_gap_next_month) > 0 OR (SELECT avg(cash_gap_next_month) FROM parted WHERE split = 'train') >= 0.5
                   FROM parted WHERE split = 'validation') AS BIGINT) AS predicted_cash_gap,
             row_number() OVER (PARTITION BY month ORDER BY client_id) AS risk_rank, 'high' AS risk_group,
             names[1] AS top_reason_1, names[2] AS top_reason_2, names[3] AS top_reason_3
           FROM parted JOIN filled USING (client_id, month) WHERE split = 'test'""",
    ),
)
def predictions_with_reasons(spark, sf_dir):
    found = classify.train_classifier(frame(spark, sf_dir), "prior").predictions()
    return found.withColumn("risk_score", F.round("risk_score", 9))


# Text ------------------------------------------------------------------------------------------------------------


def _documents(spark, sf_dir):
    return tb.categories(spark, sf_dir).select("transaction_description", "category").withColumn(
        "doc_id", F.xxhash64("transaction_description")
    )


@query(
    "J17_stratified_split",
    """SELECT lang AS category, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS train
       FROM documents GROUP BY lang""",
)
def stratified_split(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), "doc_id")
    split = text.stratified_split(rows, "doc_id")
    return split.groupBy("category").agg(
        F.count(F.when(F.col("split") == "test", 1)).alias("test"), F.count(F.when(F.col("split") == "train", 1)).alias("train")
    )


@query(
    "J18_tokens",
    r"""SELECT token, count(*) AS rows FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token
        FROM documents) GROUP BY token""",
)
def tokens(spark, sf_dir):
    words = tb.table(spark, sf_dir, "documents").select(F.explode(text.tokens("text")).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


def _categorizer(spark, sf_dir):
    return text.train_categorizer(_documents(spark, sf_dir), "doc_id")


@query("J19_categorize")
def categorize(spark, sf_dir):
    """Categories predicted for every turn of the conversations by a model trained on the documents."""
    turns = tb.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("transaction_description"))
    return _categorizer(spark, sf_dir).categorize(turns).drop("transaction_description")


_PREDICTED_SQL = """labelled AS (SELECT lang AS actual, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS predicted FROM documents)"""


@query(
    "J20_text_metrics",
    with_sql(
        _PREDICTED_SQL,
        """names AS (SELECT actual AS name FROM labelled UNION SELECT predicted FROM labelled),
           cells AS (SELECT name, count(*) FILTER (WHERE actual = name AND predicted = name) AS hit,
             count(*) FILTER (WHERE actual = name) + count(*) FILTER (WHERE predicted = name) AS mass FROM names JOIN labelled ON name IN (actual, predicted) GROUP BY name)""",
        """SELECT round(avg(2.0 * hit / mass), 9) AS f1_macro, (SELECT round(avg(CAST(actual = predicted AS INT)), 9) FROM labelled) AS accuracy,
             (SELECT count(*) FROM labelled) AS test_rows FROM cells""",
    ),
)
def text_metrics(spark, sf_dir):
    predicted = F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang"))
    rows = tb.table(spark, sf_dir, "documents").select(F.col("lang").alias("actual_category"), predicted.alias("predicted_category"))
    metrics = text.text_metrics(rows)
    return metrics.select(F.round("f1_macro", 9).alias("f1_macro"), F.round("accuracy", 9).alias("accuracy"), "test_rows")


@query("J21_text_predictions")
def text_predictions(spark, sf_dir):
    return _categorizer(spark, sf_dir).predictions


# Streaming and extension points ----------------------------------------------------------------------------------


@query("M01_incremental_canonical", with_sql(tb.CANONICAL_SQL, "SELECT * FROM canonical"))
def incremental_canonical(spark, sf_dir):
    """The ledger arrives as files; the stream's partial sums must add up to the batch result."""
    arrived = sinks.write_table(tb.transactions(spark, sf_dir), scratch(spark, "arrivals"))
    rows = canonical_stream.read_stream(spark, arrived, spark.read.parquet(arrived).schema, files_per_trigger=4)
    partial, state = scratch(spark, "partials"), scratch(spark, "progress")
    canonical_stream.partial_stream(rows, partial, state, tb.FLAGS, scale=2).awaitTermination()
    return canonical_stream.read_canonical(spark, partial, tb.FLAGS, scale=2)


@query(
    "N01_flag_aggregate",
    with_sql(
        tb.LINES_SQL,
        """SELECT client_id, nullif(concat_ws('|', CASE WHEN bool_or(untaxed) THEN 'checked' END, CASE WHEN bool_or(returned) THEN 'returned' END,
             CASE WHEN bool_or(untaxed) THEN 'untaxed' END), '') AS flags FROM lines GROUP BY client_id""",
    ),
)
def flag_aggregate(spark, sf_dir):
    return tb.lines(spark, sf_dir).groupBy("client_id").agg(union_flags(F.col("flags")).alias("flags"))


@query(
    "N02_group_transforms",
    with_sql(
        *_PREPARED,
        """SELECT series_id, month, round(avg(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 5) + 0.0 AS mean_3
           FROM prepared""",
    ),
)
def group_transforms(spark, sf_dir):
    window = forecast.by_month().rowsBetween(-2, 0)
    return prepared(spark, sf_dir).select("series_id", "month", (F.round(F.avg("value").over(window), 5) + 0.0).alias("mean_3"))


@query(
    "N03_own_model",
    with_sql(
        *_PREPARED,
        """SELECT t.series_id, t.step, t.value AS actual, round(avg(c.value), 4) + 0.0 AS forecast FROM prepared t
           JOIN prepared c ON c.series_id = t.series_id AND c.split = 'context' WHERE t.split = 'test' GROUP BY ALL""",
    ),
)
def own_model(spark, sf_dir):
    """A caller's own model in the registry: the mean of the context."""

    def mean_model(data, contract, parameters):
        context = F.when(F.col("split") == "context", F.col("value"))
        point = F.avg(context).over(forecast.whole())
        scored = data.withColumns({"forecast": point, "lower_bound": point, "upper_bound": point})
        return scored.where("split = 'test'").select(*forecast.prediction_columns(contract.target), "step")

    contract = compare.Contract("net_flow", horizon=3)
    model = {"mean": (compare.FORECASTING, mean_model)}
    predictions = compare.run_benchmark(tb.canonical(spark, sf_dir), ["mean"], contract, registry=model, scale=2).predictions
    by_date = F.row_number().over(forecast.per("series_id", order="date"))
    return predictions.select("series_id", by_date.alias("step"), "actual", (F.round("forecast", 4) + 0.0).alias("forecast"))


@query(
    "N04_own_adapter",
    """SELECT CAST(o_custkey AS VARCHAR) AS client_id, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS transaction_label,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS credit_sum, count(*) AS credit_nonzero_count FROM orders GROUP BY 1, 2, 3""",
)
def own_adapter(spark, sf_dir):
    """A caller's own adapter, registered by name and then used like the others."""
    from tideledger.operators.canonical import canonical_rows

    def orders(spark, paths, source, options):
        rows = spark.read.parquet(*paths)
        return registry.Normalized(
            canonical=canonical_rows(
                rows,
                source.id,
                "testbed",
                client_id=F.col("o_custkey").cast("string"),
                month=F.date_format("o_orderdate", "yyyy-MM"),
                transaction_label=F.col("o_orderpriority"),
                credit_sum=F.col("o_totalprice"),
                credit_nonzero_count=F.lit(1).cast("long"),
            )
        )

    result = registry.normalize(spark, "orders", [f"{sf_dir}/orders.parquet"], scale=2, adapters={"orders": orders})
    return result.canonical.select("client_id", "month", "transaction_label", "credit_sum", "credit_nonzero_count")
