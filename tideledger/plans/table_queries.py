"""Queries over validation, profiles, aggregations, joins, set operations and the daily ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.functions import scalars as S
from tideledger.functions.flags import union_flags
from tideledger.operators import canonical as can, compare, features, forecast, ledger, quality, scoring, text
from tideledger.plans import testbed as tb
from tideledger.plans.catalog import query, with_sql
from tideledger.schemas import CANONICAL_KEYS, LABELS, MEASURES
from tideledger.session import scratch
from tideledger.sources import registry, statements, tabular

# Validation and profiles -----------------------------------------------------------------------------------------


def _damaged(spark, sf_dir):
    """Ledger rows with every kind of defect, decided by their own values."""
    rows = tb.transactions(spark, sf_dir).withColumns(
        {"debit_sum": F.col("debit_sum").cast("double"), "credit_sum": F.col("credit_sum").cast("double")}
    )
    label = F.col("transaction_label")
    return rows.withColumns(
        {
            "client_id": F.when(label != "1-URGENT", F.col("client_id")),
            "month": F.when(label == "2-HIGH", F.concat("month", F.lit("-01"))).otherwise(F.col("month")),
            "debit_sum": F.when(label == "3-MEDIUM", F.lit(float("nan")))
            .when(label == "4-NOT SPECIFIED", -F.col("debit_sum"))
            .otherwise(F.col("debit_sum")),
            "debit_nonzero_count": F.when(label == "5-LOW", -F.col("debit_nonzero_count")).otherwise(
                F.col("debit_nonzero_count")
            ),
        }
    )


_DAMAGED_SQL = """SELECT count(*) AS rows, count(*) FILTER (WHERE transaction_label = '1-URGENT') AS null_client,
  count(*) FILTER (WHERE transaction_label = '2-HIGH') AS bad_month,
  count(*) FILTER (WHERE transaction_label = '3-MEDIUM') AS non_finite,
  count(*) FILTER (WHERE transaction_label = '4-NOT SPECIFIED' AND debit > 0) AS negative_amount,
  count(*) FILTER (WHERE transaction_label = '5-LOW' AND debit > 0) AS negative_count FROM ledger"""


@query("D01_violations", with_sql(tb.LEDGER_SQL, _DAMAGED_SQL))
def violations(spark, sf_dir):
    return can.violations(_damaged(spark, sf_dir))


@query(
    "D01_validated",
    with_sql(tb.CANONICAL_SQL, "SELECT client_id, month, transaction_label, currency, debit_sum, debit_nonzero_count FROM canonical"),
)
def validated(spark, sf_dir):
    rows = can.validated(tb.canonical(spark, sf_dir))
    return rows.select("client_id", "month", "transaction_label", "currency", "debit_sum", "debit_nonzero_count")


@query(
    "D02_liquidity_violations",
    with_sql(
        tb.BALANCES_SQL,
        """months AS (SELECT client_id, strftime(date, '%Y-%m') AS month, max(cash_gap) AS gap FROM balances GROUP BY ALL)""",
        "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS negative_count, count(*) FILTER (WHERE gap = 1) AS bad_proxy FROM months",
    ),
)
def liquidity_violations(spark, sf_dir):
    balances = tb.stressed_balances(spark, sf_dir)
    monthly = ledger.monthly_liquidity(balances).drop("balance_breach_proxy")
    gaps = ledger.monthly_gaps(balances).select(
        "client_id", "month", (F.col("cash_gap_current_month") * 2).alias("balance_breach_proxy")
    )
    return can.liquidity_violations(monthly.join(gaps, ["client_id", "month"]))


@query("D03_currency_count", with_sql(tb.TRANSFERS_SQL, "SELECT count(DISTINCT currency) AS currencies FROM transfer_sides"))
def currency_count(spark, sf_dir):
    from tideledger.sources import transfers

    rows = transfers.to_canonical(tb.transfers(spark, sf_dir), "lineitem", "testbed")
    return can.currency_count(can.require_single_currency(rows, combine_currencies=False))


PROFILE_SQL = """profile AS (SELECT count(*) AS rows, count(DISTINCT client_id) AS clients, min(month) AS first_month,
  max(month) AS last_month, count(DISTINCT month) AS months, count(DISTINCT transaction_label) AS labels,
  CAST(max(CASE WHEN debit_sum > 0 THEN 1 ELSE 0 END) AS BIGINT) AS has_debit,
  CAST(max(CASE WHEN credit_sum > 0 THEN 1 ELSE 0 END) AS BIGINT) AS has_credit,
  count(DISTINCT currency) AS currency_count,
  avg((client_id IS NULL)::INT + (month IS NULL)::INT + (debit_sum IS NULL)::INT + (credit_sum IS NULL)::INT) / 4.0 * 100 AS missing_percent,
  CAST(count(DISTINCT currency) > 1 AS BIGINT) AS multiple_currencies, CAST(0 AS BIGINT) AS has_balance,
  CAST(1 AS BIGINT) AS has_cash_gap_target FROM canonical)"""


def _profile(spark, sf_dir):
    return quality.profile(tb.canonical(spark, sf_dir), target=tb.lines(spark, sf_dir))


@query("D04_profile", with_sql(tb.CANONICAL_SQL, PROFILE_SQL, "SELECT * FROM profile"))
def profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(
    "D05_task_eligibility",
    with_sql(
        tb.CANONICAL_SQL,
        PROFILE_SQL,
        """SELECT CAST(clients >= 2 AND months >= 6 AND has_debit = 1 AND has_credit = 1 AS BIGINT) AS classification_eligible,
             CAST(months >= 6 AND (has_debit = 1 OR has_credit = 1) AS BIGINT) AS forecasting_eligible,
             CAST(1 AS BIGINT) AS proxy_eligible, CAST(0 AS BIGINT) AS categorization_eligible FROM profile""",
    ),
)
def task_eligibility(spark, sf_dir):
    return quality.eligibility_table(_profile(spark, sf_dir), registry.SOURCES["nested_statements"])


@query(
    "D06_model_size",
    with_sql(
        tb.CANONICAL_SQL,
        PROFILE_SQL,
        """SELECT clients * labels AS estimated_series,
             round(CAST(clients * labels * 9 * 8 * 6 AS DOUBLE) / 1048576, 2) AS estimated_memory_mb FROM profile""",
    ),
)
def model_size(spark, sf_dir):
    return quality.estimated_series(_profile(spark, sf_dir), "client_category", 6, 3)


@query(
    "D07_external_target",
    with_sql(
        tb.CANONICAL_SQL,
        tb.GAPS_SQL,
        """SELECT client_id, month, CAST(sum(CAST(credit_sum AS DECIMAL(18,2))) AS DOUBLE) AS total_credit, any_value(cash_gap_next_month) AS cash_gap_next_month
           FROM canonical JOIN target USING (client_id, month) WHERE cash_gap_next_month IS NOT NULL GROUP BY 1, 2""",
    ).replace(tb.LINES_SQL + ", limits", "limits", 1),
)
def external_target(spark, sf_dir):
    totals = features.monthly_totals(tb.canonical(spark, sf_dir), tb.LABELS, scale=2).select("client_id", "month", "total_credit")
    target = ledger.gap_target(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)))
    return quality.attach_target(totals, target)


@query(
    "D08_text_profile",
    """SELECT count(*) AS rows, count(DISTINCT lang) AS categories, CAST(0 AS BIGINT) AS has_debit, CAST(0 AS BIGINT) AS has_credit
       FROM documents""",
)
def text_profile(spark, sf_dir):
    return quality.text_profile(tb.categories(spark, sf_dir))


@query(
    "D09_point_in_time",
    with_sql(tb.CANONICAL_SQL, "SELECT count(DISTINCT (client_id, month)) AS compared, CAST(0 AS BIGINT) AS changed FROM canonical WHERE month < '1999-01'"),
)
def point_in_time(spark, sf_dir):
    """Features of earlier months before and after a month's credits are multiplied: none may change."""
    table = tb.canonical(spark, sf_dir)
    later = F.when(F.col("month") >= "1999-01", F.col("credit_sum") * 100).otherwise(F.col("credit_sum"))
    before, after = (
        features.feature_frame(rows, labels=tb.LABELS, scale=2)
        for rows in (table, table.withColumn("credit_sum", later))
    )
    names = features.feature_columns(before)
    prints = [
        frame.where("month < '1999-01'").select("client_id", "month", F.xxhash64(*[features.quoted(n) for n in names]).alias(side))
        for frame, side in ((before, "left"), (after, "right"))
    ]
    joined = prints[0].join(prints[1], ["client_id", "month"])
    return joined.agg(
        F.count(F.lit(1)).alias("compared"), F.sum(S.flag(F.col("left") != F.col("right"))).alias("changed")
    )


# Aggregations ----------------------------------------------------------------------------------------------------


@query("E01_canonical_monthly", with_sql(tb.CANONICAL_SQL, "SELECT * FROM canonical"))
def canonical_monthly(spark, sf_dir):
    return tb.canonical(spark, sf_dir)


@query(
    "E02_flag_union",
    with_sql(tb.CANONICAL_SQL, "SELECT client_id, month, transaction_label, currency, data_quality_flags FROM canonical"),
)
def flag_union(spark, sf_dir):
    rows = tb.transactions(spark, sf_dir)
    grouped = rows.groupBy(*CANONICAL_KEYS).agg(union_flags(F.col("data_quality_flags")).alias("data_quality_flags"))
    return grouped.select("client_id", "month", "transaction_label", "currency", "data_quality_flags")


@query("E03_combined_parts", with_sql(tb.CANONICAL_SQL, "SELECT * FROM canonical"))
def combined_parts(spark, sf_dir):
    """Two disjoint halves aggregated apart, then combined."""
    rows = tb.transactions(spark, sf_dir)
    usd = F.coalesce(F.col("currency") == "USD", F.lit(False)) & (F.col("debit_sum") > 50000)
    halves = [can.canonical_monthly(rows.where(condition), tb.FLAGS, scale=2) for condition in (usd, ~usd)]
    return can.combine(halves, tb.FLAGS, scale=2)


_LIQUIDITY_SQL = """SELECT client_id, strftime(date, '%Y-%m') AS month,
  CAST(arg_min(opening_balance, date) AS DOUBLE) AS opening_balance, CAST(arg_max(closing_balance, date) AS DOUBLE) AS closing_balance,
  CAST(min(closing_balance) AS DOUBLE) AS minimum_observed_balance, CAST(max(closing_balance) AS DOUBLE) AS maximum_observed_balance,
  count(*) AS balance_observations_count"""


@query(
    "E04_monthly_balances",
    with_sql(
        tb.BALANCES_SQL,
        """SELECT client_id, strftime(date, '%Y-%m') AS month, CAST(arg_min(closing_balance, date) AS DOUBLE) AS opening_balance,
             CAST(arg_max(closing_balance, date) AS DOUBLE) AS closing_balance, CAST(min(closing_balance) AS DOUBLE) AS minimum_observed_balance,
             CAST(max(closing_balance) AS DOUBLE) AS maximum_observed_balance, count(*) AS balance_observations_count,
             CAST(min(closing_balance) < 1000 AS INT) AS balance_breach_proxy FROM balances GROUP BY 1, 2""",
    ),
)
def monthly_balances(spark, sf_dir):
    seen = tb.stressed_balances(spark, sf_dir).select(
        "client_id", S.month_of(F.col("date")).alias("month"), "date", F.col("closing_balance").cast("double").alias("balance")
    )
    return can.monthly_balances(seen, ["date"], threshold=1000.0)


@query(
    "E05_merged_balances",
    with_sql(
        tb.BALANCES_SQL,
        """SELECT client_id, strftime(date, '%Y') AS month, CAST(arg_min(closing_balance, date) AS DOUBLE) AS opening_balance,
             CAST(arg_max(closing_balance, date) AS DOUBLE) AS closing_balance, CAST(min(closing_balance) AS DOUBLE) AS minimum_observed_balance,
             CAST(max(closing_balance) AS DOUBLE) AS maximum_observed_balance, count(*) AS balance_observations_count,
             CAST(min(closing_balance) < 1000 AS INT) AS balance_breach_proxy FROM balances GROUP BY 1, 2""",
    ),
)
def merged_balances(spark, sf_dir):
    monthly = monthly_balances(spark, sf_dir)
    parts = monthly.withColumn("part", F.col("month")).withColumn("month", F.substring("month", 1, 4))
    return can.merge_balances(parts, "part")


def _totals_sql(level: str) -> str:
    series = "client_id" if level == "client" else "client_id || '::' || transaction_label"
    return f"""totals AS (SELECT {series} AS series_id, client_id, month,
      CAST(sum(CAST(credit_sum AS DECIMAL(18,2))) AS DOUBLE) AS total_credit_sum,
      CAST(sum(CAST(debit_sum AS DECIMAL(18,2))) AS DOUBLE) AS total_debit_sum,
      CAST(sum(CAST(credit_sum AS DECIMAL(18,2))) - sum(CAST(debit_sum AS DECIMAL(18,2))) AS DOUBLE) AS net_flow
      FROM canonical GROUP BY {series}, client_id, month)"""


TOTALS_SQL = _totals_sql("client")
SERIES_COLUMNS = ["series_id", "client_id", "month", "total_credit_sum", "total_debit_sum", "net_flow"]


@query("E06_client_totals", with_sql(tb.CANONICAL_SQL, TOTALS_SQL, "SELECT * FROM totals"))
def client_totals(spark, sf_dir):
    return forecast.series_totals(tb.canonical(spark, sf_dir), scale=2)


@query("E06_category_totals", with_sql(tb.CANONICAL_SQL, _totals_sql("client_category"), "SELECT * FROM totals"))
def category_totals(spark, sf_dir):
    return forecast.series_totals(tb.canonical(spark, sf_dir), "client_category", scale=2).select(*SERIES_COLUMNS)


_MEASURE_SQL = {
    "total_debit": "CAST(sum(CAST(debit_sum AS DECIMAL(18,2))) AS DOUBLE)",
    "total_credit": "CAST(sum(CAST(credit_sum AS DECIMAL(18,2))) AS DOUBLE)",
    "debit_count": "CAST(sum(debit_nonzero_count) AS DOUBLE)",
    "credit_count": "CAST(sum(credit_nonzero_count) AS DOUBLE)",
}


def _features(spark, sf_dir):
    return features.monthly_totals(tb.canonical(spark, sf_dir), scale=2)


@query(
    "E07_measure_totals",
    with_sql(
        tb.CANONICAL_SQL,
        f"SELECT client_id, month, {', '.join(f'{sql} AS {name}' for name, sql in _MEASURE_SQL.items())} FROM canonical GROUP BY 1, 2",
    ),
)
def measure_totals(spark, sf_dir):
    return _features(spark, sf_dir).select("client_id", "month", *_MEASURE_SQL)


@query(
    "E08_active_categories",
    with_sql(
        tb.CANONICAL_SQL,
        "SELECT client_id, month, count(*) FILTER (WHERE debit_sum + credit_sum > 0) AS active_categories FROM canonical GROUP BY 1, 2",
    ),
)
def active_categories(spark, sf_dir):
    return _features(spark, sf_dir).select("client_id", "month", "active_categories")


#: The ten standard labels, and those of the test tables: more than the ten, found without being named.
_EVERY_LABEL = list(dict.fromkeys([*LABELS, *tb.LABELS]))


def _pivot_sql() -> str:
    columns = [
        f"""CAST(coalesce(sum(CAST({measure} AS DECIMAL(18,2))) FILTER (WHERE transaction_label = '{label}'), 0) AS DOUBLE) AS "{measure}__{label}" """
        for measure in MEASURES
        for label in _EVERY_LABEL
    ]
    return f"SELECT client_id, month, {', '.join(columns)} FROM canonical GROUP BY 1, 2"


@query("E09_label_pivot", with_sql(tb.CANONICAL_SQL, _pivot_sql()))
def label_pivot(spark, sf_dir):
    found = _features(spark, sf_dir)
    return found.select("client_id", "month", *[features.quoted(name) for name in found.columns if "__" in name])


TOTAL_SERIES_SQL = """months AS (SELECT month, sum(CAST(debit_sum AS DECIMAL(18,2))) AS debit, sum(CAST(credit_sum AS DECIMAL(18,2))) AS credit
    FROM canonical GROUP BY month), total_series AS (
  SELECT 'TOTAL' AS series_id, month,
    CAST(CASE WHEN (SELECT max(debit) > 0 AND max(credit) > 0 FROM months) THEN credit - debit
              WHEN (SELECT max(debit) > 0 FROM months) THEN debit ELSE credit END AS DOUBLE) AS value,
    CASE WHEN (SELECT max(debit) > 0 AND max(credit) > 0 FROM months) THEN 'net_flow'
         WHEN (SELECT max(debit) > 0 FROM months) THEN 'debit_flow' ELSE 'credit_flow' END AS kind FROM months)"""


@query("E10_total_series", with_sql(tb.CANONICAL_SQL, TOTAL_SERIES_SQL, "SELECT * FROM total_series"))
def total_series(spark, sf_dir):
    return forecast.total_series(tb.canonical(spark, sf_dir), scale=2)


def _categorized_days(spark, sf_dir):
    """Daily flows with a credit and a debit category that depend on the day."""
    names = F.array(*[F.lit(name) for name in tb.LABELS])
    day = F.dayofmonth("date")
    return tb.stressed_days(spark, sf_dir).select(
        "client_id",
        "date",
        F.col("credit").alias("credit_sum"),
        F.col("debit").alias("debit_sum"),
        "credit_nonzero_count",
        "debit_nonzero_count",
        F.element_at(names, day % 5 + 1).alias("credit_category"),
        F.element_at(names, (day + 2) % 4 + 1).alias("debit_category"),
    )


_ROLLUP_SQL = f"""names AS (SELECT {tb.LABELS} AS names), categorized AS (
  SELECT client_id, strftime(date, '%Y-%m') AS month, credit, debit, credit_nonzero_count, debit_nonzero_count,
    names[day(date) % 5 + 1] AS credit_category, names[(day(date) + 2) % 4 + 1] AS debit_category FROM days, names),
  shown AS (SELECT DISTINCT client_id, month, unnest({tb.LABELS}) AS transaction_label FROM categorized)
  SELECT client_id, month, transaction_label,
    CAST(coalesce(sum(debit) FILTER (WHERE debit_category = transaction_label), 0) AS DOUBLE) AS debit_sum,
    CAST(coalesce(sum(credit) FILTER (WHERE credit_category = transaction_label), 0) AS DOUBLE) AS credit_sum,
    CAST(coalesce(sum(debit_nonzero_count) FILTER (WHERE debit_category = transaction_label), 0) AS BIGINT) AS debit_nonzero_count,
    CAST(coalesce(sum(credit_nonzero_count) FILTER (WHERE credit_category = transaction_label), 0) AS BIGINT) AS credit_nonzero_count
  FROM shown JOIN categorized USING (client_id, month) GROUP BY 1, 2, 3"""


@query("E11_category_rollup", f"WITH {tb.DAYS_SQL}, {_ROLLUP_SQL}")
def category_rollup(spark, sf_dir):
    rows = ledger.category_rollup(_categorized_days(spark, sf_dir), tb.LABELS)
    return rows.withColumns({name: F.col(name).cast("double") for name in ("debit_sum", "credit_sum")})


_MONTHLY_LIQUIDITY_SQL = with_sql(
    tb.BALANCES_SQL,
    f"{_LIQUIDITY_SQL}, CAST(min(closing_balance) + max(overdraft) < 0 AS INT) AS balance_breach_proxy FROM balances GROUP BY 1, 2",
)


@query("E12_monthly_liquidity", _MONTHLY_LIQUIDITY_SQL)
def monthly_liquidity(spark, sf_dir):
    return ledger.monthly_liquidity(tb.stressed_balances(spark, sf_dir))


@query(
    "E13_conditional_counts",
    with_sql(
        tb.CANONICAL_SQL,
        """SELECT transaction_label, count(DISTINCT client_id) AS clients, count(DISTINCT client_id) FILTER (WHERE currency = 'USD') AS usd_clients,
             CAST(max(CASE WHEN debit_sum > 0 THEN 1 ELSE 0 END) AS BIGINT) AS has_debit FROM canonical GROUP BY transaction_label""",
    ),
)
def conditional_counts(spark, sf_dir):
    return tb.canonical(spark, sf_dir).groupBy("transaction_label").agg(
        F.count_distinct("client_id").alias("clients"),
        F.count_distinct(F.when(F.col("currency") == "USD", F.col("client_id"))).alias("usd_clients"),
        F.max(S.flag(F.col("debit_sum") > 0)).alias("has_debit"),
    )


@query("E14_category_counts", "SELECT lang AS category, count(*) AS rows FROM documents GROUP BY lang")
def category_counts(spark, sf_dir):
    return text.category_counts(tb.categories(spark, sf_dir))


@query(
    "E14_category_gate",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS categories, min(n) AS smallest, CAST(sum(n) >= 20 AND count(*) >= 2 AS INT) AS trainable
       FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
)
def category_gate(spark, sf_dir):
    return text.category_gate(tb.categories(spark, sf_dir))


@query(
    "E15_failed_operations",
    with_sql(
        tb.PAYLOADS_SQL,
        """SELECT client_id, strftime(moment, '%Y-%m') AS month, count(*) FILTER (WHERE failed) AS failed_operations
           FROM moves GROUP BY 1, 2 HAVING count(*) FILTER (WHERE failed) > 0""",
    ),
)
def failed_operations(spark, sf_dir):
    return statements.failed_operations(statements.statements(tb.payloads(spark, sf_dir)))


@query(
    "E16_confusion",
    with_sql(
        tb.SCORES_SQL,
        """SELECT count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp FROM scores""",
    ),
)
def confusion(spark, sf_dir):
    return scoring.confusion(tb.scores(spark, sf_dir), 0.5)


@query(
    "E17_target_summary",
    with_sql(
        tb.GAPS_SQL,
        """SELECT count(*) AS rows, count(cash_gap_next_month) AS model_observations, round(avg(cash_gap_next_month), 9) AS target_rate FROM target""",
    ),
)
def target_summary(spark, sf_dir):
    target = ledger.gap_target(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)))
    return ledger.target_summary(target).withColumn("target_rate", F.round("target_rate", 9))


# Joins -----------------------------------------------------------------------------------------------------------


@query(
    "F01_totals_with_activity",
    with_sql(
        tb.CANONICAL_SQL,
        f"""SELECT client_id, month, {_MEASURE_SQL["total_debit"]} AS total_debit,
              count(*) FILTER (WHERE debit_sum + credit_sum > 0) AS active_categories FROM canonical GROUP BY 1, 2""",
    ),
)
def totals_with_activity(spark, sf_dir):
    """Totals and activity of a client-month come from one aggregation, so there is nothing to join."""
    return _features(spark, sf_dir).select("client_id", "month", "total_debit", "active_categories")


@query(
    "F02_totals_with_pivot",
    with_sql(
        tb.CANONICAL_SQL,
        f"""SELECT client_id, month, {_MEASURE_SQL["total_credit"]} AS total_credit,
              CAST(coalesce(sum(CAST(credit_sum AS DECIMAL(18,2))) FILTER (WHERE transaction_label = '5-LOW'), 0) AS DOUBLE) AS "credit_sum__5-LOW"
            FROM canonical GROUP BY 1, 2""",
    ),
)
def totals_with_pivot(spark, sf_dir):
    return _features(spark, sf_dir).select("client_id", "month", "total_credit", features.quoted("credit_sum__5-LOW"))


@query(
    "F03_features_with_target",
    with_sql(
        tb.CANONICAL_SQL,
        tb.GAPS_SQL,
        f"""SELECT client_id, month, {_MEASURE_SQL["total_debit"]} AS total_debit, any_value(cash_gap_next_month) AS cash_gap_next_month
            FROM canonical JOIN target USING (client_id, month) WHERE cash_gap_next_month IS NOT NULL GROUP BY 1, 2""",
    ).replace(tb.LINES_SQL + ", limits", "limits", 1),
)
def features_with_target(spark, sf_dir):
    target = ledger.gap_target(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)))
    frame = features.feature_frame(tb.canonical(spark, sf_dir), target, tb.LABELS, scale=2)
    return frame.select("client_id", "month", "total_debit", "cash_gap_next_month")


@query(
    "F04_dimension_lookup",
    with_sql(
        tb.COMPANIES_SQL,
        "SELECT coalesce(company, 'UNKNOWN_COMPANY') AS client_id, count(*) AS n FROM sided LEFT JOIN companies ON user_id = account GROUP BY 1",
    ),
)
def dimension_lookup(spark, sf_dir):
    from tideledger.sources import companies

    tables = tb.company_tables(spark, sf_dir)
    # Counted per account first, so the join sees few rows however many transactions an account has.
    per_account = (
        tables["bank_transactions"].groupBy(F.col("bank_account_id").cast("string").alias("account")).agg(F.count(F.lit(1)).alias("n"))
    )
    joined = companies.with_company(per_account, companies.account_companies(tables), "UNKNOWN_COMPANY")
    return joined.groupBy("client_id").agg(F.sum("n").alias("n"))


@query(
    "F05_membership",
    with_sql(tb.CANONICAL_SQL, TOTALS_SQL, "SELECT * FROM totals WHERE client_id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)"),
)
def membership(spark, sf_dir):
    solvent = tb.table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    wanted = solvent.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("client_id"))
    return forecast.series_totals(tb.canonical(spark, sf_dir), scale=2).join(wanted, "client_id", "left_semi").select(*SERIES_COLUMNS)


PREPARED_SQL = """sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS months,
    row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS back, row_number() OVER (PARTITION BY series_id ORDER BY month) AS place
    FROM totals), prepared AS (
  SELECT *, net_flow AS value, CASE WHEN back <= 3 THEN 'test' ELSE 'context' END AS split,
    CASE WHEN back <= 3 THEN CAST(4 - back AS INT) END AS step, CAST(months - 3 AS INT) AS history FROM sized WHERE months >= 9)"""


def prepared(spark, sf_dir):
    return forecast.prepare_forecast(tb.canonical(spark, sf_dir), "net_flow", "client", 3, 6, scale=2)


@query(
    "F06_forecast_with_actual",
    with_sql(
        tb.CANONICAL_SQL,
        TOTALS_SQL,
        PREPARED_SQL,
        """SELECT t.series_id, t.month, t.value AS actual, c.value AS forecast FROM prepared t
           JOIN prepared c ON t.series_id = c.series_id AND c.place = t.history AND t.split = 'test'""",
    ),
)
def forecast_with_actual(spark, sf_dir):
    """Last-value forecasts joined to the actual months of the same series."""
    rows = prepared(spark, sf_dir)
    last = rows.where("split = 'context'").groupBy("series_id").agg(F.max_by("value", "month").alias("forecast"))
    test = rows.where("split = 'test'").select("series_id", "month", F.col("value").alias("actual"))
    return test.join(last, "series_id").select("series_id", "month", "actual", "forecast")


@query(
    "F07_context_and_test_by_step",
    with_sql(
        tb.CANONICAL_SQL,
        TOTALS_SQL,
        PREPARED_SQL,
        """SELECT t.series_id, t.step, t.value AS actual, c.value AS context_value FROM prepared t
           JOIN prepared c ON t.series_id = c.series_id AND c.place = t.step AND t.split = 'test' AND c.split = 'context'""",
    ),
)
def context_and_test_by_step(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    numbered = rows.where("split = 'context'").select(
        "series_id", F.row_number().over(forecast.by_month()).alias("step"), F.col("value").alias("context_value")
    )
    test = rows.where("split = 'test'").select("series_id", "step", F.col("value").alias("actual"))
    return test.join(numbered, ["series_id", "step"]).select("series_id", "step", "actual", "context_value")


@query(
    "F08_runs_in_order",
    with_sql(
        tb.SCORES_SQL,
        """runs AS (SELECT month AS run_id, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM scores GROUP BY month),
           wanted AS (SELECT unnest(['1997-02', '1995-05', '2050-01', '1996-11']) AS run_id, unnest([0, 1, 2, 3]) AS position)""",
        "SELECT run_id, rows, positives, position FROM runs JOIN wanted USING (run_id) ORDER BY position",
    ),
)
def runs_in_order(spark, sf_dir):
    runs = (
        tb.scores(spark, sf_dir)
        .groupBy(F.col("month").alias("run_id"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
    )
    wanted = tb.table(spark, sf_dir, "region").agg(
        F.array(*[F.lit(run) for run in ("1997-02", "1995-05", "2050-01", "1996-11")]).alias("run_ids")
    )
    return compare.in_request_order(runs, wanted).select("run_id", "rows", "positives", "position")


# Set operations --------------------------------------------------------------------------------------------------


@query(
    "I01_union_all",
    "SELECT user_id AS id, event_type AS label FROM events UNION ALL SELECT o_custkey, o_orderpriority FROM orders",
)
def union_all(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"))
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("id"))
    return can.combine_rows([events, orders])


@query("I02_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, sf_dir):
    return tb.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@query("I03_series_ids", with_sql(tb.CANONICAL_SQL, TOTALS_SQL, PREPARED_SQL, "SELECT DISTINCT series_id, CAST(1 AS BIGINT) AS batches FROM prepared"))
def series_ids(spark, sf_dir):
    """Every series lies in exactly one batch."""
    batches = forecast.series_batches(prepared(spark, sf_dir), 16)
    return batches.groupBy("series_id").agg(F.count_distinct("batch").alias("batches"))


@query("I04_shared_columns", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def shared_columns(spark, sf_dir):
    documents, labels = tb.table(spark, sf_dir, "documents"), tb.table(spark, sf_dir, "labels")
    shared = [name for name in documents.columns if name in set(labels.columns)]
    return can.combine_rows([documents.select(*shared), labels.select(*shared)])


# Daily ledger ----------------------------------------------------------------------------------------------------


def _double(df, *names):
    return df.withColumns({name: F.col(name).cast("double") for name in names})


@query(
    "L01_running_balance",
    with_sql(
        tb.BALANCES_SQL,
        "SELECT client_id, date, CAST(opening_balance AS DOUBLE) AS opening_balance, CAST(closing_balance AS DOUBLE) AS closing_balance FROM balances",
    ),
)
def running_balance(spark, sf_dir):
    rows = tb.stressed_balances(spark, sf_dir).select("client_id", "date", "opening_balance", "closing_balance")
    return _double(rows, "opening_balance", "closing_balance")


@query(
    "L02_daily_gap",
    with_sql(tb.BALANCES_SQL, "SELECT client_id, date, CAST(cash_gap_amount AS DOUBLE) AS cash_gap_amount, cash_gap FROM balances"),
)
def daily_gap(spark, sf_dir):
    rows = tb.stressed_balances(spark, sf_dir).select("client_id", "date", "cash_gap_amount", "cash_gap")
    return _double(rows, "cash_gap_amount")


@query("L03_monthly_gap", with_sql(tb.GAPS_SQL, "SELECT * FROM gaps"))
def monthly_gap(spark, sf_dir):
    return _double(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)), "cash_gap_amount")


@query("L04_gap_target", with_sql(tb.GAPS_SQL, "SELECT * FROM target"))
def gap_target(spark, sf_dir):
    target = ledger.gap_target(ledger.monthly_gaps(tb.stressed_balances(spark, sf_dir)))
    return _double(target, "cash_gap_amount")


@query(
    "L05_payment_deferral",
    with_sql(
        tb.DAYS_SQL,
        """planned AS (SELECT *, opening + sum(credit - debit) OVER (PARTITION BY client_id ORDER BY date) AS plan FROM days),
           settled AS (SELECT *, greatest(plan, -overdraft) AS balance, greatest(-overdraft - plan, 0) AS carried FROM planned)""",
        """SELECT client_id, date, CAST(balance AS DOUBLE) AS balance, CAST(carried AS DOUBLE) AS carried,
             CAST(coalesce(lag(balance) OVER (PARTITION BY client_id ORDER BY date), opening) + credit - balance AS DOUBLE) AS paid FROM settled""",
    ),
)
def payment_deferral(spark, sf_dir):
    rows = ledger.deferral_schedule(tb.stressed_days(spark, sf_dir)).select("client_id", "date", "balance", "carried", "paid")
    return _double(rows, "balance", "carried", "paid")


@query(
    "L06_available_liquidity",
    with_sql(
        tb.BALANCES_SQL,
        "SELECT client_id, date, CAST(greatest(opening_balance + credit + overdraft, 0) AS DOUBLE) AS available FROM balances",
    ),
)
def available_liquidity(spark, sf_dir):
    available = ledger.available_liquidity(F.col("opening_balance"), F.col("credit"), F.col("overdraft"))
    rows = tb.stressed_balances(spark, sf_dir).select("client_id", "date", available.alias("available"))
    return _double(rows, "available")


@query("L07_monthly_rollup", _MONTHLY_LIQUIDITY_SQL)
def monthly_rollup(spark, sf_dir):
    """Monthly liquidity from a stored daily layer, one folder per month."""
    from tideledger.sources import sinks

    days = tb.stressed_balances(spark, sf_dir).withColumn("month", S.month_of(F.col("date")))
    stored = tabular.read_tabular(spark, sinks.write_table(days, scratch(spark, "daily") + ".parquet", by_month=True))
    return ledger.monthly_liquidity(stored)
