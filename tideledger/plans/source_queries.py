"""Queries over scans, sinks, scalar functions and source adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideledger import schemas
from tideledger.functions import scalars as S
from tideledger.functions.flags import ADAPTER_FLAGS
from tideledger.operators import canonical as can
from tideledger.operators.forecast import series_totals
from tideledger.operators.ledger import daily_flows
from tideledger.plans import testbed as tb
from tideledger.plans.catalog import query, with_sql
from tideledger.session import scratch
from tideledger.sources import (
    balance_ledger,
    card_ledger,
    category_text,
    companies,
    inout_series,
    registry,
    sinks,
    statements,
    tabular,
    transfers,
)

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations pages benchmark embeddings".split()


def _paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in TABLES]


def _events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"),
    )


EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("moment", T.TimestampNTZType()),
    ]
)
EVENTS_SQL = """SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m') AS month FROM events"""


def _read_events(df: DataFrame) -> DataFrame:
    return df.select("event_id", "user_id", "event_type", "value", S.month_of(F.col("moment")).alias("month"))


# Scans and sinks -------------------------------------------------------------------------------------------------


@query("A01_scan_csv", EVENTS_SQL)
def scan_csv(spark, sf_dir):
    path = sinks.write_csv(_events_text(spark, sf_dir), scratch(spark, "events") + ".csv")
    return _read_events(tabular.read_tabular(spark, path, EVENTS_SCHEMA))


@query("A02_scan_json_lines", EVENTS_SQL)
def scan_json_lines(spark, sf_dir):
    path = scratch(spark, "events") + ".jsonl"
    _events_text(spark, sf_dir).withColumn("value", F.col("value").cast("double")).write.json(path)
    return _read_events(tabular.read_tabular(spark, path, EVENTS_SCHEMA))


@query(
    "A03_scan_parquet",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def scan_parquet(spark, sf_dir):
    orders = tabular.read_tabular(spark, f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "A05_scan_by_position",
    with_sql(
        tb.TRANSFERS_SQL,
        """SELECT from_bank, count(*) AS transfers, CAST(sum(paid) AS DOUBLE) AS paid, CAST(sum(received) AS DOUBLE) AS received
           FROM transfers GROUP BY from_bank""",
    ),
)
def scan_by_position(spark, sf_dir):
    path = sinks.write_csv(tb.transfers(spark, sf_dir), scratch(spark, "transfers") + ".csv")
    rows = transfers.read(spark, path)
    return rows.groupBy(F.col("`From Bank`").alias("from_bank")).agg(
        F.count(F.lit(1)).alias("transfers"),
        F.sum(F.col("`Amount Paid`").cast(tb.MONEY)).cast("double").alias("paid"),
        F.sum(F.col("`Amount Received`").cast(tb.MONEY)).cast("double").alias("received"),
    )


@query(
    "A06_compatible_tables",
    """SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels""",
)
def compatible_tables(spark, sf_dir):
    found = tabular.compatible_paths(spark, _paths(sf_dir), {"doc_id"})
    counts = [
        tabular.read_tabular(spark, path).agg(F.lit(tabular.stem(path)).alias("source"), F.count(F.lit(1)).alias("n"))
        for path in found
    ]
    return can.combine_rows(counts)


@query("A07_smallest_file", "SELECT doc_id, quality, toxic FROM labels")
def smallest_file(spark, sf_dir):
    chosen = tabular.choose_file(spark, tabular.compatible_paths(spark, _paths(sf_dir), {"doc_id"}))
    return tabular.read_tabular(spark, chosen).select("doc_id", "quality", "toxic")


@query("H07_smallest_table", "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def smallest_table(spark, sf_dir):
    """The smallest file with order lines, then its rows by line number."""
    found = tabular.compatible_paths(spark, _paths(sf_dir), {"l_orderkey", "l_linenumber"})
    chosen = tabular.read_tabular(spark, tabular.choose_file(spark, found))
    return chosen.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("A08_find_table", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def find_table(spark, sf_dir):
    tables = tabular.load_tables(spark, _paths(sf_dir))
    return tabular.find_table(tables, "line", without="order").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("A09_raw_profile")
def raw_profile(spark, sf_dir):
    return tabular.raw_profile(spark, sf_dir)


CANONICAL_SELECT = with_sql(tb.CANONICAL_SQL, "SELECT * FROM canonical")


@query("A10_parquet_sink", CANONICAL_SELECT)
def parquet_sink(spark, sf_dir):
    return spark.read.parquet(sinks.write_table(tb.canonical(spark, sf_dir), scratch(spark, "canonical")))


@query(
    "A11_monthly_partitions",
    with_sql(
        tb.LINES_SQL,
        """SELECT client_id, date, CAST(sum(credit) AS DOUBLE) AS credit, CAST(sum(debit) AS DOUBLE) AS debit,
                  strftime(date, '%Y-%m') AS month
           FROM lines GROUP BY client_id, date""",
    ),
)
def monthly_partitions(spark, sf_dir):
    days = daily_flows(tb.lines(spark, sf_dir)).select(
        "client_id",
        "date",
        F.col("credit").cast("double").alias("credit"),
        F.col("debit").cast("double").alias("debit"),
        S.month_of(F.col("date")).alias("month"),
    )
    path = sinks.write_table(days, scratch(spark, "days"), by_month=True)
    return spark.read.schema(days.schema).parquet(path)


@query("A12_csv_export", with_sql(tb.SCORES_SQL, "SELECT id, month, score, label FROM scores"))
def csv_export(spark, sf_dir):
    path = sinks.write_csv(tb.scores(spark, sf_dir), scratch(spark, "scores") + ".csv")
    return tabular.read_tabular(spark, path, tb.scores(spark, sf_dir).schema)


def _stored_run(spark, sf_dir):
    root, predictions = scratch(spark, "runs"), tb.scores(spark, sf_dir)
    metrics = predictions.agg(F.count(F.lit(1)).alias("test_rows"), F.sum("label").alias("positives"))
    for run in ("first", "second"):
        sinks.write_run(root, run, predictions, metrics, {"model": run})
    return sinks.read_run(spark, root, "second")


@query("A13_run_predictions", with_sql(tb.SCORES_SQL, "SELECT id, score, label, 'second' AS run_id FROM scores"))
def run_predictions(spark, sf_dir):
    return _stored_run(spark, sf_dir)["predictions"].select("id", "score", "label", "run_id")


@query(
    "A14_run_metrics",
    with_sql(
        tb.SCORES_SQL,
        "SELECT count(*) AS test_rows, CAST(sum(label) AS BIGINT) AS positives, 'second' AS run_id FROM scores",
    ),
)
def run_metrics(spark, sf_dir):
    return _stored_run(spark, sf_dir)["metrics"].select("test_rows", "positives", "run_id")


ORDER = ["client_id", "month", "transaction_label", "currency"]


@query(
    "A15_preview",
    with_sql(
        tb.CANONICAL_SQL,
        """SELECT * FROM canonical
           ORDER BY client_id NULLS FIRST, month, transaction_label, currency NULLS FIRST LIMIT 100""",
    ),
)
def preview(spark, sf_dir):
    return sinks.preview({"canonical": tb.canonical(spark, sf_dir)}, 100, ORDER)


@query(
    "A16_page",
    with_sql(
        tb.CANONICAL_SQL,
        """SELECT client_id, month, transaction_label, currency, debit_sum, (SELECT count(*) FROM canonical) AS total_rows
           FROM canonical ORDER BY client_id, month, transaction_label, currency NULLS FIRST LIMIT 50 OFFSET 1000""",
    ),
)
def page(spark, sf_dir):
    rows = tb.canonical(spark, sf_dir).select(*ORDER, "debit_sum")
    return sinks.page(rows, ORDER, 1000, 50)


@query(
    "A16_page_of_stored_order",
    with_sql(
        tb.CANONICAL_SQL,
        """SELECT client_id, month, transaction_label, currency, debit_sum, (SELECT count(*) FROM canonical) AS total_rows
           FROM canonical ORDER BY client_id, month, transaction_label, currency NULLS FIRST LIMIT 500 OFFSET 2345""",
    ),
)
def page_of_stored_order(spark, sf_dir):
    rows = tb.canonical(spark, sf_dir).select(*ORDER, "debit_sum")
    return sinks.read_page(spark, sinks.write_ordered(rows, scratch(spark, "ordered"), ORDER), 2345, 500)


# Scalars ---------------------------------------------------------------------------------------------------------


@query(
    "B01_canonical_projection",
    with_sql(
        tb.LEDGER_SQL,
        """SELECT client_id, month, transaction_label, CAST(debit AS DOUBLE) AS debit_sum, CAST(credit AS DOUBLE) AS credit_sum,
                  CAST(debit > 0 AS BIGINT) AS debit_nonzero_count, CAST(credit > 0 AS BIGINT) AS credit_nonzero_count,
                  'lineitem' AS source_dataset, 'testbed' AS source_provider, currency,
                  concat_ws('|', CASE WHEN returned THEN 'returned' END, '', CASE WHEN untaxed THEN 'untaxed|checked' END)
                    AS data_quality_flags
           FROM ledger""",
    ),
)
def canonical_projection(spark, sf_dir):
    rows = tb.transactions(spark, sf_dir)
    return rows.withColumns({name: F.col(name).cast("double") for name in ("debit_sum", "credit_sum")})


@query(
    "B02_numeric_coercion",
    """SELECT event_id, coalesce(abs(TRY_CAST(CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '-' || amount
              WHEN 'click' THEN amount || 'd' ELSE amount END AS DOUBLE)), 0) AS amount
       FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM events)""",
)
def numeric_coercion(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when(kind == "error", "n/a")
        .when(kind == "view", F.concat(F.lit("-"), value))
        .when(kind == "click", F.concat(value, F.lit("d")))
        .otherwise(value)
    )
    return _events_text(spark, sf_dir).select("event_id", S.amount(text).alias("amount"))


@query(
    "B03_label_coercion",
    """SELECT o_orderkey, upper(coalesce(CASE WHEN o_orderstatus <> 'P' THEN lower(o_orderpriority) END, 'other')) AS label
       FROM orders""",
)
def label_coercion(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") != "P", F.lower("o_orderpriority"))
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", S.label(text, upper=True).alias("label"))


@query(
    "B04_formatted_number",
    r"""SELECT l_orderkey, coalesce(TRY_CAST(regexp_replace(t, '[^0-9.\-]', '', 'g') AS DOUBLE), 0) AS amount
        FROM (SELECT l_orderkey, CASE WHEN l_tax = 0 THEN '-' WHEN l_returnflag = 'R' THEN 'INR ' || format('{:,.2f}', l_extendedprice)
                     WHEN l_linenumber = 1 THEN '1-2' WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN NULL
                     ELSE '-' || format('{:,.2f}', l_extendedprice) END AS t FROM lineitem)""",
)
def formatted_number(spark, sf_dir):
    shown, place = F.format_number("l_extendedprice", 2), F.col("l_linenumber")
    text = (
        F.when(F.col("l_tax") == 0, "-")
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("INR "), shown))
        .when(place == 1, "1-2")
        .when(place == 2, "")
        .when(place == 3, None)
        .otherwise(F.concat(F.lit("-"), shown))
    )
    return tb.table(spark, sf_dir, "lineitem").select("l_orderkey", S.parse_number(text).alias("amount"))


@query(
    "B05_description_category",
    r"""SELECT doc_id, CASE
          WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])UPI([^\p{L}\p{N}_]|$)') THEN 'UPI'
          WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])NEFT([^\p{L}\p{N}_]|$)') THEN 'NEFT'
          WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])RTGS([^\p{L}\p{N}_]|$)') THEN 'RTGS'
          WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])IMPS([^\p{L}\p{N}_]|$)') THEN 'IMPS'
          WHEN contains(t, 'CHEQUE') OR regexp_matches(t, '(^|[^\p{L}\p{N}_])CHQ([^\p{L}\p{N}_]|$)') THEN 'CHEQUE'
          WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])CASH([^\p{L}\p{N}_]|$)') THEN 'CASH'
          WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])ATM([^\p{L}\p{N}_]|$)') THEN 'ATM'
          WHEN contains(t, 'CHARGE') OR contains(t, 'FEE') THEN 'CHARGE'
          WHEN contains(t, 'REVERSAL') OR contains(t, 'REVERSED') THEN 'REVERSAL'
          ELSE 'OTHER' END AS category
        FROM (SELECT doc_id, upper(text) AS t FROM documents)""",
)
def description_category(spark, sf_dir):
    return S.with_category(tb.table(spark, sf_dir, "documents"), "text").select("doc_id", "category")


@query(
    "B06_direction",
    with_sql(
        tb.COMPANIES_SQL,
        "SELECT event_id, CAST(is_debit AS BIGINT) AS is_debit, CAST(is_credit AS BIGINT) AS is_credit FROM sided",
    ),
)
def direction(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "purchase", "outgoing")
        .when(F.col("event_type") == "click", "Deposit")
        .when(F.col("event_type") == "view", "EXPENSE")
        .when(F.col("event_type") == "error", "unknown")
    )
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    debit, credit = S.directions(text, signed)
    return events.select("event_id", S.flag(debit).alias("is_debit"), S.flag(credit).alias("is_credit"))


@query(
    "B07_step_time",
    """SELECT event_id,
              strftime(TIMESTAMP '2023-01-01' + to_hours(CAST(step AS BIGINT)), '%Y-%m-%d %H') AS by_hour,
              strftime(TIMESTAMP '2023-01-01' + to_days(CAST(step AS INT)), '%Y-%m-%d %H') AS by_day
       FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS step FROM events)""",
)
def step_time(spark, sf_dir):
    step = S.try_number(F.when(F.col("event_type") == "error", "bad").otherwise(F.col("user_id").cast("string")))
    shown = "yyyy-MM-dd HH"
    return tb.table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format(S.step_time(step, unit="hour"), shown).alias("by_hour"),
        F.date_format(S.step_time(step, unit="day"), shown).alias("by_day"),
    )


_MONTH_TEXT_SQL = """SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m') END AS month FROM events"""


def _months(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "not a date").otherwise(F.col("moment"))
    return _events_text(spark, sf_dir).select("event_id", S.month_of_text(text).alias("month"))


@query("B08_month_of_text", _MONTH_TEXT_SQL)
def month_of_text(spark, sf_dir):
    return _months(spark, sf_dir)


@query(
    "B09_composite_key",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || ':' || CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS client_id FROM customer",
)
def composite_key(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return tb.table(spark, sf_dir, "customer").select("c_custkey", S.composite_key(":", "c_nationkey", name).alias("client_id"))


@query(
    "B10_client_prefix",
    """SELECT (CASE WHEN l_suppkey % 2 = 0 THEN 'M' ELSE 'C' END) || l_suppkey AS client_id, count(*) AS n
       FROM lineitem WHERE l_suppkey % 2 <> 0 GROUP BY 1""",
)
def client_prefix(spark, sf_dir):
    sides = tb.two_sided(spark, sf_dir).select(F.col("nameDest").alias("client_id"))
    return sides.where(S.is_client(F.col("client_id"))).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B11_signed_split",
    "SELECT c_custkey, greatest(c_acctbal, 0) AS credit, greatest(-c_acctbal, 0) AS debit FROM customer",
)
def signed_split(spark, sf_dir):
    net = F.col("c_acctbal")
    return tb.table(spark, sf_dir, "customer").select("c_custkey", S.inflow(net).alias("credit"), S.outflow(net).alias("debit"))


@query("B12_drop_missing", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events WHERE event_type <> 'error'")
def drop_missing(spark, sf_dir):
    return _months(spark, sf_dir).dropna(subset=["month"])


@query(
    "B12_unreadable_dates",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE l_linenumber = 7) AS unreadable
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey""",
)
def unreadable_dates(spark, sf_dir):
    rows = tb.transfers(spark, sf_dir)
    return tabular.unreadable_dates(rows, S.moment_of(rows, "Timestamp"))


@query("B13_forbidden_targets", "SELECT event_id, value FROM events")
def forbidden_targets(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").select(
        "event_id", "value", F.lit(0).alias("isFraud"), F.lit(0).alias("Is Laundering"), F.lit(0).alias("AML labels")
    )
    return events.drop(*schemas.invalid_target_columns(events))


@query("B14_column_aliases", "SELECT ts AS date, value AS amount, user_id AS account FROM events")
def column_aliases(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").withColumnsRenamed({"ts": "Posted_At", "user_id": "ACCOUNT_ID"})
    wanted = {"date": companies.DATE, "amount": companies.AMOUNT, "account": companies.ACCOUNT}
    return events.select(
        *[F.col(tabular.first_column(events.columns, names)).alias(name) for name, names in wanted.items()]
    )


@query(
    "B15_target_alias",
    with_sql(
        tb.CANONICAL_SQL,
        """SELECT client_id AS series_id, month, CAST(sum(CAST(credit_sum AS DECIMAL(18,2))) AS DOUBLE) AS value
           FROM canonical GROUP BY client_id, month""",
    ),
)
def target_alias(spark, sf_dir):
    totals = series_totals(tb.canonical(spark, sf_dir), scale=2)
    return totals.select("series_id", "month", F.col(schemas.resolve_target("credit")).alias("value"))


@query(
    "B16_flatten_statements",
    with_sql(tb.PAYLOADS_SQL, "SELECT client_id, currency, kind, place, CAST(moment AS DATE) AS day FROM moves"),
)
def flatten_statements(spark, sf_dir):
    flat = statements.transactions(statements.statements(tb.payloads(spark, sf_dir)))
    return flat.select("client_id", "currency", "kind", "place", F.col("moment").cast("date").alias("day"))


@query("B17_guarded_ratio", "SELECT l_orderkey, l_extendedprice / greatest(l_tax * 100, 1) AS ratio FROM lineitem")
def guarded_ratio(spark, sf_dir):
    ratio = S.guarded_ratio(F.col("l_extendedprice"), F.col("l_tax") * 100)
    return tb.table(spark, sf_dir, "lineitem").select("l_orderkey", ratio.alias("ratio"))


@query(
    "B18_finite",
    """SELECT l_orderkey, CASE WHEN l_tax > 0 AND l_discount > 0 THEN l_quantity END AS finite,
              CASE WHEN l_tax > 0 AND l_discount > 0 THEN l_quantity ELSE 0 END AS model_input FROM lineitem""",
)
def finite(spark, sf_dir):
    value = (
        F.when(F.col("l_tax") <= 0, float("nan"))
        .when(F.col("l_discount") <= 0, float("-inf"))
        .otherwise(F.col("l_quantity"))
    )
    return tb.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", S.finite(value).alias("finite"), S.model_input(value).alias("model_input")
    )


@query(
    "B19_risk_group",
    with_sql(
        tb.SCORES_SQL,
        "SELECT id, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS risk_group FROM scores",
    ),
)
def risk_group(spark, sf_dir):
    return tb.scores(spark, sf_dir).select("id", S.risk_group(F.col("score")).alias("risk_group"))


@query(
    "B20_season_angle",
    """SELECT o_orderkey, month(o_orderdate) AS month_number, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin,
              round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders""",
)
def season_angle(spark, sf_dir):
    month = F.month("o_orderdate")
    sine, cosine = (F.round(angle, 6) + 0.0 for angle in S.season_angle(month))
    return tb.table(spark, sf_dir, "orders").select(
        "o_orderkey", month.alias("month_number"), sine.alias("month_sin"), cosine.alias("month_cos")
    )


@query(
    "B21_month_filter",
    with_sql(tb.SCORES_SQL, "SELECT id, month, score FROM scores WHERE month IN ('1995-03', '1996-07', '1997-11')"),
)
def month_filter(spark, sf_dir):
    return tb.scores(spark, sf_dir).where(F.col("month").isin("1995-03", "1996-07", "1997-11")).select("id", "month", "score")


@query(
    "B22_failed_rows",
    with_sql(
        tb.PAYLOADS_SQL,
        """SELECT client_id, kind, CAST(failed AS BIGINT) AS failed, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
                  balance FROM moves""",
    ),
)
def failed_rows(spark, sf_dir):
    flat = statements.transactions(statements.statements(tb.payloads(spark, sf_dir)))
    return flat.select(
        "client_id",
        "kind",
        S.flag(F.col("failed")).alias("failed"),
        "debit",
        "credit",
        F.when(F.col("balance_text").isNotNull(), S.parse_number("balance_text")).alias("balance"),
    )


@query(
    "B23_default_label",
    with_sql(
        tb.COMPANIES_SQL,
        """SELECT coalesce(company, 'UNKNOWN_COMPANY') AS client_id, strftime(ts, '%Y-%m') AS month, 'OTHER' AS transaction_label,
                  count(*) FILTER (WHERE is_debit) AS debit_nonzero_count
           FROM sided LEFT JOIN companies ON user_id = account GROUP BY 1, 2""",
    ),
)
def default_label(spark, sf_dir):
    tables = tb.company_tables(spark, sf_dir)
    tables["bank_transactions"] = tables["bank_transactions"].drop("memo")
    rows = can.canonical_monthly(companies.to_canonical(tables, "events", "testbed"), companies.FLAGS)
    return rows.select("client_id", "month", "transaction_label", "debit_nonzero_count")


# Adapters --------------------------------------------------------------------------------------------------------

_ADAPTER_COLUMNS = """CAST(sum(CAST({debit} AS DECIMAL(18,4))) AS DOUBLE) AS debit_sum,
  CAST(sum(CAST({credit} AS DECIMAL(18,4))) AS DOUBLE) AS credit_sum"""


def _checked(rows: DataFrame, *keys: str) -> DataFrame:
    """Canonical table of adapter rows with exact sums, the columns that vary."""
    table = can.canonical_monthly(rows, ADAPTER_FLAGS, scale=4)
    return table.select(
        "client_id", "month", "transaction_label", *keys, "debit_sum", "credit_sum", "debit_nonzero_count", "credit_nonzero_count"
    )


@query(
    "C01_two_sided_canonical",
    with_sql(
        tb.TWO_SIDED_SQL,
        """typed AS (SELECT *, change IS NULL OR (change = 0 AND amount > 0) AS by_type,
             kind IN ('PAYMENT','TRANSFER','CASH_OUT','DEBIT') AS outgoing, kind IN ('CASH_IN','CREDIT') AS incoming FROM admitted)""",
        """valued AS (SELECT *,
             CASE WHEN by_type AND ((side = 0 AND outgoing) OR (side = 1 AND incoming)) THEN amount
                  WHEN change < 0 THEN -change ELSE 0 END AS debit,
             CASE WHEN by_type AND ((side = 0 AND incoming) OR (side = 1 AND outgoing)) THEN amount
                  WHEN change > 0 THEN change ELSE 0 END AS credit FROM typed)""",
        f"""SELECT client_id, month, kind AS transaction_label, {_ADAPTER_COLUMNS.format(debit="debit", credit="credit")},
              count(*) FILTER (WHERE debit > 0) AS debit_nonzero_count, count(*) FILTER (WHERE credit > 0) AS credit_nonzero_count,
              CASE WHEN bool_or(by_type) THEN 'balance_delta_fallback' END AS data_quality_flags
            FROM valued GROUP BY client_id, month, kind""",
    ),
)
def two_sided_canonical(spark, sf_dir):
    rows = balance_ledger.to_canonical(tb.two_sided(spark, sf_dir), "lineitem", "testbed", "1995-01-01")
    return _checked(rows, "data_quality_flags")


_FIRST_LAST = """first({first} ORDER BY {order}) AS opening_balance, last({last} ORDER BY {order}) AS closing_balance,
  CAST(least(min({first}), min({last})) AS DOUBLE) AS minimum_observed_balance,
  CAST(greatest(max({first}), max({last})) AS DOUBLE) AS maximum_observed_balance,
  count(*) AS balance_observations_count,
  CAST(least(min({first}), min({last})) < {threshold} AS INT) AS balance_breach_proxy"""


@query(
    "C02_two_sided_liquidity",
    with_sql(
        tb.TWO_SIDED_SQL,
        f"""SELECT client_id, month, {_FIRST_LAST.format(first="old", last="new", order="step, side, old, new", threshold=0)}
            FROM admitted WHERE old IS NOT NULL AND new IS NOT NULL GROUP BY client_id, month""",
    ),
)
def two_sided_liquidity(spark, sf_dir):
    return balance_ledger.to_liquidity(tb.two_sided(spark, sf_dir), "1995-01-01")


@query(
    "C03_debit_only",
    f"""SELECT CAST(user_id AS VARCHAR) AS client_id, strftime(ts, '%Y-%m') AS month, event_type AS transaction_label,
          {_ADAPTER_COLUMNS.format(debit="value", credit="0")}, count(*) FILTER (WHERE value > 0) AS debit_nonzero_count,
          CAST(0 AS BIGINT) AS credit_nonzero_count, 'debit_only' AS data_quality_flags
        FROM events GROUP BY 1, 2, 3""",
)
def debit_only(spark, sf_dir):
    cards = tb.table(spark, sf_dir, "events").select(
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step"),
        F.col("user_id").alias("customer"),
        F.col("event_type").alias("category"),
        F.col("value").alias("amount"),
        F.lit(0).alias("fraud"),
    )
    return _checked(card_ledger.to_canonical(cards, "events", "testbed", "2024-01-01"), "data_quality_flags")


@query(
    "C04_two_currencies",
    with_sql(
        tb.TRANSFERS_SQL,
        f"""SELECT client_id, month, label AS transaction_label, currency, {_ADAPTER_COLUMNS.format(debit="debit", credit="credit")},
              count(*) FILTER (WHERE debit > 0) AS debit_nonzero_count, count(*) FILTER (WHERE credit > 0) AS credit_nonzero_count
            FROM transfer_sides WHERE month IS NOT NULL GROUP BY 1, 2, 3, 4""",
    ),
)
def two_currencies(spark, sf_dir):
    return _checked(transfers.to_canonical(tb.transfers(spark, sf_dir), "lineitem", "testbed"), "currency")


@query(
    "C05_nested_statements",
    with_sql(
        tb.PAYLOADS_SQL,
        f"""SELECT client_id, strftime(moment, '%Y-%m') AS month, kind AS transaction_label, currency,
              {_ADAPTER_COLUMNS.format(debit="debit", credit="credit")},
              count(*) FILTER (WHERE debit <> 0) AS debit_nonzero_count, count(*) FILTER (WHERE credit <> 0) AS credit_nonzero_count,
              CASE WHEN bool_or(failed) THEN 'failed_excluded' END AS data_quality_flags
            FROM moves GROUP BY 1, 2, 3, 4""",
    ),
)
def nested_statements(spark, sf_dir):
    rows = statements.to_canonical(statements.statements(tb.payloads(spark, sf_dir)), "lineitem", "testbed")
    return _checked(rows, "currency", "data_quality_flags")


@query(
    "C06_statement_liquidity",
    with_sql(
        tb.PAYLOADS_SQL,
        """seen AS (SELECT client_id, moment, 0 AS kind, place, balance FROM moves WHERE balance IS NOT NULL
             UNION ALL SELECT client_id, day, 1, 0, CAST(price AS DOUBLE) FROM items
             UNION ALL SELECT client_id, day + 20, 2, 0, quantity FROM items)""",
        f"""SELECT client_id, strftime(moment, '%Y-%m') AS month,
              {_FIRST_LAST.format(first="balance", last="balance", order="moment, kind, place, balance", threshold=20)}
            FROM seen GROUP BY 1, 2""",
    ),
)
def statement_liquidity(spark, sf_dir):
    return statements.to_liquidity(statements.statements(tb.payloads(spark, sf_dir)), threshold=20.0)


@query(
    "C07_company_ledger",
    with_sql(
        tb.COMPANIES_SQL,
        f"""SELECT coalesce(company, 'UNKNOWN_COMPANY') AS client_id, strftime(ts, '%Y-%m') AS month, event_type AS transaction_label,
              {_ADAPTER_COLUMNS.format(debit="CASE WHEN is_debit THEN value ELSE 0 END", credit="CASE WHEN is_credit THEN value ELSE 0 END")},
              count(*) FILTER (WHERE is_debit) AS debit_nonzero_count, count(*) FILTER (WHERE is_credit) AS credit_nonzero_count,
              'one_company' AS data_quality_flags
            FROM sided LEFT JOIN companies ON user_id = account GROUP BY 1, 2, 3""",
    ),
)
def company_ledger(spark, sf_dir):
    return _checked(companies.to_canonical(tb.company_tables(spark, sf_dir), "events", "testbed"), "data_quality_flags")


@query(
    "C08_company_liquidity",
    with_sql(
        tb.COMPANIES_SQL,
        f"""SELECT coalesce(company, 'SINGLE_COMPANY') AS client_id, strftime(ts, '%Y-%m') AS month,
              {_FIRST_LAST.format(first="value", last="value", order="ts, value", threshold=1)}
            FROM events LEFT JOIN companies ON user_id = account WHERE event_type = 'view' GROUP BY 1, 2""",
    ),
)
def company_liquidity(spark, sf_dir):
    return companies.to_liquidity(tb.company_tables(spark, sf_dir), threshold=1.0)


def _series(spark, sf_dir):
    flows = tb.lines(spark, sf_dir).select(
        F.col("date").alias("Value Date"), F.col("credit").alias("Total Inflow"), F.col("debit").alias("Total Outflow")
    )
    return inout_series.to_series(flows, scale=2)


_SERIES_SQL = """series AS (SELECT 'AGGREGATE' AS series_id, date, CAST(sum(credit) AS DOUBLE) AS inflow,
  CAST(sum(debit) AS DOUBLE) AS outflow, CAST(sum(credit) - sum(debit) AS DOUBLE) AS net_flow FROM lines GROUP BY date)"""


@query("C09_inout_series", with_sql(tb.LINES_SQL, _SERIES_SQL, "SELECT * FROM series"))
def aggregate_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query(
    "C10_series_canonical",
    with_sql(
        tb.LINES_SQL,
        _SERIES_SQL,
        f"""SELECT series_id AS client_id, strftime(date, '%Y-%m') AS month, side AS transaction_label,
              {_ADAPTER_COLUMNS.format(debit="debit", credit="credit")},
              count(*) FILTER (WHERE debit <> 0) AS debit_nonzero_count, count(*) FILTER (WHERE credit <> 0) AS credit_nonzero_count,
              'aggregate_series|not_client_level' AS data_quality_flags
            FROM (SELECT series_id, date, 'INFLOW' AS side, 0 AS debit, inflow AS credit FROM series
                  UNION ALL SELECT series_id, date, 'OUTFLOW', outflow, 0 FROM series) GROUP BY 1, 2, 3""",
    ),
)
def series_canonical(spark, sf_dir):
    return _checked(inout_series.to_canonical(_series(spark, sf_dir), "lineitem", "testbed"), "data_quality_flags")


@query(
    "C11_category_table",
    """SELECT DISTINCT text AS transaction_description, lang AS category, source AS country, CAST(NULL AS VARCHAR) AS currency
       FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""",
)
def category_table(spark, sf_dir):
    return category_text.to_table(tb.categories(spark, sf_dir))


@query(
    "C12_adapter_by_name",
    f"""SELECT CAST(user_id AS VARCHAR) AS client_id, strftime(ts, '%Y-%m') AS month, event_type AS transaction_label,
          {_ADAPTER_COLUMNS.format(debit="value", credit="0")}, 'card_ledger' AS source_dataset, 'debit_only' AS data_quality_flags
        FROM events GROUP BY 1, 2, 3""",
)
def adapter_by_name(spark, sf_dir):
    cards = tb.table(spark, sf_dir, "events").select(
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step"),
        F.col("user_id").alias("customer"),
        F.col("event_type").alias("category"),
        F.col("value").alias("amount"),
        F.lit(0).alias("fraud"),
    )
    path = sinks.write_csv(cards, scratch(spark, "cards") + ".csv")
    result = registry.normalize(spark, "card_ledger", [path], {"base_date": "2024-01-01"}, scale=4).canonical
    return result.select(
        "client_id", "month", "transaction_label", "debit_sum", "credit_sum", "source_dataset", "data_quality_flags"
    )


@query(
    "C13_quality_flags",
    with_sql(
        tb.LINES_SQL,
        """SELECT DISTINCT unnest(string_split(concat_ws('|', CASE WHEN returned THEN 'returned' END,
             CASE WHEN untaxed THEN 'untaxed|checked' END), '|')) AS flag FROM lines WHERE returned OR untaxed""",
    ),
)
def quality_flags(spark, sf_dir):
    return can.quality_flags(tb.canonical(spark, sf_dir))
