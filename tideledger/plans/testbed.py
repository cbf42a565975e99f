"""The driver's tables seen as ledgers, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideledger.functions.scalars import flag
from tideledger.operators.canonical import canonical_monthly, canonical_rows
from tideledger.operators.ledger import daily_flows, running_balance
from tideledger.sources.statements import STATEMENT

LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = ("checked", "returned", "untaxed")
MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payments of suppliers: returned ones are debits, the others credits."""
    price = F.col("l_extendedprice").cast(MONEY)
    returned = F.col("l_returnflag") == "R"
    zero = F.lit(0).cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("client_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        price.alias("amount"),
        F.when(returned, price).otherwise(zero).alias("debit"),
        F.when(returned, zero).otherwise(price).alias("credit"),
        F.when(F.col("l_linestatus") == "F", "USD").alias("currency"),
        F.concat_ws(
            "|", F.when(returned, "returned"), F.lit(""), F.when(F.col("l_tax") == 0, "untaxed|checked")
        ).alias("flags"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with the order's priority as transaction label."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("transaction_label"))
    items = lines(spark, sf_dir)
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as unaggregated canonical rows."""
    return canonical_rows(
        ledger(spark, sf_dir),
        "lineitem",
        "testbed",
        client_id=F.col("client_id"),
        month=F.col("month"),
        transaction_label=F.col("transaction_label"),
        debit_sum=F.col("debit"),
        credit_sum=F.col("credit"),
        debit_nonzero_count=flag(F.col("debit") > 0),
        credit_nonzero_count=flag(F.col("credit") > 0),
        currency=F.col("currency"),
        data_quality_flags=F.col("flags"),
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical monthly table of the ledger, with exact sums."""
    return canonical_monthly(transactions(spark, sf_dir), FLAGS, scale=2)


def stressed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily flows under stress (half the credits, debits plus a tenth) with opening balance and overdraft."""
    flows = lines(spark, sf_dir).select(
        "client_id",
        "date",
        (F.col("credit") * F.lit("0.50").cast("decimal(3,2)")).alias("credit"),
        (F.col("debit") * F.lit("1.10").cast("decimal(3,2)")).alias("debit"),
    )
    limits = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("client_id"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).cast("decimal(18,4)").alias("opening"),
        F.when(F.col("s_suppkey") % 2 == 0, 50000).otherwise(0).cast("decimal(18,4)").alias("overdraft"),
    )
    return daily_flows(flows).join(limits, "client_id")


def stressed_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_balance(stressed_days(spark, sf_dir))


LINES_SQL = """lines AS (
  SELECT l_orderkey, 'S' || l_suppkey AS client_id, CAST(l_shipdate AS DATE) AS date,
         strftime(l_shipdate, '%Y-%m') AS month,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS debit,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS credit,
         CASE WHEN l_linestatus = 'F' THEN 'USD' END AS currency,
         l_returnflag = 'R' AS returned, l_tax = 0 AS untaxed
  FROM lineitem)"""
LEDGER_SQL = f"""{LINES_SQL}, ledger AS (
  SELECT lines.*, o_orderpriority AS transaction_label FROM lines JOIN orders ON l_orderkey = o_orderkey)"""
CANONICAL_SQL = f"""{LEDGER_SQL}, canonical AS (
  SELECT client_id, month, transaction_label,
         CAST(sum(debit) AS DOUBLE) AS debit_sum, CAST(sum(credit) AS DOUBLE) AS credit_sum,
         count(*) FILTER (WHERE debit > 0) AS debit_nonzero_count,
         count(*) FILTER (WHERE credit > 0) AS credit_nonzero_count,
         'lineitem' AS source_dataset, 'testbed' AS source_provider, currency,
         nullif(concat_ws('|', CASE WHEN bool_or(untaxed) THEN 'checked' END,
                               CASE WHEN bool_or(returned) THEN 'returned' END,
                               CASE WHEN bool_or(untaxed) THEN 'untaxed' END), '') AS data_quality_flags
  FROM ledger GROUP BY client_id, month, transaction_label, currency)"""
DAYS_SQL = f"""{LINES_SQL}, limits AS (
  SELECT 'S' || s_suppkey AS client_id, CAST(greatest(s_acctbal, 0.0) AS DECIMAL(18,4)) AS opening,
         CAST(CASE WHEN s_suppkey % 2 = 0 THEN 50000 ELSE 0 END AS DECIMAL(18,4)) AS overdraft
  FROM supplier), flows AS (
  SELECT client_id, date, sum(credit) * 0.50 AS credit, sum(debit) * 1.10 AS debit,
         count(*) FILTER (WHERE credit > 0) AS credit_nonzero_count,
         count(*) FILTER (WHERE debit > 0) AS debit_nonzero_count
  FROM lines GROUP BY client_id, date), days AS (
  SELECT * FROM flows JOIN limits USING (client_id))"""
BALANCES_SQL = f"""{DAYS_SQL}, free AS (
  SELECT *, opening + sum(credit - debit) OVER (PARTITION BY client_id ORDER BY date) AS free FROM days), absorbed AS (
  SELECT *, greatest(max(-overdraft - free) OVER (PARTITION BY client_id ORDER BY date), 0) AS absorbed FROM free),
balances AS (
  SELECT client_id, date, credit, debit, opening, overdraft, free + absorbed AS closing_balance,
         coalesce(lag(free + absorbed) OVER w, opening) AS opening_balance,
         absorbed - coalesce(lag(absorbed) OVER w, 0) AS cash_gap_amount,
         CAST(absorbed - coalesce(lag(absorbed) OVER w, 0) > 0 AS INT) AS cash_gap
  FROM absorbed WINDOW w AS (PARTITION BY client_id ORDER BY date))"""
GAPS_SQL = f"""{BALANCES_SQL}, gaps AS (
  SELECT client_id, strftime(date, '%Y-%m') AS month, max(cash_gap) AS cash_gap_current_month,
         CAST(sum(cash_gap_amount) AS DOUBLE) AS cash_gap_amount
  FROM balances GROUP BY ALL), target AS (
  SELECT *, lead(cash_gap_current_month) OVER (PARTITION BY client_id ORDER BY month) AS cash_gap_next_month FROM gaps)"""


# Source-shaped views ---------------------------------------------------------------------------------------------


def two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a two-sided ledger with balances; some are missing, some do not move."""
    price, old = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    place = F.col("l_linenumber")
    kinds = F.array(*[F.lit(k) for k in ("PAYMENT", "TRANSFER", "cash_out", "DEBIT", "CASH_IN", "credit", "REFUND")])
    kind = F.when(F.col("l_suppkey") % 11 != 0, F.element_at(kinds, (place % 7 + 1).cast("int")))
    days = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    moved = F.when(place % 7 < 4, old - price).otherwise(old + price)
    return table(spark, sf_dir, "lineitem").select(
        (days * 24 + place).alias("step"),
        kind.alias("type"),
        price.alias("amount"),
        F.concat(F.lit("C"), (F.col("l_partkey") % 500).cast("string")).alias("nameOrig"),
        old.alias("oldbalanceOrg"),
        F.when(place == 2, None).when(place == 3, old).otherwise(moved).alias("newbalanceOrig"),
        F.concat(F.when(F.col("l_suppkey") % 2 == 0, "M").otherwise("C"), F.col("l_suppkey").cast("string")).alias("nameDest"),
        price.alias("oldbalanceDest"),
        F.when(place != 5, price + F.col("l_quantity")).alias("newbalanceDest"),
    )


TWO_SIDED_SQL = """two_sided AS (
  SELECT date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 24 + l_linenumber AS step,
         CASE WHEN l_suppkey % 11 <> 0 THEN
           ['PAYMENT','TRANSFER','CASH_OUT','DEBIT','CASH_IN','CREDIT','REFUND'][l_linenumber % 7 + 1]
         ELSE 'OTHER' END AS kind,
         l_extendedprice AS amount, 'C' || (l_partkey % 500) AS orig, l_quantity * 1000 AS orig_old,
         CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN l_quantity * 1000
              WHEN l_linenumber % 7 < 4 THEN l_quantity * 1000 - l_extendedprice
              ELSE l_quantity * 1000 + l_extendedprice END AS orig_new,
         CASE WHEN l_suppkey % 2 = 0 THEN 'M' ELSE 'C' END || l_suppkey AS dest, l_extendedprice AS dest_old,
         CASE WHEN l_linenumber <> 5 THEN l_extendedprice + l_quantity END AS dest_new
  FROM lineitem), sides AS (
  SELECT step, kind, amount, 0 AS side, orig AS client_id, orig_old AS old, orig_new AS new FROM two_sided
  UNION ALL
  SELECT step, kind, amount, 1, dest, dest_old, dest_new FROM two_sided), admitted AS (
  SELECT *, new - old AS change,
         strftime(TIMESTAMP '1995-01-01' + to_hours(CAST(step AS BIGINT)), '%Y-%m') AS month
  FROM sides WHERE client_id LIKE 'C%')"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transfers from the customer's bank to the supplier's, each in its region's currency."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = F.concat(F.lit("CUR"), F.col("n_regionkey").cast("string"))
    bank = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    customers = (
        table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", bank.alias("c_bank"), region.alias("c_currency"))
    )
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", bank.alias("s_bank"), region.alias("s_currency"))
    )
    joined = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linenumber")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    moment = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "MM/dd/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy/MM/dd HH:mm"))
    return joined.select(
        F.when(F.col("l_linenumber") == 7, "unknown").otherwise(moment).alias("Timestamp"),
        F.col("c_bank").alias("From Bank"),
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("Account"),
        F.col("s_bank").alias("To Bank"),
        F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("Account.1"),
        (F.col("l_extendedprice").cast(MONEY) - F.col("l_quantity").cast("decimal(5,0)")).cast("string").alias("Amount Received"),
        F.col("s_currency").alias("Receiving Currency"),
        F.col("l_extendedprice").cast(MONEY).cast("string").alias("Amount Paid"),
        F.col("c_currency").alias("Payment Currency"),
        F.when(F.col("l_returnflag") != "N", F.col("o_orderpriority")).alias("Payment Format"),
        F.lit("0").alias("Is Laundering"),
    )


TRANSFERS_SQL = """banks AS (SELECT n_nationkey, printf('%03d', n_nationkey) AS bank, 'CUR' || n_regionkey AS currency FROM nation),
transfers AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate, '%Y-%m') END AS month,
         cb.bank AS from_bank, 'A' || o_custkey AS sender, sb.bank AS to_bank, 'B' || l_suppkey AS receiver,
         CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(5,0)) AS received, sb.currency AS received_in,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS paid, cb.currency AS paid_in,
         CASE WHEN l_returnflag <> 'N' THEN o_orderpriority ELSE 'OTHER' END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN banks cb ON cb.n_nationkey = c_nationkey JOIN banks sb ON sb.n_nationkey = s_nationkey),
transfer_sides AS (
  SELECT month, from_bank || ':' || sender AS client_id, label, paid AS debit, 0 AS credit, paid_in AS currency FROM transfers
  UNION ALL
  SELECT month, to_bank || ':' || receiver, label, 0, received, received_in FROM transfers)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as JSON-like statement payloads with three transactions; every second one wraps its statement."""
    price = F.col("l_extendedprice").cast(MONEY)
    fee = (price * F.col("l_tax").cast("decimal(3,2)")).cast("string")
    text = F.format_number(F.col("l_extendedprice"), 2)
    day = F.col("l_shipdate").cast("date")

    def transaction(date, later, description, debit, credit, balance, failed):
        return F.struct(
            date.alias("date"),
            later.alias("transaction_date"),
            F.lit(description).alias("description"),
            debit.alias("debit"),
            credit.alias("credit"),
            balance.alias("balance"),
            failed.alias("failed"),
        )

    none, day_text = F.lit(None).cast("string"), F.when(F.col("l_linenumber") == 2, F.date_format(day, "MM/dd/yyyy")).otherwise(day.cast("string"))
    moves = F.array(
        transaction(day_text, none, "NEFT sale", F.lit("-"), F.concat(F.lit("INR "), text), text,
            F.when(F.col("l_returnflag") == "R", F.element_at(F.array(F.lit("true"), F.lit("1"), F.lit("True")), 1 + (F.col("l_partkey") % 3).cast("int"))).otherwise("0")),
        transaction(none, F.date_add(day, 20).cast("string"), "monthly fee", fee, F.lit(""), F.lit(""), none),
        transaction(F.lit("no date"), none, "ATM CASH", text, none, text, F.lit("false")),
    )
    nothing = F.lit(None).cast(moves_type())
    long_name = F.col("l_linenumber") % 2 == 1
    statement = [
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("customer_id"),
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("account_number"),
        none.alias("accountNumber"),
        F.when(F.col("l_linestatus") == "F", "INR").alias("currency"),
        text.alias("opening_balance"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("closing_balance"),
        day_text.alias("start_date"),
        F.date_add(day, 20).cast("string").alias("end_date"),
        F.when(long_name, nothing).otherwise(moves).alias("transactions"),
        F.when(long_name, moves).otherwise(nothing).alias("transaction_details"),
    ]
    whole = table(spark, sf_dir, "lineitem").select(
        F.struct(*statement).alias("s"), (F.col("l_orderkey") % 2 == 0).alias("wrapped")
    )
    own = [F.when(~F.col("wrapped"), F.col(f"s.{name}")).alias(name) for name in STATEMENT.fieldNames()]
    return whole.select(*own, F.when(F.col("wrapped"), F.array("s")).alias("statements"))


def moves_type():
    return STATEMENT["transactions"].dataType


PAYLOADS_SQL = """items AS (
  SELECT CASE WHEN l_suppkey % 3 <> 0 THEN 'S' || l_suppkey ELSE 'A' || l_suppkey END AS client_id,
         CASE WHEN l_linestatus = 'F' THEN 'INR' END AS currency, CAST(l_shipdate AS DATE) AS day,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_tax AS DECIMAL(3,2)) AS tax,
         l_returnflag = 'R' AS failed, l_quantity AS quantity
  FROM lineitem), moves AS (
  SELECT client_id, currency, day AS moment, 'NEFT' AS kind, failed, CAST(0 AS DECIMAL(18,4)) AS debit,
         CASE WHEN failed THEN CAST(0 AS DECIMAL(18,2)) ELSE price END AS credit, 0 AS place, CAST(price AS DOUBLE) AS balance FROM items
  UNION ALL
  SELECT client_id, currency, day + 20, 'CHARGE', false, price * tax, 0, 1, NULL FROM items)"""


def company_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events as bank transactions and statements of accounts; every second account has a company."""
    events = table(spark, sf_dir, "events")
    direction = (
        F.when(F.col("event_type") == "purchase", "outgoing")
        .when(F.col("event_type") == "click", "Deposit")
        .when(F.col("event_type") == "view", "EXPENSE")
        .when(F.col("event_type") == "error", "unknown")
    )
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return {
        "bank_transactions": events.select(
            F.col("ts").alias("transaction_date"),
            F.col("user_id").alias("bank_account_id"),
            signed.alias("amount"),
            direction.alias("Direction"),
            F.col("event_type").alias("memo"),
        ),
        "bank_accounts": table(spark, sf_dir, "customer")
        .where("c_custkey % 4 < 2")
        .select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("company_id")),
        "bank_statements": events.where("event_type = 'view'").select(
            F.col("ts").alias("statement_date"), F.col("user_id").alias("bank_account_id"), F.col("value").alias("balance")
        ),
    }


COMPANIES_SQL = """directed AS (
  SELECT *, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END AS amount,
         CASE event_type WHEN 'purchase' THEN 'outgoing' WHEN 'click' THEN 'deposit' WHEN 'view' THEN 'expense'
                         WHEN 'error' THEN 'unknown' ELSE '' END AS direction FROM events), marked AS (
  SELECT *, regexp_matches(direction, 'debit|out|withdraw|expense') AS d,
         regexp_matches(direction, 'credit|in|deposit|income') AS c FROM directed), sided AS (
  SELECT *, d OR (NOT d AND NOT c AND amount < 0) AS is_debit, c OR (NOT d AND NOT c AND amount >= 0) AS is_credit
  FROM marked), companies AS (
  SELECT c_custkey AS account, 'N' || c_nationkey AS company FROM customer WHERE c_custkey % 4 < 2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a deterministic score and a label, for the metrics."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        ((F.col("o_orderkey") * 7919 % 1000) / F.lit(1000.0)).alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


SCORES_SQL = """scores AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month,
         CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
         CAST(o_orderstatus = 'F' AS INT) AS label FROM orders)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions, their language as category."""
    return table(spark, sf_dir, "documents").select(
        F.col("text").alias("transaction_description"),
        F.col("lang").alias("category"),
        F.col("source").alias("country"),
        F.lit(None).cast("string").alias("currency"),
    )
