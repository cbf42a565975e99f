"""Company ledger spread over several tables: transactions, accounts, statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tideledger.functions.scalars import directions, field_number, flag, label, moment_of, month_of
from tideledger.operators.canonical import balances_of, canonical_monthly, canonical_rows, merged_ends, observed_ends, packed_order
from tideledger.sources.tabular import SourceError, find_table, first_column

# Accepted column names, in order of preference.
DATE = ["date", "transaction_date", "posted_at", "timestamp"]
AMOUNT = ["amount", "transaction_amount", "value"]
ACCOUNT = ["bank_account_id", "account_id"]
COMPANY = ["company_id", "business_id"]
DIRECTION = ["direction", "transaction_type", "type"]
DESCRIPTION = ["description", "memo", "category"]
ACCOUNT_ID = ["id", "bank_account_id", "account_id"]
STATEMENT_DATE = ["date", "statement_date", "month"]
BALANCE = ["closing_balance", "balance", "ending_balance"]

ONE_COMPANY = "one_company"
FLAGS = (ONE_COMPANY,)
SINGLE = "SINGLE_COMPANY"


def account_companies(tables: dict[str, DataFrame]) -> DataFrame | None:
    """account → company, one row per account; of repeated accounts the greatest company name counts."""
    accounts = find_table(tables, "account", without="transaction")
    if accounts is None:
        return None
    account, company = first_column(accounts.columns, ACCOUNT_ID), first_column(accounts.columns, COMPANY)
    if not (account and company):
        return None
    return (
        accounts.select(F.col(account).cast("string").alias("account"), F.col(company).cast("string").alias("company"))
        .groupBy("account")
        .agg(F.max("company").alias("company"))
    )


def with_company(df: DataFrame, companies: DataFrame | None, default: str) -> DataFrame:
    """Resolve ``account`` to a client. The lookup is a plain left join: its size decides whether it is broadcast."""
    if companies is None:
        return df.withColumn("client_id", F.lit(default))
    joined = df.join(companies, "account", "left")
    return joined.withColumn("client_id", F.coalesce("company", F.lit(default)))


def to_canonical(tables: dict[str, DataFrame], dataset: str, provider: str, day_first: bool = False) -> DataFrame:
    """Canonical rows of the transaction table.

    Rows are first summed per account, month and label, so an account with very many transactions enters the lookup
    join as few rows. Counts follow the direction, so a zero amount counts too.
    """
    moves = find_table(tables, "transaction")
    if moves is None:
        raise SourceError("No table with 'transaction' in its name")
    names = moves.columns
    day, value = first_column(names, DATE), first_column(names, AMOUNT)
    if not (day and value):
        raise SourceError("The transaction table needs a date and an amount column")
    account, company = first_column(names, ACCOUNT), first_column(names, COMPANY)
    direction, description = first_column(names, DIRECTION), first_column(names, DESCRIPTION)

    signed = F.coalesce(field_number(moves, value).cast("double"), F.lit(0.0))
    is_debit, is_credit = directions(direction, signed)
    size = F.abs(signed)
    holder = F.col(company) if company else F.col(account) if account else F.lit(None)
    rows = canonical_rows(
        moves,
        dataset,
        provider,
        client_id=holder.cast("string"),
        month=month_of(moment_of(moves, day, day_first)),
        transaction_label=label(description) if description else F.lit("OTHER"),
        debit_sum=F.when(is_debit, size).otherwise(F.lit(0.0)),
        credit_sum=F.when(is_credit, size).otherwise(F.lit(0.0)),
        debit_nonzero_count=flag(is_debit),
        credit_nonzero_count=flag(is_credit),
        data_quality_flags=F.lit(ONE_COMPANY),
    ).where("month is not null")
    if company:
        return rows
    companies = account_companies(tables) if account else None
    if companies is None:
        return rows.withColumn("client_id", F.lit(SINGLE))
    partial = canonical_monthly(rows, FLAGS).withColumnRenamed("client_id", "account")
    return with_company(partial, companies, "UNKNOWN_COMPANY").select(*rows.columns)


def to_liquidity(tables: dict[str, DataFrame], threshold: float = 0.0, day_first: bool = False) -> DataFrame | None:
    """Monthly balances of the statement table; none without one."""
    readings = find_table(tables, "statement")
    if readings is None:
        return None
    names = readings.columns
    day, value = first_column(names, STATEMENT_DATE), first_column(names, BALANCE)
    if not (day and value):
        return None
    account, company = first_column(names, ACCOUNT), first_column(names, COMPANY)
    moment = moment_of(readings, day, day_first)
    plain = readings.select(
        (F.col(company) if company else F.col(account) if account else F.lit(None)).cast("string").alias("account"),
        month_of(moment).alias("month"),
        moment.alias("moment"),
        field_number(readings, value).cast("double").alias("balance"),
    ).dropna(subset=["month", "moment", "balance"])
    # An account's readings become one row a month before the account is looked up.
    ordered = plain.select("account", "month", "balance", packed_order(F.col("moment")).alias("order"))
    ends = observed_ends(ordered, ["account", "month"], "order")
    if company:
        seen = ends.withColumnRenamed("account", "client_id").dropna(subset=["client_id"])
    else:
        seen = with_company(ends, account_companies(tables) if account else None, SINGLE)
    return balances_of(merged_ends(seen, ["client_id", "month"]), threshold)


def days(tables: dict[str, DataFrame]) -> DataFrame:
    """``day``: the date texts of transactions and statements; typed dates aren't listed."""
    found = []
    for part, names in (("transaction", DATE), ("statement", STATEMENT_DATE)):
        table = find_table(tables, part)
        name = first_column(table.columns, names) if table is not None else None
        if name and isinstance(table.schema[name].dataType, T.StringType):
            found.append(table.select(F.col(name).alias("day")))
    return reduce(DataFrame.unionByName, found) if found else next(iter(tables.values())).select(F.lit(None).cast("string").alias("day")).limit(0)
