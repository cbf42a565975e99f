"""Small helpers of the tests."""

from pyspark.sql import types as T


def rows(df, *columns, order=None):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=lambda r: tuple(str(v) for v in r))


def short(canonical):
    """(client, month, label, debit, credit, n_debit, n_credit, currency, flags)."""
    return rows(
        canonical,
        "client_id",
        "month",
        "transaction_label",
        "debit_sum",
        "credit_sum",
        "debit_nonzero_count",
        "credit_nonzero_count",
        "currency",
        "data_quality_flags",
    )


def monthly(spark, records):
    """Canonical rows from (client, month, label, debit, credit)."""
    from tideledger.schemas import CANONICAL

    full = [
        (c, m, label, float(d), float(k), int(d > 0), int(k > 0), "test", "test", None, None)
        for c, m, label, d, k in records
    ]
    return spark.createDataFrame(full, CANONICAL)


def months(count, start=(2020, 1)):
    year, month = start
    return [f"{year + (month - 1 + i) // 12:04d}-{(month - 1 + i) % 12 + 1:02d}" for i in range(count)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LONG, DOUBLE, TEXT = T.LongType(), T.DoubleType(), T.StringType()
