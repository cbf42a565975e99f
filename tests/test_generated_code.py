"""Date parsing stays in methods that the JIT compiles, and reads each shape as before."""

import datetime

from pyspark.sql import functions as F

from tideledger.functions.dates import parse_moment
from tideledger.sources import statements

JIT_LIMIT = 8000  # bytes of a method beyond which the JVM only interprets it


def sizes(df):
    """The longest generated method of each part of a plan; -1 where the code is too long to be loaded at all."""
    found = df._jdf.queryExecution().debug().codegenToSeq()
    return [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]


def test_parsing_statements_is_compiled(spark, tmp_path):
    path = tmp_path / "statements.json"
    path.write_text('{"customer_id": "a", "transactions": [{"date": "2024-01-05", "credit": "5"}]}\n')
    flat = statements.transactions(statements.statements(spark.read.schema(statements.DOCUMENT).json(str(path))))
    assert all(0 < size < JIT_LIMIT for size in sizes(flat))
    assert [r["moment"] for r in flat.collect()] == [datetime.datetime(2024, 1, 5)]


def test_every_beginning_keeps_its_shapes(spark):
    day, noon = datetime.datetime(2024, 3, 4), datetime.datetime(2024, 3, 4, 12)
    want = {
        "2024-03-04": day, "2024/3/4": day, "2024.03.04 12:00": noon, "3/4/2024": day, "3-4-24 12:00 PM": noon, "4.3.2024": day, "04.03.24 12:00 AM": day,
        "20240304": day, "20240304T120000": noon, "20240304120000": noon, "4 March 2024": day, "4-Mar-2024 12:00": noon, "Mar 4, 2024": day, "sept 31, 2024": None,
        "3/4/2024 PM": None, "3/4": None, "4 May": None, "no date": None, "": None, "12": None, "20240304x": None, "4.3.20245": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", parse_moment("t").alias("m")).collect()} == want
    kept = df.where(parse_moment("t", day_first=True) == F.lit("2024-04-03").cast("timestamp")).collect()
    assert [r["t"] for r in kept] == ["3/4/2024"]
