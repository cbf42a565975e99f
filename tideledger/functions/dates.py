"""Date texts of transaction files.

A text's shape decides how it is read: each row passes cheap shape tests, at most one of them rewrites it in ISO form, and
one cast reads that, without a parser that fails by exception. Whether 05/01/2025 is in May or in January is a property of
a source, never of a row: a column is read in one order, and rows that don't fit it have no date and are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

_CLOCK = r"(?:[ T,]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?(?:[AaPp][Mm])?)?$"
_TWO = r"^(\d{1,2})[/-](\d{1,2})[/-]"
# A year of two digits lies between 1969 and 2068.
_YEARS = [(r"(\d{4})", ""), (r"([0-5]\d|6[0-8])", "20"), (r"(69|[7-9]\d)", "19")]
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAMES = {name: str(i) for i, month in enumerate(_MONTHS, 1) for name in (month, month[:3])} | {"sept": "9"}


class DateOrderError(ValueError):
    """A column has dates that only fit a leading day and others that only fit a leading month."""


def _iso(text: Column, day_first: bool) -> Column:
    """ISO form of date text, null for any other shape. How a text begins rules out all shapes but a few."""
    order = "$2-$1" if day_first else "$1-$2"
    slashes, dots = [], []
    for year, century in _YEARS:
        slashes.append((f"{_TWO}{year}{_CLOCK}", f"{century}$3-{order} $4"))
        dots.append((rf"^(\d{{1,2}})\.(\d{{1,2}})\.{year}{_CLOCK}", f"{century}$3-$2-$1 $4"))  # dots: always the day first
    years = [(rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_CLOCK}", "$1-$2-$3 $4")]
    digits = [
        (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_CLOCK}", "$1-$2-$3 $4"),
        (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
    ]
    number = F.try_element_at(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair]), F.lower(F.regexp_extract(text, r"([A-Za-z]{3,9})", 1)))
    named = [
        (rf"^(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ ,-]+(\d{{4}}){_CLOCK}", "$3-#-$1 $4"),
        (rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? +(\d{{4}}){_CLOCK}", "$3-#-$2 $4"),
    ]

    def first_of(forms: list[tuple[str, str]], rewrite=lambda written: written) -> Column:
        return reduce(lambda done, form: done.when(text.rlike(form[0]), rewrite(F.regexp_replace(text, *form))), forms, F).otherwise(None)

    head = F.left(text, F.lit(5))
    cases = [
        (text.rlike(r"^\d{4}-\d"), text),
        (~text.rlike(r"\d"), F.lit(None)),
        (head.rlike(r"^\d{1,2}[/-]\d"), first_of(slashes)),
        (head.rlike(r"^\d{4}[/.]"), first_of(years)),
        (head.rlike(r"^\d{1,2}\."), first_of(dots)),
        (head.rlike(r"^\d{5}"), first_of(digits)),
        (head.rlike("[A-Za-z]"), first_of(named, lambda written: F.replace(written, F.lit("#"), number))),
    ]
    return F.trim(reduce(lambda done, case: done.when(*case), cases, F))


def parse_moment(value: Column | str, day_first: bool = False) -> Column:
    """Timestamp of date text; null where it has none of the known shapes or no such day exists.

    ISO dates, year first with slashes, dots or none (20250105), numbers with slashes or dashes in the order that
    ``day_first`` says, numbers with dots (the day first), names of months; each with or without a time, AM or PM and
    fractions of a second; years of two digits.
    """
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    half = F.lower(F.right(text, F.lit(2)))

    def in_day(moment: Column) -> Column:
        shift = F.when((half == "pm") & (F.hour(moment) < 12), 12).when((half == "am") & (F.hour(moment) == 12), -12).otherwise(0)
        return F.when(half.isin("am", "pm"), F.timestamp_add("HOUR", shift, moment)).otherwise(moment)

    # Bound once by the lambda. Written out at each use, the shapes make one generated method too long for the JIT.
    return F.get(F.transform(F.array(_iso(text, day_first).try_cast("timestamp")), in_day), F.lit(0))


def moment_of(df: DataFrame, name: str, day_first: bool = False) -> Column:
    """Date or timestamp of a column: typed ones are used as they are, text is parsed where it can be."""
    return parse_moment(F.col(name), day_first) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name)


def order_counts(df: DataFrame, name: str) -> DataFrame:
    """``rows, day_first, month_first``: numeric dates of text, and those among them that fit one order only."""
    text = F.trim(F.col(name).cast("string"))
    first, second = (F.regexp_extract(text, rf"{_TWO}(?:\d{{4}}|\d{{2}})(?!\d)", i).try_cast("int") for i in (1, 2))
    numbers = df.select(first.alias("a"), second.alias("b")).where("a IS NOT NULL")
    return numbers.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("a > 12 AND b <= 12")).alias("day_first"), F.count_if(F.expr("b > 12 AND a <= 12")).alias("month_first")
    )


def day_first_of(df: DataFrame, name: str) -> bool:
    """The order of a source's dates by its own rows, in one pass over the column; the month first where none tells."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return False
    found = order_counts(df, name).first()
    if found["day_first"] and found["month_first"]:
        raise DateOrderError(f"{name}: {found['day_first']} dates need the day first and {found['month_first']} the month first; choose with day_first")
    return found["day_first"] > 0
