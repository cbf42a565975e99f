"""Column helpers. All of them are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideledger.functions.dates import moment_of, parse_moment  # noqa: F401

WORD = r"\p{L}\p{N}_"


def _word(text: str) -> str:
    """Pattern for ``text`` as a whole word, with Unicode letters and digits as word characters."""
    return f"(^|[^{WORD}]){text}([^{WORD}]|$)"


# Description categories in order of precedence, the first match wins. Each has its words; the ones
# marked True must stand alone, the others may be part of a longer word.
DESCRIPTION_CATEGORIES = [
    ("UPI", [("UPI", True)]),
    ("NEFT", [("NEFT", True)]),
    ("RTGS", [("RTGS", True)]),
    ("IMPS", [("IMPS", True)]),
    ("CHEQUE", [("CHEQUE", False), ("CHQ", True)]),
    ("CASH", [("CASH", True)]),
    ("ATM", [("ATM", True)]),
    ("CHARGE", [("CHARGE", False), ("FEE", False)]),
    ("REVERSAL", [("REVERSAL", False), ("REVERSED", False)]),
]

# Substrings that mark the direction of a payment.
DEBIT_WORDS = ("debit", "out", "withdraw", "expense")
CREDIT_WORDS = ("credit", "in", "deposit", "income")


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def try_number(value: Column | str) -> Column:
    """Text or number to double; null where it is no number (NaN counts as missing)."""
    text = F.trim(column(value).cast("string"))
    # Java would read a trailing type letter ("1d", "2f") as part of the number.
    number = F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def number(value: Column | str) -> Column:
    """Like ``try_number``, with 0 for a bad value."""
    return F.coalesce(try_number(value), F.lit(0.0))


def amount(value: Column | str) -> Column:
    """Absolute amount of number text, 0 for a bad value."""
    return F.abs(number(value))


def field_number(df: DataFrame, name: str) -> Column:
    """Numeric value of a column, null where missing. Typed columns are used as they are, so decimals stay decimals."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(F.col(name)), F.col(name).cast("double"))
    if isinstance(kind, T.DecimalType):
        return F.col(name)
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return try_number(F.col(name))


def field_amount(df: DataFrame, name: str) -> Column:
    """Absolute value of a column, 0 where missing or bad."""
    return F.abs(F.coalesce(field_number(df, name), F.lit(0)))


def parse_number(value: Column | str) -> Column:
    """Formatted number text ("1,250.50", "-", "INR 5") to double; 0 where nothing parses."""
    digits = F.regexp_replace(column(value).cast("string"), "[^0-9.\\-]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def category_text(value: Column | str) -> Column:
    """What ``category_of`` looks at: the upper-case text, empty for null."""
    return F.upper(F.coalesce(column(value).cast("string"), F.lit("")))


def category_of(text: Column) -> Column:
    """Category of a prepared text by the first matching pattern, else OTHER."""

    def has(word: str, alone: bool) -> Column:
        # The plain search is cheap and rules out most texts before the pattern runs.
        return text.contains(word) & text.rlike(_word(word)) if alone else text.contains(word)

    chain = F
    for name, words in DESCRIPTION_CATEGORIES:
        chain = chain.when(_any(has(word, alone) for word, alone in words), name)
    return chain.otherwise("OTHER")


def with_category(df: DataFrame, text: str, name: str = "category") -> DataFrame:
    """Adds the category of a description. The text is prepared in its own projection, once for all patterns."""
    prepared = df.withColumn("_text", category_text(text))
    return prepared.select(*df.columns, category_of(F.col("_text")).alias(name))


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def directions(direction: Column | str | None, signed: Column) -> tuple[Column, Column]:
    """(is_debit, is_credit). Both can hold ("outgoing" contains "in"); the sign decides where neither does."""
    if direction is None:
        return signed < 0, signed >= 0
    text = F.lower(F.coalesce(column(direction).cast("string"), F.lit("")))
    debit, credit = (_any(text.contains(word) for word in words) for words in (DEBIT_WORDS, CREDIT_WORDS))
    neither = ~(debit | credit)
    return debit | (neither & (signed < 0)), credit | (neither & (signed >= 0))


def step_time(step: Column, base: str = "2023-01-01", unit: str = "hour") -> Column:
    """``base`` plus a numeric step of hours or days; a missing step gives ``base``."""
    micros = {"hour": 3_600_000_000, "day": 86_400_000_000}[unit]
    span = (F.coalesce(step.cast("double"), F.lit(0.0)) * float(micros)).cast("long")
    return F.timestamp_add("MICROSECOND", span, F.lit(base).cast("timestamp_ntz"))


def truthy(value: Column | str) -> Column:
    """Whether a field of JSON says yes: true, a number other than 0, or a text other than empty or a word for no."""
    text = F.lower(F.trim(F.coalesce(column(value).cast("string"), F.lit(""))))
    return ~(text.isin("", "false", "no", "n", "none", "null") | text.rlike(r"^[+-]?0*\.?0*$"))


def month_of(value: Column) -> Column:
    """'yyyy-MM' of a date or timestamp; null stays null."""
    return F.date_format(value, "yyyy-MM")


def month_of_text(value: Column | str, day_first: bool = False) -> Column:
    """'yyyy-MM' of date text (see ``parse_moment``); null where it is no date."""
    return month_of(parse_moment(value, day_first))


def label(value: Column | str, upper: bool = False) -> Column:
    """Transaction label with OTHER for null."""
    text = F.coalesce(column(value).cast("string"), F.lit("OTHER"))
    return F.upper(text) if upper else text


def is_client(client: Column, include_merchants: bool = False) -> Column:
    """Ids of clients start with C; those of merchants, with M, count only on request."""
    return client.startswith("C") | client.startswith("M") if include_merchants else client.startswith("C")


def composite_key(separator: str, *parts: Column | str) -> Column:
    """Parts joined by ``separator``; null if any part is null."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(separator), column(part).cast("string")]
    return F.concat(*pieces[1:])


def inflow(net: Column) -> Column:
    return F.greatest(net, F.lit(0).cast("double"))


def outflow(net: Column) -> Column:
    return F.greatest(-net, F.lit(0).cast("double"))


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """``top / max(bottom, 1)``: never divides by zero."""
    return top / F.greatest(bottom.cast("double"), F.lit(1.0))


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    real = value.cast("double")
    return F.when(~F.isnan(real) & (F.abs(real) != math.inf), real)


def model_input(value: Column) -> Column:
    """Finite value for a model; missing history is 0."""
    return F.coalesce(finite(value), F.lit(0.0))


def risk_group(percentile: Column) -> Column:
    return F.when(percentile >= 0.90, "high").when(percentile >= 0.60, "medium").otherwise("low")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0), as bigint."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def season_angle(month_number: Column) -> tuple[Column, Column]:
    """Sine and cosine of the month on the yearly circle."""
    angle = month_number * (2.0 * math.pi / 12.0)
    return F.sin(angle), F.cos(angle)
