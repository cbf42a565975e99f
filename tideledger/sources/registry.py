"""Sources by name: how to read, detect and normalize each of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tideledger.functions.dates import day_first_of
from tideledger.functions.flags import ADAPTER_FLAGS
from tideledger.operators.canonical import canonical_monthly
from tideledger.operators.quality import Source
from tideledger.sources import balance_ledger, card_ledger, category_text, companies, inout_series, statements, transfers
from tideledger.sources.tabular import (
    SourceError,
    columns_of,
    compatible_paths,
    load_tables,
    read_tabular,
    selected_files,
    suffix,
)


@dataclass
class Normalized:
    """What a source gives; tables it does not have are None. All frames are lazy."""

    canonical: DataFrame | None = None
    liquidity: DataFrame | None = None
    series: DataFrame | None = None
    categories: DataFrame | None = None
    mapping: dict = field(default_factory=dict)


def _union(spark: SparkSession, paths: list[str], required: set[str]) -> DataFrame:
    compatible = compatible_paths(spark, paths, required)
    if not compatible:
        raise SourceError(f"No file has the columns {sorted(required)}")
    whole = read_tabular(spark, compatible[0])
    for path in compatible[1:]:
        whole = whole.unionByName(read_tabular(spark, path), allowMissingColumns=True)
    return whole


def _balance_ledger(spark, paths, source, options) -> Normalized:
    rows = _union(spark, paths, balance_ledger.REQUIRED)
    shared = {
        "base_date": options.get("base_date", "2023-01-01"),
        "include_merchants": options.get("include_merchants", False),
    }
    return Normalized(
        canonical=balance_ledger.to_canonical(rows, source.id, "file", **shared),
        liquidity=balance_ledger.to_liquidity(rows, threshold=options.get("balance_breach_threshold", 0.0), **shared),
        mapping=balance_ledger.MAPPING,
    )


def _card_ledger(spark, paths, source, options) -> Normalized:
    rows = _union(spark, paths, card_ledger.REQUIRED)
    base = options.get("base_date", "2023-01-01")
    return Normalized(canonical=card_ledger.to_canonical(rows, source.id, "file", base), mapping=card_ledger.MAPPING)


def _used(paths: list[str]) -> dict:
    """The files read; ``selected_file`` names the one if it is only one."""
    return {"selected_files": paths, "selected_file": paths[0] if len(paths) == 1 else None}


def _day_first(options: dict, days: DataFrame, name: str) -> bool:
    """The order of a source's dates: chosen, or by its own rows."""
    chosen = options.get("day_first")
    return day_first_of(days, name) if chosen is None else chosen


def _transfers(spark, paths, source, options) -> Normalized:
    # Spark numbers a repeated header name by its place ("Account2", "Account4"), so only unique names can be asked for.
    needed = transfers.REQUIRED - {"Account", "Account.1"}
    chosen = selected_files(compatible_paths(spark, paths, needed), options.get("selected_file"))
    parts = [transfers.read(spark, p) if suffix(p) == ".csv" else read_tabular(spark, p).select(*[f"`{c}`" for c in transfers.COLUMNS]) for p in chosen]
    rows = reduce(DataFrame.unionByName, parts)
    canonical = transfers.to_canonical(
        rows, source.id, "file", options.get("combine_currencies", False), options.get("fx"), _day_first(options, rows, "Timestamp")
    )
    return Normalized(canonical=canonical, mapping={**transfers.MAPPING, **_used(chosen)})


def _statements(spark, paths, source, options) -> Normalized:
    chosen = [path for path in paths if suffix(path) in {".json", ".jsonl", ".ndjson"}]
    if not chosen:
        raise SourceError("No JSON statements")
    payloads = statements.read(spark, chosen[0])
    for path in chosen[1:]:
        payloads = payloads.unionByName(statements.read(spark, path))
    rows = statements.statements(payloads)
    day_first = _day_first(options, statements.days(rows), "day")
    return Normalized(
        canonical=statements.to_canonical(rows, source.id, "file", day_first),
        liquidity=statements.to_liquidity(rows, options.get("balance_breach_threshold", 0.0), day_first),
        mapping=statements.MAPPING,
    )


def _companies(spark, paths, source, options) -> Normalized:
    tables = load_tables(spark, [path for path in paths if suffix(path) in {".csv", ".parquet", ".jsonl", ".json"}])
    day_first = _day_first(options, companies.days(tables), "day")
    return Normalized(
        canonical=companies.to_canonical(tables, source.id, "file", day_first),
        liquidity=companies.to_liquidity(tables, options.get("balance_breach_threshold", 0.0), day_first),
        mapping={"tables": list(tables), "client_level": "company"},
    )


def _inout_series(spark, paths, source, options) -> Normalized:
    found = [p for p in paths if suffix(p) == ".csv" and inout_series.is_series(columns_of(spark, p))]
    if not found:
        raise SourceError("No CSV with a date and a flow column")
    chosen = selected_files(found, options.get("selected_file"))
    tables = [read_tabular(spark, p) for p in chosen]
    days = reduce(DataFrame.unionByName, [inout_series.days(t) for t in tables])
    day_first = _day_first(options, days, "day")
    series = inout_series.total([inout_series.to_series(t, day_first=day_first) for t in tables])
    return Normalized(
        canonical=inout_series.to_canonical(series, source.id, "file"), series=series, mapping=_used(chosen)
    )


def _category_text(spark, paths, source, options) -> Normalized:
    return Normalized(categories=category_text.to_table(_union(spark, paths, category_text.REQUIRED)))


ADAPTERS: dict[str, Callable] = {
    "balance_ledger": _balance_ledger,
    "card_ledger": _card_ledger,
    "currency_transfers": _transfers,
    "nested_statements": _statements,
    "company_ledger": _companies,
    "inout_series": _inout_series,
    "category_text": _category_text,
}


def _source(name: str, tasks: set[str], limitations: set[str] = frozenset()) -> Source:
    return Source(name, frozenset(tasks), frozenset(limitations))


# What each kind of source supports, and what it lacks.
SOURCES = {
    source.id: source
    for source in (
        _source("balance_ledger", {"data_ingestion_demo", "monthly_aggregation", "balance_breach_proxy", "proxy_risk"}),
        _source(
            "card_ledger",
            {"data_ingestion_demo", "debit_flow_forecasting", "transaction_category_analysis"},
            {"debit_only", "no_balance", "no_credit_flow"},
        ),
        _source("currency_transfers", {"data_ingestion_demo", "monthly_aggregation", "flow_forecasting", "proxy_risk"}),
        _source("inout_series", {"flow_forecasting"}, {"aggregate_series", "not_client_level"}),
        _source(
            "nested_statements",
            {"data_ingestion_demo", "monthly_aggregation", "flow_forecasting", "balance_breach_proxy", "proxy_risk"},
        ),
        _source("company_ledger", {"data_ingestion_demo", "flow_forecasting"}, {"one_company", "free_sample"}),
        _source(
            "category_text",
            {"transaction_categorization"},
            {"no_client_id", "no_date", "no_amount", "cannot_build_monthly_cashflow"},
        ),
        _source(
            "files",
            {"data_ingestion_demo", "monthly_aggregation", "flow_forecasting", "transaction_categorization"},
        ),
    )
}


def normalize(
    spark: SparkSession,
    name: str,
    paths: list[str],
    options: dict | None = None,
    scale: int | None = None,
    adapters: dict[str, Callable] | None = None,
) -> Normalized:
    """Normalize the files of a source; ``options['adapter']`` overrides the adapter of that name.

    ``adapters`` adds the caller's own: functions ``(spark, paths, source, options) -> Normalized``.
    """
    options, known = options or {}, {**ADAPTERS, **(adapters or {})}
    adapter = options.get("adapter", name)
    if adapter not in known:
        raise SourceError(f"No adapter {adapter!r}; there are {', '.join(sorted(known))}")
    source = SOURCES.get(name, Source(name))
    result = known[adapter](spark, paths, source, options)
    if result.canonical is not None:
        result.canonical = canonical_monthly(result.canonical, ADAPTER_FLAGS, scale)
    return result
