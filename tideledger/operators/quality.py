"""Profiles of a table and what they allow: tasks and models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, functions as F

from tideledger.functions.scalars import flag
from tideledger.schemas import check_target_name, resolve_target


def profile(df: DataFrame, liquidity: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """One row describing a canonical table.

    Several distinct counts in one aggregation would copy every row per count. Instead rows are summed once per client
    and once per (month, label, currency), of which there are few; the counts are taken from those.
    """
    missing = sum(F.col(name).isNull().cast("int") for name in ("client_id", "month", "debit_sum", "credit_sum"))
    clients = df.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(missing).alias("missing"),
        F.max(flag(F.col("debit_sum") > 0)).alias("debit"),
        F.max(flag(F.col("credit_sum") > 0)).alias("credit"),
    )
    none = F.lit(0).cast("long")
    whole = clients.agg(
        F.coalesce(F.sum("n"), none).alias("rows"),
        F.count("client_id").alias("clients"),
        F.coalesce(F.max("debit"), none).alias("has_debit"),
        F.coalesce(F.max("credit"), none).alias("has_credit"),
        F.coalesce(F.sum("missing") / F.sum("n") / 4.0 * 100.0, F.lit(0.0)).alias("missing_percent"),
    )
    kinds = df.select("month", "transaction_label", "currency").distinct().agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_distinct("month").alias("months"),
        F.count_distinct("transaction_label").alias("labels"),
        F.count_distinct("currency").alias("currency_count"),
    )
    names = ["rows", "clients", "first_month", "last_month", "months", "labels", "has_debit", "has_credit", "currency_count", "missing_percent"]
    both = whole.unionByName(kinds, allowMissingColumns=True)  # two rows, each with its own columns
    return both.agg(*[F.max(name).alias(name) for name in names]).select(
        "*",
        (F.col("currency_count") > 1).cast("long").alias("multiple_currencies"),
        F.lit(int(liquidity is not None)).cast("long").alias("has_balance"),
        F.lit(int(target is not None)).cast("long").alias("has_cash_gap_target"),
    )


def text_profile(df: DataFrame) -> DataFrame:
    """One row describing a categorization table: it has rows and categories, but no flows."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("category").alias("categories"),
        F.lit(0).cast("long").alias("has_debit"),
        F.lit(0).cast("long").alias("has_credit"),
    )


@dataclass(frozen=True)
class Source:
    """What a source can be used for."""

    id: str
    tasks: frozenset[str] = frozenset()
    limitations: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Eligibility:
    classification: bool
    forecasting: bool
    proxy: bool
    categorization: bool
    reasons: list[str] = field(default_factory=list)


NO_CLIENT_LEVEL = {"one_company", "not_client_level"}
FORECAST_TASKS = {"flow_forecasting", "debit_flow_forecasting"}
PROXY_TASKS = {"proxy_risk", "balance_breach_proxy"}
GENERATED = "synthetic"


def task_eligibility(facts: Row | dict, source: Source) -> Eligibility:
    """Which tasks a profiled table supports. ``facts`` is the one row of ``profile``."""
    facts = facts.asDict() if isinstance(facts, Row) else dict(facts)
    months, clients = facts.get("months") or 0, facts.get("clients") or 0
    debit, credit = bool(facts.get("has_debit")), bool(facts.get("has_credit"))
    obstacles = {
        "No agreed cash-gap target; fraud and anomaly labels do not count": not facts.get("has_cash_gap_target"),
        "Client-level classification needs two clients": clients < 2 or bool(NO_CLIENT_LEVEL & source.limitations),
        "Classification needs six months": months < 6,
        "Classification needs debit and credit flows": not (debit and credit),
    }
    reasons = [reason for reason, applies in obstacles.items() if applies]
    supports_flows = bool(FORECAST_TASKS & source.tasks) or source.id == GENERATED
    return Eligibility(
        classification=not reasons,
        forecasting=months >= 6 and (debit or credit) and supports_flows,
        proxy=bool(facts.get("has_balance")) or bool(PROXY_TASKS & source.tasks),
        categorization="transaction_categorization" in source.tasks,
        reasons=reasons,
    )


def eligibility_table(facts: DataFrame, source: Source) -> DataFrame:
    """The same rules as columns over one or more profile rows, without leaving Spark."""
    flows = (F.col("has_debit") == 1) | (F.col("has_credit") == 1)
    both = (F.col("has_debit") == 1) & (F.col("has_credit") == 1)
    client_level = F.lit(not NO_CLIENT_LEVEL & source.limitations)
    supports_flows = F.lit(bool(FORECAST_TASKS & source.tasks) or source.id == GENERATED)
    rules = {
        "classification_eligible": (F.col("has_cash_gap_target") == 1)
        & (F.col("clients") >= 2)
        & client_level
        & (F.col("months") >= 6)
        & both,
        "forecasting_eligible": (F.col("months") >= 6) & flows & supports_flows,
        "proxy_eligible": (F.col("has_balance") == 1) | F.lit(bool(PROXY_TASKS & source.tasks)),
        "categorization_eligible": F.lit("transaction_categorization" in source.tasks),
    }
    return facts.select(*[flag(rule).alias(name) for name, rule in rules.items()])


@dataclass(frozen=True)
class ModelSpec:
    id: str
    task: str
    targets: frozenset[str]
    needs_training: bool = True


def estimated_series(facts: DataFrame, level: str, min_history: int, horizon: int) -> DataFrame:
    """Number of series and a memory estimate in MB for a model run over a profiled table."""
    clients = F.greatest(F.col("clients"), F.lit(1))
    series = clients * F.greatest(F.col("labels"), F.lit(1)) if level == "client_category" else clients
    width = max(min_history + horizon, 1)
    return facts.select(
        series.alias("estimated_series"),
        F.round(F.greatest(series, F.lit(1)) * float(width * 8 * 6) / float(1024**2), 2).alias("estimated_memory_mb"),
    )


def model_eligibility(
    model: ModelSpec, facts: Row | dict, target: str, level: str = "client", horizon: int = 1, min_history: int = 6
) -> list[str]:
    """Reasons why a model cannot run on a profiled table; an empty list means it can."""
    facts = facts.asDict() if isinstance(facts, Row) else dict(facts)
    try:
        target = resolve_target(target)
    except ValueError as problem:
        return [str(problem)]
    reasons = []
    if target not in model.targets:
        reasons.append(f"{model.id} does not predict {target}")
    if model.task == "cash_gap_classification":
        if target != "cash_gap_next_month":
            reasons.append("A cash-gap classifier predicts cash_gap_next_month")
        if not facts.get("has_cash_gap_target"):
            reasons.append("A classifier needs a historical cash-gap target")
    else:
        if target == "cash_gap_next_month":
            reasons.append("A forecaster predicts credit, debit or net flow")
        if (facts.get("months") or 0) < min_history + horizon:
            reasons.append(f"At least {min_history + horizon} months of history are needed")
    if level not in ("client", "client_category"):
        reasons.append(f"Unknown series level {level!r}")
    return reasons


def attach_target(features: DataFrame, target: DataFrame, name: str = "cash_gap_next_month") -> DataFrame:
    """Join an agreed external target on client and month; the name is guarded and unlabelled months drop out."""
    check_target_name(name)
    agreed = target.select("client_id", "month", F.col(name).cast("int").alias(name)).where(F.col(name).isNotNull())
    return features.join(agreed, ["client_id", "month"])
