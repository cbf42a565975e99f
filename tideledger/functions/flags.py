"""Quality flags: pipe-separated sets in storage, arrays or bit masks while computing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The flags the source adapters raise.
ADAPTER_FLAGS = (
    "aggregate_series",
    "balance_delta_fallback",
    "debit_only",
    "failed_excluded",
    "not_client_level",
    "one_company",
)


def split_flags(flags: Column) -> Column:
    return F.array_remove(F.split(flags, "[|]"), "")


def union_flags(flags: Column) -> Column:
    """Aggregate: sorted distinct union of pipe-separated sets, null if empty. Takes any flag text."""
    members = F.array_sort(F.array_distinct(F.flatten(F.collect_set(split_flags(flags)))))
    return F.nullif(F.array_join(members, "|"), F.lit(""))


def flag_mask(flags: Column, known: tuple[str, ...]) -> Column:
    """Bit mask of a flag set over a known vocabulary; a foreign flag raises instead of being lost."""
    if len(known) > 62:
        raise ValueError("A flag vocabulary holds at most 62 names; use union_flags")
    padded = F.concat(F.lit("|"), flags, F.lit("|"))
    united = F.lit(0).cast("long")
    for bit, name in enumerate(known):
        united = united + F.when(padded.contains(f"|{name}|"), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    only_known = padded.rlike(f"^[|]+((\\Q{'\\E|\\Q'.join(known)}\\E)[|]+)*$")
    complaint = F.raise_error(F.concat(F.lit("Unknown quality flag in: "), flags)).cast("long")
    mask = F.when(flags.isNull(), F.lit(0).cast("long"))
    # Most rows carry one flag; only real sets are taken apart.
    for bit, name in enumerate(known):
        mask = mask.when(flags == name, F.lit(1 << bit).cast("long"))
    return mask.when(only_known, united).otherwise(complaint)


def mask_flags(mask: Column, known: tuple[str, ...]) -> Column:
    """Pipe-separated flag set of a bit mask, null if empty."""
    order = sorted(range(len(known)), key=lambda bit: known[bit])
    names = [F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(known[bit])) for bit in order]
    return F.nullif(F.concat_ws("|", *names), F.lit(""))
