"""How filters interact: what each removes behind every possible prefix of others.

Each filter stores the ids that fail it as a table of its own. Those relations alone say everything: the survivors of a
prefix are the ids left by anti-joins with its filters' relations, what the next filter removes is a semi-join of these
survivors with its relation, and what it fails beyond that was removed before. A prefix's survivors don't depend on its
order, and all sets of filters go through the same two joins: one row for each id and set of filters is anti-joined with
the relations of that set, what is left with a further filter is semi-joined with that filter's relation. Ids that fail
nothing survive everywhere; they are counted, not joined.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from tideledger.llm.common import checked
from tideledger.llm.decontaminate import words_of
from tideledger.session import stage

#: Counts of removed rows with a label, and the 0/1 columns that have it.
LOSSES = {"good_lost": "good", "toxic_lost": "toxic"}


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` measured once, and five example filters as conditions that hold for a failing row.

    A: under 50 words; B: fewer than 65 of 100 words are distinct; C: more than 5 of 100 code points are A-Z; D: one of
    ``#$%&*|``; E: the same text stands under a smaller key. Null texts count as empty; a null key is neither smaller nor
    larger than another.
    """
    measured = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_words", words_of(F.col("_text")))
    measured = stage(
        measured.select(
            *[c for c in docs.columns if c != text],
            F.unhex(F.sha2("_text", 256)).alias("_digest"),
            F.xxhash64("_text").alias("_body"),
            F.size("_words").alias("_n"),
            F.size(F.array_distinct("_words")).alias("_distinct"),
            (F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_capitals"),
            F.length("_text").alias("_chars"),
            (F.translate("_text", "#$%&*|", "") != F.col("_text")).alias("_marks"),
        )
    )
    # Texts are one digest each; a digest of very many rows is one row of this side, the other is split by AQE.
    firsts = measured.groupBy("_digest").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).filter("_first < _last")
    measured = measured.join(checked(firsts.select("_digest", "_first")), "_digest", "left")
    conditions = {
        "A": F.col("_n") < 50,
        "B": 100 * F.col("_distinct") < 65 * F.col("_n"),
        "C": 100 * F.col("_capitals") > 5 * F.col("_chars"),
        "D": F.col("_marks"),
        "E": F.coalesce(F.col("_first") < F.col(key), F.lit(False)),
    }
    return measured, conditions


def relations(rows: DataFrame, conditions: dict[str, Column], id_columns: list[str]) -> dict[str, DataFrame]:
    """One stored table of distinct ids for each filter: those of the rows for which its condition holds."""
    return {name: stage(rows.filter(failing).select(*id_columns).distinct()) for name, failing in conditions.items()}


def audit(units: DataFrame, failing: dict[str, DataFrame], id_columns: list[str], part: str, rows: str, losses: dict[str, str]) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``units`` has one row for each id and part: ``part``, ``rows`` (how many rows it stands for) and 0/1 columns named in
    ``losses``; ``failing`` has each filter's id table. All orders of the filters are listed, at most nine filters.

    ``<part>, filter_order, step, filter, kept, removed, redundant, unique_fails, <losses>, shapley``: rows left after
    the step, removed by it, failing its filter but removed before, failing no other filter, removed rows with each 0/1
    column, and the rows that this filter removes summed over all orders. A null in an id is equal to nothing, so it fails
    nothing; ids that are in a relation but not in ``units`` count for nothing. Without units the result is empty.
    """
    names = list(failing)
    bit = {name: 1 << i for i, name in enumerate(names)}
    everything = (1 << len(names)) - 1
    carried = [*id_columns, part, rows, *losses.values()]

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[c] == b[c] for c in id_columns])

    related = reduce(DataFrame.unionByName, [ids.select(*id_columns, F.lit(bit[name]).alias("_bit")) for name, ids in failing.items()])
    touched = units.select(*carried).join(related.select(*id_columns).distinct(), id_columns, "left_semi")
    # Dealt by id before it has a row for each set, so that the rows of the sets aren't shuffled.
    sets = F.explode(F.array(*[F.lit(s) for s in range(everything + 1)]))
    spread = touched.repartition(*id_columns).withColumn("_set", sets)
    survivors = stage(spread.join(related, same(spread, related) & (spread["_set"].bitwiseAND(related["_bit"]) != 0), "left_anti"))

    alive = survivors.groupBy(part, "_set").agg(F.sum(rows).alias("_alive"))
    further = F.explode(F.filter(F.array(*[F.lit(b) for b in bit.values()]), lambda b: b.bitwiseAND(F.col("_set")) == 0))
    ahead = survivors.withColumn("_next", further)
    gone = ahead.join(related, same(ahead, related) & (ahead["_next"] == related["_bit"]), "left_semi")
    counts = [F.sum(rows).alias("_rows"), *[F.sum(F.col(c) * F.col(rows)).alias(new) for new, c in losses.items()]]
    name_of = F.element_at(F.create_map(*[x for n in names for x in (F.lit(bit[n]), F.lit(n))]), F.col("_next"))
    removed = stage(gone.groupBy(part, "_set", "_next").agg(*counts).withColumn("filter", name_of).drop("_next"))
    totals = units.groupBy(part).agg(F.sum(rows).alias("_total"))
    listed = alive.filter("_set = 0").select(part, F.col("_alive").alias("_touched"))

    steps = [("".join(order), i + 1, name, sum(bit[n] for n in order[:i])) for order in permutations(names) for i, name in enumerate(order)]
    grid = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(n).alias("filter"), F.lit(m).alias("_set")) for o, s, n, m in steps])
    counted = totals.join(listed, totals[part].eqNullSafe(listed[part]), "left").select(totals[part], "_total", F.coalesce("_touched", F.lit(0)).alias("_touched"))
    table = counted.select(part, "_total", "_touched", F.explode(grid).alias("_step")).select(part, "_total", "_touched", "_step.*")
    mask = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(bit[n]))])
    table = table.withColumn("_after", F.col("_set").bitwiseOR(mask[F.col("filter")]))

    def matched(left: DataFrame, right: DataFrame, on: dict[str, str], values: dict[str, str]) -> DataFrame:
        """Left join of the small tables; missing counts are zero."""
        right = right.select(*[F.col(c).alias(f"_r_{c}") for c in on.values()], *[F.col(c).alias(f"_v_{new}") for new, c in values.items()])
        same = reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[f"_r_{b}"]) for a, b in on.items()])
        return left.join(right, same, "left").select(left["*"], *[F.coalesce(F.col(f"_v_{new}"), F.lit(0)).cast("long").alias(new) for new in values])

    table = matched(table, removed, {part: part, "filter": "filter", "_set": "_set"}, {"removed": "_rows"} | {new: new for new in losses})
    table = matched(table, alive, {part: part, "_after": "_set"}, {"_alive": "_alive"})
    first = removed.filter("_set = 0")  # behind nothing a filter removes all that fail it
    table = matched(table, first, {part: part, "filter": "filter"}, {"_fails": "_rows"})
    others = removed.filter(F.col("_set") == F.lit(everything) - mask[F.col("filter")])
    table = matched(table, others, {part: part, "filter": "filter"}, {"unique_fails": "_rows"})
    shares = table.groupBy(part, "filter").agg(F.sum("removed").alias("_share"))
    table = matched(table, shares, {part: part, "filter": "filter"}, {"shapley": "_share"})
    return table.select(
        part,
        "filter_order",
        F.col("step").cast("int"),
        "filter",
        (F.col("_total") - F.col("_touched") + F.col("_alive")).alias("kept"),
        "removed",
        (F.col("_fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *losses,
        "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The five example filters audited over ``docs``, parts by ``part`` (null: empty string), losses by ``labels``.

    An id is the key and a 64-bit hash of the text. Rows that repeat key, text and part are one unit that counts as often. A key with several label rows has a label that
    any of them sets; null labels and keys set none. Null and empty texts fail A. Other columns are ignored.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    measured, conditions = failures(named)
    ids = ["_id", "_none", "_body"]
    measured = measured.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    failing = relations(measured, conditions, ids)
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    units = measured.groupBy(*ids, "doc_id", "part").agg(F.count(F.lit(1)).alias("rows")).join(marks, "doc_id", "left")
    units = stage(units.withColumns({c: F.coalesce(c, F.lit(0)) for c in LOSSES.values()}))
    return audit(units, failing, ids, "part", "rows", LOSSES)
