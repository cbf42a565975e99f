import re
from itertools import permutations

from tideledger.llm import audit
from tideledger.llm.queries import QUERIES


def plain(rows, labels):
    """Each order applied filter by filter."""
    failing = []
    for doc, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(d is not None and doc is not None and d < doc and (o or "") == t for d, o, _ in rows)
        capitals = sum("A" <= c <= "Z" for c in t)
        tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(t), any(c in "#$%&*|" for c in t), smaller]
        failing.append({name for name, bad in zip("ABCDE", tests) if bad})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        listed = []
        for order in permutations("ABCDE"):
            alive = set(mine)
            for step, name in enumerate(order, 1):
                gone = {i for i in alive if name in failing[i]}
                fails = {i for i in mine if name in failing[i]}
                before = fails - alive
                alive -= gone
                removed_by[name] += len(gone)
                only = sum(failing[i] == {name} for i in mine)
                listed.append((part, "".join(order), step, name, len(alive), len(gone), len(before), only, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)))
        out += [(*x, removed_by[x[3]]) for x in listed]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS part", "1 AS rows", "2 AS _n", "'y' AS step")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'z' AS source")
    return sorted(tuple(r) for r in audit.audit_documents(docs, marks).collect())


def test_orders_against_plain_sets(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose, "a"), (2, prose, "a"), (3, "short", "a"), (4, "SHORT # TEXT", "b"), (5, "go " * 80, "b"), (6, prose + " %", "b")]
    rows += [(7, None, None), (8, "", None), (9, " \t\n", ""), (None, prose, "a"), (None, None, "a"), (3, "short", "a"), (3, "short", "b"), (10, "short", "c")]
    rows += [(11, "A" * 9 + " " + "long " * 20_000, "c"), (12, prose + " x", "c")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 1), (99, 1, 1), (11, 1, 0)]
    assert run(spark, rows, labels) == plain(rows, labels)


def test_no_rows_no_labels_and_nothing_failing(spark):
    assert run(spark, [], []) == []
    prose = " ".join(f"word{i}" for i in range(60))
    found = run(spark, [(1, prose, "a")], [])
    assert len(found) == 600 and {r[4:] for r in found} == {(1, 0, 0, 0, 0, 0, 0)}


def test_own_filters_and_ids(spark):
    """The audit itself takes any id tables; ids that no unit has count for nothing."""
    units = spark.createDataFrame([(i, "p", 1, i % 2) for i in range(10)] + [(30, "p", 5, 1), (None, "q", 4, 1)], "id int, p string, n int, odd int")
    small = spark.createDataFrame([(0,), (1,), (2,), (77,)], "id int")
    null = spark.createDataFrame([(30,), (2,), (None,)], "id int")
    got = {tuple(r) for r in audit.audit(units, {"x": small, "y": null}, ["id"], "p", "n", {"odd_lost": "odd"}).collect()}
    assert {r[3:] for r in got if r[0] == "q"} == {("x", 4, 0, 0, 0, 0, 0), ("y", 4, 0, 0, 0, 0, 0)}
    assert {r for r in got if r[0] == "p"} == {
        ("p", "xy", 1, "x", 12, 3, 0, 2, 1, 5),
        ("p", "xy", 2, "y", 7, 5, 1, 5, 5, 11),
        ("p", "yx", 1, "y", 9, 6, 0, 5, 5, 11),
        ("p", "yx", 2, "x", 7, 2, 1, 2, 1, 5),
    }


def test_query_has_all_steps_of_all_orders(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = spark.read.parquet(f"{sample}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    got = sorted(tuple(r) for r in QUERIES["op11_filter_audit"](spark, sample).collect())
    assert got == plain([tuple(r) for r in docs], [tuple(r) for r in labels])
