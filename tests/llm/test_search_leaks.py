import random

import numpy as np
import pytest

from tideledger.llm import decontaminate, mtree

RNG = random.Random(31)
WORDS = ["".join(RNG.choice("abcdefghijklm") for _ in range(RNG.randint(3, 9))) for _ in range(2000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow_top(rows, every, k):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    out = set()
    asked = {}
    for i, v in kept:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for i, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("shard,block,page", [(8192, 1024, 64), (40, 3, 8)])
def test_top_k_is_exact(spark, shard, block, page, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", page)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)]  # one very common vector, all ties
    rows += [(600, None), (650, []), (700, [1.0] * 11 + [None]), (750, [float("nan")] * 12), (800, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (850, [0.0] * 12), (900, [2.0, -1.0]), (950, [-0.001] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS v", "2 AS rank")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df, shard=shard, block=block).collect()}
    assert got == slow_top(rows, 50, 5)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(50, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in mtree.top_k(few).collect()] == [(50, 1, 1, 256 * 128 + 512 * 128)]
    assert mtree.top_k(few.filter("false")).count() == 0


def test_repeated_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (4, [1.0, 1.0])]
    got = sorted((r.rank, r.vec_id, r.score) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(1, 3, 131072), (2, 3, 131072), (3, 4, 65536)]


QUESTION = "A farmer named Alice has 12 sheep and 30 goats and sells 12 sheep to her neighbour Bernard for 45 dollars each before the winter market opens"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, QUESTION), (2, prose(40, 1)), (3, None), (4, ""), (5, "12 30 45"), (6, prose(15, 2)), (6, prose(15, 2)), (7, "tiny benchmark item")]
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "'x' AS words", "1 AS n", "'y' AS doc")


def test_leaks(spark, documents, benchmark):
    put = lambda text, seed: f"{prose(60, seed)} {text} {prose(60, seed + 1)}"
    other = QUESTION.replace("12", "77").replace("30", "5").replace("45", "120").replace("Alice", "Maria").replace("Bernard", "Conrad")
    bent = QUESTION.replace("12 sheep and", "77 sheep and").replace("sells 12", "sells 78")  # one slot value becomes two
    words = prose(40, 1).split()
    rows = [
        (1, put(QUESTION, 10)), (2, put(other, 12)), (3, put(bent, 14)), (4, put(" ".join(words), 16)), (5, put(" ".join(words[:20]), 18)),
        (6, put(" ".join(words[:20] + ["extra"] + words[20:]), 20)), (7, put("\n".join(words).upper(), 22)), (8, None), (9, ""), (10, prose(500, 24)), (None, put(QUESTION, 26)),
        (11, put(prose(15, 2), 28)), (11, put(prose(15, 2), 28)), (12, prose(15, 2)), (13, "12 30 45 " * 50), (14, put("tiny benchmark item", 30)), (15, prose(15, 2) + " " + prose(30_000, 32)),
    ]
    out = decontaminate.leaks(documents(rows), benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got == {(1, 1), (2, 1), (4, 2), (6, 2), (7, 2), (None, 1), (11, 6), (12, 6), (14, 7), (15, 6)} and len(out) == len(got)
    by = {(r.doc_id, r.item_id): r for r in out}
    assert by[2, 1].changed and not by[1, 1].changed and by[1, 1].start == 60
    assert by[4, 2].similarity == 1.0 and 0.8 <= by[6, 2].similarity < 1.0


def test_blocks_of_anchors_and_a_shuffle_give_the_same(documents, benchmark, monkeypatch):
    rows = [(i, f"{prose(50, 50 + i)} {QUESTION if i % 2 else prose(40, 1)}") for i in range(6)]
    monkeypatch.setattr(decontaminate, "ANCHORS", 5)
    monkeypatch.setattr(decontaminate, "PLACES", 0)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(rows), benchmark).collect()}
    assert got == {(i, 1 if i % 2 else 2) for i in range(6)}


def test_no_documents_or_items(documents, benchmark):
    assert decontaminate.leaks(documents([]), benchmark).count() == 0
    assert decontaminate.leaks(documents([(1, QUESTION)]), benchmark.filter("false")).count() == 0


def test_driver_tables_against_brute_force(spark, sample):
    docs, items = spark.read.parquet(f"{sample}/documents.parquet"), spark.read.parquet(f"{sample}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    windows = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    held = [(r.item_id, windows(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for own in [windows(r.text)] for i, s in held if len(own & s) >= 0.8 * len(s)}
    assert want and got == want
