import hashlib
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tideledger.llm import periodic
from tideledger.llm.queries import QUERIES


def plain_runs(words, length=24, times=3):
    """Every period tried at every place."""
    found, n = {}, len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(length, times * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((i, size, p) for (i, size), p in found.items())


def plain_row(words):
    found = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found)]
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *top, digest(listed), digest(b" ".join(kept)))


_unit = st.lists(st.integers(0, 3), min_size=1, max_size=9)
_piece = st.tuples(_unit, st.integers(1, 30), st.lists(st.integers(0, 5), max_size=4)).map(lambda x: x[0] * x[1] + x[2])
_nested = st.tuples(_piece, st.integers(3, 5), st.integers(0, 7)).map(lambda x: (x[0] * x[1])[x[2] :])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(_piece, _nested, st.lists(_piece, max_size=3).map(lambda x: sum(x, []))), min_size=1, max_size=6))
def test_runs_equal_brute_force(documents):
    numbered = [np.unique(np.array(d, np.int64), return_inverse=True)[1].astype(np.int64) for d in documents]
    for d, found in zip(numbered, periodic.runs_of(numbered)):
        assert [tuple(r) for r in found.tolist()] == plain_runs(d.tolist())


@given(st.lists(st.integers(0, 40), min_size=1, max_size=200), st.data())
@settings(max_examples=60, deadline=None)
def test_successor_in_a_slice(values, data):
    tree = periodic.WaveletTree(np.array(values, np.int64))
    lo = data.draw(st.integers(0, len(values) - 1))
    hi, at = data.draw(st.integers(lo, len(values))), data.draw(st.integers(0, 70))
    expected = min([v for v in values[lo:hi] if v >= at], default=999)
    assert tree.successor(np.array([lo]), np.array([hi]), np.array([at]), 999).tolist() == [expected]


def test_suffix_array_in_order():
    text = np.array([1, 0, 1, 0, 1, 2, 0, 1, 0], np.int64)
    order, _ = periodic.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_one_word_very_often_and_long_periods():
    found = periodic.runs_of([np.zeros(200_000, np.int64), np.tile(np.arange(30_000), 4), np.arange(23)])
    assert [f.tolist() for f in found] == [[[0, 200_000, 1]], [[0, 120_000, 30_000]], []]


def test_limits_are_checked():
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(40, np.int64), length=10)


def test_null_empty_long_and_repeated_texts(spark, documents):
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    texts = [None, "", " \t\n ", "one", "go " * 30, "Go go " * 20, long, "go " * 30, "a b " * 24, "x " * 23]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "go " * 30), (None, "go " * 30)]
    got = sorted(tuple(r)[:8] for r in periodic.detect(documents(rows)).fillna({"doc_id": -1}).collect())
    want = sorted((-1 if i is None else i, *plain_row((t or "").encode().split())) for i, t in rows)
    assert [tuple(r) for r in got] == want
    assert periodic.detect(documents([]).limit(0)).count() == 0


def test_query_equals_brute_force_on_the_whole_table(spark, sample):
    def words(doc, text):
        own = (text or "").encode().split()
        h = crc32(str(doc).encode())
        g, n = h // 10, len(own)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
        return own

    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()
    small = {d: t for d, t in docs if len(t or "") < 30_000}  # the plain way takes too long beyond
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sample).collect()}
    assert set(got) == {d for d, _ in docs}
    assert {d: got[d] for d in small} == {d: plain_row(words(d, t)) for d, t in small.items()}
    assert sum(r[0] > 0 for r in got.values()) > 5
