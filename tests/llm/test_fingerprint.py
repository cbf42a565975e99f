import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tideledger.llm import fingerprint
from tideledger.llm.queries import QUERIES


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_sketch(text, k=128, size=5):
    """Same hashes with the xxhash library: one of each word, chained over a shingle as Spark does it for several columns."""
    words = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").lower().encode().split()]
    hashes = set()
    for i in range(len(words)):
        seed = 42
        for w in words[max(0, i - size + 1) : i + 1]:
            seed = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed)
        hashes.add(signed(seed))
    return sorted(hashes)[:k]


def plain_likeness(a, b, k=128):
    whole = sorted(set(a) | set(b))[:k]
    return len(set(whole) & set(a) & set(b)) / len(whole) if whole else 1.0


def rendered(sketch):
    return "".join(f"{h % 2**64:016x}" for h in sketch)


def plain(rows):
    """Rows of (doc_id, text) in descending order; the first follows the last."""
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for i, (d, t) in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, other, behind = plain_sketch(t), plain_sketch(edited), plain_sketch(following)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), rendered(own), rendered(other), plain_likeness(own, other), plain_likeness(own, behind)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def test_nulls_empty_texts_repeated_keys_and_sparse_keys(spark, documents):
    rows = [(5, None), (9, ""), (10, "one"), (11, "one two"), (12, "Ünï cödé " * 40), (-7, "a b c d e f"), (2**62, "z " * 300)]
    rows += [(5, "again"), (5, "again"), (None, "no id"), (None, None), (12, "Ünï cödé " * 40), (7_000_000, "x y\tz\n" * 20)]
    assert got(fingerprint.fingerprints(documents(rows))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(3, "alone in the world")], [(None, None)]])
def test_none_or_one_document(spark, documents, rows):
    assert got(fingerprint.fingerprints(documents(rows).filter("doc_id IS NOT NULL OR true"))) == plain(rows)


def test_a_key_of_very_many_rows_gets_windows_of_its_own(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS", 16)
    rows = [(i, f"text number {i} of some") for i in range(300)] + [(150, f"variant {i}") for i in range(200)] + [(150, "the same")] * 90
    rows += [(None, f"lost {i % 40}") for i in range(120)]
    assert got(fingerprint.fingerprints(documents(rows))) == plain(rows)


def test_query_equals_brute_force_on_the_whole_table(spark, sample):
    rows = [tuple(r) for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_bottom_k_fingerprints"](spark, sample)) == plain(rows)


def test_parts_merge_into_the_whole(spark):
    words = [f"w{i % 977}" for i in range(5000)]
    parts = [" ".join(words[max(0, a - 4) : a + 500]) for a in range(0, 5000, 500)]
    df = spark.createDataFrame([("long", p) for p in parts] + [("none", None), ("none", " ")], "name string, text string")
    merged = {r["name"]: r["sketch"] for r in fingerprint.merged(fingerprint.add_sketch(df, "text"), ["name"]).collect()}
    # Shorter shingles at the head of a part are the only ones that the whole text doesn't have.
    heads = {h for p in parts[1:] for h in plain_sketch(" ".join(p.split()[:4]))}
    assert merged["long"] == sorted(set(plain_sketch(" ".join(words), 10**6)) | heads)[:128]
    assert merged["none"] == []


def test_estimates_are_near_the_truth(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fingerprint.add_sketch(fingerprint.add_sketch(df, "a", "sa", k=1024), "b", "sb", k=1024)
    pick = df.select(
        fingerprint.resemblance(F.col("sa"), F.col("sb"), 1024).alias("r"),
        fingerprint.containment(F.col("sa"), F.col("sb"), 1024).alias("c"),
        fingerprint.distinct_shingles(F.col("sa"), 1024).alias("n"),
    ).first()
    assert pick["r"] == pytest.approx(0.5, abs=0.06) and pick["c"] == pytest.approx(2 / 3, abs=0.08)
    assert pick["n"] == pytest.approx(3000, rel=0.12)


def test_no_python_in_the_plan(spark, documents):
    plan = fingerprint.fingerprints(documents([(1, "a b"), (2, "c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
