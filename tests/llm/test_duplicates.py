import random

import numpy as np
import pytest
import xxhash

from tideledger.llm import passages, simhash
from tideledger.llm.components import components

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(3000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one Two", "one two three", "É Ünï a b", "a b " * 400, prose(700, 1)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_text_in_portions():
    text = prose(140_000, 2)
    words = text.encode().split()
    counts = np.zeros(64, int)
    for i in range(len(words) - 2):
        counts += np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42)], "<u8").view(np.uint8), bitorder="little")
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 2)


def slow_components(points, radius):
    label = {p: p for p in points}
    for p in points:
        for q in points:
            if bin(p ^ q).count("1") <= radius:
                a, b = label[p], label[q]
                if a != b:
                    label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("shard,leaf", [(10, 8), (60, 16), (10_000, 400)])
def test_links_are_exact_however_the_tree_cuts(spark, shard, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SAMPLE", 64)
    rng = random.Random(4)
    points = {rng.getrandbits(64) for _ in range(150)}
    for p in list(points)[:60]:  # chains and a dense group
        for _ in range(3):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            points.add(p)
    centre = rng.getrandbits(64)
    points |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(p),) for p in points], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.near_links(classes, 2, shard), "a", "b").collect()}
    want = slow_components(sorted(points), 2)
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(signed(p))
    for group in groups.values():
        if len(group) == 1:
            assert next(iter(group)) not in roots
        else:
            assert {roots.get(p) for p in group} == {min(group)}


def test_links_on_their_own():
    points = np.sort(np.array([0, 1, 3, 7, 15, 255, 1 << 63], np.uint64))
    assert simhash.link(points, 2).tolist() == [0, 0, 0, 0, 0, 5, 0] or simhash.link(points, 2)[:5].tolist() == [0] * 5


def test_near_duplicates_of_odd_rows(spark, documents):
    base = prose(900, 3)
    rows = [(5, base), (3, base), (9, base.upper()), (None, base), (7, None), (8, ""), (6, " \n"), (2, "alone here now"), (2, "alone here now"), (None, "only me without key")]
    out = simhash.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows)
    got = sorted(((r.doc_id, r.component_id) for r in out), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (None, 3), (7, 6), (8, 6), (6, 6), (2, 2), (2, 2), (None, None)], key=str)
    assert {r.fingerprint for r in out if r.doc_id in (6, 7, 8)} == {"0" * 16}
    assert simhash.near_duplicates(documents([])).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def slow_chain(x, y, weight, gap):
    best = 0
    order = sorted(range(len(x)), key=lambda i: x[i])
    score = {}
    for i in order:
        before = [score[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in score if x[j] < x[i] and y[j] < y[i]]
        score[i] = weight + max([0, *before])
        best = max(best, score[i])
    return best


def test_best_chain_equals_the_quadratic_one():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 40)
        x, y = (np.array([rng.randrange(60) for _ in range(n)]) for _ in range(2))
        found = passages.chains(x, y)
        assert sorted(i for c in found for i in c) == list(range(n))
        first = found[0]
        assert (np.diff(x[first]) > 0).all() and (np.diff(y[first]) > 0).all()
        total = passages.K * len(first) - passages.GAP * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert total == pytest.approx(slow_chain(x.tolist(), y.tolist(), passages.K, passages.GAP))


def test_a_shared_run_shares_a_seed():
    rng = random.Random(9)
    for n in range(50):
        run = prose(passages.K + passages.W - 1, 100 + n)
        sides = [passages.seeds(passages.word_hashes(f"{prose(rng.randint(0, 60), n + s)} {run} {prose(rng.randint(0, 60), n - s)}".encode()))[1] for s in (1000, 2000)]
        assert set(sides[0].tolist()) & set(sides[1].tolist())


def spans(out, key):
    return [(r.start, r.end, r.ref_doc_id) for r in out if r.doc_id == key]


def test_passages(spark, documents):
    shared, fuzzy = prose(80, 20).split(), None
    fuzzy = list(shared)
    fuzzy[20], fuzzy[50] = "changed", "altered"
    fuzzy.insert(35, "inserted")
    a = prose(200, 21).split() + shared + prose(100, 22).split()
    b = prose(90, 23).split() + shared + prose(150, 24).split()
    c = [w.upper() for w in fuzzy] + prose(120, 25).split()
    short = prose(60, 26).split() + shared[:40] + prose(60, 27).split()
    join = " ".join
    rows = [(10, join(a)), (11, join(b)), (12, "\n".join(c)), (13, join(short)), (14, prose(300, 28)), (15, None), (16, ""), (17, "few words only"), (None, join(a)), (18, join(a)), (18, join(a)), (19, "spam " * 4000), (20, "spam " * 3000)]
    docs = documents(rows)
    found = passages.repeated(docs)
    out = found.collect()
    assert spans(out, 11) == [(90, 170, 10)]
    assert spans(out, 18)[0][:2] == (0, len(a)) and not spans(out, 10)
    (start, end, ref) = spans(out, 12)[0]
    assert (start, ref) == (0, 10) and abs(end - 81) <= 1
    assert not spans(out, 13) and not spans(out, 14) and not {r.doc_id for r in out} & {15, 16, 17, None}
    assert all(r.similarity >= 0.8 for r in out)
    left = passages.without_passages(documents(rows, clash=False), found).collect()
    by = {}
    for r in left:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[11][0].split() == b[:90] + b[170:]
    assert by[10] == [join(a)] and by[14] == [prose(300, 28)] and by[15] == [None] and by[16] == [""]
    assert 18 not in by and by[None] == [join(a)]
    assert by[12][0].split() == c[end:]


def test_passages_of_nothing(documents):
    assert passages.repeated(documents([])).count() == 0
