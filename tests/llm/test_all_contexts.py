"""Language model: every word is a context of its own."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from tideledger.llm import pitmanyor


def pairs(text):
    words = pitmanyor.tokens(text)
    return list(zip(words, [None, *words[:-1]]))


def hashes(text):
    (_, _, words, before), = pitmanyor._hashed(pa.array([text], pa.string()))
    return list(zip(words.tolist(), before.tolist()))


def test_hashes_tell_the_tokens_of_any_portion_apart(monkeypatch):
    texts = [None, "", " ", "One two", "one TWO\n\n", "\tÄ ä a\x1fb\x0bc", "x" * 5000, "two  one", "one", ""]
    known = {}
    for size in (1, 7, 1 << 21):
        monkeypatch.setattr(pitmanyor, "_BYTES", size)
        for column in (pa.array(texts), pa.array(["skipped", *texts])[1:]):
            found = [[] for _ in texts]
            for first, row, words, before in pitmanyor._hashed(column):
                for r, *pair in zip(row.tolist(), words.tolist(), before.tolist()):
                    found[first + r].append(tuple(pair))
            for text, got in zip(texts, found):
                want = pairs(text)
                assert len(got) == len(want) and got[0][1] == pitmanyor.START
                for (word, _), (h, _), behind in zip(want, got, [*got[1:], None]):
                    assert known.setdefault(word, h) == h and (behind is None or behind[1] == h)
    assert len(set(known.values())) == len(known)


@pytest.fixture(scope="module")
def learned(documents):
    # 60 contexts of the same frequency, each with a word of its own and one they share.
    rows = [(100 * i + k, f"left{i} right{i} end left{i} both") for i in range(60) for k in range(4)]
    return rows, pitmanyor.train(documents(rows))


def test_a_word_is_expected_where_it_was_seen(documents, learned):
    _, model = learned
    out = {r.doc_id: r.score for r in pitmanyor.score(documents([(i, f"left{i % 60} right{(i if i < 60 else i + 1) % 60}") for i in range(120)]), model).collect()}
    assert all(out[i] > out[60 + i] + 0.5 for i in range(60))


@pytest.mark.parametrize("hot", [1 << 19, 5, 0])
def test_scores_are_those_of_the_tables(documents, learned, monkeypatch, hot):
    monkeypatch.setattr(pitmanyor, "HOT", hot)
    rows, model = learned
    counts = collections.Counter(h for _, text in rows for h in hashes(text))
    dishes = {r.w: r for r in model.dishes.collect()}
    places = {r.u: r for r in model.restaurants.collect()}
    cells = {(r.w, r.u): r for r in model.cells.collect()}
    assert {k: r.n for k, r in cells.items()} == counts and len(places) == 60 * 2 + 3  # and the start, "end" and "both"
    assert {u: r.customers for u, r in places.items()} == collections.Counter(u for _, u in counts.elements())
    roots = np.array([r.roots for r in dishes.values()]).sum(axis=0)
    assert roots + model.unseen == pytest.approx(np.ones(pitmanyor.SAMPLES))

    def chance(w, u):
        shares = places[u].shares if u in places else [1.0] * pitmanyor.SAMPLES
        own = cells[w, u].seated / (1 + places[u].customers) if (w, u) in cells else 0.0
        return own + np.mean(np.array(shares) * (dishes[w].roots if w in dishes else model.unseen))

    for u in places:  # each context's chances add up
        assert sum(chance(w, u) for w in dishes) + np.mean(np.array(places[u].shares) * model.unseen) == pytest.approx(1)
    texts = [(1, rows[0][1]), (2, "right1 left2 right3 right3"), (3, "new words left4 NEW left4 right4"), (4, None), (3, "both " * 40)]
    found = sorted((r.n_tokens, r.score, r.n_known) for r in pitmanyor.score(documents(texts), model).collect())
    plain = [(hashes(t), [w in dishes for w, _ in hashes(t)]) for _, t in texts]
    want = sorted((len(h), sum(math.log10(chance(w, u)) for w, u in h), sum(k)) for h, k in plain)
    assert [list(x) for x in found] == [pytest.approx(list(x)) for x in want]


def test_seats_go_on_from_round_to_round(documents, monkeypatch):
    asked = []
    swept = pitmanyor._swept
    monkeypatch.setattr(pitmanyor, "_swept", lambda state, *a: asked.append((state.filter("u IS NOT NULL").agg({"t0": "sum"}).first()[0], a[3])) or swept(state, *a))
    pitmanyor.train(documents([(i, "a b " * 30 + f"c{i % 7} b") for i in range(40)]))
    assert [list(numbers) for _, numbers in asked] == [[0, 1], [2, 3], [4, 5, 6, 7, 8]]
    assert asked[1][0] > asked[0][0]  # the second round begins with the tables of the first, not with one a cell
