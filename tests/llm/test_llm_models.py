import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.llm import langid, pitmanyor, queries, ruleset
from tideledger.llm.common import fold

ENGLISH = "the house of water and that with this for was over there when they have been under light world people".split()
SPANISH = "el agua de los niños que con esta para fue sobre donde cuando ellos tienen sido bajo mundo gente mañana".split()
RUSSIAN = "дом вода который этот для был над там когда они имеют под свет мир люди завтра утро".split()


def text(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def learned(documents):
    rows = [(i, text(w, 80, i), lang) for i in range(60) for w, lang in ((ENGLISH, "en"), (SPANISH, "es"), (RUSSIAN, "ru"))]
    return langid.train(documents(rows + [(900, None, "en"), (901, "nothing", None), (902, "", "es")]))


def test_languages_and_spans(documents, learned):
    assert learned.languages == ["en", "es", "ru"]
    mixed = f"{text(ENGLISH, 40, 1)}. {text(RUSSIAN, 30, 2)} {text(SPANISH, 20, 3)}"
    rows = [(1, text(ENGLISH, 20, 4)), (2, text(SPANISH, 20, 5)), (3, text(RUSSIAN, 20, 6)), (4, mixed), (5, None), (6, ""), (7, "123 !!! 4.5\n"), (8, "漢字かな"), (2, text(SPANISH, 20, 5)), (None, text(ENGLISH, 60_000, 7)), (9, "a" * 3_000_000)]
    out = langid.identify(documents(rows), learned).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [by[i].lang_pred for i in (1, 2, 3, None)] == ["en", "es", "ru", "en"]
    assert [(by[i].lang_pred, by[i].score, by[i].spans) for i in (5, 6, 7)] == [("und", 0.0, [])] * 3
    assert by[8].lang_pred in learned.languages and by[8].score == 0.0  # a script nobody taught
    assert all(0 <= r.score <= 1 for r in out) and by[1].score > 0.9
    cut = [(s.lang, mixed[s.start : s.end]) for s in by[4].spans]
    assert [c[0] for c in cut] == ["en", "ru", "es"]
    assert sum(len(set(part.replace(".", "").split()) - set(w)) for (_, part), w in zip(cut, (ENGLISH, RUSSIAN, SPANISH))) <= 2


def slow_path(scores, switch):
    value, back = list(scores[0]), []
    for row in scores[1:]:
        best = max(range(len(value)), key=lambda j: value[j])
        came = [j if value[j] >= value[best] - switch else best for j in range(len(value))]
        value = [max(value[j], value[best] - switch) + row[j] for j in range(len(row))]
        back.append(came)
    state = max(range(len(value)), key=lambda j: value[j])
    path = [state]
    for came in reversed(back):
        state = came[state]
        path.append(state)
    return path[::-1]


def test_many_paths_at_once_equal_single_ones():
    rng = np.random.default_rng(2)
    scores = [rng.normal(size=(n, 4)).astype(np.float32) * 3 for n in (0, 1, 7, 30, 30, 2, 0, 90)]
    for s, path in zip(scores, langid.paths(scores, 2.5)):
        assert path.tolist() == (slow_path(s.astype(float), 2.5) if len(s) else [])


def test_scores_do_not_depend_on_portions(learned, monkeypatch):
    long = text(ENGLISH + SPANISH, 3000, 8)
    whole = langid.word_scores(learned, long)
    monkeypatch.setattr(langid, "PORTION", 1000)
    parts = langid.word_scores(learned, long)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert np.abs(whole[2] - parts[2]).mean() < 0.2 and (whole[2].argmax(1) == parts[2].argmax(1)).mean() > 0.99


def test_nothing_to_learn(documents):
    model = langid.train(documents([(1, None), (2, "x", None)]))
    assert [(r.lang_pred, r.score) for r in langid.identify(documents([(1, "some words")]), model).collect()] == [("und", 0.0)]
    assert langid.identify(documents([]), model).count() == 0


def test_held_out_languages(spark, sample):
    out = queries.QUERIES["op2_language_spans"](spark, sample).join(spark.read.parquet(f"{sample}/documents.parquet"), "doc_id")
    rows = out.filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def junk(seed):
    return " ".join(w + "!!" for w in text(ENGLISH, 30, seed).upper().split())


def test_rules_compile_to_what_they_say(spark):
    rule = (("upper", 0.1, math.inf), ("words", -math.inf, 3.0))
    df = spark.createDataFrame([(0.2, 2.0), (0.1, 2.0), (0.2, 3.0), (0.2, 3.1)], "upper double, words double")
    assert [r[0] for r in df.select(ruleset.condition(rule)).collect()] == [True, False, True, False]
    model = ruleset.Ensemble(0.5, {rule: -2.0}, {"words": (0.25, 1.0, 3.0)})
    got = [r[0] for r in df.select(model.column()).collect()]
    want = [1 / (1 + math.exp(-(0.5 - 2.0 * (u > 0.1 and w <= 3.0) + 0.25 * min(max(w, 1.0), 3.0)))) for u, w in ((0.2, 2.0), (0.1, 2.0), (0.2, 3.0), (0.2, 3.1))]
    assert got == pytest.approx(want)


def test_quality_of_documents(spark, documents):
    rows = [(i, junk(i) if i % 4 == 0 else text(ENGLISH + SPANISH, 60, i)) for i in range(400)]
    measured = ruleset.statistics(documents(rows + [(1000, None), (1001, ""), (1002, "word " * 100_000), (None, junk(9)), (1001, "")]), "doc_id", "text")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(3, 0), (3, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    ensemble = ruleset.fit(measured.join(ruleset.one_label(labels, "doc_id", "quality").filter(fold("doc_id", 5) != 0), "doc_id"))
    assert ensemble.rules and len(ensemble.rules) + len(ensemble.linear) < 120
    out = {r.doc_id: r for r in ruleset.score(measured, ensemble).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].predicted == int(i % 4 != 0) for i in held)
    assert all(0 <= r.score <= 1 for r in out.values()) and {1000, 1001, 1002, None} < set(out)
    assert out[1000].score == out[1001].score


def test_one_label_only(spark, documents):
    measured = ruleset.statistics(documents([(1, "a b"), (2, "c")]), "doc_id", "text")
    one = ruleset.fit(measured.withColumn("label", F.lit(1)))
    assert {round(r.score, 6) for r in ruleset.score(measured, one).collect()} == {round(2.5 / 3, 6)}
    none = ruleset.fit(measured.withColumn("label", F.lit(1)).filter("false"))
    assert {r.score for r in ruleset.score(measured, none).collect()} == {0.5}


def test_label_conflicts(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert {tuple(r) for r in ruleset.one_label(labels, "doc_id", "quality").collect()} == {(1, 1), (2, 0)}


def test_stirling_numbers_count_seatings():
    d = 0.3
    table = np.exp(pitmanyor.stirling(d, 6))

    def weights(c):  # all set partitions by their table sizes
        if not c:
            return {0: 1.0}
        total = collections.Counter()
        for first in range(c):  # customers besides the first one at the first table
            for t, w in weights(c - 1 - first).items():
                total[t + 1] += math.comb(c - 1, first) * math.prod(j - d for j in range(1, first + 1)) * w
        return total

    for c in range(1, 7):
        for t, w in weights(c).items():
            assert table[c, t] == pytest.approx(w)


def test_tables_follow_their_distribution():
    n, c, d, weight = 20_000, 9, 0.4, 1.7
    rng = np.random.default_rng(0)
    drawn = pitmanyor.draw_tables(np.full(n, c), np.full(n, weight), d, rng.random(n))
    want = np.exp(pitmanyor.stirling(d)[c, 1 : c + 1]) * weight ** np.arange(1, c + 1)
    got = np.bincount(drawn, minlength=c + 1)[1:] / n
    assert np.abs(got - want / want.sum()).max() < 0.015
    many = pitmanyor.draw_tables(np.array([0, 1, 5000, 10**7]), np.full(4, 5.0), d, np.full(4, 0.5))
    assert many[0] == 0 and many[1] == 1 and pitmanyor.EXACT > 1 and 20 < many[2] < many[3] < 10**5


def test_scores(spark, documents, monkeypatch):
    rows = [(i, text(ENGLISH, 30, i).replace("house", "House") + f" rare{i} {'x' * (i % 5)}") for i in range(150)]
    rows += [(500, None), (501, ""), (501, ""), (502, "never seen words\x1fhere"), (None, "the house"), (503, "the " * 30_000)]
    docs = documents(rows)
    train = docs.filter(fold("doc_id", 7) != 2)
    learn = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = collections.Counter(w for t in learn for w in pitmanyor.tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    found = []
    for hot in (1 << 17, 12):
        monkeypatch.setattr(pitmanyor, "HOT", hot if hot > 40 else 40)
        monkeypatch.setattr(pitmanyor, "FREQUENT", 10)
        model = pitmanyor.train(train)
        assert (model.tokens, model.words) == (total, kinds)
        out = pitmanyor.score(docs, model).collect()
        assert len(out) == len(rows)
        for key, body in rows:
            r = next(x for x in out if x.doc_id == key)
            own = pitmanyor.tokens(body)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), total)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), rel=1e-9)
            assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
        found.append({r.doc_id: r.score for r in out})
        rowsum = model.table.collect()
        for u in range(len(model.shares)):
            direct = sum(d for r in rowsum for k, d in zip(r.contexts, r.direct) if k == u)
            parent = sum(np.array(r.roots) for r in rowsum) + model.unseen
            assert direct + float((parent * model.shares[u]).mean()) == pytest.approx(1.0)
    assert found[0] == pytest.approx(found[1])  # scored in place or by the join


def test_model_beats_the_base_on_texts_it_has_not_seen(spark, sample):
    out = queries.QUERIES["op3_pitman_yor"](spark, sample).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_model_of_nothing(documents):
    model = pitmanyor.train(documents([]))
    assert [(r.n_tokens, r.n_known, r.score, r.base_score) for r in pitmanyor.score(documents([(1, "a b")]), model).collect()] == [(3, 0, 0.0, 0.0)]
    assert pitmanyor.score(documents([]), model).count() == 0
