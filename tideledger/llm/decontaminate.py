"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other parameters keeps its template. A document
holds an item if at least ``similarity`` of the item's template windows occur in it together. By counting, one of any
floor((1 - similarity) x windows) + 1 windows must then occur exactly; those with the longest words are looked for, each
by its longest word. Only where that word stands in a text is a window built and compared, so the pass over the texts
is one join of their words with a small table and shuffles nothing; only texts with a match are looked up again. Slots of the aligned place must be filled consistently.
Beside its template an item is looked for by its plain words, in the same pass, so that a copy in other case is found.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideledger.session import stage

WINDOW = 5
#: Words of a window that must not be placeholders.
LITERALS = 3
#: Anchor rows broadcast at once, at about 100 bytes each; a larger benchmark is worked through in blocks of that size.
ANCHORS = 200_000
#: Matched places (about 50 bytes each) up to which their documents are found by a broadcast; beyond it by a shuffle.
PLACES = 400_000
PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡*#&|"
#: Number words and units of measure.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = "mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hour hours minute minutes second seconds day days week weeks year years percent dollar dollars euro euros meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres degree degrees".split()  # noqa: E501
_SPACE = " \t\n\r\x0b\x0c"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\r\x0b\f]+"))


def core(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(PUNCTUATION)))


def _number(word: Column) -> Column:
    bare = F.btrim(word, F.lit(PUNCTUATION))
    return bare.rlike(r"^[+-]?[$€£]?[0-9][0-9.,:/]*(%|st|nd|rd|th)?$") | F.lower(bare).isin(NUMBER_WORDS)


def _canonical(word: Column, before: Column) -> Column:
    """Placeholder or lower-case core of a word, given the word before it ('' at the start of a text)."""
    starts = (before == "") | before.rlike("[.!?:][\"'”’)]*$")
    name = F.btrim(word, F.lit(PUNCTUATION)).rlike(r"^\p{Lu}\p{Ll}+$") & ~starts
    return (
        F.when(_number(word), "<num>").when(core(word).isin(UNITS) & _number(before), "<unit>").when(name, "<name>").otherwise(core(word))
    )


def template(led: Column) -> Column:
    """Canonical words of a list whose first element is only the word before."""
    return F.slice(F.transform(led, lambda w, i: _canonical(w, F.coalesce(F.get(led, i - 1), F.lit("")))), 2, 1_000_000)


def plain(led: Column) -> Column:
    """Lower-case cores of a list whose first element is only the word before."""
    return F.slice(F.transform(led, lambda w: core(w)), 2, 1_000_000)


def _led(words: Column, start: Column, length: Column) -> Column:
    """``length`` words from 0-based ``start``, with the word before in front ('' if there is none)."""
    first = F.array(F.coalesce(F.get(words, start - 1), F.lit("")))
    return F.concat(first, F.slice(words, start + 1, length))


def _windows(tokens: Column, width: Column) -> Column:
    """All windows of ``width`` words of a template as structs (start, literals, text)."""
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(0), F.greatest(F.size(tokens) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    literal = lambda t: ~t.isin("<num>", "<unit>", "<name>", "")
    made = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"),
            F.size(F.filter(F.slice(tokens, s + 1, width), literal)).alias("literals"),
            F.array_join(F.slice(tokens, s + 1, width), " ").alias("text"),
        ),
    )
    return F.filter(made, lambda w: w["literals"] >= F.least(F.lit(LITERALS), width))


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """Each item as template, and as plain words if it has placeholders and fills a window."""
    read = benchmark.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    led = F.concat(F.array(F.lit("")), F.col("words"))
    both = read.select("*", template(led).alias("canonical"), plain(led).alias("plain"))
    exact = F.when((F.col("canonical") != F.col("plain")) & (F.size("words") >= WINDOW), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    made = (
        both.select("item_id", "words", "canonical", "plain", F.explode(exact).alias("exact"))
        .withColumn("tokens", F.when(F.col("exact"), F.col("plain")).otherwise(F.col("canonical")))
        .drop("canonical", "plain")
        .withColumn("found", _windows(F.col("tokens"), F.least(F.size("tokens"), F.lit(WINDOW))))
        .filter(F.size("found") > 0)
    )
    return stage(made.withColumn("n", F.size("words")).withColumn("texts", F.array_distinct(F.transform("found", lambda w: w["text"]))))


def _anchors(items: DataFrame, similarity: float) -> DataFrame:
    """For each form of an item enough windows that one of them must occur: ``item_id, exact, n, start, offset, width, anchor, hash``."""
    opened = items.select("item_id", "exact", "n", F.size("texts").alias("count"), "tokens", F.explode("found").alias("w"))
    width = F.least(F.size("tokens"), F.lit(WINDOW))
    parts = F.slice("tokens", F.col("w.start") + 1, width)
    sized = F.transform(parts, lambda t, i: F.struct(F.when(t.isin("<num>", "<unit>", "<name>"), 0).otherwise(F.length(t)).alias("len"), (-i).alias("at")))
    longest = F.array_max(sized)
    rows = opened.select(
        "item_id", "exact", "n", "count", F.col("w.start").alias("start"), F.col("w.text").alias("text"), (-longest["at"]).alias("offset"),
        longest["len"].alias("len"), F.get(parts, -longest["at"]).alias("word"), width.alias("width"),
    )
    # A text that occurs twice in an item is one window of its set: choose among distinct texts, then take all places.
    rank = F.dense_rank().over(Window.partitionBy("item_id", "exact").orderBy(F.desc("len"), "text"))
    chosen = rows.withColumn("rank", rank).filter(F.col("rank") <= F.floor((1 - F.lit(similarity)) * F.col("count") + 1e-9) + 1)
    return chosen.select("item_id", "exact", "n", "start", "offset", "width", F.col("word").alias("anchor"), F.xxhash64("text").alias("hash"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8,
) -> DataFrame:
    """``<key>, item_id, similarity, start, changed`` for each document that holds an item.

    ``similarity`` is the part of the item's distinct template windows found at the place (best place), ``start`` the
    word where it begins, ``changed`` whether any slot has another value. A place whose slots are filled inconsistently
    (one value of the item with two in the text) doesn't count; two values may become the same. Windows with fewer than
    three words that aren't placeholders, or of an item shorter than a window fewer than it has, say too little and are
    left out. An item of a window or more is also matched by its plain words, names and numbers included and case apart,
    to the same part of its windows. A shorter one with no other window, and null or blank items, match nothing; nor do null or blank texts. Repeated documents
    and items give one row for each pair of keys. Other columns are ignored; empty tables give an empty result.
    """
    items = _items(benchmark, item_key, item_text)
    anchors = stage(_anchors(items, similarity))
    raw = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("raw"))
    texts = raw.select("doc", words_of(F.col("raw")).alias("words"))
    # Each word with its neighbours: a row has a few words only, however long its text is.
    pad = F.array(*[F.lit("")] * WINDOW)
    shifted = [F.slice(F.concat(pad, "words", pad), 1 + k, F.size("words")).alias(f"w{k}") for k in range(2 * WINDOW)]
    spread = texts.filter(F.size("words") > 0).select("doc", F.posexplode(F.arrays_zip(*shifted)).alias("at", "near"))
    spread = spread.withColumn("anchor", core(F.col(f"near.w{WINDOW}")))
    blocks = max(1, ceil(anchors.count() / ANCHORS))
    hits = None
    for block in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("item_id", "start"), F.lit(blocks)) == block)
        near = F.array(*[F.col(f"near.w{k}") for k in range(2 * WINDOW)])
        led = F.slice(near, WINDOW - F.col("offset"), F.col("width") + 1)
        there = F.when(F.col("exact"), plain(led)).otherwise(template(led))
        found = (
            spread.join(F.broadcast(part), "anchor")
            .filter(F.xxhash64(F.array_join(there, " ")) == F.col("hash"))
            .select("doc", "item_id", "exact", "n", (F.col("at") - F.col("offset") - F.col("start")).alias("first"))
        )
        hits = found if hits is None else hits.unionByName(found)
    # A document's places are at most as many as its words; its text is looked up once.
    held = stage(hits.distinct().groupBy("doc").agg(F.collect_list(F.struct("item_id", "exact", "n", "first")).alias("places")))
    size = held.agg(F.count(F.lit(1)), F.sum(F.size("places"))).first()
    if size[0] + (size[1] or 0) <= PLACES:
        held = F.broadcast(held)
    slack = lambda p: F.ceil(p["n"] / 4).cast("int")
    low = lambda p: F.greatest(p["first"] - slack(p), F.lit(0))
    region = lambda p: F.struct(
        p["item_id"].alias("item_id"), p["exact"].alias("exact"), p["first"].alias("first"), low(p).alias("low"),
        _led(F.col("words"), low(p), p["first"] + p["n"] + slack(p) - low(p)).alias("led"),
    )
    places = (
        raw.withColumnRenamed("doc", "own_doc").join(held, F.col("own_doc").eqNullSafe(F.col("doc")))
        .select("doc", "places", words_of(F.col("raw")).alias("words"))
        .select("doc", F.explode(F.transform("places", region)).alias("p")).select("doc", "p.*")
    )
    joined = places.join(items.select("item_id", "exact", "n", F.col("words").alias("own"), F.col("tokens").alias("own_tokens"), "texts"), ["item_id", "exact"])
    # Few rows; written once, so that no later expression repeats the template's work.
    joined = stage(joined.withColumn("tokens", F.when(F.col("exact"), plain(F.col("led"))).otherwise(template(F.col("led")))))
    there = _windows(F.col("tokens"), F.least(F.col("n"), F.lit(WINDOW)))
    share = F.size(F.array_intersect("texts", F.transform(there, lambda w: w["text"]))) / F.size("texts")
    slot = lambda t: t.isin("<num>", "<unit>", "<name>")
    shift = F.col("first") - F.col("low")
    pairs = F.filter(
        F.transform(
            "own_tokens",
            lambda t, i: F.when(
                slot(t) & (F.get(F.col("tokens"), i + shift) == t),
                F.struct(core(F.get(F.col("own"), i)).alias("own"), core(F.get(F.col("led"), i + shift + 1)).alias("there")),
            ),
        ),
        lambda p: p.isNotNull(),
    )
    judged = joined.select("doc", "item_id", "first", share.alias("share"), F.array_distinct(pairs).alias("pairs")).filter(
        F.col("share") >= similarity
    )
    owns = F.size(F.array_distinct(F.transform("pairs", lambda p: p["own"])))
    kept = judged.filter(owns == F.size("pairs"))
    changed = F.exists("pairs", lambda p: p["own"] != p["there"])
    best = kept.select("doc", "item_id", "share", F.greatest("first", F.lit(0)).alias("start"), changed.alias("changed"))
    return best.groupBy("doc", "item_id").agg(
        F.max("share").alias("similarity"), F.min("start").alias("start"), F.min("changed").alias("changed")
    ).withColumnRenamed("doc", key)
