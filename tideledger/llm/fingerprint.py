"""Document fingerprints: bottom-k sketches of shingle hashes, written with DataFrame functions only.

A sketch is the sorted array of the k smallest distinct shingle hashes of a text. Sketches of parts merge into the
sketch of the whole, so a document may come in pieces, and a source or a day may have one sketch of all its texts. Two
sketches estimate resemblance and containment of the shingle sets, one estimates how many distinct shingles there are.
Null and blank texts have the empty sketch; it is equal to itself (resemblance 1) and unlike all others (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideledger.llm.common import checked
from tideledger.llm.decontaminate import words_of
from tideledger.operators.ordered import ranked
from tideledger.session import stage

#: Hashes of a sketch: the standard error of a resemblance r is sqrt(r(1-r)/K), 0.044 at most.
K = 128
#: Words of a shingle.
WORDS = 5
#: A window over neighbouring documents holds about so many rows, and so many bytes of text.
ROWS, BYTES = 2000, 32_000_000
#: Stands for a missing id, behind all others.
_NO_ID = -(2**63)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word, capital letters as small ones."""
    return F.transform(words_of(F.lower(text)), lambda word: F.xxhash64(word))


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(words: Column, k: int = K, size: int = WORDS) -> Column:
    """Sketch of a column that holds ``word_hashes``.

    Every word ends a shingle of itself and up to ``size - 1`` words before it, so a text of a few words has shingles
    too: as many as words, the first ones shorter. ``words`` must be a column of the frame, not an expression: it is
    read once for each place of a shingle.
    """
    return bottom(F.transform(words, lambda x, i: F.xxhash64(*[F.get(words, i - back) for back in range(size - 1, 0, -1)], x)), k)


def add_sketch(docs: DataFrame, text: str, name: str = "sketch", k: int = K, size: int = WORDS) -> DataFrame:
    """``docs`` with the sketch of a text column."""
    return docs.withColumn("_words", word_hashes(F.col(text))).withColumn(name, sketch(F.col("_words"), k, size)).drop("_words")


def merged(sketches: DataFrame, by: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of ``by``: that of all parts' shingles together.

    A part's hashes are rows for a while. Each task keeps the k smallest of a group before anything is shuffled, so a
    group of very many parts costs k rows a task. Groups of empty sketches only have the empty one.
    """
    parts = sketches.select(*by, F.explode_outer(name).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_hash").asc_nulls_last()))
    least = parts.withColumn("_place", place).filter(F.col("_place") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(name))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets, 0 to 1: the part of their common sketch that both hold."""
    whole = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(whole, F.array_intersect(a, b)))
    return F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(both / F.size(whole))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of the shingles of ``a`` that ``b`` has too, 0 to 1; an empty ``a`` is contained in everything."""
    alike = resemblance(a, b, k)
    own, other = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), alike * (own + other) / ((1 + alike) * own)))


def rendered(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash, in the order of the hashes as signed numbers."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, text, next_text`` (null texts empty): the text of the next document in descending order of the key, after
    the last one that of the first.

    The whole texts are shuffled once: keys are cut into buckets of neighbouring values, each bucket is one small window,
    and a copy of the next bucket's first document stands at its end. Documents without a key come last. Rows with one
    key are ordered by the hash of their text and then by the text. A key of very many rows has windows of its own by hash,
    and its rows of one text are counted, not repeated, while they are ordered.
    """
    keyed = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("_key", F.coalesce("_id", F.lit(_NO_ID))).withColumn("_hash", F.xxhash64("text"))
    seen = keyed.agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count("_id").alias("rows"), F.avg(F.octet_length("text")).alias("bytes")).first()
    rows = max(16, min(ROWS, int(BYTES / max(seen["bytes"] or 1, 1))))
    width = max(1, min(2**62, ((seen["most"] or 0) - (seen["least"] or 0) + 1) * rows // max(seen["rows"], 1)))
    bucket = F.expr(f"(_key + if(_key < {_NO_ID + width}, {width}L, 0L) - pmod(_key, {width}L)) div {width}L")
    keyed = keyed.withColumn("_bucket", F.when(F.col("_key") == _NO_ID, F.lit(_NO_ID)).otherwise(bucket))

    heavy = stage(keyed.groupBy("_bucket", "_key").count().filter(F.col("count") > 4 * rows).select("_bucket", "_key"))
    keyed = keyed.withColumns({"_segment": F.lit(0), "_slice": F.lit(0).cast("long"), "_copies": F.lit(1).cast("long")})
    if heavy.head(1):
        # Rows before the heavy key, its own by slices of the hash, and rows behind it are buckets of their own.
        lists = heavy.groupBy("_bucket").agg(F.sort_array(F.collect_list("_key")).alias("_heavy"))
        spread = keyed.join(checked(lists), "_bucket", "left")
        own = F.coalesce(F.array_contains("_heavy", F.col("_key")), F.lit(False))
        before = F.coalesce(F.size(F.filter("_heavy", lambda x: x > F.col("_key"))), F.lit(0))
        spread = spread.withColumn("_segment", F.when(F.col("_heavy").isNull(), 0).otherwise(2 * before + own.cast("int")))
        spread = spread.withColumn("_slice", F.when(own, F.shiftright("_hash", 50)).otherwise(0)).drop("_heavy", "_copies")
        keyed = spread.groupBy(*spread.columns).agg(F.count(F.lit(1)).alias("_copies")).select(*keyed.columns)

    part = ["_bucket", "_segment", "_slice"]
    order = [F.col("_bucket").desc(), F.col("_segment").asc(), F.col("_slice").asc()]
    # Numbers only: one row for each window. Its first row is that of the largest key and, among its rows, the least hash.
    firsts = keyed.groupBy(*part).agg(F.min(F.struct((-1 - F.col("_key")).alias("_back"), "_hash")).alias("_first"))
    numbered = stage(ranked(firsts.select(*part, (-1 - F.col("_first._back")).alias("_key"), F.col("_first._hash").alias("_hash")), [], order, "_number"))
    windows = numbered.count()
    earlier = numbered.select(*part, (F.col("_number") % F.lit(max(windows, 1)) + 1).alias("_number"))
    heads = numbered.select("_number", "_key", "_hash").join(earlier, "_number").drop("_number")
    guests = keyed.select("_key", "_hash", "_id", "text").join(checked(heads), ["_key", "_hash"])
    guests = guests.groupBy(*part).agg(F.min("text").alias("text")).withColumn("_guest", F.lit(True))

    table = keyed.withColumn("_guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    order = [F.col("_guest").asc(), F.col("_key").desc(), F.col("_hash").asc(), F.col("text").asc()]
    led = table.withColumn("next_text", F.lead("text").over(Window.partitionBy(*part).orderBy(*order))).filter(~F.col("_guest"))
    if heavy.head(1):
        led = led.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        led = led.withColumn("next_text", F.when(F.col("_copy") < F.col("_copies"), F.col("text")).otherwise(F.col("next_text")))
    return led.select(F.col("_id").alias(key), "text", "next_text")


def edited(text: Column, other: Column, n: Column) -> Column:
    """``text`` of ``n`` code points, its last half replaced by as many first code points of ``other``."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text and of its edited form: the last half of its code points replaced by the beginning of the
    next document's text, in descending order of the key.

    ``<key>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_part, shingles``:
    resemblance of the text's sketch to the edited one and to the next document's, the part of the text's shingles that
    the edited text keeps, and the estimated number of distinct ones. One row for each row of ``docs``, in no order. Null
    texts count as empty, rows may repeat keys and texts, null keys come last; a single document is its own next one.
    Other columns are ignored; an empty table gives an empty result.
    """
    pairs = followed(docs.select(key, text), key, text).withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"), F.col("n_chars")))
    named = {"_own": "text", "_edited": "edited", "_next": "next_text"}
    pairs = pairs.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[word_hashes(F.col(source)).alias(name) for name, source in named.items()]
    )
    sketched = pairs.withColumns({name: sketch(F.col(name)) for name in named})
    return sketched.select(
        key,
        "n_chars",
        "edited_sha256",
        rendered(F.col("_own")).alias("fingerprint"),
        rendered(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_edited")).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_next")).alias("near_next"),
        containment(F.col("_own"), F.col("_edited")).alias("kept_part"),
        distinct_shingles(F.col("_own")).alias("shingles"),
    )
