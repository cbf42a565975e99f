"""SimHash near-duplicates, linked exactly by vantage-point trees over Hamming space.

A node of the tree holds a fingerprint, its vantage point, and a distance m. Fingerprints with distance up to
m + radius - 1 go left, those with distance m or more go right. If two fingerprints differ in at most ``radius`` bits,
their distances to the vantage point differ by no more (triangle inequality), so they meet on one side at least: every
link is found in some leaf. The top of the tree, built from a bounded sample, deals the fingerprints to shards; each
shard continues the tree in memory down to small leaves, where all distances are computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tideledger.llm.components import components
from tideledger.session import stage

#: Fingerprints drawn to choose the vantage points of the top tree. Which are drawn affects balance, never the result.
SAMPLE = 4096
#: Fingerprints that a shard should hold, and a leaf inside a shard.
SHARD, LEAF = 20_000, 400


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if len(words) else 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for start in range(0, total, 65536):  # a long text in portions
        part = words[start : start + 65536 + shingle - 1]
        hashes = np.array([digest(join(w), 42) for w in zip(*[part[i:] for i in range(shingle)])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """``<key>, fp`` per row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    hashed = F.pandas_udf(work, "bigint")
    return docs.select(F.col(key), hashed(F.col(text).cast("string")).alias("fp"))


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """A vantage point and distance that divide the points best, with both sides; None if no division helps."""
    best = None
    for vantage in points[:: max(1, len(points) // 6)][:6]:
        far = np.bitwise_count(points ^ vantage)
        for m in np.unique(np.quantile(far, (0.4, 0.5, 0.6)).astype(np.int64)):
            left, right = far <= m + radius - 1, far >= m
            worst = max(left.sum(), right.sum())
            if best is None or worst < best[0]:
                best = worst, vantage, int(m), left, right
    if best is None or best[0] > 0.9 * len(points):
        return None
    return best[1:]


def plant(sample: np.ndarray, depth: int, radius: int) -> list:
    """Top of the tree as nested [vantage, m, left, right]; a leaf is its number."""
    count = iter(range(1 << 30))

    def grow(points: np.ndarray, level: int):
        parts = _split(points, radius) if level and len(points) > 8 else None
        if parts is None:
            return next(count)
        vantage, m, left, right = parts
        return [int(vantage), m, grow(points[left], level - 1), grow(points[right], level - 1)]

    return grow(sample, depth)


def _deal(tree, points: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of its points) for a batch."""
    if not len(at):
        return
    if isinstance(tree, int):
        yield tree, at
        return
    far = np.bitwise_count(points[at] ^ np.uint64(tree[0]))
    yield from _deal(tree[2], points, at[far <= tree[1] + radius - 1], radius)
    yield from _deal(tree[3], points, at[far >= tree[1]], radius)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of nodes, with the paths of all nodes shortened."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent[x]
        parent[:] = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _find(parent, i), _find(parent, j)
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def link(points: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """For sorted distinct points the position of the smallest point of each one's component within the radius.

    Only the components leave a shard, so a dense cluster costs its distances but not a row per pair.
    """
    parent = np.arange(len(points))
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        own = points[at]
        parts = _split(own, radius) if len(at) > leaf else None
        if parts is not None:
            stack += [at[parts[2]], at[parts[3]]]
            continue
        for start in range(0, len(at), 512):
            near = np.bitwise_count(own[start : start + 512, None] ^ own[None, start:]) <= radius
            i, j = np.nonzero(near)
            keep = i < j
            _unite(parent, at[start + i[keep]], at[start + j[keep]])
    return _find(parent, np.arange(len(points)))


def near_links(classes: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, distinct) within ``radius`` bits of each other.

    Per shard each point is linked to the smallest point of its component there, so there are fewer edges than points.
    """
    spark, total = classes.sparkSession, classes.count()
    drawn = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()  # bounded: only to choose vantage points
    depth = max(0, math.ceil(math.log(max(1, total / shard)) / math.log(1 / 0.6)))
    tree = spark.sparkContext.broadcast(plant(np.array([r.fp for r in drawn], dtype=np.int64).view(np.uint64), depth, radius))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for number, at in _deal(tree.value, points, np.arange(len(points)), radius):
                yield pd.DataFrame({"shard": number, "fp": points[at].view(np.int64)})

    def join(batch: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(batch["fp"].to_numpy(np.int64).view(np.uint64))
        roots = link(points, radius)
        other = roots != np.arange(len(points))
        return pd.DataFrame({"a": points[other].view(np.int64), "b": points[roots[other]].view(np.int64)})

    dealt = classes.select("fp").mapInPandas(deal, "shard int, fp bigint")
    return dealt.groupBy("shard").applyInPandas(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``<key>, fingerprint, component_id`` per row: texts whose fingerprints are linked by steps of ``radius`` bits.

    ``component_id`` is the smallest key of the component; null keys are ignored for it, and it is null if a component
    has no other. A null text counts as empty, with fingerprint zero, and is linked like any other. Equal fingerprints
    are one class, so copies are never expanded into pairs. Repeated rows get the same result each; other columns are
    ignored; an empty table gives an empty result.
    """
    marked = stage(fingerprints(docs, key, text, shingle))
    classes = stage(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(near_links(classes, radius), "a", "b")
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = stage(joined)
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
