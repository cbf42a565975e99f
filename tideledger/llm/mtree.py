"""Exact top-k inner products by best-first search in M-trees.

Vectors of different length have no metric for their inner product, so each candidate gets one further component that
brings all to the same norm, and a query gets a zero there. Then d^2 = |q|^2 + M^2 - 2 q.x: the nearest candidates are
those with the highest products. Everything is integer up to the last bound, so results are exact.

Candidates are dealt to shards by pivots drawn from a bounded sample; each shard holds one M-tree of paged nodes: a
routing object, its covering radius, and for every member the distance to it. Queries are dealt in blocks, and a pair of
(block, shard) is one unit of work of bounded size. A node is opened only if its bound can still beat the k-th score,
and a member's product is computed only if |d(q, parent) - d(member, parent)| can.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tideledger.session import stage

#: Candidates of a shard, queries of a block, members of a page, and vectors drawn to choose the shards' pivots.
SHARD, BLOCK, PAGE, SAMPLE = 8192, 1024, 512, 2048


def digits(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``id, v``: components as floor(scale * x); rows with a null or non-finite component, or none, are left out."""
    kept = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(
        F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return kept.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector is padded with zeros, which leaves its products as they are."""
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


class Tree:
    """M-tree of one shard, built top down. ``points`` are integer vectors, ``ids`` their keys."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, page: int = PAGE):
        norms = (points.astype(object) ** 2).sum(axis=1) if len(points) and abs(points).max() > 2**26 else (points**2).sum(axis=1)
        self.points, self.ids, self.top = points, ids, int(max(norms, default=0))
        self.real = points.astype(float)  # exact, and fast, while products stay below 2^53
        # The further component that lifts every norm to the largest one; real numbers are used for bounds only.
        self.lifted = np.column_stack([points.astype(float), np.sqrt(np.array([self.top - int(n) for n in norms], float))]) if len(points) else np.zeros((0, 1))
        self.nodes: list[tuple] = []  # (routing vector, radius, distance to the parent's routing vector, children or None, members, their distances)
        self.page, self.root = page, None
        if len(points):
            self.root = self._grow(np.arange(len(points)), None)

    def _grow(self, at: np.ndarray, above: np.ndarray | None) -> int:
        center = self.lifted[at].mean(axis=0)
        far = np.sqrt(((self.lifted[at] - center) ** 2).sum(axis=1))
        step = 0.0 if above is None else float(np.sqrt(((center - above) ** 2).sum()))
        number = len(self.nodes)
        self.nodes.append(())
        children = None
        if len(at) > self.page and far.max() > 1e-9:
            # Up to eight routing objects far from each other; each member goes to the nearest.
            chosen = [at[far.argmax()]]
            near = np.sqrt(((self.lifted[at] - self.lifted[chosen[0]]) ** 2).sum(axis=1))
            sides = np.zeros(len(at), np.int64)
            for n in range(1, 8):
                if near.max() <= 1e-9:
                    break
                chosen.append(at[near.argmax()])
                other = np.sqrt(((self.lifted[at] - self.lifted[chosen[-1]]) ** 2).sum(axis=1))
                sides[other < near] = n
                near = np.minimum(near, other)
            children = [self._grow(at[sides == n], center) for n in range(len(chosen)) if (sides == n).any()]
        self.nodes[number] = (center, float(far.max()), step, children, at, far)
        return number

    def search(self, query: np.ndarray, own: int, best: list[tuple[int, int]], k: int) -> None:
        """Put the k best (score, -id) of this tree and ``best``, a heap with the worst first, into ``best``."""
        if self.root is None:
            return
        q = np.append(query.astype(float), 0.0)
        square = float((query.astype(float) ** 2).sum())
        slack = 1e-6 * (1.0 + square + self.top)
        real, exact = query.astype(float), square < 2.0**52 and self.top < 2.0**52  # so is every product, by Cauchy-Schwarz

        def highest(distance: float) -> float:
            """Upper bound of the score of anything at least so far away."""
            return (square + self.top - max(0.0, distance) ** 2) / 2 + slack

        def distance(number: int) -> float:
            return float(np.sqrt(((self.nodes[number][0] - q) ** 2).sum()))

        start = distance(self.root)
        queue = [(-highest(start - self.nodes[self.root][1]), self.root, start)]
        while queue:
            bound, number, here = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                return
            _, _, _, children, members, far = self.nodes[number]
            if children is None:
                if len(best) == k:  # stored distances say which members can matter
                    gap = np.abs(far - here)
                    members = members[(square + self.top - gap**2) / 2 + slack >= best[0][0]]
                if not len(members):
                    continue
                scores = self.real[members] @ real if exact else self.points[members] @ query
                if len(best) == k:  # an equal score can still win by its key
                    good = scores >= best[0][0]
                    scores, members = scores[good], members[good]
                order = np.lexsort((self.ids[members], -scores))
                taken = 0
                for i in order:
                    entry = (int(scores[i]), -int(self.ids[members[i]]))
                    if -entry[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    taken += 1
                    if taken == k:
                        break
                continue
            for child in children:
                _, radius, step, *_ = self.nodes[child]
                # Without a distance computed: no nearer than the gap of the two distances to this node, less the radius.
                if len(best) == k and highest(abs(here - step) - radius) < best[0][0]:
                    continue
                there = distance(child)
                heapq.heappush(queue, (-highest(there - radius), child, there))


def top_k(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query by integer inner product.

    Queries are the rows whose key is divisible by ``every``, candidates all rows with another key. Ties go to the
    smaller key; a query with fewer candidates gets all. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without a key. Vectors of unequal length are compared as if filled up with
    zeros. Repeated rows are candidates each; a repeated query (same key) counts once, with its smallest vector. Products
    are exact while they stay below 2^63. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = stage(digits(vectors.filter(F.col(key).isNotNull()), key, vector, scale))
    summary = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    total, width = summary["n"], summary["width"] or 1
    shards = max(1, ceil(total / shard))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, ceil(rows.filter(F.col("id") % every == 0).count() / block))
    drawn = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()  # bounded: pivots only steer balance
    sample = _matrix(pd.Series([r.v for r in drawn]), width).astype(float)
    pivots = spark.sparkContext.broadcast(sample[:: max(1, len(sample) // max(1, min(shards, len(sample))))][:shards])

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            own = _matrix(values, width).astype(float)
            far = (pivots.value**2).sum(axis=1)[None, :] - 2 * own @ pivots.value.T
            yield pd.Series(far.argmin(axis=1) if len(own) else np.zeros(0, int)).astype("int32")

    cell = F.pandas_udf(nearest, "int")
    placed = stage(rows.withColumn("cell", cell("v")))
    # A pivot with many vectors (copies of one, say) gets several shards of bounded size.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("parts"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most SAMPLE rows
    sizes = stage(sizes.withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int")))
    shards = sizes.agg(F.coalesce(F.sum("parts"), F.lit(1))).first()[0]
    homes = placed.join(F.broadcast(sizes), "cell").select(
        (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"), "id", "v"
    )
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # The stated query set against all rows, in blocks: each pair of (shard, block) is one unit of work.
    left = homes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1))))

    def work(keys, own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(_matrix(own["v"], width), own["id"].to_numpy(np.int64))
        found = []
        for q, v in zip(questions["id"], _matrix(questions["v"], width)):
            best: list[tuple[int, int]] = []
            tree.search(v, int(q), best, k)
            found += [(int(q), -i, s) for s, i in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    partial = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(work, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
