"""Runs of repeated word sequences: stretches of a text that keep one period over and over.

Found by internal pattern matching. A run of period q holds, in its first words, an aligned block of 2^j words that comes
again q words later. So for every j the aligned blocks look for their next occurrences in a window of twice their length:
all occurrences of a block are one interval of the suffix array, and a wavelet tree over that array gives the first
one behind a given place (range successor). Occurrences that overlap by half stand in an arithmetic progression; its
ends say which periods come into question, without looking at its members. Each candidate is then extended word by word
to both sides, which gives the run exactly.

Texts are worked on in batches of whole documents; words are numbered per document, so nothing matches between two of them.
Documents in which no eight words in a row come twice have no run and leave before the suffix array is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tideledger.llm.common import mixed

#: Words of a run at least, repetitions of its period at least, words of the smallest block.
LENGTH, TIMES, BLOCK = 24, 3, 8
#: Words that are worked on together; a longer document is a batch of its own.
BATCH = 300_000
#: Pairs of words compared at once when candidates are extended.
_AT_ONCE = 1 << 18


class WaveletTree:
    """Counts and successors among the values of any slice of a row of non-negative integers; one bit per value and level."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, int(values.max()).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.words.append(packed)
            self.ones.append(before)
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << low) - np.uint64(1)))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each slice are smaller than its bound."""
        found, lo, hi = np.zeros(len(lo), np.int64), lo.copy(), hi.copy()
        for level in range(self.bits):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            found += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return np.where(bound >= 1 << self.bits, hi - lo + found, found)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each slice."""
        value, lo, hi, k = np.zeros(len(lo), np.int64), lo.copy(), hi.copy(), k.copy()
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            zeros = (hi - b) - (lo - a)
            one = k >= zeros
            value = value * 2 + one
            k = np.where(one, k - zeros, k)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
        """The smallest value of each slice that is at least ``at``; ``none`` where there isn't one."""
        rank = np.where(at >= 1 << self.bits, hi - lo, self.below(lo, hi, np.minimum(at, (1 << self.bits) - 1)))
        found = np.full(len(lo), none, np.int64)
        some = rank < hi - lo
        found[some] = self.smallest(lo[some], hi[some], rank[some])
        return found


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by prefix doubling, and for each one j such that it differs from the one before it in its first
    2^j symbols, but not in its first 2^(j-1)."""
    n = len(symbols)
    name = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(name, kind="stable")
    apart = np.full(n, 127, np.int8)
    apart[0] = 0
    step, level = 1, 0
    while True:
        new = name[order[1:]] != name[order[:-1]]
        apart[1:][new & (apart[1:] == 127)] = level
        if new.all():
            return order, apart
        behind = np.zeros(n, np.int64)
        behind[: n - step] = name[step:] + 1
        # Only suffixes that are not told apart yet are sorted again, in their places.
        edge = np.concatenate([[True], new, [True]])
        places = np.nonzero(~(edge[:-1] & edge[1:]))[0]
        tied = order[places]
        order[places] = tied[np.lexsort((behind[tied], name[tied]))]
        changed = np.concatenate([[True], (name[order[1:]] != name[order[:-1]]) | (behind[order[1:]] != behind[order[:-1]])])
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(changed) - 1
        name, step, level = fresh, step * 2, level + 1


def _agreeing(symbols: np.ndarray, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from x on equal those from y on (x < y); ``back``: how many before x equal those before y."""
    n, total, active, width = len(symbols), np.zeros(len(x), np.int64), np.arange(len(x)), 16
    while len(active):
        width = min(2 * width, max(16, _AT_ONCE // len(active)))
        at, stride = total[active], np.arange(width)
        if back:
            a, b = (x[active] - 1 - at)[:, None] - stride, (y[active] - 1 - at)[:, None] - stride
            inside = a >= 0
        else:
            a, b = (x[active] + at)[:, None] + stride, (y[active] + at)[:, None] + stride
            inside = b < n
        same = inside & (symbols[np.clip(a, 0, n - 1)] == symbols[np.clip(b, 0, n - 1)])
        reach = np.where(same.all(axis=1), width, same.argmin(axis=1))
        total[active] += reach
        active = active[reach == width]
    return total


def _stretches(symbols: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the longest stretch around ``at`` that keeps the period; one pass over the symbols for each period."""
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for d in np.unique(period):
        mine = np.nonzero(period == d)[0]
        breaks = np.nonzero(symbols[:-d] != symbols[d:])[0]
        behind = np.searchsorted(breaks, at[mine])
        left[mine] = np.concatenate([[0], breaks + 1])[behind]
        right[mine] = np.concatenate([breaks, [len(symbols) - d]])[behind] + d
    return left, right


def _chain_ends(at: np.ndarray, period: np.ndarray, block: int) -> np.ndarray:
    """Of candidates (block, period) one for each chain of neighbouring blocks with one period: the others are in its run."""
    order = np.lexsort((at, period))
    a, p = at[order], period[order]
    first = np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] - a[:-1] > block)])
    return order[first]


def candidates(symbols: np.ndarray, longest: int, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that every run of at least 24 symbols and ``times`` (3 or more) periods shows at one place."""
    n = len(symbols)
    order, apart = suffix_array(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tree = WaveletTree(order)
    xs, ps = [], []
    block, level = BLOCK, BLOCK.bit_length() - 1
    while block * times <= max(longest, times * BLOCK) and block <= n:
        at = np.arange(0, n - block + 1, block)
        # Suffixes that share their first 2^level symbols are neighbours; a group starts where they were told apart.
        starts = np.nonzero(apart <= level)[0]
        group = np.searchsorted(starts, place[at], side="right") - 1
        lo = starts[group]
        hi = np.concatenate([starts, [n]])[group + 1]
        kept = hi - lo > 1
        at, lo, hi = at[kept], lo[kept], hi[kept]
        end = at + 2 * block
        seek = at + (1 if block == BLOCK else block)
        found = tree.successor(lo, hi, seek, 2 * n)
        x_level, p_level = [], []
        while True:
            live = found < end
            at, lo, hi, end, found = at[live], lo[live], hi[live], end[live], found[live]
            if not len(at):
                break
            x_level.append(at)
            p_level.append(found - at)
            following = tree.successor(lo, hi, found + 1, 2 * n)
            step = following - found
            dense = np.nonzero((step <= block // 2) & (following < end))[0]
            if len(dense):
                # A progression of difference d lies in a stretch of period d. Either the block lies in it too, or
                # the period looked for takes one end of the block's own stretch to the end of this one.
                d, b, f = step[dense], at[dense], found[dense]
                own, far = _stretches(symbols, b, d), _stretches(symbols, f, d)
                far_right = far[1]
                for p in (far[0] - own[0], far[1] - own[1]):
                    fit = (p > 0) & (p < 2 * block) & (b + p + block <= n)
                    there = place[np.where(fit, b + p, 0)]
                    fit &= (there >= lo[dense]) & (there < hi[dense])
                    x_level.append(b[fit])
                    p_level.append(p[fit])
                last = f + (far_right - block - f) // d * d
                following[dense] = tree.successor(lo[dense], hi[dense], last + 1, 2 * n)
            found = following
        if x_level:
            x, p = np.concatenate(x_level), np.concatenate(p_level)
            ends = _chain_ends(x, p, block)
            xs.append(x[ends])
            ps.append(p[ends])
        block, level = block * 2, level + 1
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(xs), np.concatenate(ps)


def runs(symbols: np.ndarray, longest: int | None = None, length: int = LENGTH, times: int = TIMES) -> np.ndarray:
    """Start, length and period of every run, by start and period: at least ``max(length, times * period)`` symbols with
    that smallest period that no neighbour continues. ``length`` is 24 or more and ``times`` 3 or more."""
    if length < 3 * BLOCK or times < TIMES:
        raise ValueError(f"Runs have {3 * BLOCK} symbols and {TIMES} periods at least")
    if len(symbols) < length:
        return np.zeros((0, 3), np.int64)
    at, period = candidates(symbols, longest or len(symbols))
    start = at - _agreeing(symbols, at, at + period, back=True)
    size = at + period + _agreeing(symbols, at, at + period) - start
    fit = size >= np.maximum(length, times * period)
    found = np.unique(np.stack([start[fit], size[fit], period[fit]], axis=1), axis=0)
    if len(found):  # multiples of a period cover the same stretch
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _suspects(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which documents of a batch have a block of eight words twice; by hashes, so a few more may be among them."""
    n = len(symbols) - BLOCK + 1
    suspect = np.zeros(len(sizes), bool)
    if n < 1:
        return suspect
    hashes = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BLOCK):
            hashes = hashes * np.uint64(0xD1342543DE82EF95) + symbols[i : i + n].astype(np.uint64)
    hashes = mixed(hashes)
    order = np.argsort(hashes)
    again = order[1:][hashes[order[1:]] == hashes[order[:-1]]]
    suspect[np.searchsorted(np.cumsum(sizes), again, side="right")] = True
    return suspect


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each document, given as its words' numbers; all of them in one suffix array."""
    sizes = np.array([len(d) for d in documents], np.int64)
    found = [np.zeros((0, 3), np.int64) for _ in documents]
    bases = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # no two documents share a number
    joined = np.concatenate([d + base for d, base in zip(documents, bases)]) if len(documents) else np.zeros(0, np.int64)
    chosen = np.nonzero(_suspects(joined, sizes) & (sizes >= LENGTH))[0]
    if not len(chosen):
        return found
    # A symbol of its own closes every document, so that no block reaches into the next one.
    parts = [np.concatenate([documents[i] + bases[i], [bases[i] + sizes[i]]]) for i in chosen]
    heads = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    every = runs(np.concatenate(parts), int(sizes[chosen].max()))
    owner = np.searchsorted(heads, every[:, 0], side="right") - 1
    for k in np.unique(owner):
        mine = every[owner == k].copy()
        mine[:, 0] -= heads[k]
        found[chosen[k]] = mine
    return found


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by single spaces, of each run only its first period."""
    if not len(found):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.nonzero(np.cumsum(depth)[:-1] == 0)[0]])


def _row(words: list[bytes], found: np.ndarray) -> tuple:
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    best = min(found.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest()


_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", again: tuple[Column, Column] | None = None) -> DataFrame:
    """The runs of each text.

    ``<key>, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs``: the run with the greatest
    length over period (ties: smallest start, then period; nulls without a run), digests of all runs and of the text
    without repetitions, and the runs as ``array<struct<start, length, period>>``. One row for each row of ``docs``, null
    keys and repeated rows too; null, empty and short texts have no run. ``again`` repeats parts of a text before: from word
    ``a`` (``least(a, n - 1)`` is taken) on, its next ``p`` words come over and over, as (a, p) in words; null leaves a text as it
    is. Words are compared byte by byte. Other columns are ignored; an empty table gives an empty result.
    """
    first, period = again or (F.lit(None), F.lit(None))
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), first.cast("long").alias("_a"), period.cast("long").alias("_p"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, documents, symbols, held = [], [], [], 0
            for doc, content, a, p in zip(batch["_key"], batch["_text"], batch["_a"], batch["_p"]):
                words = content.encode("utf-8", "surrogatepass").split() if isinstance(content, str) else []
                if words and pd.notna(a):
                    a, p = min(int(a), len(words) - 1), max(1, int(p))
                    words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
                numbers: dict[bytes, int] = {}
                own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                if held and held + len(own) > BATCH:
                    yield _table(keys, documents, symbols, schema)
                    keys, documents, symbols, held = [], [], [], 0
                keys.append(doc)
                documents.append(words)
                symbols.append(own)
                held += len(own)
            if keys:
                yield _table(keys, documents, symbols, schema)

    kind = dict(chosen.dtypes)["_key"]
    schema = f"_key {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"
    return chosen.mapInPandas(work, schema).withColumnRenamed("_key", key)


def _table(keys: list, documents: list[list[bytes]], symbols: list[np.ndarray], schema: str) -> pd.DataFrame:
    found = runs_of(symbols)
    rows = [_row(words, f) for words, f in zip(documents, found)]
    frame = pd.DataFrame(rows, columns=_NAMES)
    frame = frame.astype({c: "Int64" for c in _NAMES[:5]})
    frame["runs"] = [[dict(zip(("start", "length", "period"), r)) for r in f.tolist()] for f in found]
    frame.insert(0, "_key", pd.Series(keys, dtype=object))
    return frame
