"""Language-model scoring with a hierarchical Pitman-Yor model sampled by Gibbs.

Words are dishes. Every word that follows a context is a customer in that context's restaurant; every table there is a
customer of the root restaurant that all contexts share as parent, whose own base knows the training words and one slot
for all others. Contexts are the start of a text and every word of the training texts, so restaurants are as many as words.

A cell is a word in a context. One customer sits at one table, so cells of one customer are counted once and never drawn
again; only cells of more are state. Seats of one dish depend on other dishes through its contexts' totals only. Cells are
therefore dealt to tasks by word, with the totals of their contexts joined to them; each sweep redraws the tables of every
dish in every restaurant from their conditional (generalised Stirling numbers), and totals are summed by context between
rounds, which go on from the seats of the round before. Draws come from a hash of (dish, restaurant, sweep), so a repeated
task draws the same. Several samples are kept; each is a normalised model, and their predictive probabilities are averaged.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideledger.llm.common import checked, mixed
from tideledger.session import stage

#: Contexts whose totals are sent to every task, besides the start of a text: they hold the most cells, so a join by context
#: would give them one task each. All others are joined.
FREQUENT = 30
#: Cells whose probabilities are sent to every task (a fixed bound); the others are scored by a join.
HOT = 1 << 19
#: Strengths of root and contexts, and the part of the base that belongs to words not seen in training.
STRENGTH, UNSEEN = (1.0, 1.0), 0.9
#: Rounds with new totals, sweeps of a round, and samples kept after one more round's sweeps.
ROUNDS, SWEEPS, SAMPLES = 2, 2, 3
#: Customers of one dish up to which tables are drawn exactly; further ones are seated in blocks.
EXACT = 160
#: The context at the start of a text.
START = 0
_END = b"\n"  # a line break is no word, so it can stand for the end
#: Tokens that are counted at once, bytes of text that are split at once, and rows of dishes that are seated at once.
_FLUSH, _BYTES, _ROWS = 2_000_000, 1 << 21, 200_000

_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LETTER = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64))
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z as small letters, then the end. ``_hashed`` gives the hashes of the same."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(_END)
    return words


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for the bytes of each word: the values of its letters times the powers of a factor, mixed."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()), _FACTOR)]))
        sums = np.add.reduceat(_LETTER[data[place + np.repeat(starts, lengths)]] * powers[place], first)
        return mixed(sums ^ mixed(lengths.astype(np.uint64))).view(np.int64)


_END_HASH = _word_hashes(np.frombuffer(_END, np.uint8), np.array([0]), np.array([1]))[0]


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each token behind it, word, word before) of portions of a column of texts."""
    if not len(column):
        return
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(at, at[row] + _BYTES, "right")) - 1)
        data, edges = every[at[row] : at[last]], at[row : last + 1] - at[row]
        word = np.concatenate([[False], ~_SPACE[data], [False]])  # a place before and one behind
        begins = np.zeros(len(data) + 1, bool)
        begins[edges] = True
        starts = np.nonzero(word[1:-1] & (~word[:-2] | begins[:-1]))[0]
        ends = np.nonzero(word[1:-1] & (~word[2:] | begins[1:]))[0] + 1
        of = np.searchsorted(edges, starts, "right") - 1
        count = last - row
        words = np.full(len(starts) + count, _END_HASH)
        words[np.arange(len(starts)) + of] = _word_hashes(data, starts, ends)
        sizes = np.bincount(of, minlength=count) + 1
        before = np.concatenate([[START], words[:-1]])
        before[np.cumsum(sizes) - sizes] = START
        yield row, np.repeat(np.arange(count), sizes), words, before
        row = last


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places in sorted columns at which another group begins."""
    changed = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.nonzero(np.concatenate([[True], changed]))[0]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (word, context), of a bounded number of tokens at once."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        w, u = (np.concatenate(parts) for parts in zip(*held))
        order = np.lexsort((u, w))
        w, u = w[order], u[order]
        heads = _heads(w, u)
        return pa.RecordBatch.from_pydict({"w": w[heads], "u": u[heads], "n": np.diff(np.append(heads, len(w)))})

    for batch in batches:
        for _, _, words, before in _hashed(batch.column("text")):
            held.append((words, before))
            size += len(words)
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


@lru_cache(maxsize=4)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: weight of all seatings of c customers at t tables, S[c+1, t] = S[c, t-1] + (c - t d) S[c, t]."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + table[c]
            come = np.concatenate([[-np.inf], table[c, :-1]])
            table[c + 1] = np.logaddexp(stay, come)
    return table


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, uniform: np.ndarray) -> np.ndarray:
    """Tables of each dish given its customers: P(t) proportional to S[c, t] weight^t, by inversion."""
    tables = np.minimum(customers, 1).astype(np.int64)
    table, few = stirling(discount), np.minimum(customers, EXACT)
    order = np.argsort(few, kind="stable")
    edges = np.nonzero(np.diff(few[order]))[0] + 1
    for at in np.split(order, edges):
        if not len(at):
            continue
        c = int(few[at[0]])
        if c < 2:
            continue
        for part in np.array_split(at, max(1, len(at) * c // 1_000_000)):
            logs = table[c, 1 : c + 1][None, :] + np.log(weight[part])[:, None] * np.arange(1, c + 1)[None, :]
            chance = np.exp(logs - logs.max(axis=1, keepdims=True))
            reach = np.cumsum(chance, axis=1)
            tables[part] = 1 + (reach < uniform[part, None] * reach[:, -1:]).sum(axis=1).clip(max=c - 1)
    many = np.nonzero(customers > EXACT)[0]
    seated, shift = np.full(len(many), float(EXACT)), 0.0
    while len(many):
        b, t = weight[many], tables[many]
        block = np.minimum(np.maximum(1.0, np.floor(0.05 * (seated + b))), customers[many] - seated)
        shift += 0.6180339887498949
        new = np.minimum(np.floor(block * b / (b + seated - discount * t) + (uniform[many] + shift) % 1.0), block)
        tables[many] += new.astype(np.int64)
        seated = seated + block
        left = seated < customers[many]
        many, seated = many[left], seated[left]
    return tables


@dataclass
class Totals:
    """Customers of the root, which are the tables of all contexts, and tables of the root."""

    customers: float
    root: float


@dataclass
class Setting:
    discounts: tuple[float, float]  # root, contexts
    words: int

    def base(self) -> float:
        return (1 - UNSEEN) / max(1, self.words)

    def slack(self, totals: Totals) -> float:
        """What the root owes its base."""
        return STRENGTH[0] + self.discounts[0] * totals.root

    def unseen(self, totals: Totals) -> float:
        """The root's probability of all unseen words."""
        return self.slack(totals) * (UNSEEN if self.words else 1.0) / (STRENGTH[0] + totals.customers)


def sweeps(
    setting: Setting, totals: Totals, words: np.ndarray, ones: np.ndarray, root_t: np.ndarray,
    dish: np.ndarray, context: np.ndarray, tables: np.ndarray, count: np.ndarray, leaf: np.ndarray, numbers: range,
):
    """Yield after each sweep (tables of each cell, customers and tables of each dish at the root).

    Dishes have a hash, their cells of one customer, and tables at the root; cells have a dish, a context, the tables of that
    context, customers, and tables. ``numbers`` are those of the sweeps since the start.
    """
    seed, d, slack = mixed(words.view(np.uint64)), setting.discounts[0], setting.slack(totals)

    def customers() -> np.ndarray:
        return (ones + np.bincount(dish, weights=leaf, minlength=len(words))).astype(np.int64)

    def uniform(own: np.ndarray, place: np.ndarray, number: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = own ^ mixed(place + mixed(np.array([number], np.uint64)))
        return ((mixed(key) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53

    root_c = customers()
    for number in numbers:
        # The parent's view of a dish without the tables this restaurant has sent it.
        others = np.maximum(root_c[dish] - leaf - d * root_t[dish], 0.0)
        parent = (others + slack * setting.base()) / (STRENGTH[0] + totals.customers)
        weight = (STRENGTH[1] + setting.discounts[1] * tables) * parent
        leaf = draw_tables(count, weight, setting.discounts[1], uniform(seed[dish], context.view(np.uint64), number))
        root_c = customers()
        root_t = draw_tables(root_c, np.full(len(words), slack * setting.base()), d, uniform(seed, np.array([999], np.uint64), number))
        yield leaf, root_c, root_t


def _dishes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Portions of whole dishes, of rows sorted by word."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            w = table.column("w").to_numpy()
            cut = int(np.searchsorted(w, w[-1]))
            if cut:
                yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), len(table) - cut
            rows = max(rows, 2 * size)  # a dish of very many cells isn't copied again with every batch
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_context(rows: DataFrame, contexts: DataFrame, often: list[int]) -> DataFrame:
    """Inner join on the context, whose most frequent ones are sent to every task."""
    many = F.col("u").isin(often)
    return rows.filter(many).join(F.broadcast(contexts.filter(many)), "u").unionByName(rows.filter(~many).join(contexts.filter(~many), "u"))


def _swept(state: DataFrame, setting: Setting, totals: Totals, often: list[int], numbers: range, samples: int) -> DataFrame:
    """The state after the sweeps ``numbers``, with the seats of the last ``samples`` of them.

    A state has rows of dishes (``u`` null, ``n`` their cells of one customer, ``t`` customers and ``r`` tables at the root) and
    of cells (``n`` customers, ``t`` tables, ``ones`` the cells of one customer of their context).
    """
    cells, dishes = state.filter("u IS NOT NULL"), state.filter("u IS NULL")
    tables = checked(cells.groupBy("u").agg((F.max("ones") + F.sum("t0")).alias("tables")))
    dealt = _by_context(cells, tables, often).unionByName(dishes.withColumn("tables", F.lit(0).cast("bigint")))
    names = [f"{c}{i}" for i in range(samples) for c in "tr"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _dishes(batches, _ROWS):
            w, n, t, r, tables = (table.column(c).to_numpy() for c in ("w", "n", "t0", "r0", "tables"))
            cell = table.column("u").is_valid().to_numpy(zero_copy_only=False)
            dish = np.cumsum(np.concatenate([[False], w[1:] != w[:-1]]))
            own = np.nonzero(~cell)[0]  # one row a dish, in the dishes' order
            context = table.column("u").filter(pa.array(cell)).to_numpy()
            found = sweeps(setting, totals, w[own], n[own], r[own], dish[cell], context, tables[cell], n[cell], t[cell], numbers)
            out = {c: table.column(c) for c in ("w", "u", "n", "ones")}
            for i, (leaf, root_c, root_t) in enumerate(found, samples - len(numbers)):
                if i >= 0:
                    seats, roots = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
                    seats[cell], seats[own], roots[own] = leaf, root_c, root_t
                    out[f"t{i}"], out[f"r{i}"] = pa.chunked_array([seats]), pa.chunked_array([roots])
            yield from pa.table(out).combine_chunks().to_batches()

    fields = ", ".join(f"{c} bigint" for c in ("w", "u", "n", "ones", *names))
    return stage(dealt.repartition("w").sortWithinPartitions("w").mapInArrow(work, fields))


@dataclass
class Model:
    """Trained model of three tables, of ``w`` and ``u`` as hashes of words; the rest is small."""

    dishes: DataFrame  # w, n, roots (the root's probability per sample): one row per training word
    restaurants: DataFrame  # u, customers, shares (chance of the parent per sample): one row per context
    cells: DataFrame  # w, u, n, seated (customers less the discounts of their tables, averaged): one row per word and context
    often: list[int]  # contexts with most customers, the start of a text first
    shares: np.ndarray  # [context, sample] chance of the parent: at the start, in a context not seen in training, in ``often``
    unseen: np.ndarray  # [sample] the root's probability of all unseen words
    tokens: int
    words: int

    @property
    def table(self) -> DataFrame:
        """``w, n, roots, contexts, direct``: training words with their contexts, in which ``direct`` is the probability
        without the parent's part. Contexts that ``shares`` has are numbered as there."""
        direct = F.col("seated") / (STRENGTH[1] + F.col("customers"))
        numbers = F.create_map(*[F.lit(x).cast("bigint") for i, u in enumerate(self.often) for x in (u, i + 1 if i else 0)])
        cells = self.cells.join(self.restaurants, "u").select("w", F.struct(F.coalesce(numbers[F.col("u")], F.col("u")).alias("u"), direct.alias("p")).alias("c"))
        lists = cells.groupBy("w").agg(F.collect_list("c").alias("c"))
        return self.dishes.join(lists, "w").select("w", "n", "roots", F.col("c.u").alias("contexts"), F.col("c.p").alias("direct"))


def train(docs: DataFrame, text: str = "text") -> Model:
    """Train on all rows of ``docs``; a null text is an empty one."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    # Tasks count first; a hot cell is a row for each of their flushes.
    counts = texts.mapInArrow(_cells, "w bigint, u bigint, n bigint").repartition("w").groupBy("w", "u").agg(F.sum("n").alias("n"))
    cells = stage(counts.sortWithinPartitions("w"))
    one = F.sum((F.col("n") == 1).cast("bigint")).alias("ones")
    contexts = stage(cells.groupBy("u").agg(F.sum("n").alias("customers"), one))
    words = stage(cells.groupBy("w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), one))

    def number(what: Column | str) -> Column:
        return F.coalesce(F.sum(F.expr(what).cast("bigint") if isinstance(what, str) else what), F.lit(0))

    leaves = cells.agg(number("n"), number("n = 1"), number("n = 2"), F.count(F.lit(1))).first()
    kinds = words.agg(F.count(F.lit(1)), number("cells = 1"), number("cells = 2"), number("n = 1")).first()

    def discount(one: int, two: int) -> float:
        """From how many occur once and twice (as for Kneser-Ney), kept inside (0, 1)."""
        return round(min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5, 4)

    setting = Setting((discount(kinds[1], kinds[2]), discount(leaves[1], leaves[2])), kinds[0])
    frequent = contexts.filter(F.col("u") != START).orderBy(F.desc("customers"), "u").limit(FREQUENT).collect()
    often = [START, *[r.u for r in frequent]]
    # A word that occurs once has one table everywhere, so it isn't part of the state.
    nothing = F.lit(None).cast("bigint")
    lone, table = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    opened = _by_context(cells.filter("n > 1"), contexts.select("u", "ones"), often).select("w", "u", "n", "ones", table.alias("t0"), lone.alias("r0"))
    state = stage(opened.unionByName(words.filter("n > 1").select("w", nothing.alias("u"), F.col("ones").alias("n"), lone.alias("ones"), "cells", table.alias("r0")).withColumnRenamed("cells", "t0")))
    totals, done = Totals(float(leaves[3]), float(kinds[0])), 0
    for number_of, samples in [(SWEEPS, 1)] * ROUNDS + [(SWEEPS + SAMPLES, SAMPLES)]:
        state = _swept(state, setting, totals, often, range(done, done + number_of), samples)
        done += number_of
        sums = state.agg(*[number(F.when(F.col("u").isNull(), F.col(f"{c}{i}"))) for i in range(samples) for c in "tr"]).first()
        # Words outside the state have one customer and one table each.
        found = [Totals(float(sums[2 * i] + kinds[3]), float(sums[2 * i + 1] + kinds[3])) for i in range(samples)]
        totals = found[0]

    def root(totals: Totals, c: Column, t: Column) -> Column:
        d = setting.discounts[0]
        return (c - d * t + setting.slack(totals) * setting.base()) / (STRENGTH[0] + totals.customers)

    def share(i: int) -> Column:
        tables = F.col("ones") + F.coalesce(F.col(f"t{i}"), F.lit(0))
        return (STRENGTH[1] + setting.discounts[1] * tables) / (STRENGTH[1] + F.col("customers"))

    each = range(len(found))
    dishes = state.filter("u IS NULL").withColumn("roots", F.array(*[root(s, F.col(f"t{i}"), F.col(f"r{i}")) for i, s in enumerate(found)]))
    once = words.filter("n = 1").select("w", "n", F.array(*[root(s, F.lit(1), F.lit(1)) for s in found]).alias("roots"))
    seats = state.filter("u IS NOT NULL")
    tables = seats.groupBy("u").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in each])
    restaurants = stage(contexts.join(tables, "u", "left").select("u", "customers", F.array(*[share(i) for i in each]).alias("shares")))
    mean = reduce(Column.__add__, [F.col(f"t{i}") for i in each]) / len(found)
    seated = (F.col("n") - setting.discounts[1] * mean).alias("seated")
    known = {r.u: r.shares for r in restaurants.filter(F.col("u").isin(often)).collect()}
    empty = [1.0] * len(found)
    return Model(
        words.filter("n > 1").select("w", "n").join(dishes.select("w", "roots"), "w").unionByName(once),
        restaurants,
        cells.filter("n = 1").select("w", "u", "n", F.lit(1 - setting.discounts[1]).alias("seated")).unionByName(seats.select("w", "u", "n", seated)),
        often, np.array([known.get(START, empty), empty, *[known[u] for u in often[1:]]]),
        np.array([setting.unseen(s) for s in found]), int(leaves[0]), int(kinds[0]),
    )


def _key(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(w.view(np.uint64) ^ mixed(u.view(np.uint64)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: dict | None = None) -> DataFrame:
    """``<key>, n_tokens, n_known, train_tokens, base_score, score, perplexity`` per row, and the columns in ``keep``.

    ``score`` is the averaged model's log10 probability of the text's words and its end, ``base_score`` that of the
    add-one unigram model, ``n_known`` counts tokens seen in training. A null or empty text is its end alone. Words in contexts
    among the ``HOT`` most frequent cells are scored where the text is read; the others meet their probabilities in a join, one
    row per (text, word, context). Repeated rows are scored each; other columns are ignored; an empty table gives an empty
    result. Trained on nothing, every text has score 0.
    """
    spark: SparkSession = docs.sparkSession
    number = model.shares.shape[1]
    whole = float(model.tokens + model.words + 1)

    def parent(shares: Column, roots: Column) -> Column:
        return sum((F.get(shares, F.lit(i)) * F.get(roots, F.lit(i)) for i in range(number)), F.lit(0.0)) / number

    dishes = model.dishes.select("w", "roots", F.log10((F.col("n") + 1) / whole).alias("base"))
    chance = F.col("seated") / (STRENGTH[1] + F.col("customers")) + parent(F.col("shares"), F.col("roots"))
    cells = stage(_by_context(model.cells, model.restaurants, model.often).join(dishes, "w").select("w", "u", "n", F.log10(chance).alias("log"), "base"))
    # Cells above a count of which there are HOT at most.
    least, room = 0, HOT
    for r in cells.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        room -= r["count"]
        if room < 0:
            least = r["n"]
            break
    hot = cells.filter(F.col("n") > least).select("w", "u", "log", "base").toArrow()
    w, u, logs, bases = (hot.column(c).to_numpy() for c in ("w", "u", "log", "base"))
    order = np.argsort(_key(w, u), kind="stable")
    shared = spark.sparkContext.broadcast((_key(w, u)[order], w[order], u[order], logs[order], bases[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hot_w, hot_u, logs, bases = shared.value
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for first, row, words, before in _hashed(batch.column("text")):
                met = np.zeros(len(words), bool)
                count = int(row[-1]) + 1
                here, here_base = np.zeros(count), np.zeros(count)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, _key(words, before)), len(keys) - 1)
                    met = (hot_w[at] == words) & (hot_u[at] == before)
                    here = np.bincount(row[met], weights=logs[at[met]], minlength=count)
                    here_base = np.bincount(row[met], weights=bases[at[met]], minlength=count)
                # A row a text, with what was scored here, and one for each cell of it that wasn't.
                own = ids[first : first + count]
                none = pa.nulls(count, pa.int64())
                sizes = np.bincount(row, minlength=count)
                yield pa.RecordBatch.from_pydict({
                    "row": own, "w": none, "u": none, "times": sizes, "log": here.astype(float), "base": here_base.astype(float), "known": np.bincount(row[met], minlength=count),
                })
                row, words, before = row[~met], words[~met], before[~met]
                if len(row):
                    order = np.lexsort((before, words, row))
                    row, words, before = row[order], words[order], before[order]
                    heads = _heads(row, words, before)
                    times, zero = np.diff(np.append(heads, len(row))), np.zeros(len(heads))
                    yield pa.RecordBatch.from_pydict({
                        "row": own[row[heads]], "w": words[heads], "u": before[heads], "times": times, "log": zero, "base": zero, "known": zero.astype(np.int64),
                    })

    # Files and their splits decide the row number, so a repeated task gives the same.
    columns = {key: F.col(key)} | (keep or {})
    numbered = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(columns.values())], F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    read = stage(numbered.select("row", "text").mapInArrow(work, "row bigint, w bigint, u bigint, times bigint, log double, base double, known bigint"))
    here = read.filter("w IS NULL").select("row", F.col("times").alias("n_tokens"), "log", "base", "known")
    cold = read.filter("w IS NOT NULL").select("row", "w", "u", "times")
    met = cold.join(cells.filter(F.col("n") <= least).select("w", "u", "log", "base"), ["w", "u"], "left")
    strange = F.col("log").isNull()
    times = F.col("times")
    there = stage(
        met.groupBy("row").agg(
            F.sum(times * F.col("log")).alias("log"), F.sum(times * F.col("base")).alias("base"), F.sum(F.when(~strange, times)).alias("known"),
            F.collect_list(F.when(strange, F.struct("w", "u", "times"))).alias("strange"),
        )
    )
    # Words in contexts where training has not seen them: the parent's part alone.
    alone = there.select("row", F.inline("strange")).join(dishes, "w", "left").join(model.restaurants.select("u", "shares"), "u", "left")
    shares = F.coalesce("shares", F.array(*[F.lit(1.0)] * number))
    roots = F.coalesce("roots", F.array(*[F.lit(float(x)) for x in model.unseen]))
    parts = alone.select(
        "row", (times * F.log10(parent(shares, roots))).alias("log"), (times * F.coalesce("base", F.lit(-np.log10(whole)))).alias("base"),
        F.when(F.col("base").isNotNull(), times).otherwise(0).alias("known"),
    ).unionByName(there.drop("strange"))
    sums = parts.unionByName(here.drop("n_tokens")).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("log", "base", "known")])
    scored = numbered.drop("text").join(here.select("row", "n_tokens"), "row").join(sums, "row")
    return scored.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(columns)], "n_tokens", F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("log").alias("score"),
        F.pow(F.lit(10.0), -F.col("log") / F.col("n_tokens")).alias("perplexity"),
    )
