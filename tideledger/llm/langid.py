"""Language identification: script ranges narrow the candidates, a Viterbi path over words labels spans.

The model is counted from labelled texts: letter trigrams in a table of fixed size per language, and letters per script.
A word (a run of letters) scores each language by its trigrams; languages that hardly use the word's script are out. The
best path over a text's words pays a penalty for each change of language, so single odd words don't break a span. The
language with most letters on the path is the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Trigram table entries per language: with the number of languages this bounds the model.
SLOTS = 1 << 16
#: A language is a candidate for a script if at least this part of its letters are of it.
SHARE = 0.001
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: Characters worked on at once.
PORTION = 1 << 20
UNKNOWN = "und"

#: First code points of script ranges, with the script's name.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0 if it is no letter), and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            small = letter.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    starts = np.array([start for start, _ in SCRIPTS])
    numbers = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)
    return lower, numbers[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, script = _tables()
    return lower[codes], script[codes]


def _trigrams(letters: np.ndarray) -> np.ndarray:
    """Slot of the trigram around each letter; what is no letter counts as a gap."""
    padded = np.concatenate([[0], letters, [0]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mix = padded[:-2] * np.uint64(0x9E3779B1) + padded[1:-1] * np.uint64(0x85EBCA77) * np.uint64(31) + padded[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        mix ^= mix >> np.uint64(29)
        mix *= np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(48)).astype(np.int32)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Texts, or parts of long ones cut at a space, in lists of about PORTION characters (for counting only)."""
    held, size = [], 0
    for text in texts:
        at = 0
        while at < len(text):
            end = at + PORTION
            if end < len(text):
                end = max(text.rfind(" ", at, end), at) + 1 if text.rfind(" ", at, end) > at else end
            part = text[at:end]
            at = end
            held.append(part)
            size += len(part)
            if size >= PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    languages: list[str]  # sorted
    scores: np.ndarray  # [SLOTS, languages] log probability of a trigram
    open_: np.ndarray  # [scripts, languages] candidates; words of a script without any tell nothing
    common: int  # language of most training letters


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all rows with a text and a language. The driver gets one row per (language, used slot): bounded by SLOTS."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                own = totals.setdefault(name, np.zeros(SLOTS + len(NAMES), np.int64))
                for part in _portions(texts.tolist()):
                    letters, scripts = _letters("\n".join(part))
                    is_letter = letters > 0
                    own[:SLOTS] += np.bincount(_trigrams(letters)[is_letter], minlength=SLOTS)
                    own[SLOTS:] += np.bincount(scripts[is_letter], minlength=len(NAMES))
        for name, own in totals.items():
            used = np.nonzero(own)[0]
            yield pd.DataFrame({"lang": name, "slot": used.astype(np.int32), "n": own[used]})

    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    rows = labelled.mapInPandas(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((SLOTS + len(NAMES), max(1, len(languages))))
    counts[rows["slot"].to_numpy(int), rows["lang"].map({n: i for i, n in enumerate(languages)}).to_numpy(int)] = rows["n"].to_numpy(float)
    letters = counts[SLOTS:].sum(axis=0)
    used = (counts[:SLOTS].sum(axis=1) > 0).sum() + 1
    scores = np.log((counts[:SLOTS] + 0.5) / (letters + 0.5 * used))
    open_ = counts[SLOTS:] >= SHARE * np.maximum(letters, 1)
    return Model(languages, scores.astype(np.float32), open_, int(letters.argmax()))


def word_scores(model: Model, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and scores [words, languages] of the runs of letters of a text."""
    starts, ends, scores = [], [], []
    at = 0
    while at < len(text):
        end = min(len(text), at + PORTION)
        if end < len(text):  # cut behind a run of letters; a longer run is cut anyway
            cut = end
            while cut > at and text[cut - 1].isalpha():
                cut -= 1
            end = cut if cut > at else end
        letters, scripts = _letters(text[at:end])
        is_letter = letters > 0
        edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
        first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if len(first):
            where = np.nonzero(is_letter)[0]
            own = model.scores[_trigrams(letters)[where]]
            heads = np.concatenate([[0], np.cumsum(last - first)[:-1]])
            total = np.add.reduceat(own, heads, axis=0)
            allowed = model.open_[scripts[first]]
            total = np.where(allowed, total, np.float32(-1e6)) * allowed.any(axis=1, keepdims=True)
            starts.append(first + at)
            ends.append(last + at)
            scores.append(total)
        at = end
    if not starts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, max(1, len(model.languages))), np.float32)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(scores)


def paths(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best language of each word, for many texts at once: step t treats the t-th word of all texts that have one."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    steps = int(lengths[0]) if len(order) else 0
    if not steps:
        return [np.zeros(0, np.int64) for _ in scores]
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than t
    begin = np.concatenate([[0], np.cumsum(alive)])
    kinds = scores[0].shape[1]
    flat = np.empty((begin[-1], kinds), np.float32)  # words of step t side by side
    for place, i in enumerate(order):
        flat[begin[: lengths[place]] + place] = scores[i]
    stay = np.empty((begin[-1], kinds), bool)
    jump = np.empty(begin[-1], np.int16)
    value = flat[: alive[0]].astype(np.float64)
    last = np.zeros(len(order), np.int64)
    for t in range(1, steps):
        n = alive[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        best = value.argmax(axis=1)
        other = value[np.arange(n), best] - switch
        keep = value >= other[:, None]
        stay[begin[t] : begin[t] + n] = keep
        jump[begin[t] : begin[t] + n] = best
        value = np.where(keep, value, other[:, None]) + flat[begin[t] : begin[t] + n]
    last[: len(value)] = value.argmax(axis=1)
    labels = np.empty(begin[-1], np.int64)
    state = last.copy()
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        span = slice(begin[t], begin[t] + n)
        labels[span] = state[:n]
        if t:
            keep = stay[span][np.arange(n), state[:n]]
            state[:n] = np.where(keep, state[:n], jump[span])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for place, i in enumerate(order):
        out[i] = labels[begin[: lengths[place]] + place]
    return out


FIELDS = "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH, keep: list[str] | None = None) -> DataFrame:
    """``<key>, lang_pred, score, spans`` per row, and the columns named in ``keep``.

    ``lang_pred`` is the language with most letters on the best path (of equal ones the first by name), ``score`` their
    part of all letters (letters of a script that no
    language uses count for none), ``spans`` the runs of one language as character offsets, from its first word to its last. A
    null text, or one without a letter, has ``und``, score 0 and no span; so has every text if nothing was learned. Where
    no word tells languages apart, the language of most training letters is taken. Texts are read whole. Repeated rows
    get the same result each; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            for texts in _groups(batch):
                words = [word_scores(known, t) for t in texts] if known.languages else []
                found = paths([w[2] for w in words], switch)
                rows += [_row(known, *w[:2], w[2], p) for w, p in zip(words, found)] or [(UNKNOWN, 0.0, [])] * len(texts)
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    named = F.pandas_udf(label, FIELDS)
    columns = [c for c in keep or [] if c != key]
    return docs.select(key, *columns, named(F.col(text).cast("string")).alias("_found")).select(key, *columns, "_found.*")


def _groups(batch: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for text in batch:
        held.append(text or "")
        size += len(held[-1])
        if size >= 4 * PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _row(model: Model, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, path: np.ndarray) -> tuple:
    if not len(path):
        return UNKNOWN, 0.0, []
    told = scores.any(axis=1)  # words in a script that some language uses
    if told.any():
        letters = np.bincount(path, weights=(ends - starts) * told, minlength=len(model.languages))
        best = int(letters.argmax())
        share = float(letters[best] / (ends - starts).sum())
    else:
        best, share = model.common, 0.0
        path = np.full(len(path), best)
    heads = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1])
    tails = np.concatenate([heads[1:] - 1, [len(path) - 1]])
    spans = [(model.languages[path[h]], int(starts[h]), int(ends[t])) for h, t in zip(heads, tails)]
    return model.languages[best], share, spans
