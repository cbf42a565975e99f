"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

The text is cut into pieces by the tokenizer's pattern; merges never cross a piece. Inside a piece, tokens are emitted
as soon as no later byte can change them. How many bytes that takes is computed from the merge list: a merge can only be
prevented by an earlier merge that takes part of its right side, which again hangs on a still earlier one further right.
The longest such chain bounds the lookahead, so a piece of any length is encoded in windows of fixed size.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: The pattern that cuts text into pieces (fixed by the tokenizer).
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The same for text of Latin-1 characters only, where the classes are short.
LATIN = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
ANY = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

BLOCK = 1 << 16
#: Pieces kept encoded per worker; the table is emptied when it is full.
CACHE = 1 << 18


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


_ID = (1 << 24) - 1
_NONE = 1 << 62


class Merges:
    """A byte-level BPE vocabulary: merge table over ids, bytes of each id and the sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.single = [vocab[letters[b]] for b in range(256)]
        self.special = special
        self.content = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.content |= {i: text.encode() for text, i in special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.coded = {pair: rank << 24 | new for pair, (rank, new) in self.pairs.items()}
        self.longest = max((len(c) for c in self.content.values()), default=1)
        self.lookahead = self._lookahead()

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        return cls(data["model"]["vocab"], merges, {t["content"]: t["id"] for t in data["added_tokens"]})

    def _lookahead(self) -> int:
        """Bytes after a token that can decide it.

        reach(a, b) = bytes of b, plus the longest reach of an earlier merge (c, d) where c is b or a right end of b
        that has not yet been taken up in b. Ranks fall along the chain, so ascending ranks see all they need.
        """
        made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right of the merge that makes it
        best: dict[int, tuple[list[int], list[int]]] = {}  # left token: ranks, longest reach up to each
        most = 0
        for (a, b), (rank, new) in self.pairs.items():
            token, limit, further = b, rank, 0
            while True:
                ranks, reach = best.get(token, ((), ()))
                if at := bisect.bisect_left(ranks, limit):
                    further = max(further, reach[at - 1])
                if token not in made:
                    break
                limit, token = made[token][0], made[token][2]
            here = len(self.content[b]) + further
            ranks, reach = best.setdefault(a, ([], []))
            ranks.append(rank)
            reach.append(max(here, reach[-1] if reach else 0))
            made.setdefault(new, (rank, a, b))
            most = max(most, here)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of a byte string taken as a whole."""
        ids, code = [self.single[b] for b in data], self.coded.get
        if len(ids) > 64:
            return self._merge_long(ids)
        # For each neighbouring pair its rank and what it becomes, in one number; none: the largest.
        found = [code(pair, _NONE) for pair in zip(ids, ids[1:])]
        while found and (least := min(found)) != _NONE:
            at = found.index(least)
            ids[at : at + 2] = [least & _ID]
            del found[at]
            if at:
                found[at - 1] = code((ids[at - 1], ids[at]), _NONE)
            if at < len(found):
                found[at] = code((ids[at], ids[at + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j], after[i] = pairs[p][1], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := (ids[x], ids[y])) in pairs:
                    heapq.heappush(heap, (pairs[q][0], x, q))
        return [x for x in ids if x is not None]

    def stream(self, data: bytes) -> Iterator[int]:
        """Ids of a byte string of any length, emitted once they are stable, through a window of fixed size."""
        window, at = 2 * self.lookahead + 2 * self.longest, 0
        if len(data) <= window:
            yield from self.merge(data)
            return
        while at < len(data):
            ids = self.merge(data[at : at + window])
            if at + window >= len(data):
                yield from ids
                return
            end = 0
            for i in ids:
                if end + len(self.content[i]) > window - self.lookahead:
                    break
                end += len(self.content[i])
                yield i
            at += end


def cut(text: str) -> list[str]:
    """Pieces of a text without special tokens."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY.findall(text)
    return LATIN.findall(text)


def pieces(text: str, special: tuple[str, ...]) -> Iterator[list[str]]:
    """Lists of pieces, block by block; a special token is a piece of its own.

    A block's last pieces are held back while further characters, or a special token that has begun, can change them.
    """
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    held, at, size = "", 0, BLOCK
    while at < len(text):
        buffer, at = held + text[at : at + size], min(len(text), at + size)
        parts = marks.split(buffer) if marks else [buffer]
        for i, part in enumerate(parts[:-1]):
            yield [part] if i % 2 else cut(part)
        tail = parts[-1]
        if at >= len(text):
            yield cut(tail)
            return
        limit = len(tail) - 4
        for mark in special:
            for n in range(min(len(mark) - 1, len(tail)), 0, -1):
                if tail.endswith(mark[:n]):
                    limit = min(limit, len(tail[: len(tail) - n].rstrip()) - 1)
                    break
        found, end, keep = cut(tail), 0, 0
        for n, piece in enumerate(found):
            if end > limit:
                break
            keep, start = n, end
            end += len(piece)
        held = tail[start:] if keep else tail
        size = BLOCK if keep else 2 * size  # one long piece: read on in growing steps
        yield found[:keep]


class Encoder(dict):
    """Ids of a piece as decimal text, kept for the pieces seen lately."""

    def __init__(self, merges: Merges):
        super().__init__({text: str(i) for text, i in merges.special.items()})
        self.merges, self.special = merges, tuple(merges.special)

    def __missing__(self, piece: str) -> str:
        ids = ",".join(map(str, self.merges.stream(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
                self.update({text: str(i) for text, i in self.merges.special.items()})
            self[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[str]:
        """Comma-joined ids, block by block."""
        for block in pieces(text, self.special):
            if block:
                yield ",".join(map(self.__getitem__, block))


class Decoder:
    """Byte-to-text state machine: takes ids in any portions and gives the characters that are complete."""

    def __init__(self, content: dict[str, bytes]):
        self.content, self.state = content, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[str], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.content.__getitem__, ids)), last)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Encode and decode every text with the tokenizer file at ``path``.

    Returns ``<key>, n_tokens, ids_sha256, decoded_sha256``: digests of the decimal ids joined by commas and of the
    decoded text in UTF-8; ``with_text`` adds ``ids`` (array) and ``decoded``. A null text is empty and has no token. The
    strings of special tokens in a text are those tokens. Other columns are ignored; repeated rows are repeated. Each row
    is worked on alone: no shuffle, and the only state kept between rows is a bounded table of encoded pieces.
    """
    model = docs.sparkSession.sparkContext.broadcast(Merges.load(path))
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_text:
        fields += ", ids array<int>, decoded string"

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model.value)
        content = {str(i): c for i, c in model.value.content.items()}
        for batch in batches:
            rows = []
            for value in batch:
                count, first, ids_hash, text_hash = 0, True, hashlib.sha256(), hashlib.sha256()
                decoder, all_ids, decoded = Decoder(content), [], []
                for block in encoder.encode(value or ""):
                    ids_hash.update((block if first else "," + block).encode())
                    ids, first = block.split(","), False
                    count += len(ids)
                    out = decoder.feed(ids)
                    text_hash.update(out.encode())
                    if with_text:
                        all_ids += map(int, ids)
                        decoded.append(out)
                out = decoder.feed([], last=True)
                text_hash.update(out.encode())
                row = (count, ids_hash.hexdigest(), text_hash.hexdigest())
                rows.append((*row, all_ids, "".join(decoded) + out) if with_text else row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    coded = F.pandas_udf(work, fields)
    return docs.select(F.col(key), coded(F.col(text).cast("string")).alias("_coded")).select(key, "_coded.*")
