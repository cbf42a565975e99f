import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideledger.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab AB  \n\t'sltrevmd0123.,!?éßñ   日本語кот\x1c\x1f\x85½²Ⅷ​́😀"


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def texts(n):
    rng = random.Random(n)
    for i in range(n):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        yield text[:20] + "<|endoftext|>" + text[20:] + "<|endof" if i % 5 == 0 else text


@pytest.mark.parametrize("block", [5, 9, 33, 1 << 16])
def test_stream_equals_the_library(merges, library, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", block)
    encoder = bpe.Encoder(merges)
    content = {str(i): c for i, c in merges.content.items()}
    for text in texts(400):
        ids = ",".join(encoder.encode(text))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)), (text, block)
        decoder = bpe.Decoder(content)
        assert "".join(decoder.feed([i]) for i in ids.split(",") if i) + decoder.feed([], True) == text


def test_long_pieces_through_the_window(merges, library):
    rng = random.Random(3)
    for piece in ("a" * 5000, "ab" * 3000, "=-" * 2500, "".join(rng.choice("etaoinshr") for _ in range(8000)), "é" * 3000):
        assert list(merges.stream(piece.encode())) == library.encode(piece, add_special_tokens=False).ids


def test_lookahead_suffices_for_random_merge_lists():
    """On small alphabets, where chains are long: a token is final once ``lookahead`` bytes follow."""
    rng = random.Random(5)
    letters = bpe.byte_letters()
    for _ in range(60):
        vocab = {letters[b]: b for b in range(256)}
        alive, merges = [letters[ord(c)] for c in "abc"], []
        for _ in range(rng.randint(2, 14)):
            a, b = rng.choice(alive), rng.choice(alive)
            if a + b not in vocab and len(a + b) < 9:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
                alive.append(a + b)
        model = bpe.Merges(vocab, merges, {})
        for _ in range(20):
            data = "".join(rng.choice("abc") for _ in range(rng.randint(1, 400))).encode()
            assert list(model.stream(data)) == model.merge(data)


def test_incomplete_bytes_decode_like_the_library(merges, library):
    rng = random.Random(8)
    content = {str(i): c for i, c in merges.content.items()}
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(12)]
        decoder = bpe.Decoder(content)
        got = "".join(decoder.feed([str(i)]) for i in ids) + decoder.feed([], True)
        assert got == library.decode(ids, skip_special_tokens=False)


def test_rows(documents, library):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "x" * 300_000), (5, "many words " * 20_000)]
    out = bpe.round_trip(documents(rows), FILE, with_text=True).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert by[key].n_tokens == len(ids) and by[key].ids == ids and by[key].decoded == (text or "")
        assert by[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(documents([]), FILE).count() == 0
