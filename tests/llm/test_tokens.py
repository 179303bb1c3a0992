import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_codec, packing, token_count, vocab
from .conftest import AWKWARD

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _texts():
    rng = random.Random(3)
    pool = [chr(i) for i in [*range(0x250), *range(0x370, 0x530), 0x200B, 0x3000, 0x2028, 0x130, 0x1E9E, 0xFB01, 0x4E2D, 0x1F600, 0x301, 0x212B]] + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "aaaa"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    return made + [t or "" for _, t in AWKWARD] + ["ΣΑΣ ΑΣ", "ab" * 900, "a" * 3000, " " * 99, "aaa aaaa aaaaa"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_like_library(path):
    library, texts = Tokenizer.from_file(path), _texts()
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_count.count_texts(path, texts) == [len(i) for i in ids]
    assert bpe_codec.encode_texts(path, texts) == ids
    if path == WORD:
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(path, texts)] == ids
        assert [bpe_codec.decode_ids(path, i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_character(path):
    """Each code point between two letters and beside a digit, and random texts over all of Unicode."""
    rng = random.Random(9)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}a " for c in every[k : k + 500]) for k in range(0, len(every), 500)]
    texts += ["".join(f"1{c}'s" for c in every[k : k + 500]) for k in range(0, 0x20000, 500)]
    odd = sorted(map(chr, vocab.odd_characters("".join(every)))) if path == WORD else []
    texts += ["".join(rng.choices(every, k=20)) for _ in range(2000)] + ["".join(rng.choice([*odd[::97], *"ab1 '!\n<|"]) for _ in range(30)) for _ in range(1000 if odd else 0)]
    library = Tokenizer.from_file(path)
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_count.count_texts(path, texts) == [len(i) for i in ids]
    assert bpe_codec.encode_texts(path, texts) == ids
    if path == WORD:
        assert len(odd) > 10_000
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(path, texts)] == ids


def test_quick_words():
    """The spelled-out classes split as the pattern does: each code point up to U+FFFF between letters, digits and marks; the rest goes to the pattern."""
    voc, rng = vocab.load(WORD), random.Random(3)
    every = [chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}a1{c}'s'{c}!{c}" for c in every[k : k + 500]) for k in range(0, len(every), 500)] + ["".join(rng.choices([*every[:300], *"'stremvld "], k=40)) for _ in range(2000)]
    for text in texts:
        assert voc.quick.findall(text) == voc.pattern.findall(text)
    assert voc.words("a\U00010400b 1") == ["a\U00010428b", "1"] and vocab.load(BYTE).quick is None


def test_joined_pretokens(monkeypatch):
    """New pre-tokens go to the library as one text and come back each with its own ids."""
    texts = ["It's 12-fold!", "</w> a</w>b <|ENDOFTEXT|>", "it's\x85it\xa0s\u3000\x1c\x1fé", "ab" * 900]
    library, inner, calls = Tokenizer.from_file(WORD), packing._library(WORD)[0], []
    spy = type("Spy", (), {"encode_batch_fast": lambda self, some, **how: calls.append(len(some)) or inner.encode_batch_fast(some, **how)})()
    closing = packing._library(WORD)[1]
    monkeypatch.setattr(packing, "_library", lambda path: (spy, closing))
    monkeypatch.setattr(packing, "_known", {})
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(WORD, texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert calls == [1]


def test_trees_agree():
    voc, rng = vocab.load(WORD), random.Random(5)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [tuple(bpe_codec.encode_alone(voc, voc.symbols(w))) for w in words] == bpe_codec.encode_words(voc, words)


def test_queries(awkward, nothing):
    library = Tokenizer.from_file(BYTE)
    counts = token_count.token_counts(awkward, BYTE).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted((i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in AWKWARD)
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.codec_digest(awkward, WORD).collect()) == sorted(want)
    both = bpe_codec.decode(bpe_codec.encode(awkward, WORD), WORD).collect()
    assert sorted(hashlib.sha256(r.decoded.encode()).hexdigest() for r in both) == sorted(w[3] for w in want)
    for empty in (token_count.token_counts(nothing, BYTE), bpe_codec.codec_digest(nothing, WORD), packing.pack(nothing, WORD, 1)):
        assert empty.collect() == []


def test_packing(awkward):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(awkward, WORD, 1).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    by_doc = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in AWKWARD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        copies = sum(x == (i, t) for x in AWKWARD)
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in pieces)
        assert sum(r.length for r in pieces) == copies * len(ids)
        assert {(r.start, tuple(r.ids)) for r in pieces} == {(s, tuple(ids[s : s + n])) for s, n in zip(np.cumsum([0, *packing.decompose(len(ids))])[:-1].tolist(), packing.decompose(len(ids)), strict=True)}


def test_decompose():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        parts = packing.decompose(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and len(parts) == n // 2048 + bin(n % 2048).count("1")
    with pytest.raises(ValueError):
        packing.pack(None, WORD, 1, limit=1000)
