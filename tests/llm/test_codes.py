import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import byte_codec, components as C, resample, vector_codes
from .conftest import AWKWARD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ------------------------------------------------------------ byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_codec_like_library(library):
    rng = random.Random(1)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    pool = " \t\n  'stmdrevlaB1é՘  !.-"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(5000)] + ["".join(rng.choices(every, k=30)) for _ in range(1500)]
    texts += [t or "" for _, t in AWKWARD] + ["", " ", "  ", "'", "'r", "'re", "a'", "\0\0a\0", " " * 99 + "a", "ab" * 3000, "a" * 4000, "it's we're 'Tis ''s \t's"]
    texts += ["".join(f"a{c}a " for c in every[k : k + 2000]) for k in range(0, len(every), 2000)]  # every code point between two letters
    ranks = byte_codec.load(RANKS)
    for text, (ids, offsets, decimals) in zip(texts, byte_codec.encode_texts(RANKS, texts), strict=True):
        want = library.encode_ordinary(text)
        assert ids.tolist() == want and decimals == " ".join(map(str, want))
        assert offsets.tolist() == np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in want)])[:-1].tolist() if want else not len(offsets)
        assert ranks.decode(ids, offsets) == ranks.decode(ids) == text.encode()


def test_scan_composes():
    own, then, led, _ = byte_codec.automaton()
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 101):
        f = own[rng.integers(0, len(own), n)]
        at, want = f[0], [f[0]]
        for g in f[1:]:
            at = then[at, g]
            want.append(at)
        assert byte_codec.scan(f, then).tolist() == want
    assert len({int(then[then[a, b], c]) == int(then[a, then[b, c]]) for a in range(len(then)) for b in range(len(then)) for c in range(len(then))}) == 1


def test_byte_codec_query(awkward, nothing, library):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = [(i or 0, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in AWKWARD]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_codec.codec_digest(awkward, RANKS).collect()) == sorted(want)
    both = byte_codec.decode(byte_codec.encode(awkward, RANKS), RANKS)
    assert sorted(sha(bytes(r.decoded)) for r in both.collect()) == sorted(w[3] for w in want)
    cut = byte_codec.decode(byte_codec.encode(awkward, RANKS).filter("doc_id = 7").select(F.slice("ids", 3, 40).alias("ids"), "offsets"), RANKS).first()
    text = AWKWARD[6][1].encode()
    assert bytes(cut.decoded) == text[cut.offsets[2] : cut.offsets[42]]
    assert byte_codec.codec_digest(nothing, RANKS).collect() == []


# ------------------------------------------------------------ vector codes


def _codes(rows, entries, rounds=4, parts=4):
    """Lloyd's algorithm without bounds, in Python's integers."""
    kept = sorted((i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda k: (gap(c[p], books[p][k]), k)) for p in range(parts)] for c in cut]
        if r == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(gap(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at, strict=True)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for k in a), e, by_label[label], digest) for (i, _, label), a, e in zip(kept, at, errors, strict=True))


@pytest.mark.parametrize("few", [True, False])
def test_vector_codes(spark, monkeypatch, few):
    rng = random.Random(few)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([None, 1, 1, 1, 2])) for i in range(40 if few else 700)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)] + [(2000 + i, [0.25] * 8 + [-0.25] * 8, 5) for i in range(60)]  # ties and one vector of many rows
    rows += [(-3, None, 1), (-2, [float("nan")] * 16, 1), (-1, [0.5] * 15 + [None], 1), (5000, [float("inf")] * 16, 2), (5001, [], 2)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 0.0, [1]) for r in rows], "vec_id long, embedding array<float>, label int, error double, x array<int>").repartition(3)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    for limit in (None, 0):  # sums of labels broadcast, or joined by a shuffle
        if limit is not None:
            monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
        got = sorted(tuple(r) for r in vector_codes.code_query(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
        assert got == _codes(as_float, 256)


def test_vector_codes_bounds_save_scans(spark):
    rng = random.Random(4)
    rows = [(i, [10.0 * (i % 20) + rng.gauss(0, 0.01) for _ in range(8)], 1) for i in range(2000)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=20)
    assert books.shape == (4, 20, 2) and coded.agg(F.sum("scans")).first()[0] == 0  # the last round settles all parts by their bounds


def test_vector_codes_odd(spark):
    shape = "vec_id long, embedding array<double>, label int"
    assert vector_codes.code_query(spark.createDataFrame([], shape)).collect() == []
    rows = [(None, [1.0] * 8, None), (4, [1.0] * 4, None), (4, [1e30] * 8, 1), (3, [2.0] * 8, None), (3, [2.0] * 8, None), (9, [1.0] * 7, 1)]
    got = sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in vector_codes.code_query(spark.createDataFrame(rows, shape)).collect())
    assert got == [(0, "03030303", 0, 0), (3, "00000000", 0, 0), (3, "00000000", 0, 0), (4, "02020202", 0, 0)]
    wide = np.array([[2**26, -(2**26)]] * 3)
    assert vector_codes.distances(wide, -wide[:1]).tolist() == [[2 * 2**54]] * 3


# ------------------------------------------------------------ resampling


def _resampled(docs, target, least=20):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(resample.WORD, low)
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]  # noqa: B905

    own, other = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in other for b in f)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resample(spark, awkward, nothing):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "g4mma", "délta", "中", "x-y", "\U0001f600"]) + str(rng.randint(0, 30)) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(900 + i, "alpha1 beta2 " * 12) for i in range(100)] + [(None, text(30)), (400, None), (401, ""), (402, " .. "), (403, "w" * 9000), (404, text(5000))]
    target = [text(20) + " alpha1 beta2" for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, True, "w") for d in docs], "doc_id long, text string, row int, able boolean, words string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resample.resample(frame, goal).collect()), key=str)
    assert got == _resampled(docs, target)
    odd = sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in resample.resample(awkward, nothing).collect()), key=str)
    assert odd == sorted((r[:4] for r in _resampled(AWKWARD, [])), key=str)
    ranks = sorted(r.rank for r in resample.resample(awkward, goal, percent=100, least_words=1).collect() if r.rank is not None)
    assert ranks == list(range(1, 1 + sum(bool(re.search(resample.WORD, (t or "").lower())) for _, t in AWKWARD)))  # repeated rows are drawn each
    assert resample.resample(nothing, goal).collect() == []


def test_resample_is_native(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(50)], "doc_id long, text string")
    plan = resample.weights(docs, resample.gains(docs, docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 1
