"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token has a binary tree whose leaves are its adjacent pairs and whose nodes hold the
smallest ``rank * width + position`` below them, so the root is the leftmost pair of lowest rank.
A merge changes at most three leaves, each repaired on its path to the root; encoding ends when the
root holds no merge.  Short pre-tokens of a batch run their trees side by side as rows of a numpy
array; long ones run alone.

Null text encodes to no ids and decodes to the empty text.  Special strings inside a text become
their own ids, as the library's default has it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from . import vocab as V
from .batches import map_slices, narrow

#: Encodings of so many different pre-tokens stay in each Python worker; beyond, they are computed anew.
REMEMBERED = 250_000
#: Longer pre-tokens get a tree of their own.
SIDE_BY_SIDE = 64

_known: dict[str, dict[str, tuple[int, ...]]] = {}


def encode_alone(voc: V.Vocabulary, symbols: np.ndarray) -> list[int]:
    """Ids of one sequence of symbols."""
    sym = symbols.tolist()
    n = len(sym)
    if n < 2:
        return sym
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    pairs, size, made, none = voc.pairs, voc.size, voc.made, int(V.NONE)

    def leaf(i: int, j: int) -> int:
        rank = pairs.get(sym[i] * size + sym[j])
        return none if rank is None else rank * width + i

    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = leaf(i, i + 1)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low

    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        sym[i], k = int(made[rank]), after[j]
        after[i] = k
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            put(i, leaf(i, k))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], leaf(before[i], i))
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return out


def encode_side_by_side(voc: V.Vocabulary, rows: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Ids of many sequences: row r holds ``lengths[r]`` symbols, then filling."""
    m, full = rows.shape
    width = 1 << max(0, (full - 2).bit_length()) if full > 1 else 1
    sym = rows.copy()
    column = np.arange(full)
    tree = np.full((m, 2 * width), V.NONE)
    if full > 1:
        rank = voc.ranks(sym[:, :-1].reshape(-1), sym[:, 1:].reshape(-1)).reshape(m, full - 1)
        rank[column[1:][None, :] >= lengths[:, None]] = V.NONE
        tree[:, width : width + full - 1] = np.where(rank == V.NONE, V.NONE, rank * width + column[:-1])
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    after = np.broadcast_to(column + 1, (m, full)).copy()
    before = np.broadcast_to(column - 1, (m, full)).copy()
    gone = np.zeros((m, full), bool)
    gone[column[None, :] >= lengths[:, None]] = True

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
        k = width + i
        tree[r, k] = value
        for _ in range(width.bit_length() - 1):
            k >>= 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    def leaf(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        rank = voc.ranks(sym[r, i], sym[r, j])
        return np.where(rank == V.NONE, V.NONE, rank * width + i)

    r = np.flatnonzero(tree[:, 1] != V.NONE)
    while len(r):
        rank, i = np.divmod(tree[r, 1], width)
        j = after[r, i]
        k = after[r, j]
        sym[r, i] = voc.made[rank]
        after[r, i] = k
        gone[r, j] = True
        inner = j < full - 1
        put(r[inner], j[inner], V.NONE)
        more = k < lengths[r]
        put(r[~more], i[~more], V.NONE)
        q, a, b = r[more], i[more], k[more]
        before[q, b] = a
        put(q, a, leaf(q, a, b))
        h = before[r, i]
        had = h >= 0
        q, a, b = r[had], h[had], i[had]
        put(q, a, leaf(q, a, b))
        r = r[tree[r, 1] != V.NONE]
    kept = ~gone
    flat = sym[kept].tolist()
    ends = np.cumsum(kept.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_words(voc: V.Vocabulary, words: list[str]) -> list[tuple[int, ...]]:
    """Ids of each pre-token."""
    out: list[tuple[int, ...]] = [()] * len(words)
    by_width: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for w, word in enumerate(words):
        symbols = voc.symbols(word)
        if len(symbols) > SIDE_BY_SIDE:
            out[w] = tuple(encode_alone(voc, symbols))
        elif len(symbols):
            by_width[1 << (len(symbols) - 1).bit_length()].append((w, symbols))
    for full, group in by_width.items():
        flat, starts = V.ragged([s for _, s in group])
        lengths = np.diff(starts)
        rows = np.zeros((len(group), full), np.int64)
        rows[np.arange(full)[None, :] < lengths[:, None]] = flat
        for (w, _), ids in zip(group, encode_side_by_side(voc, rows, lengths), strict=True):
            out[w] = tuple(ids)
    return out


def encode_texts(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of each whole text."""
    voc = V.load(path)
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    known.update({t: (i,) for t, i in voc.special.items()})
    words = [voc.words(t) for t in texts]
    fresh = list(set().union(*words) - known.keys())
    known.update(zip(fresh, encode_words(voc, fresh), strict=True))
    return [[i for w in ws for i in known[w]] for ws in words]


def decode_ids(path: str, ids: list[int]) -> str:
    """Text of a list of ids; byte-level vocabularies without a decoder join their tokens by a space, as the library does."""
    return " ".join(map(V.load(path).tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of long) of each text."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        return {"id": piece.column("id"), "ids": encode_texts(path, piece.column("text").to_pylist())}

    src = narrow(docs, id_col, text_col)
    return map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, ids array<long>", fn).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of an ids column; null ids decode to null."""

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else decode_ids(path, x.tolist()))

    if df.schema[ids_col].dataType != ArrayType(LongType()):
        df = df.withColumn(ids_col, F.col(ids_col).cast("array<long>"))
    return df.withColumn(out_col, text(ids_col))


def codec_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and keeps digests of ids and decoded text, so that neither is shuffled or stored."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        encoded = encode_texts(path, piece.column("text").to_pylist())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return {
            "id": piece.column("id"),
            "n_tokens": [len(x) for x in encoded],
            "ids_sha256": [sha(" ".join(map(str, x))) for x in encoded],
            "decoded_sha256": [sha(decode_ids(path, x)) for x in encoded],
        }

    src = narrow(docs, id_col, text_col)
    schema = f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(src, schema, fn).withColumnRenamed("id", id_col)
