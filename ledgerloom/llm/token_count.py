"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbol ids.  In each round every
sequence finds its lowest-rank adjacent pair and all its occurrences merge at once, from the left
and without overlap; sequences with no pair left retire.  The number of surviving symbols is the
token count.  Null text counts as empty: zero tokens.  Special strings inside a text are one token,
as the library's default has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vocab as V
from .batches import map_slices, narrow

#: Counts of so many different pre-tokens stay in each Python worker; beyond, they are computed anew.
REMEMBERED = 400_000

_known: dict[str, dict[str, int]] = {}


def merge_counts(voc: V.Vocabulary, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols that survive in each of the sequences ``symbols[starts[i]:starts[i + 1]]``."""
    n = len(starts) - 1
    counts = np.diff(starts)
    seq = np.repeat(np.arange(n), counts)
    sym = symbols.astype(np.int64, copy=True)
    ranks = np.full(len(sym), V.NONE)
    if len(sym) > 1:
        ranks[:-1] = np.where(seq[1:] == seq[:-1], voc.ranks(sym[:-1], sym[1:]), V.NONE)
    while len(sym):
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        own = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(sym))))
        live = own != V.NONE
        if not live.all():  # done: their counts stand
            sym, seq, ranks, own = sym[live], seq[live], ranks[live], own[live]
            if not len(sym):
                break
        hit = ranks == own
        # of overlapping occurrences in a row (as in aaa), take the 1st, 3rd, ...
        at = np.flatnonzero(hit)
        run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
        lead = np.flatnonzero(np.append(True, np.diff(run) != 0))
        at = at[(np.arange(len(at)) - lead[run]) % 2 == 0]
        counts -= np.bincount(seq[at], minlength=n)
        sym[at] = voc.made[ranks[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        touched = np.zeros(len(sym), bool)
        touched[at] = True
        sym, seq, ranks, touched = sym[keep], seq[keep], ranks[keep], touched[keep]
        t = np.flatnonzero(touched)
        for i in (t, t[t > 0] - 1):  # the pairs beginning at and ending in a new symbol
            end = i + 1 >= len(sym)
            j = np.where(end, i, i + 1)
            ranks[i] = np.where(end | (seq[i] != seq[j]), V.NONE, voc.ranks(sym[i], sym[j]))
    return counts


def count_words(voc: V.Vocabulary, words: list[str]) -> list[int]:
    """Token count of each pre-token."""
    return merge_counts(voc, *V.ragged([voc.symbols(w) for w in words])).tolist()


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Token count of each whole text."""
    voc = V.load(path)
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    known.update(dict.fromkeys(voc.special, 1))
    words = [voc.words(t) for t in texts]
    fresh = list(set().union(*words) - known.keys())
    known.update(zip(fresh, count_words(voc, fresh), strict=True))
    return [sum(map(known.__getitem__, w)) for w in words]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each text, under the vocabulary file at ``path``."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        texts = piece.column("text").to_pylist()
        return {"id": piece.column("id"), "n_tokens": count_texts(path, texts), "n_bytes": [len(t.encode()) for t in texts]}

    src = narrow(docs, id_col, text_col)
    out = map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long", fn)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
