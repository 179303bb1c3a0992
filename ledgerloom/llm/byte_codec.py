"""Byte-level BPE encoding and decoding under a rank file, with vectorised pre-tokenisation.

All texts of a slice stand in one array of code points.  A table gives the class of each code point, and
neighbours refine it (the last of several white spaces, an apostrophe before a contraction).  Each refined
class is a function from state to state of the automaton that splits texts, and functions compose: a
prefix scan over their composition, in two sweeps of doubling strides, gives the state before every code
point, and with it whether a pre-token begins there.  No regular expression sees the texts.  The slices
between boundaries are encoded once each and remembered; their byte offsets are kept, so that decoding
puts every token where it came from.

Null text counts as empty: no ids.  Strings that look like special tokens are ordinary text.  Repeated
rows are encoded each on their own, extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_slices, narrow

#: Encodings of so many different pre-tokens stay in each Python worker; beyond, they are computed anew.
REMEMBERED = 400_000
#: Pre-tokens of more bytes are merged with a heap.
LONG = 64

# Classes of code points, and what neighbours make of them.
LETTER, NUMBER, OTHER, WHITE, BLANK = range(5)
#: Letter, number, other, apostrophe of a contraction of one letter, of two, last white space of a run (a blank, another one), any other white space, end of text.
KINDS = L, N, O, ONE, TWO, BLANK_LAST, WHITE_LAST, SPACE, END = range(9)  # noqa: E741
#: A pre-token is over; within letters, numbers, others, white space; after a blank that the next run takes along; one or two letters of a contraction to come.
STATES = CLOSED, IN_L, IN_N, IN_O, IN_SPACE, TAKEN, LEFT_1, LEFT_2 = range(8)

_known: dict[str, dict[bytes, tuple[bytes, str]]] = {}


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a code point of ``kind``, and whether a pre-token begins with it."""
    if kind == L and state in (LEFT_1, LEFT_2):
        return (CLOSED if state == LEFT_1 else LEFT_1), False
    if kind in (ONE, TWO) and state in (IN_O, TAKEN):  # within a run of others an apostrophe is one of them
        return IN_O, False
    if kind in (L, N, O):
        own = (IN_L, IN_N, IN_O)[kind]
        return own, state not in (own, TAKEN)
    after = {ONE: LEFT_1, TWO: LEFT_2, BLANK_LAST: TAKEN, WHITE_LAST: CLOSED, SPACE: IN_SPACE, END: CLOSED}[kind]
    return after, not (kind == SPACE and state == IN_SPACE)


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that the kinds' transitions compose to: number of each kind's function, number of f-then-g, state that each leads to from the start, and whether a pre-token begins by (state, kind)."""
    own = [tuple(_step(s, k)[0] for s in STATES) for k in KINDS]
    found = list(dict.fromkeys(own))
    at = {f: i for i, f in enumerate(found)}
    for f in found:  # grows while it is walked
        for g in own:
            h = tuple(g[s] for s in f)
            if h not in at:
                at[h] = len(found)
                found.append(h)
    then = np.array([[at[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
    begins = np.array([[_step(s, k)[1] for k in KINDS] for s in STATES])
    return np.array([at[f] for f in own], np.uint16), then, np.array([f[CLOSED] for f in found], np.uint8), begins


def scan(functions: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Composition of all functions up to each place."""
    n = len(functions)
    if n < 2:
        return functions.copy()
    pairs = scan(then[functions[0 : n - 1 : 2], functions[1::2]], then)
    out = np.empty_like(functions)
    out[0], out[1::2] = functions[0], pairs
    out[2::2] = then[pairs[: (n - 1) // 2], functions[2::2]]
    return out


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, as the library's own tables have it (they follow another version of Unicode than Python's)."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})  # what a pattern leaves out is left out of the ids
        out[np.frombuffer(probe.decode(probe.encode_ordinary(every)).encode("utf-32-le"), np.uint32)] = kind
    out[ord(" ")] = BLANK
    return out


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in an array of code points where a pre-token begins; ``ends`` are the places of the marks that close each text."""
    kind = classes()[points]
    white = kind >= WHITE
    white[ends] = False
    follows = np.zeros(len(points), bool)  # white space or the end comes next
    follows[:-1] = white[1:]
    follows[ends[ends > 0] - 1] = True
    sym = kind.copy()
    sym[white] = np.where(follows[white], SPACE, np.where(kind[white] == BLANK, BLANK_LAST, WHITE_LAST))
    apostrophe = np.flatnonzero(points[:-1] == ord("'"))
    first = points[apostrophe + 1]
    second = points[np.minimum(apostrophe + 2, len(points) - 1)]
    pair = lambda x, y: (first == ord(x)) & (second == ord(y))
    sym[apostrophe[np.isin(first, [ord(c) for c in "stmd"])]] = ONE
    sym[apostrophe[pair("r", "e") | pair("v", "e") | pair("l", "l")]] = TWO
    sym[ends] = END
    own, then, led, begins = automaton()
    state = np.full(len(points), CLOSED, np.uint8)
    state[1:] = led[scan(own[sym], then)[:-1]]
    return np.flatnonzero(begins[state, sym])


class Ranks:
    """Token bytes of a rank file, and their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (1 + max(self.ids.values()))
        for token, i in self.ids.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: merges of lowest rank first, the leftmost of equals."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        return self._merge_long(word) if len(word) > LONG else self._merge_short(word)

    def _merge_short(self, word: bytes) -> list[int]:
        rank, cuts, none = self.ids.get, list(range(len(word) + 1)), len(self.lengths)
        ranks = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            del cuts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(word[cuts[i] : cuts[i + 2]], none)
            if i:
                ranks[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ids[word[a:b]] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def _merge_long(self, word: bytes) -> list[int]:
        ids, n = self.ids, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ids.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or after[j] != end:  # one of the two has merged since
                continue
            gone[j], after[i], before[end] = 1, end, i
            for a in (i, before[i]):
                if a >= 0 and after[a] < n and (r := ids.get(word[a : (e := after[after[a]])])) is not None:
                    heapq.heappush(heap, (r, a, e))
        out, i = [], 0
        while i < n:
            out.append(ids[word[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Bytes of a list of ids; each token stands at its offset, or after the one before."""
        size = self.lengths[ids]
        if offsets is None:
            offsets = np.cumsum(size) - size
        run = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(run, size)
        out = np.zeros(int((offsets + size).max(initial=0)), np.uint8)
        out[np.repeat(offsets, size) + within] = self.flat[np.repeat(self.starts[ids], size) + within]
        return out.tobytes()


@functools.cache
def load(path: str) -> Ranks:
    """One copy for each Python worker."""
    return Ranks(path)


def encode_texts(path: str, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Ids of each whole text, the byte offset of each, and the ids as decimals joined by a blank."""
    ranks, known = load(path), _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    joined = "\0".join([*texts, ""])
    points, blob = np.frombuffer(joined.encode("utf-32-le"), np.uint32), joined.encode()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    begin = boundaries(points, ends)
    cut = place[begin]
    at = np.searchsorted(begin, ends)  # a mark is a pre-token of its own
    offsets, out, first = cut.tolist(), [], 0
    for k, mark in enumerate(at.tolist()):
        words = [blob[a:b] for a, b in zip(offsets[first:mark], offsets[first + 1 : mark + 1])]  # noqa: B905
        pieces = []
        for word in words:
            piece = known.get(word)
            if piece is None:
                merged = ranks.merge(word)
                known[word] = piece = (np.array(merged, "<u4").tobytes(), " ".join(map(str, merged)))
            pieces.append(piece)
        ids = np.frombuffer(b"".join([p[0] for p in pieces]), "<u4").astype(np.int64)
        counts = np.array([len(p[0]) for p in pieces], np.int64) >> 2
        size = ranks.lengths[ids]
        run = np.cumsum(size) - size
        lead = np.cumsum(counts) - counts  # first id of each pre-token
        start = place[ends[k - 1] + 1] if k else 0
        out.append((ids, run + np.repeat(cut[first:mark] - start - run[lead], counts), " ".join([p[1] for p in pieces])))
        first = mark + 1
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` and ``offsets`` (byte at which each token begins) of each text."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        made = encode_texts(path, piece.column("text").to_pylist())
        return {"id": piece.column("id"), "ids": [m[0] for m in made], "offsets": [m[1] for m in made]}

    src = narrow(docs, id_col, text_col)
    return map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, ids array<long>, offsets array<long>", fn).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of an ids column (lists of any cut of a text decode to its bytes); null ids decode to null."""

    @F.pandas_udf("binary")
    def raw(ids):
        return ids.map(lambda x: None if x is None else load(path).decode(np.asarray(x, np.int64)))

    return df.withColumn(out_col, raw(F.col(ids_col).cast("array<long>")))


def codec_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids at their offsets, and keeps digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        made = encode_texts(path, piece.column("text").to_pylist())
        ranks, sha = load(path), lambda raw: hashlib.sha256(raw).hexdigest()
        return {
            "id": piece.column("id"),
            "n_tokens": [len(ids) for ids, _, _ in made],
            "ids_sha256": [sha(decimals.encode()) for _, _, decimals in made],
            "decoded_sha256": [sha(ranks.decode(ids, offsets)) for ids, offsets, _ in made],
        }

    src = narrow(docs, id_col, text_col)
    schema = f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(src, schema, fn).withColumnRenamed("id", id_col)
