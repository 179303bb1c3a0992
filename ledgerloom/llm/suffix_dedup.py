"""Suffix-array dedup: exact removal of strings that repeat anywhere in the corpus.

A depth-limited radix sort of suffixes, through ``depth`` tokens only: suffixes that agree so far are
the windows of ``depth`` tokens that repeat.  Tokens are bytes, or words for passages.

1. Equal texts are one text with a count.
2. A filter drops windows that are alone: each window has an anchor, its string of ``depth // 2 + 1``
   tokens with the smallest hash, and equal windows have equal anchors at equal places.  Neighbouring
   windows share their anchor, so one row stands for a stretch of them; anchors that stand in one row
   only leave.  Equal stretches are one stretch with a count, and all their windows repeat.
3. What is left is sorted by most-significant-digit passes over the windows' own bytes (eight a pass,
   words one a pass).  The leading digit is the anchor with its place, so windows that can be equal
   meet in one task; a window that is alone after a pass leaves the sort.  The groups after the last
   pass are the repeated windows, equal byte by byte.

A group of more than CHUNK stretches is dealt over tasks, each sorts its part, and the parts are
matched by digests (128 bits): first those of the bytes that a block of neighbouring windows has in
common, and where these stand in several parts those of the windows.  Rows are joined back to their
counts by broadcast where a key is crowded (if its keys are few enough) and by shuffle otherwise.

Strings never cross texts; overlapping occurrences count, and the input is judged as it came.  Null
and empty texts, and texts shorter than ``depth``, lose nothing.  Rows that repeat a text repeat each
other: all lose it.  Ids play no part, so null or repeated ids are kept as they are.  Texts are told
apart by 128 bits of hash, stretches by 64 bits beside those of their anchor, words by 64 bits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .batches import map_slices, narrow
from .components import checked, cut, discard

#: Bytes of a string that counts as repeated.
DEPTH = 400
#: Words of a passage that counts as repeated.
PASSAGE = 51
#: Long texts are hashed in stretches of so many windows.
STRETCH = 1 << 19
#: Stretches that one task sorts together, at most.
CHUNK = 512
#: Rows of a key above which it is joined apart.
CROWD = 1000

_SEED = np.random.default_rng(400)
_BYTE = _SEED.integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE = 0xD1342543DE82EF95
_LOW = np.uint64((1 << 20) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def sizes(depth: int) -> tuple[int, int]:
    """Tokens of an anchor, and places that it can take in a window."""
    if not 8 <= depth <= 50_000:
        raise ValueError("depth has to be between 8 and 50000")
    return depth // 2 + 1, depth - depth // 2


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``depth`` bytes, or ``depth`` words."""

    depth: int
    words: bool = False

    @property
    def key(self) -> int:
        """Tokens of an anchor."""
        return sizes(self.depth)[0]

    @property
    def step(self) -> int:
        """Tokens of a digit."""
        return 1 if self.words else 8

    @property
    def block(self) -> int:
        """Places of a block of windows."""
        return max(1, self.depth // 16)

    @property
    def least_bytes(self) -> int:
        """Bytes of the shortest text that has a window."""
        return 2 * self.depth - 1 if self.words else self.depth

    def tokens(self, raw: np.ndarray) -> np.ndarray:
        return word_hashes(raw) if self.words else raw

    def digits(self, tokens: np.ndarray) -> np.ndarray:
        """The digit at each place: the word, or eight bytes with the first on top (short ones at the end are padded)."""
        if self.words:
            return tokens
        padded = np.concatenate([tokens, np.zeros(7, np.uint8)])
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").reshape(-1).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _powers(inverse: bool) -> np.ndarray:
    n = STRETCH + 70_000
    out = np.full(n, np.uint64(pow(_BASE, -1, 2**64) if inverse else _BASE))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any substring of at most STRETCH + 60,000 tokens, from prefix sums."""

    def __init__(self, tokens: np.ndarray):
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        values = _BYTE[tokens] if tokens.dtype == np.uint8 else tokens
        np.cumsum(values * _powers(False)[: len(tokens)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _powers(True)[start])


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word (bytes between ASCII white space)."""
    edge = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):  # stretches of whole words; a longer word is hashed alone
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + STRETCH, "right")))
        if end[to - 1] - base > STRETCH:
            out[at] = xxhash.xxh3_64_intdigest(raw[base : end[at]].tobytes())
        else:
            part = Hashes(raw[base : end[to - 1]])
            out[at:to] = part(start[at:to] - base, end[at:to] - base)
        at = to
    return out


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from running minima within blocks of that width."""
    n = len(key)
    padded = np.full(n + -n % width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor position, first and last window start and hash of the stretch, per row of windows in a row."""
    key, width = sizes(depth)
    out = []
    for first in range(0, max(0, len(tokens) - depth + 1), STRETCH):
        part = tokens[first : first + STRETCH + depth - 1]
        at = np.arange(len(part) - key + 1)
        hashes = Hashes(part)(at, at + key)
        # ties go to the leftmost place, which equal windows share
        low = _window_minima((hashes & ~_LOW) | at.astype(np.uint64), width)
        a = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        p = (low[a] & _LOW).astype(np.int64)
        out.append((hashes[p], p + first, a + first, np.append(a[1:], len(low)) - 1 + first))
    if not out:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, p, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    # rows that the end of a stretch divides are made one again: an anchor position has one row
    head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    h, p, a, b = h[head], p[head], a[head], b[np.append(head[1:], len(p)) - 1]
    size = tokens.itemsize
    view = memoryview(np.ascontiguousarray(tokens)).cast("B")
    whole = np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip((a * size).tolist(), ((b + depth) * size).tolist(), strict=True)], np.uint64)
    return h, p, a, b, _mix(whole + (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (p - b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_PACK = 1 << 16


def _pack(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Anchor position and its distances from the first and last window, in one number."""
    return (p * _PACK + (p - a)) * _PACK + (p - b)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, hi = np.divmod(x, _PACK)
    p, lo = np.divmod(rest, _PACK)
    return p, p - lo, p - hi


def _raw(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value.as_buffer()), np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _texts(keyed: DataFrame) -> DataFrame:
    """k, l, n, compressed text, its number of words and how many rows have it; copies are reduced before they are sent."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        pack = zstandard.ZstdCompressor(level=1)
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in piece.column("text").cast(pa.binary())]
        words = [int((np.diff(~_SPACE[x], prepend=False) & ~_SPACE[x]).sum()) for x in raw]
        return {c: piece.column(c) for c in ("k", "l", "n")} | {"z": [pack.compress(x) for x in raw], "words": words}

    made = map_slices(keyed.select("k", "l", "n", "text"), "k long, l long, n long, z binary, words long", fn)
    return made.groupBy("k", "l").agg(*(F.first(c).alias(c) for c in ("n", "z", "words")), F.count("*").alias("copies"))


def _anchor_rows(texts: DataFrame, unit: Unit) -> DataFrame:
    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        found = [anchors(unit.tokens(_raw(x)), unit.depth) for x in piece.column("z")]
        counts = [len(f[0]) for f in found]
        own = pa.array(np.repeat(np.arange(len(counts)), counts))
        h, p, a, b, extent = (np.concatenate(c) for c in zip(*found, strict=True))
        return {"h": _signed(h), "at": _pack(p, a, b), "extent": _signed(extent)} | {c: piece.column(c).take(own) for c in ("k", "l", "copies")}

    return map_slices(texts.select("k", "l", "z", "copies"), "h long, k long, l long, copies long, at long, extent long", fn, "z")


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found``, whose ``n`` says how many rows have the key.

    Crowded keys are broadcast if they are few enough, so that their rows stay where they are; only
    the others meet by shuffle, at most CROWD rows a key.
    """
    crowded = cut(found.filter(F.col("n") > CROWD))
    if crowded.isEmpty():
        return rows.join(found, keys, how)
    crowded = checked(crowded)
    rest = rows.join(crowded.select(*keys), keys, "left_anti").join(found.filter(F.col("n") <= CROWD), keys, how)
    return rows.join(crowded, keys).unionByName(rest)


def _bodies(tasks: DataFrame, unit: Unit) -> DataFrame:
    """The stretches to sort, with their tokens."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        cols: dict[str, list] = {c: [] for c in ("h", "part", "k", "l", "at", "alone", "body")}
        for k, n, z, todo in zip(piece.column("k").to_pylist(), piece.column("l").to_pylist(), piece.column("z"), piece.column("tasks"), strict=True):
            tokens = unit.tokens(_raw(z))
            for c in ("h", "part", "at", "alone"):
                cols[c] += todo.values.field(c).to_pylist()
            _, a, b = _unpack(todo.values.field("at").to_numpy())
            cols["body"] += [tokens[x : y + unit.depth].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            cols["k"] += [k] * len(a)
            cols["l"] += [n] * len(a)
        return cols

    return map_slices(tasks, "h long, part int, k long, l long, at long, alone boolean, body binary", fn, "z")


def radix(names: np.ndarray, place: np.ndarray, body: list[np.ndarray], windows: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Sorts all windows of some stretches; the first window of stretch i has ``place[i]`` tokens before its anchor.

    Returns, per window in the order of stretches, the number of the group of equal windows that it
    ends in and whether that holds more than one.  Only windows of stretches with equal ``names``
    (equal anchors, compared byte by byte) are compared.
    """
    lengths = np.array([len(x) for x in body])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    digit = unit.digits(np.concatenate(body))
    own = np.repeat(np.arange(len(body)), windows)
    shift = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    at, before = start[own] + shift, place[own] - shift
    group = np.zeros(len(own), np.int64)
    many = np.zeros(len(own), bool)
    live = np.lexsort((before, names[own]))
    g = np.cumsum(np.append(False, (names[own][live][1:] != names[own][live][:-1]) | (before[live][1:] != before[live][:-1])))
    left = -(-before // unit.step)
    given = 0

    def leave(live: np.ndarray, g: np.ndarray, given: int) -> tuple[np.ndarray, np.ndarray, int]:
        alone = np.bincount(g)[g] == 1
        out = live[alone]
        group[out] = given + np.arange(len(out))
        g = g[~alone]
        return live[~alone], np.cumsum(np.append(False, g[1:] != g[:-1])) if len(g) else g, given + len(out)

    live, g, given = leave(live, g, given)
    rest = unit.depth - unit.key
    for t in range(-(-rest // unit.step) + 1):
        if not len(live):
            break
        # digits before the anchor, then those after it; the last of either part may overlap what is sorted already
        place_of = np.where(t < left[live], t * unit.step, before[live] + unit.key + (t - left[live]) * unit.step)
        d = digit[at[live] + np.minimum(place_of, unit.depth - unit.step)]
        differ = (g[1:] == g[:-1]) & (d[1:] != d[:-1])
        if not differ.any():
            continue
        mixed = np.zeros(int(g[-1]) + 1, bool)
        mixed[g[1:][differ]] = True
        here = np.flatnonzero(mixed[g])
        order = here[np.lexsort((d[here], g[here]))]
        live[here], d[here] = live[order], d[order]
        g = np.cumsum(np.append(False, (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        live, g, given = leave(live, g, given)
    group[live] = given + g
    many[live] = True
    return group, many


def _array(values: pa.Array | np.ndarray | list, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _sorted(bodies: DataFrame, unit: Unit) -> DataFrame:
    """Runs of repeated windows (k, l, first, last), and of groups dealt over parts the blocks of different windows.

    A block has the digest of what its windows have in common and the digests of the windows; ``first`` of a
    window is null if it repeats within its part.
    """
    schema = "k long, l long, first long, last long, h long, block int, digest binary, windows array<struct<place:int,digest:binary,first:long>>"
    window = pa.struct([("place", pa.int32()), ("digest", pa.binary()), ("first", pa.int64())])
    fields = pa.schema([(c, pa.int64()) for c in ("k", "l", "first", "last", "h")] + [("block", pa.int32()), ("digest", pa.binary()), ("windows", pa.list_(window))])

    def digest(x: np.ndarray) -> bytes:
        return hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    kind = np.uint64 if unit.words else np.uint8

    def sort(table: pa.Table) -> pa.RecordBatch:
        h, part, at, alone, k, n = (table.column(c).to_numpy() for c in ("h", "part", "at", "alone", "k", "l"))
        p, a, b = _unpack(at)
        body = [np.frombuffer(x, kind) for x in table.column("body").to_pylist()]
        known: dict = {}
        names = np.array([known.setdefault((x, y, s[i : i + unit.key].tobytes()), len(known)) for x, y, s, i in zip(h.tolist(), part.tolist(), body, (p - a).tolist(), strict=True)])
        count = b - a + 1
        group, many = radix(names, p - a, body, count, unit)
        own = np.repeat(np.arange(len(body)), count)
        shift = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        hit = many & alone[own]
        # runs of neighbouring windows of one stretch
        begin = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (own[1:] != own[:-1])))
        end = np.flatnonzero(hit & np.append(~hit[1:] | (own[1:] != own[:-1]), True))
        o = own[begin]
        none = [None] * len(o)
        cols = {"k": k[o], "l": n[o], "first": a[o] + shift[begin], "last": a[o] + shift[end], "h": h[o], "block": none, "digest": none, "windows": none}
        split = np.flatnonzero(part[own] >= 0)
        if len(split):
            w = np.sort(split[np.unique(group[split], return_index=True)[1]])
            o, at_window = own[w], shift[w]
            place = (p - a)[o] - at_window
            block = place // unit.block
            head = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (block[1:] != block[:-1])))
            own_digest = [digest(body[i][x : x + unit.depth]) for i, x in zip(o.tolist(), at_window.tolist(), strict=True)]
            first = pa.array(a[o] + at_window, mask=many[w] | ~alone[o])
            windows = pa.StructArray.from_arrays([pa.array(place, type=pa.int32()), pa.array(own_digest, type=pa.binary()), first], fields=list(window))
            o, low = o[head], block[head] * unit.block
            # what windows at places low to low + block - 1 share
            x, y = (p - a)[o] - low, (p - a)[o] - low - unit.block + 1 + unit.depth
            common = [digest(body[i][u:v]) for i, u, v in zip(o.tolist(), x.tolist(), y.tolist(), strict=True)]
            none = [None] * len(o)
            listed = pa.ListArray.from_arrays(pa.array(np.append(head, len(w)), type=pa.int32()), windows)
            more = {"k": k[o], "l": n[o], "first": none, "last": none, "h": h[o], "block": block[head], "digest": common, "windows": listed}
            cols = {c: pa.concat_arrays([_array(x[c], fields.field(c).type) for x in (cols, more)]) for c in cols}
        return pa.RecordBatch.from_arrays([_array(cols[f.name], f.type) for f in fields], schema=fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, part = (batch.column(c).to_numpy() for c in ("h", "part"))
            edges = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(h)]
            begin = 0
            for x, y in zip(edges, edges[1:]):  # noqa: B905
                if rows >= CHUNK and (h[x], part[x]) != last:
                    if x > begin:
                        held.append(batch.slice(begin, x - begin))
                    yield sort(pa.Table.from_batches(held))
                    held, rows, begin = [], 0, x
                rows, last = rows + y - x, (h[x], part[x])
            held.append(batch.slice(begin))
        if held:
            yield sort(pa.Table.from_batches(held))

    return bodies.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(run, schema)


def _runs(texts: DataFrame, unit: Unit) -> DataFrame:
    """k, l and runs of repeated windows (their first and last starts) of texts that stand once."""
    long_enough = texts.filter(F.col("words" if unit.words else "n") >= unit.depth)
    rows = cut(_anchor_rows(long_enough, unit))
    twice = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(join_counted(rows, twice, ["h"]).drop("n"))
    discard(rows)
    once = F.col("copies") == 1
    extents = cut(shared.groupBy("h", "extent").agg(F.count("*").alias("n"), F.min(F.struct("k", "l", "at", once.alias("once"))).alias("one")).select("h", "extent", "n", "one.*"))
    again = extents.filter("n > 1").select("h", "extent", "n")
    full = join_counted(shared.filter(once), again, ["h", "extent"]).select("k", "l", "at").distinct()
    several = extents.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("rows") / CHUNK).cast("int")
    alone = F.col("once") & (F.col("n") == 1)
    dispute = join_counted(extents.select("h", "k", "l", "at", alone.alias("alone")), several, ["h"]).withColumnRenamed("n", "rows")
    part = F.when(parts > 1, F.pmod(F.xxhash64("k", "l", "at"), parts).cast("int")).otherwise(F.lit(-1))
    tasks = dispute.groupBy("k", "l").agg(F.collect_list(F.struct("h", "at", "alone", part.alias("part"))).alias("tasks"))
    found = cut(_sorted(_bodies(long_enough.select("k", "l", "z").join(tasks, ["k", "l"]), unit), unit))
    split = found.filter("digest IS NOT NULL")
    blocks = split.groupBy("h", "block", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    windows = join_counted(split.select("k", "l", "h", "block", "digest", "windows"), blocks, ["h", "block", "digest"]).select("k", "l", "h", F.inline("windows"))
    windows = cut(windows.select("k", "l", "h", "place", "digest", "first", F.col("first").alias("last")))
    cross = windows.groupBy("h", "place", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    across = join_counted(windows.filter("first IS NOT NULL"), cross, ["h", "place", "digest"])
    p, lo, hi = (F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(_PACK - 1), F.col("at").bitwiseAND(_PACK - 1))
    runs = full.select("k", "l", (p - lo).alias("first"), (p - hi).alias("last"))
    for more in (found.filter("digest IS NULL"), across):
        runs = runs.unionByName(more.select("k", "l", "first", "last"))
    return cut(runs.groupBy("k", "l").agg(F.collect_list(F.struct("first", "last")).alias("runs")))


def _gone(runs: pa.Scalar, n: int, depth: int) -> np.ndarray:
    """Which of n tokens some run covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.values.field("first").to_numpy(), 1)
    np.add.at(change, runs.values.field("last").to_numpy() + depth, -1)
    return np.cumsum(change[:-1]) > 0


def _covered(rows: DataFrame, depth: int, with_kept: bool) -> DataFrame:
    """k, l, n_removed, spans, kept_sha256 (and the kept bytes) of each text with repeated windows."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_removed", "spans", "kept_sha256", "kept")}
        for z, runs in zip(piece.column("z"), piece.column("runs"), strict=True):
            raw = _raw(z)
            gone = _gone(runs, len(raw), depth)
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            kept = raw[~gone].tobytes()
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        made = {"k": piece.column("k"), "l": piece.column("l")} | out
        return made if with_kept else {c: v for c, v in made.items() if c != "kept"}

    schema = "k long, l long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_kept
    return map_slices(rows, schema, fn, "z")


def _passage_words(rows: DataFrame, passage: int) -> DataFrame:
    """k, l and the words that lie in repeated passages."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        counts = [int(_gone(runs, n, passage).sum()) for n, runs in zip(piece.column("words").to_pylist(), piece.column("runs"), strict=True)]
        return {"k": piece.column("k"), "l": piece.column("l"), "passage_words": counts}

    return map_slices(rows, "k long, l long, passage_words long", fn, None)


def repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, passage: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, spans (byte ranges removed), kept_sha256 and, if asked for, ``kept`` (binary) of each row.

    With ``passage`` a second sort, of words instead of bytes, finds passages of so many words (white
    space aside) that stand elsewhere too, shorter in bytes or not; ``n_passage_words`` counts the
    words that lie in them.  Nothing is removed on their account.
    """
    unit, by_word = Unit(depth), Unit(passage, words=True) if passage else None
    # texts are told apart by two hashes, so copies share their result
    keyed = narrow(docs, id_col, text_col).withColumns({"k": F.xxhash64("text"), "l": F.xxhash64(F.lit(depth), "text"), "n": F.octet_length("text").cast("long")})
    least = min(u.least_bytes for u in (unit, by_word) if u)
    texts = cut(_texts(keyed.filter(F.col("n") >= least)))
    once, more = texts.filter("copies = 1"), texts.filter("copies > 1")
    found = _covered(once.select("k", "l", "z").join(_runs(texts, unit), ["k", "l"]), depth, with_kept)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = {"n_removed": F.col("n"), "spans": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))), "kept_sha256": F.lit(nothing)} | ({"kept": F.lit(b"")} if with_kept else {})
    full = F.col("n") >= depth
    copied = more.select("k", "l", F.col("copies"), *(F.when(full, v).alias(c) for c, v in whole.items()), *([F.when(F.col("words") >= passage, F.col("words")).alias("passage_words")] if passage else []))
    if by_word:
        counted = _passage_words(once.select("k", "l", "words").join(_runs(texts, by_word), ["k", "l"]), passage)
        found = found.join(counted, ["k", "l"], "full_outer")
    results = found.withColumn("n", F.lit(1).cast("long")).unionByName(copied.withColumnRenamed("copies", "n"))
    plain = keyed.select("id", "k", "l", F.col("n").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"), *([F.encode("text", "UTF-8").alias("own")] if with_kept else []))
    judged = join_counted(plain.filter(F.col("n_bytes") >= least), results, ["k", "l"], "left").drop("n")
    out = judged.unionByName(plain.filter(F.col("n_bytes") < least), allowMissingColumns=True)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.lit(0).cast("long")
    columns = [F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256")]
    columns += [F.coalesce("passage_words", zero).alias("n_passage_words")] if passage else []
    return out.select(*columns, *([F.coalesce("kept", "own").alias("kept")] if with_kept else []))


def repeat_query(docs: DataFrame) -> DataFrame:
    """The digest of ``documents``."""
    return repeats(docs, passage=PASSAGE).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passage_words")


def oracle(depth: int = DEPTH, passage: int = PASSAGE) -> str:
    """DuckDB SQL that lists the hash of every window of the corpus, of bytes and of words."""
    return f"""
      WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
      x AS (SELECT r, doc_id, b, octet_length(b) AS n, hex(b) AS hx FROM d),
      w AS (SELECT r, s, md5(substring(hx, 2 * s + 1, {2 * depth})) AS h FROM (SELECT r, hx, unnest(range(0, n - {depth - 1})) AS s FROM x WHERE n >= {depth})),
      g AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
      o AS (SELECT r, s, s - lag(s) OVER (PARTITION BY r ORDER BY s) AS gap FROM g),
      i AS (SELECT r, s, sum(CASE WHEN gap IS NULL OR gap > {depth} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM o),
      m AS (SELECT r, k, min(s) AS a, max(s) + {depth} AS e FROM i GROUP BY 1, 2),
      t AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans FROM m GROUP BY 1),
      p AS (SELECT m.r, m.a, substring(hx, 2 * coalesce(lag(m.e) OVER (PARTITION BY m.r ORDER BY m.a), 0) + 1, 2 * (m.a - coalesce(lag(m.e) OVER (PARTITION BY m.r ORDER BY m.a), 0))) AS piece FROM m JOIN x USING (r)),
      q AS (SELECT r, string_agg(piece, '' ORDER BY a) AS pieces FROM p GROUP BY 1),
      z AS (SELECT r, max(e) AS e FROM m GROUP BY 1),
      wl AS (SELECT r, list_filter(regexp_split_to_array(decode(b), '[ \t\n\x0B\f\r]+'), lambda v: v <> '') AS ws FROM x),
      wi AS (SELECT r, s, md5(array_to_string(ws[s + 1 : s + {passage}], ' ')) AS h FROM (SELECT r, ws, unnest(range(0, len(ws) - {passage - 1})) AS s FROM wl WHERE len(ws) >= {passage})),
      wg AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS c FROM wi) WHERE c > 1),
      wc AS (SELECT r, sum(least({passage}, coalesce(nxt - s, {passage}))) AS n_passage_words FROM (SELECT r, s, lead(s) OVER (PARTITION BY r ORDER BY s) AS nxt FROM wg) GROUP BY r)
      SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(pieces, '') || substring(hx, 2 * coalesce(z.e, 0) + 1))) AS kept_sha256, coalesce(n_passage_words, 0)::BIGINT AS n_passage_words
      FROM x LEFT JOIN t USING (r) LEFT JOIN q USING (r) LEFT JOIN z USING (r) LEFT JOIN wc USING (r)"""
