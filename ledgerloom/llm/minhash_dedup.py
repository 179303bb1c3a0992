"""MinHash near-dedup with fast similarity sketching.

A document's set holds its distinct 5-word shingles.  The sketch throws the set into bins, round
after round: in round i < t each shingle goes to a random bin with value i + fraction; in round
t + j every shingle goes to bin j.  A bin keeps its smallest value, and the rounds end as soon as
all bins are filled, so every coordinate is filled and collides with the probability of the Jaccard
similarity.  Coordinates form bands; documents that share a band are candidates, and a link counts
only if 100 * |A and B| >= 75 * |A or B| on the full sets.

Copies (equal sets) are one node.  In a bucket every member is first verified against the smallest
one, then members outside a bucket's first or last component against a member inside it.  Buckets
that still hold several components are searched whole, in blocks of bounded size whose set products
are computed at once; only the connections found leave the task.  So no pairs of a bucket are listed
and no link between components is lost.

Null, empty and blank texts have an empty set and link with nothing (n_shingles 0, a component of
their own).  Rows with a null id link with nothing and have a null component.  Rows that repeat an
id are one node if their texts are equal; other texts under the same id join its node.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import free_name, grouped, left_join_known, map_slices, narrow
from .components import checked, components, cut

BINS, BAND = 128, 4
WORDS = 5
#: Members of a block when a bucket is searched whole.
BLOCK = 512

#: Least similarity in hundredths.
SIMILAR = 75

_SEED = np.random.default_rng(2017)
_BYTE = _SEED.integers(0, 2**64, 256, np.uint64, endpoint=False)
_ROUND = _SEED.integers(0, 2**64, 2 * BINS, np.uint64, endpoint=False)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
# what separates words: space and \t to \r; A-Z count as a-z
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_SEGMENT = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _segments(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Long buffers cut between words."""
    start = 0
    while len(raw) - start > _SEGMENT:
        gaps = np.flatnonzero(_GAP[raw[start : start + _SEGMENT]])
        if not len(gaps):  # one very long word
            rest = np.flatnonzero(_GAP[raw[start + _SEGMENT :]])
            end = start + _SEGMENT + int(rest[0]) + 1 if len(rest) else len(raw)
        else:
            end = start + int(gaps[-1]) + 1
        yield raw[start:end]
        start = end
    yield raw[start:]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word of a text's bytes, in order."""
    out = []
    for part in _segments(raw):
        inside = ~_GAP[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        # positions count from the word's start, so equal words hash equally wherever they stand
        within = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part)))) if first[0] == 0 else np.concatenate([np.zeros(first[0], np.int64), np.arange(first[0], len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))])
        length = end - first
        power = _powers(_BASE, int(length.max()))
        value = np.where(inside, _BYTE[part], np.uint64(0)) * power[np.where(inside, within, 0)]
        total = np.add.reduceat(value, first)
        out.append(mix(total + length.astype(np.uint64) * _SPREAD))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(raw: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's bytes; fewer words than ``width`` are one shingle."""
    words = word_hashes(raw)
    if not len(words):
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    total = np.full(n, np.uint64(width_here))
    for k in range(width_here):
        total = mix(total * _BASE + words[k : k + n])
    return np.unique(total)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates per non-empty set: round number above, hash bits below."""
    n = len(sets)
    full = np.iinfo(np.uint64).max
    out = np.full(n * bins, full)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    for r in range(2 * bins):
        if not len(items):
            break
        h = mix(items ^ _ROUND[r])
        value = np.uint64(r) << np.uint64(56) | h >> np.uint64(8)
        if r < bins:
            np.minimum.at(out, owner * bins + (h & np.uint64(bins - 1)).astype(np.int64), value)
        else:
            np.minimum.at(out, owner * bins + (r - bins), value)
        open_ = (out.reshape(n, bins) == full).any(1)
        more = open_[owner]
        owner, items = owner[more], items[more]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key per band of coordinates; the band's number is part of it."""
    n, bins = sketch.shape
    total = np.broadcast_to(np.arange(bins // band, dtype=np.uint64), (n, bins // band)).copy()
    for k in range(band):
        total = mix(total * _BASE + sketch[:, k::band])
    return total.view(np.int64)


def _raw(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_key (a digest of the set) and band keys of each text; the last two are null for empty sets."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        sets = [shingle_set(_raw(x)) for x in piece.column("text").cast(pa.binary())]
        some = [i for i, s in enumerate(sets) if len(s)]
        keys = dict(zip(some, band_keys(sketches([sets[i] for i in some])), strict=True))
        return {
            "id": piece.column("id"),
            "n_shingles": [len(s) for s in sets],
            "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "bands": [keys.get(i) for i in range(len(sets))],
        }

    src = narrow(docs, id_col, text_col)
    return map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, n_shingles long, set_key binary, bands array<long>", fn)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n and the full set (packed 64-bit hashes) of the texts whose id is in ``ids``."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        sets = [shingle_set(_raw(x)) for x in piece.column("text").cast(pa.binary())]
        return {"id": piece.column("id"), "items": [s.tobytes() for s in sets]}

    src = narrow(docs, id_col, text_col).join(ids, "id", "left_semi")
    return map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, items binary", fn)


def verify(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        ok = []
        for x, y in zip(piece.column("x"), piece.column("y"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(s) + len(t) - len(np.union1d(s, t))
            ok.append(100 * both >= similar * (len(s) + len(t) - both))
        keep = pa.array(ok, pa.bool_())
        return {"a": piece.column("a").filter(keep), "b": piece.column("b").filter(keep)}

    kind = pairs.schema["a"].dataType.simpleString()
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")
    return map_slices(both, f"a {kind}, b {kind}", fn, "y")


def _fitting(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    a, b = (sizes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    return pairs.distinct().join(a, "a").join(b, "b").filter(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b")).select("a", "b")


def _apart(crowded: DataFrame, parts: DataFrame) -> DataFrame:
    """key, node and part of the members of buckets that hold more than one component."""
    placed = crowded.select("key", F.col("b").alias("node")).join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    return cut(placed.join(mixed, "key", "left_semi"))


def connections(sets: list[np.ndarray], similar: int = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of positions that connect the same sets as all links among ``sets`` do, at most one per set."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    row, column = row[common], np.unique(column[common], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)  # counts: exact below 2 ** 24
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part @ part.T
    linked = np.empty((n, n), bool)
    for i in range(n):  # row by row, in integers
        shared = both[i].astype(np.int64)
        linked[i] = 100 * shared >= similar * (size[i] + size - shared)
    label = np.arange(n, dtype=np.int32)
    while True:
        new = np.where(linked, label[None, :], np.int32(n)).min(1)
        new = np.minimum(new, label)
        if (new == label).all():
            return [(int(a), i) for i, a in enumerate(label) if a != i]
        label = new[new]


def search_whole(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Connections (a, b) within each bucket of ``apart``, as all links in it would make them.

    A bucket of more than BLOCK members is cut into blocks, and every pair of blocks is a task.
    """
    kind = apart.schema["node"].dataType.simpleString()
    count = apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = apart.join(count, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(task.alias("task"), "node").join(sets.select(F.col("id").alias("node"), "items"), "node").select("task", "node", "items")

    def run(batches):
        for table in grouped(batches, "task"):
            nodes = table.column("node").to_pylist()
            found = connections([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")])
            if found:
                out = pa.table({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]})
                yield from out.cast(to_arrow_schema(schema)).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"a {kind}, b {kind}")
    return cut(rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, schema))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, itself included) and kept of each row."""
    seen = cut(profile(docs, id_col, text_col))
    some = seen.filter("id IS NOT NULL AND set_key IS NOT NULL")
    reps = cut(some.groupBy("set_key", "n_shingles").agg(F.min("id").alias("rep")))
    # one row of bands per node: every copy has the same
    nodes = some.join(reps.select("set_key", "rep"), "set_key").filter("id = rep").dropDuplicates(["set_key"])
    members = nodes.select(F.explode("bands").alias("key"), "rep")
    buckets = cut(members.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).filter("a < b"))
    crowded = cut(members.join(buckets.filter("n > 2").select("key", "a"), "key").select("key", "a", F.col("rep").alias("b")))
    first = cut(_fitting(buckets.filter("n = 2").select("a", "b").union(crowded.filter("a < b").select("a", "b")), reps))
    touched = cut(first.select(F.col("a").alias("id")).union(first.select("b")).union(crowded.select("b")).distinct())
    sets = cut(full_sets(docs, checked(touched), id_col, text_col))
    links = cut(verify(first, sets))
    parts = components(links)
    apart = _apart(crowded, parts)
    # the first and last component of a bucket, each with one member that varies with the bucket
    ends = apart.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    seat = F.xxhash64("node", "key")
    placed = apart.join(ends, "key")
    picks = placed.groupBy("key").agg(
        F.min_by("node", F.when(F.col("part") == F.col("low"), seat)).alias("in_low"), F.min_by("node", F.when(F.col("part") == F.col("high"), seat)).alias("in_high")
    )
    placed = placed.join(picks, "key")
    tries = [placed.filter(F.col("part") != F.col(end)).select(F.least("node", pick).alias("a"), F.greatest("node", pick).alias("b")) for end, pick in (("low", "in_low"), ("high", "in_high"))]
    second = cut(_fitting(tries[0].union(tries[1]), reps).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        links = cut(links.union(verify(second, sets)))
        parts = components(links)
    apart = _apart(crowded, parts)
    if not apart.isEmpty():
        links = links.union(search_whole(apart, sets))
        parts = components(links)
    groups = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = left_join_known(seen.select("id", "n_shingles", "set_key"), groups, "set_key")
    own = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), own).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group one with the smallest id; of rows that repeat its id and text, one.

    Different texts under one id are judged apart, each for itself.
    """
    mark, place = free_name(docs, "__text"), free_name(docs, "__place")
    own = docs.filter(F.col(id_col).isNotNull()).withColumn(mark, F.xxhash64(text_col))
    texts = cut(own.select(F.col(id_col).alias("__id"), mark).distinct())
    by = id_col
    if not texts.groupBy("__id").count().filter("count > 1").isEmpty():
        # numbers in the order of ids take the place of ids
        places = checked(cut(texts.orderBy("__id", mark).withColumn(place, F.monotonically_increasing_id())))
        by = place
        p = places.select(F.col("__id").alias(id_col), mark, place)
        own = own.join(p, [id_col, mark])
    found = near_duplicates(own, by, text_col).filter("kept").select(by)
    kept = own.join(found.distinct(), by, "left_semi").dropDuplicates([by])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def oracle() -> str:
    """DuckDB SQL: every pair that shares a shingle is compared on full sets, components by fixpoint."""
    return r"""
      WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w WHERE len(w) > 0),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
      e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
      r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.c = e.a),
      c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
      SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
