"""Embedding near-dedup with cross-polytope hashing.

Vectors are rotated by three rounds of random signs and fast Hadamard transforms; the hash of a
rotated vector is the coordinate of largest magnitude with its sign, that is the nearest corner of a
cross-polytope.  ``parts`` such hashes form a bucket of a table, and every vector also probes the
buckets that the next-largest coordinates would give.  Two vectors are candidates when the bucket of
one is among the probes of the other; candidates are verified by cosine in double precision.

``parts`` grows with the number of different vectors, so that buckets stay small; ``tables`` follows
from the chance that a pair at the threshold misses all tables, measured on random pairs (``MISS``).

Copies are one node with a multiplicity.  Buckets are compared in blocks of bounded size, every pair
of blocks a task, and a pair counts only in the first bucket that both share, so links are counted
without listing pairs.  Of the links themselves only connections (at most one per vector and task)
leave a task; they carry the components.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.  Where
dimensions differ, vectors are compared with those of their own dimension.
Rows with a null id link with nothing and have a null component.  Rows that repeat an id and vector
count as copies of each other.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import grouped, left_join_known, map_slices
from .components import components, cut

SIMILAR = 0.95
#: Largest chance that a pair at the threshold shares no bucket.
MISS = 1e-5
#: Probes of each vector in a table, its own bucket included.
PROBES = 6
#: Different vectors that a bucket holds on average, at most.
CROWD = 16
#: Tables whose codes are made together when the first shared one of a pair is looked for.
STEP = 3
#: Members of a block when a bucket is compared.
BLOCK = 512


@dataclass(frozen=True)
class Plan:
    """Rotations and probes for vectors of ``dim`` components."""

    dim: int
    parts: int
    tables: int
    probes: int = PROBES

    @property
    def size(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def signs(self) -> np.ndarray:
        return _signs(self.size, self.parts * self.tables)


@functools.cache
def _signs(size: int, n: int) -> np.ndarray:
    """Three sign vectors for each rotation; a longer plan begins with the shorter ones."""
    return np.stack([np.random.default_rng([95, size, r]).choice([-1.0, 1.0], (3, size)) for r in range(n)])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, scaled to keep lengths."""
    n = x.shape[-1]
    x = x.reshape(-1, n)
    h = 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


def rotated(unit: np.ndarray, signs: np.ndarray, size: int) -> np.ndarray:
    """The vectors under one rotation."""
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x = hadamard(x * s)
    return x


def bucket_codes(unit: np.ndarray, plan: Plan, first: int = 0) -> np.ndarray:
    """Codes (vectors, tables from ``first`` on, probes); the first probe is the vector's own bucket."""
    n, size = len(unit), plan.size
    out = np.empty((n, plan.tables - first, plan.probes), np.int64)
    signs = plan.signs()
    depth = min(plan.probes, size)
    for t in range(first, plan.tables):
        corners, losses = [], []
        for k in range(plan.parts):
            x = rotated(unit, signs[t * plan.parts + k], size)
            big = np.argpartition(-np.abs(x), depth - 1, 1)[:, :depth]
            value = np.take_along_axis(x, big, 1)
            # ties go to the smaller coordinate
            order = np.lexsort((big, -np.abs(value)), axis=1)
            big, value = np.take_along_axis(big, order, 1), np.take_along_axis(value, order, 1)
            corners.append(big * 2 + (value < 0))
            losses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        # single changes, and the double change of the cheapest ones, ranked by the magnitude given up
        code, loss = [], []
        base = [c[:, 0] for c in corners]
        code.append(_join(base, size))
        loss.append(np.full(n, -1.0))
        for k in range(plan.parts):
            for j in range(1, depth):
                code.append(_join([c[:, j] if i == k else base[i] for i, c in enumerate(corners)], size))
                loss.append(losses[k][:, j])
        for k in range(plan.parts):
            for m in range(k):
                if depth > 1:
                    code.append(_join([c[:, 1] if i in (k, m) else base[i] for i, c in enumerate(corners)], size))
                    loss.append(losses[k][:, 1] + losses[m][:, 1])
        codes, costs = np.stack(code, 1), np.stack(loss, 1)
        best = np.argsort(costs, axis=1, kind="stable")[:, : plan.probes]
        picked = np.take_along_axis(codes, best, 1)
        if picked.shape[1] < plan.probes:  # a plan of few coordinates has fewer probes
            picked = np.concatenate([picked, np.repeat(picked[:, :1], plan.probes - picked.shape[1], 1)], 1)
        out[:, t - first] = picked
    return out


def _join(corners: list[np.ndarray], size: int) -> np.ndarray:
    total = np.zeros(len(corners[0]), np.int64)
    for c in corners:
        total = total * (2 * size) + c
    return total


@functools.cache
def plan_for(dim: int, n: int, similar: float = SIMILAR, miss: float = MISS) -> Plan:
    """Parts from the number of vectors, tables from the miss rate of random pairs at the threshold."""
    size = 1 << max(1, (dim - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(n, 2) / CROWD, 2 * size)))
    rng = np.random.default_rng(17)
    a = rng.normal(size=(1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    pair = similar * a + math.sqrt(1 - similar**2) * b
    trial = Plan(dim, parts, 4)
    x, y = bucket_codes(a, trial), bucket_codes(pair, trial)
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean()
    tables = math.ceil(math.log(miss) / math.log(1 - min(max(met, 0.01), 1 - 1e-9)))
    return Plan(dim, parts, max(2, tables))


def _units(items: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(v.as_buffer() for v in items), np.float64).reshape(-1, dim)
    # the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _normal(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, digest and packed doubles of each row; dim 0 and nulls for vectors that can't link."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        dims, digests, packed = [], [], []
        for v in piece.column("v"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.zeros(0)
            ok = v.is_valid and len(x) and v.values.null_count == 0 and np.isfinite(x).all() and (x != 0).any()
            raw = (x + 0.0).tobytes() if ok else None  # -0 and 0 are equal
            dims.append(len(x) if ok else 0)
            packed.append(raw)
            digests.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
        return {"id": piece.column("id"), "dim": dims, "digest": digests, "items": packed}

    return map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, dim int, digest binary, items binary", fn, None)


def compare(units: np.ndarray, ids: np.ndarray, copies: np.ndarray, table: int, code: int, plan: Plan, similar: float, sides: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member of a bucket (weighted by copies) that are counted here, and connections as pairs of positions.

    A pair counts in the first table that both share and there in the bucket of its smaller id, if
    the other probes that, else in the bucket of the other.  ``sides`` tells blocks apart: only pairs
    across count.
    """
    n = len(units)
    near = units @ units.T >= similar
    near |= near.T
    np.fill_diagonal(near, False)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(np.triu(near))
    links = np.zeros(n, np.int64)
    if not len(a):
        return links, []
    low = ids[a] <= ids[b]
    a, b = np.where(low, a, b), np.where(low, b, a)
    # most pairs share an early table, so few vectors are rotated for the later ones
    start = 0
    while start <= table and len(a):
        end = min(table + 1, start + STEP)
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = np.split(place, 2)
        codes = bucket_codes(units[used], Plan(plan.dim, plan.parts, end, plan.probes), start)
        here = np.ones(len(a), bool)
        for t in range(end - start):
            a_own = (codes[y, t] == codes[x, t, :1]).any(1)  # the bucket of a, which b probes
            b_own = (codes[x, t] == codes[y, t, :1]).any(1)
            if start + t < table:
                here &= ~(a_own | b_own)
            else:
                here &= np.where(a_own, codes[x, t, 0] == code, b_own & (codes[y, t, 0] == code))
        a, b, start = a[here], b[here], end
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    # connections of the linked pairs, by labels that fall until they agree
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return links, [(int(x), i) for i, x in enumerate(label) if x != i]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similar: float = SIMILAR) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id reachable, itself included) and kept of each row."""
    rows = cut(_normal(vectors, id_col, vector_col))
    kind = rows.schema["id"].dataType.simpleString()
    some = rows.filter("id IS NOT NULL AND dim > 0")
    nodes = cut(some.groupBy("digest", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("items").alias("items")))
    # few numbers reach the driver: the vectors of each dimension
    plans = {r["dim"]: plan_for(r["dim"], r["n"], similar) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def keys(piece: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("bucket", "table", "code", "dim", "digest")}
        dims = piece.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            plan = plans[dim]
            at = np.flatnonzero(dims == dim)
            for part in np.array_split(at, -(-len(at) // 256)):
                mine = piece.take(pa.array(part))
                codes = bucket_codes(_units(mine.column("items"), dim), plan)
                fresh = codes != codes[:, :, :1]  # without the repeats that fill up a short list of probes
                fresh[:, :, 0] = True
                row, table, _ = np.nonzero(fresh)
                out["code"].append(codes[fresh])
                out["table"].append(table.astype(np.int32))
                out["dim"].append(np.full(len(row), dim, np.int32))
                digests = mine.column("digest").to_pylist()
                out["digest"] += [digests[i] for i in row]
        made = {c: np.concatenate(v) for c, v in out.items() if c not in ("digest", "bucket")}
        # a 64-bit name of (dim, table, code)
        name = (made["code"].astype(np.uint64) * np.uint64(4096) + made["table"].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + made["dim"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return made | {"bucket": name.view(np.int64), "digest": out["digest"]}

    members = map_slices(nodes.select("digest", "dim", "items"), "bucket long, table int, code long, dim int, digest binary", keys, "items")
    counts = cut(members.groupBy("bucket", "table", "code", "dim").agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = members.join(counts.select("bucket", "table", "code", "dim", blocks.alias("blocks")), ["bucket", "table", "code", "dim"])
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("bucket", "table", "code", "dim", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.least("own", "other") == F.greatest("own", "other"), F.lit(-1)).otherwise(F.col("own"))
    sent = dealt.select(task.alias("task"), "table", "code", "dim", side.alias("side"), "digest").join(nodes.select("digest", "rep", "copies", "items"), "digest")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"a {kind}, b {kind}, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            if group.num_rows < 2:
                continue
            dim = group.column("dim")[0].as_py()
            reps = group.column("rep").to_numpy()
            sides = group.column("side").to_numpy()
            links, found = compare(
                _units(group.column("items"), dim), reps, group.column("copies").to_numpy(), group.column("table")[0].as_py(), group.column("code")[0].as_py(), plans[dim], similar, sides if sides[0] >= 0 else None
            )
            at = np.flatnonzero(links)
            if len(at):  # a count as a row (rep, null, n), a connection as a row (a, b, null)
                ids = reps.tolist()
                a = [ids[i] for i in at] + [ids[x] for x, _ in found]
                b = [None] * len(at) + [ids[y] for _, y in found]
                n = links[at].tolist() + [None] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((a, b, n), arrow, strict=True)], schema=arrow)

    found = cut(sent.repartition("task").sortWithinPartitions("task").mapInArrow(run, schema))
    parts = components(found.filter("b IS NOT NULL").select("a", "b"))
    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    labelled = nodes.select("digest", "rep", "copies").join(linked, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = labelled.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = left_join_known(rows.select("id", "digest"), found, "digest")
    lone = F.col("n_links").isNull() | F.col("id").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def oracle(similar: float = SIMILAR) -> str:
    """DuckDB SQL over all pairs of vectors."""
    return f"""
      WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= {similar}),
      r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.c = e.a),
      c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY 1),
      n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
      SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
