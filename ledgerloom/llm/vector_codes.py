"""Vector codes by product quantisation, with Hamerly's bounds over exact integers.

Vectors become integers, ``floor(1024 * x)``, and are cut into equal consecutive parts.  Each part
position has a codebook that a few rounds of Lloyd's algorithm move.  Every round writes, with the
integers of a vector, the entry of each part, one upper bound of the distance to it and one lower bound
of the distance to any other entry.  When the entries have moved, the bounds move with them; a part is
compared with all entries, in whole numbers, unless its upper bound is strictly below its lower bound
(or below half the way from its entry to the next one), so that of entries equally near the lower index
still wins.  Bounds are rounded outwards, and so never leave out a scan that the integers would need.

Only codebooks, and sums and counts by entry, meet at the driver: their size follows from the dimension.

Vectors that are null or hold null or non-finite components are left out, and so are those that can't be
cut: of a length that is no multiple of ``parts``, or other than the length of the first vector by id
that can be cut.  Rows with equal ids count each on their own, ordered by their components; null ids come
last.  With fewer rows than entries a codebook has as many entries as there are rows.  Components beyond
65,536 either way count as that, so that sums of squares fit a long.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import components as C
from .batches import free_name

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers lie within this bound.
LARGEST = 65_536 * SCALE
#: Rows that Python looks at together.
ROWS = 4096
#: Keys over which rows with equal labels are dealt when their sums are joined.
DEALT = 32


def integers(vectors: DataFrame, vector_col: str, parts: int) -> DataFrame:
    """Rows of ``vectors`` that can be cut, with the vector as whole numbers in ``x``."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)).filter(F.coalesce(finite, F.lit(False)))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return kept.withColumn("x", whole)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each entry, as whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # doubles hold every sum exactly
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for k, entry in enumerate(book):
        gap = x - entry
        out[:, k] = (gap * gap).sum(1)
    return out


def assign(x: np.ndarray, book: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each row and new bounds, from the last entry and bounds and the way that each entry has moved; and the number of full scans.

    ``at`` is -1 for a row without an entry.
    """
    at, n = at.copy(), len(book)
    between = np.sqrt(distances(book, book).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    half = between.min(1) / 2 * (1 - 1e-12)
    known = np.maximum(at, 0)
    order = np.argsort(moved)
    others = np.where(known == order[-1], moved[order[-2]] if n > 1 else 0.0, moved[order[-1]])  # the farthest way of any other entry
    upper = np.where(at < 0, np.inf, (upper + moved[known]) * (1 + 1e-12))
    lower = np.where(at < 0, 0.0, np.maximum(0.0, (lower - others) * (1 - 1e-12) - 1e-9))
    need = ~(upper < np.maximum(lower, half[known]))
    t = np.flatnonzero(need & (at >= 0))
    gap = x[t] - book[at[t]]
    upper[t] = np.sqrt((gap * gap).sum(1).astype(np.float64)) * (1 + 1e-12)  # the exact distance may settle it
    need[t] = ~(upper[t] < np.maximum(lower[t], half[at[t]]))
    t = np.flatnonzero(need)
    if len(t):
        d = distances(x[t], book)
        best = d.argmin(1)  # of equals the first
        row = np.arange(len(t))
        upper[t] = np.sqrt(d[row, best].astype(np.float64)) * (1 + 1e-12)
        d[row, best] = np.iinfo(np.int64).max
        lower[t] = np.sqrt(d.min(1).astype(np.float64)) * (1 - 1e-12) if n > 1 else np.inf
        at[t] = best
    return at, upper, lower, len(t)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.reshape(-1), kind))


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Rows of ``state`` (rest, x, at, upper, lower) under the codebooks ``books`` (part, entry, position)."""
    parts, _, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                piece = batch.slice(i, ROWS)
                x = _matrix(piece.column("x"), np.int64)
                at, upper, lower = (_matrix(piece.column(c), k) for c, k in (("at", np.int64), ("upper", np.float64), ("lower", np.float64)))
                made = [assign(x[:, p * width : (p + 1) * width], books[p], at[:, p], upper[:, p], lower[:, p], moved[p]) for p in range(parts)]
                new = {c: _lists(np.stack([m[k] for m in made], 1), t) for k, (c, t) in enumerate((("at", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())))}
                scans = pa.array(np.full(piece.num_rows, sum(m[3] for m in made) / piece.num_rows))
                yield pa.RecordBatch.from_arrays([{**new, "scans": scans}.get(n, piece.column(n) if n in piece.schema.names else None) for n in names], names)

    names = [f.name for f in state.schema if f.name != "scans"] + ["scans"]
    kinds = {f.name: f.dataType.simpleString() for f in state.schema} | {"scans": "double"}
    return state.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the integers and number of the rows of each (part, entry), added up within tasks before they are shuffled."""
    parts, entries, width = shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, at = _matrix(batch.column("x"), np.int64), _matrix(batch.column("at"), np.int64)
            for p in range(parts):
                for w in range(width):  # exact: whole numbers below 2^53 in doubles within a batch
                    total[p, :, w] += np.bincount(at[:, p], x[:, p * width + w].astype(np.float64), entries).astype(np.int64)
                count[p] += np.bincount(at[:, p], minlength=entries)
        p, k = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), _lists(total[p, k], pa.int64())], ["part", "entry", "n", "total"])

    added = state.select("x", "at").mapInArrow(run, "part int, entry int, n long, total array<long>")
    rows = added.select("part", "entry", F.posexplode_outer(F.concat(F.array("n"), "total")).alias("place", "value")).groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((parts, entries, width + 1), np.int64)
    for r in rows.collect():  # as many as the codebooks have components, and one count an entry
        out[r.part, r.entry, r.place] = r.value
    return out[:, :, 1:], out[:, :, 0]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """id, the columns of ``keep``, ``codes`` (entry of each part) and ``error`` of each vector that can be cut, and the final codebooks (part, entry, position)."""
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])
    source = integers(source, "_vector", parts).drop("_vector")
    smallest = lambda df: [r.x for r in df.orderBy(F.col("_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    seeds = smallest(source)
    dim = len(seeds[0]) if seeds else parts
    source = source.filter(F.size("x") == dim)
    if any(len(x) != dim for x in seeds):
        seeds = smallest(source)
    width = dim // parts
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    none = lambda value, kind: F.array_repeat(F.lit(value), parts).cast(f"array<{kind}>")
    state = source.withColumns({"at": none(-1, "int"), "upper": none(float("inf"), "double"), "lower": none(0.0, "double"), "scans": F.lit(0.0)})
    moved, written = np.zeros(books.shape[:2]), None
    for r in range(rounds + 1):
        if not len(seeds):
            break
        state = C.cut(_round(state, books, moved))
        if written is not None:
            C.discard(written)
        written = state
        if r == rounds:
            break
        total, count = _sums(state, books.shape)
        new = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)  # // goes down
        moved = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
        books = new
    error = _error(state, books) if len(seeds) else state.withColumn("error", F.lit(0).cast("long"))
    return error.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)], F.col("at").alias("codes"), "error", "scans"), books


def _error(state: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``error``, the squared distance to the entries of all parts."""
    parts, _, width = books.shape
    names = [f.name for f in state.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column("x"), np.int64), _matrix(batch.column("at"), np.int64)
            gap = x - np.concatenate([books[p][at[:, p]] for p in range(parts)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((gap * gap).sum(1))], [*names, "error"])

    return state.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema) + ", error long")


def sum_by_label(rows: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of equal ``label``, nulls together.

    The sums are combined before they are shuffled and broadcast while they are few; else each is
    repeated over DEALT keys, over which the rows of a label are dealt.
    """
    name, deal = free_name(rows, "_label"), free_name(rows, "_deal")
    sums = C.checked(C.cut(rows.groupBy(F.col(label).alias(name)).agg(F.sum(value).alias(out)).withColumn(deal, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))))
    dealt = rows.withColumn(deal, (F.monotonically_increasing_id() % DEALT).cast("int"))
    return dealt.join(sums.withColumnRenamed(deal, deal + "2"), (F.col(label).eqNullSafe(F.col(name))) & (F.col(deal) == F.col(deal + "2"))).drop(name, deal, deal + "2")


def code_query(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of each vector."""
    coded, books = compress(vectors, id_col, vector_col, (label_col,))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return sum_by_label(coded.withColumn("code", code), label_col, "error", "label_error").select(F.col(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: every part against every entry in every round."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS DOUBLE)) AS x, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT n, vec_id, label, p, x[1 + p * len(x) // {parts} : (p + 1) * len(x) // {parts}] AS v FROM kept, range({parts}) t(p))""",
        f"book0 AS MATERIALIZED (SELECT p, n - 1 AS k, v AS c FROM cut WHERE n <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT n, p, min_by(k, d * 1000 + k) AS k, min(d) AS d FROM
            (SELECT n, p, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM cut JOIN book{r} USING (p)) GROUP BY n, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p, k, list(m ORDER BY w) AS c FROM (SELECT p, k, w, floor(sum(v[w]) / count(*)) AS m FROM cut JOIN near{r} USING (n, p), range(1, len(v) + 1) t(w) GROUP BY p, k, w) GROUP BY p, k)""")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, k))")
    return f"""WITH {', '.join(steps)},
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM cut JOIN near{rounds} USING (n, p) GROUP BY n, vec_id, label),
        digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""
