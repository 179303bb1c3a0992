"""Arrow helpers shared by the per-document operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Python works on slices of at most so many text bytes (one longer text is a slice of its own).
SLICE_BYTES = 2 << 20


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` by ``key``; rows without a key match nothing and stay where they are, instead of meeting in one task."""
    known = F.col(key).isNotNull()
    return left.filter(known).join(right, key, "left").unionByName(left.filter(~known), allowMissingColumns=True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds few bytes of ``column``, whatever the text lengths are."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(n) + 64
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


def release() -> None:
    """Gives back to the machine what Arrow keeps of freed batches: workers wait, with all they hold, for the next stage."""
    pa.default_memory_pool().release_unused()


def map_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, list] | None], column: str | None = "text") -> DataFrame:
    """``mapInArrow`` over small slices by the bytes of ``column`` (None: of 1,000 rows); ``fn`` returns the output columns of a slice."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column) if column else (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                made = fn(piece)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of all rows of one key, from batches sorted by it; holds one key's rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            if held and held[-1].column(key)[-1].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
