"""Packing by power-of-two decomposition.

A document's ids (with the closing id) are cut into pieces whose lengths are the binary digits of
its length, the longest first, none longer than the sequence limit.  Every piece is a sequence of
its own in the bucket of its length: no sequence crosses documents, nothing is padded, and batches
draw from one bucket at a time.

Null and empty texts hold the closing id alone: one piece of length 1.  Repeated rows are packed
each on their own and get sequences of their own.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vocab as V
from .batches import narrow, slices

LIMIT = 2048
#: Encodings of so many different pre-tokens stay in each Python worker; beyond, they are computed anew.
REMEMBERED = 300_000
#: New pre-tokens that the library encodes at once, as one text; what it returns is far larger than its ids.
AT_ONCE = 4096

_known: dict[str, dict[str, bytes]] = {}


@functools.cache
def _library(path: str):
    """The vocabulary's tokenizer for pre-tokens joined by spaces, and by id whether it closes a pre-token; normalising and splitting are done before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer(Tokenizer.from_file(path).model)
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    voc = V.load(path)
    return own, np.array([t.endswith(voc.suffix) for t in voc.tokens])


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """The library's ids of each whole text, as little-endian 32-bit numbers; each different pre-token of a batch is encoded once."""
    voc = V.load(path)
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    known.update({t: np.array([i], "<u4").tobytes() for t, i in voc.special.items()})
    words = [voc.words(t) for t in texts]
    fresh = list(set().union(*words) - known.keys())
    for k in range(0, len(fresh), AT_ONCE):
        some = fresh[k : k + AT_ONCE]
        library, closing = _library(path)
        ids = np.array(library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        flat, ends = ids.tobytes(), (4 * (np.flatnonzero(closing[ids]) + 1)).tolist()
        known.update(zip(some, [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
    return [b"".join(map(known.__getitem__, ws)) for ws in words]


def decompose(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole limits, then the binary digits of the rest."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless left out, ``ids``.

    ``limit`` is a power of two.  ``length`` is the bucket; write with ``partitionBy("length")`` to
    keep buckets apart.  ``sequence_id`` numbers the rows within each task (partition number in the
    upper bits), which needs no shuffle and gives the same numbers when a task runs again.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit is no power of two")
    src = narrow(docs, id_col, text_col)
    fields = [pa.field("id", _arrow(src.schema["id"].dataType))] + [pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    end = np.array([end_id], "<u4").tobytes()
    out = pa.schema(fields + [pa.field("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                owner, columns, parts = [], [], []
                for row, ids in enumerate(encode_texts(path, piece.column("text").to_pylist())):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in decompose(total, limit):
                        part = ids[4 * start : 4 * (start + n)]
                        owner.append(row)
                        columns.append((start, n, zlib.crc32(part), total))
                        if with_ids:
                            parts.append(np.frombuffer(part, "<u4").astype(np.int64))
                        start += n
                made = [piece.column("id").take(pa.array(owner, pa.int64()))] + [pa.array(c, pa.int64()) for c in np.array(columns, np.int64).reshape(-1, 4).T]
                if with_ids:
                    flat, starts = V.ragged(parts)
                    made.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int64())))
                yield pa.RecordBatch.from_arrays(made, schema=out)

    schema = f"id {src.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    numbered = src.mapInArrow(run, schema).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return numbered.withColumnRenamed("id", id_col)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
