"""Sources: size-capped objects, canonical JSON records, JSONL captures, and stored log events.

Schemas are fixed and closed.  A record that doesn't parse, has other keys, or isn't in canonical form
is kept with a status instead of failing the read, so refusals stay data.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerloom import model as M


def read_objects(spark: SparkSession, path: str, cap: int = M.OBJECT_BYTES, start_after: str | None = None, max_keys: int | None = None) -> DataFrame:
    """Objects under a prefix in key order: path, length, status (ok or too_large) and content (null beyond the cap).

    A listing of more than ``max_keys`` keys is refused, never cut: every row then has the status
    over_limit and no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if start_after is not None:
        files = files.filter(F.col("path") > start_after)
    ok = F.col("length") <= cap
    out = files.select("path", "length", F.when(ok, "ok").otherwise("too_large").alias("status"), F.when(ok, F.col("content")).alias("content"))
    if max_keys is None:
        return out.orderBy("path")
    if files.select("path").count() > max_keys:
        out = out.select("path", "length", F.lit("over_limit").alias("status"), F.lit(None).cast("binary").alias("content"))
    return out.orderBy("path")


def decode_records(df: DataFrame, json_col: str, schema: StructType, canonical: bool = True) -> DataFrame:
    """Adds ``record`` and ``status``: absent, malformed (no JSON of the schema, or other keys), not_canonical, or ok.

    Canonical means that encoding the record again gives the same text: fixed order, explicit nulls.
    """
    raw = F.col(json_col)
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    known = F.sort_array(F.json_object_keys(raw)) == F.array(*(F.lit(n) for n in sorted(schema.names)))
    same = F.to_json(parsed, {"ignoreNullFields": "false"}) == raw
    required = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            required = required & parsed[f.name].isNotNull()
    status = F.when(raw.isNull(), "absent").when(parsed.isNull() | ~F.coalesce(known, F.lit(False)) | ~required, "malformed").when(F.lit(canonical) & ~F.coalesce(same, F.lit(False)), "not_canonical").otherwise("ok")
    return df.withColumns({"status": status, "record": F.when(status == "ok", parsed)})


def bound_heads(df: DataFrame, json_col: str, expected_scope: str) -> DataFrame:
    """Heads bound to the scope they are read for: owner and lease stand or fall together, epoch and sequence are positive."""
    out = decode_records(df, json_col, M.HEAD)
    r = F.col("record")
    ok = (r["scope_id"] == F.col(expected_scope)) & (r["controller_instance_id"].isNull() == r["lease_until"].isNull()) & (r["scope_epoch"] > 0) & (r["sequence"] > 0) & M.is_digest(r["tail_event_digest"])
    return out.withColumn("status", F.when((F.col("status") == "ok") & ~F.coalesce(ok, F.lit(False)), "unbound").otherwise(F.col("status")))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """The JSONL inventory, with its fixed schema; a bad line fails the read."""
    return spark.read.schema(M.TARGET).option("mode", "FAILFAST").json(path)


def read_capture(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """One relation per record kind of a mixed JSONL stream, which is read as text and parsed by kind."""
    lines = spark.read.text(path).withColumn("record", F.get_json_object("value", "$.record"))
    return {kind: lines.filter(F.col("record") == kind).select(F.from_json("value", schema).alias("r")).select("r.*") for kind, schema in schemas.items()}


# ---------------------------------------------------------------- binary events


class Refused(ValueError):
    """Bytes outside the deterministic encoding."""


def _head(data: memoryview, at: int) -> tuple[int, int, int]:
    first = data[at]
    major, low = first >> 5, first & 31
    if low < 24:
        return major, low, at + 1
    if low > 27:
        raise Refused("indefinite or reserved length")
    size = 1 << (low - 24)
    value = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    # the shortest form is the only one
    if at + 1 + size > len(data) or value < (24 if size == 1 else 1 << (4 * size)):
        raise Refused("length is cut or not the shortest")
    return major, value, at + 1 + size


def _item(data: memoryview, at: int, depth: int = 0):
    if at >= len(data) or depth > 32:
        raise Refused("cut short or too deep")
    major, n, at = _head(data, at)
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(data):
            raise Refused("a string is cut")
        raw = bytes(data[at : at + n])
        return (raw if major == 2 else raw.decode()), at + n
    if major == 4:
        out = []
        for _ in range(n):
            x, at = _item(data, at, depth + 1)
            out.append(x)
        return out, at
    if major == 5:
        table: dict = {}
        for _ in range(n):
            k, at = _item(data, at, depth + 1)
            if not isinstance(k, str) or k in table:
                raise Refused("a key repeats or is no text")
            table[k], at = _item(data, at, depth + 1)
        return table, at
    if major == 7 and n in (20, 21, 22):
        return {20: False, 21: True, 22: None}[n], at
    raise Refused("a type that records don't use")


def decode_binary(raw: bytes):
    """One deterministic binary value; anything after it is refused."""
    try:
        value, end = _item(memoryview(raw), 0)
    except (UnicodeDecodeError, IndexError) as e:
        raise Refused(str(e)) from e
    if end != len(raw):
        raise Refused("bytes after the value")
    return value


def encode_binary(value) -> bytes:
    """The deterministic form of a value; maps keep the order of their fields."""

    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        for k, size in enumerate((1, 2, 4, 8)):
            if n < 1 << (8 * size):
                return bytes([major << 5 | 24 + k]) + n.to_bytes(size, "big")
        raise Refused("a number is too large")

    if value is None or isinstance(value, bool):
        return {False: b"\xf4", True: b"\xf5", None: b"\xf6"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(encode_binary, value))
    return head(5, len(value)) + b"".join(encode_binary(k) + encode_binary(v) for k, v in value.items())


EVENT = "struct<scope_id:string,sequence:bigint,parent_sequence:bigint,parent_digest:string,writer_epoch:bigint,operation_id:string,payload_type:string>"
STORED_CAP, OPEN_CAP = 256 * 1024, 1024 * 1024


def decode_events(objects: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``envelope``, ``digest`` and ``event_status`` to stored events (compressed deterministic binary): size caps, decompression, decoding, same bytes when encoded again, exactly the six envelope fields.

    No built-in decompresses or decodes these, so a vectorised function does.
    """
    schema = f"event_status string, digest string, envelope {EVENT}"
    from pyspark.sql.types import _parse_datatype_string

    @F.pandas_udf(_parse_datatype_string(schema))
    def decode(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_event(c) for c in content], columns=["event_status", "digest", "envelope"])

    made = decode(F.col(content_col))
    return objects.withColumn("__e", made).select(*objects.columns, "__e.event_status", "__e.digest", "__e.envelope")


def _event(content: bytes | None):
    import hashlib

    import zstandard

    if content is None:
        return "absent", None, None
    if len(content) > STORED_CAP:
        return "too_large", None, None
    try:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)) as r:
            raw = r.read(OPEN_CAP + 1)
    except zstandard.ZstdError:
        return "malformed", None, None
    if len(raw) > OPEN_CAP:
        return "too_large", None, None
    try:
        value = decode_binary(raw)
        if encode_binary(value) != raw:
            return "not_canonical", None, None
        e = value["envelope"]
        parent = e["parent_event"]
        if set(e) != {"scope_id", "sequence", "parent_event", "writer_epoch", "operation_id", "payload_type"} or (parent is not None and set(parent) != {"sequence", "digest"}):
            return "malformed", None, None
        row = {"scope_id": e["scope_id"], "sequence": e["sequence"], "parent_sequence": parent and parent["sequence"], "parent_digest": parent and parent["digest"], "writer_epoch": e["writer_epoch"], "operation_id": e["operation_id"], "payload_type": e["payload_type"]}
    except (Refused, KeyError, TypeError):
        return "malformed", None, None
    # an event is named by the digest of its stored bytes
    return "ok", hashlib.sha256(content).hexdigest(), row


def listing_dense(keys: DataFrame, key_col: str, tail: Column) -> DataFrame:
    """Whether each scope's listed event keys hold every sequence up to its tail once."""
    from ledgerloom.functions.scalar import parse_event_key

    parsed = keys.select("scope_id", tail.alias("tail"), *parse_event_key(F.col(key_col))).filter(F.col("canonical") & (F.col("sequence") <= F.col("tail")))
    a = parsed.groupBy("scope_id", "tail").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    return a.select("scope_id", ((F.col("n") == F.col("d")) & (F.col("low") == 1) & (F.col("high") == F.col("tail")) & (F.col("n") == F.col("tail"))).alias("dense"))
