"""Stored binary records as rows: plans, manifests, traces, pack catalogues, pointers and whole events.

A record is a domain prefix and one value in deterministic binary form.  Its form lists the fields in
order; decoding checks size, prefix, fields, bounds, order of lists and that encoding again gives the
same bytes, then digest and scope.  Refused bytes stay rows with a status.  No built-in decodes these
bytes, so a vectorised function does, one record at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import repeat

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ledgerloom import model as M
from ledgerloom.functions.scalar import parse_event_key

from .objects import OPEN_CAP, STORED_CAP, Refused, decode_binary, encode_binary

_HEX = re.compile(r"[0-9a-f]{64}\Z")


@dataclass(frozen=True)
class Optional:
    """A field that may be null."""

    form: object


@dataclass(frozen=True)
class Tagged:
    """A map of one entry, the variant's name; as a row it is ``kind`` and the fields of all variants."""

    variants: dict


@dataclass(frozen=True)
class Sorted:
    """A list in ascending order of ``keys`` (None: of the items themselves) without repeats."""

    form: object
    keys: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Form:
    """A kind of record: its fields in order, its prefix and the most bytes behind that."""

    fields: dict
    cap: int
    domain: bytes = b""
    #: Field that names the scope.
    scope: tuple[str, ...] = ("scope_id",)
    #: More rules, over the decoded fields.
    rule: object = field(default=None, compare=False)


_EVENT_REF = {"sequence": "positive", "digest": "digest"}
_BINDING = {"scope_id": "digest", "plan_digest": "digest", "work_id": "name", "work_revision": "positive", "claim_fence": "positive", "grant_digest": "digest", "attempt": "positive"}
_BOUNDED = {"retained": "text", "full_bytes": "count", "full_digest": "digest"}

# Outcomes of an invocation.
OUTCOMES = ("success", "refused", "timed_out", "canceled", "definite_failure", "unknown")


def _ranges(v: dict) -> bool:
    packs, points = v["packs"], v["checkpoints"]
    touching = any(a["end"] >= b["start"] for a, b in zip(packs, packs[1:]))  # noqa: B905
    falling = any(a["sequence"] >= b["sequence"] for a, b in zip(points, points[1:]))  # noqa: B905
    return v["version"] == 1 and not touching and not falling and all(p["start"] <= p["end"] for p in packs) and max(len(packs), len(points)) <= M.MAX_EVENTS


FORMS = {
    "plan": Form(
        {
            "scope_id": "digest", "objective_digest": "digest", "parent_plan_digest": Optional("digest"),
            "bases": Sorted(Tagged({"observation": _EVENT_REF, "prior_revision": {"plan_digest": "digest"}}), ("kind", "sequence", "digest", "plan_digest")),
            "work_specs": Sorted({"work_id": "name", "dependencies": Sorted("name"), "bounds": {"max_attempts": "positive", "deadline_unix_ms": "positive"}}, ("work_id",)),
            "reserved_budget_units": "count",
        },
        1 << 20, b"plan.proposal\0",
    ),
    "manifest": Form(
        {"binding": _BINDING, "provider": "text", "model_id": "text", "configuration_id": "text", "configuration_digest": "digest", "request_digest": "digest", "max_output_tokens": "positive", "deadline_unix_ms": "positive", "operation_id": "name"},
        64 << 10, b"invocation.manifest\0", ("binding", "scope_id"),
    ),
    "trace": Form(
        {
            "binding": _BINDING, "manifest_digest": "digest", "outcome": "text", "provider_request_id": Optional("text"),
            "reported_use": Optional({"input_tokens": "count", "output_tokens": "count", "total_tokens": "count", "cache_read_input_tokens": Optional("count"), "cache_write_input_tokens": Optional("count")}),
            "output": Optional(_BOUNDED), "diagnostic": Optional(_BOUNDED),
        },
        64 << 10, b"invocation.trace\0", ("binding", "scope_id"), lambda v: v["outcome"] in OUTCOMES,
    ),
    "catalog": Form({"version": "count", "scope_id": "digest", "packs": [{"start": "positive", "end": "positive", "pack_digest": "digest"}], "checkpoints": [_EVENT_REF]}, 1 << 20, rule=_ranges),
    "pointer": Form({"version": "count", "scope_id": "digest", "catalog_digest": "digest"}, 4 << 10, rule=lambda v: v["version"] == 1),
}

_ENVELOPE = {"scope_id": "digest", "sequence": "positive", "parent_event": Optional(_EVENT_REF), "writer_epoch": "positive", "operation_id": "name", "payload_type": "text"}
PAYLOADS = {
    "root_genesis": {"campaign_id": "name", "parent_scope_id": Optional("digest"), "delegation_digest": Optional("digest"), "config_digest": "digest"},
    "plan_admitted": {"plan_digest": "digest"},
    "grant_activated": {"work_id": "name", "work_revision": "positive", "claim_fence": "positive", "grant_digest": "digest", "attempt": "positive", "units": "positive", "deadline_unix_ms": "positive"},
    "artifact_reference": {
        "kind": "text", "digest": "digest", "size": "count", "media_type": "text", "producer_attempt": "text", "creation_time_unix_ms": "count", "retention_class": Optional("text"),
        "work_id": "name", "work_revision": "positive", "grant_digest": "digest", "attempt": "positive",
    },
    "projection_checkpoint_published": {"version": "count", "snapshot_digest": "digest", "snapshot_length": "positive", "covered_sequence": "positive", "covered_tail_digest": "digest", "covered_active_plan_digest": Optional("digest")},
}


def _checked(form, value):
    """The value as a row of its form; raises Refused."""
    if isinstance(form, Optional):
        return None if value is None else _checked(form.form, value)
    if isinstance(form, dict):
        if not isinstance(value, dict) or list(value) != list(form):
            raise Refused("other fields")
        return {k: _checked(f, value[k]) for k, f in form.items()}
    if isinstance(form, list):
        if not isinstance(value, list):
            raise Refused("no list")
        return [_checked(form[0], v) for v in value]
    if isinstance(form, Sorted):
        out = _checked([form.form], value)
        order = [x if form.keys is None else tuple((x.get(k) is not None, x.get(k)) for k in form.keys) for x in out]
        if any(not a < b for a, b in zip(order, order[1:])):  # noqa: B905
            raise Refused("a list out of order")
        return out
    if isinstance(form, Tagged):
        if not isinstance(value, dict) or len(value) != 1 or next(iter(value)) not in form.variants:
            raise Refused("no variant")
        ((kind, body),) = value.items()
        return {"kind": kind} | _checked(form.variants[kind], body)
    if form in ("count", "positive"):
        ok = type(value) is int and (form == "positive") <= value <= M.MAX_INTEGER
    elif form == "digest":
        ok = isinstance(value, str) and bool(_HEX.match(value))
    else:
        ok = isinstance(value, str) and (form == "text" or (1 <= len(value.encode()) <= 128 and "/" not in value))
    if not ok:
        raise Refused(f"no {form}")
    return value


def _bare(form, row):
    """The value that a row of the form stands for."""
    if isinstance(form, Optional):
        return None if row is None else _bare(form.form, row)
    if isinstance(form, dict):
        return {k: _bare(f, row[k]) for k, f in form.items()}
    if isinstance(form, list):
        return [_bare(form[0], x) for x in row]
    if isinstance(form, Sorted):
        return [_bare(form.form, x) for x in row]
    if isinstance(form, Tagged):
        return {row["kind"]: _bare(form.variants[row["kind"]], row)}
    return row


def ddl(form) -> str:
    """The Spark type of a form."""
    if isinstance(form, Optional):
        return ddl(form.form)
    if isinstance(form, dict):
        return f"struct<{','.join(f'{k}:{ddl(f)}' for k, f in form.items())}>"
    if isinstance(form, list):
        return f"array<{ddl(form[0])}>"
    if isinstance(form, Sorted):
        return f"array<{ddl(form.form)}>"
    if isinstance(form, Tagged):
        merged = {k: f for fields in form.variants.values() for k, f in fields.items()}
        return f"struct<kind:string,{','.join(f'{k}:{ddl(f)}' for k, f in merged.items())}>"
    return "bigint" if form in ("count", "positive") else "string"


def form_of(kind: str, namespace: bytes = b"") -> Form:
    """The form of a kind of record whose prefix begins with the ``namespace`` under which a deployment stores its records; kinds without a prefix have none."""
    form = FORMS[kind]
    return replace(form, domain=namespace + form.domain) if form.domain else form


def encode(kind: str, row: dict, namespace: bytes = b"") -> bytes:
    """The stored bytes of a record."""
    form = form_of(kind, namespace)
    return form.domain + encode_binary(_bare(form.fields, row))


def encode_records(df: DataFrame, kind: str, record_col: str, out_col: str = "content", namespace: bytes = b"") -> DataFrame:
    """Adds the stored bytes of a record column of ``ddl(FORMS[kind].fields)``."""

    @F.arrow_udf("binary")
    def pack(records: pa.Array) -> pa.Array:
        return pa.array([encode(kind, r, namespace) for r in records.to_pylist()], pa.binary())

    return df.withColumn(out_col, pack(F.col(record_col).cast(ddl(FORMS[kind].fields))))


def _decoded(form: Form, content: bytes | None) -> tuple[str, dict | None]:
    if content is None:
        return "absent", None
    if not len(content) or len(content) > len(form.domain) + form.cap:
        return "too_large", None
    if not content.startswith(form.domain):
        return "malformed", None
    body = content[len(form.domain) :]
    try:
        row = _checked(form.fields, decode_binary(body))
        if form.rule is not None and not form.rule(row):
            return "malformed", None
        return ("ok", row) if encode_binary(_bare(form.fields, row)) == body else ("not_canonical", None)
    except (Refused, RecursionError):
        return "malformed", None


def decode_records(objects: DataFrame, kind: str, content_col: str = "content", digest: Column | None = None, scope: Column | None = None, namespace: bytes = b"") -> DataFrame:
    """Adds ``status`` and ``record`` to stored records of a kind, whose prefix begins with ``namespace``.

    Status: absent, too_large (or empty), malformed, not_canonical, reference_mismatch (the bytes don't have the
    ``digest`` they are read for), unbound (another scope than ``scope``), or ok; the record is null unless ok.
    """
    form = form_of(kind, namespace)
    out = _parse_datatype_string(f"struct<status:string,record:{ddl(form.fields)}>")

    arrow = to_arrow_type(out)

    @F.arrow_udf(out)
    def decode(content: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("status", "record"), _decoded(form, c), strict=True)) for c in content.to_pylist()], arrow)

    made = objects.withColumn("__r", decode(F.col(content_col)))
    own = F.col("__r.record")
    for name in form.scope:
        own = own[name]
    status = F.col("__r.status")
    if digest is not None:
        status = F.when((status == "ok") & ~F.coalesce(F.sha2(content_col, 256) == digest, F.lit(False)), "reference_mismatch").otherwise(status)
    if scope is not None:
        status = F.when((status == "ok") & ~F.coalesce(own == scope, F.lit(False)), "unbound").otherwise(status)
    kept = [F.col(c) for c in objects.columns if c not in ("status", "record")]
    return made.select(*kept, status.alias("status"), F.when(status == "ok", F.col("__r.record")).alias("record"))


# ---------------------------------------------------------------- whole events

_ALL = {k: f for fields in PAYLOADS.values() for k, f in fields.items()}
_EVENT = f"struct<status:string,envelope:{ddl(_ENVELOPE)},payload:{ddl(_ALL)}>"


_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=3, write_content_size=True), zstandard.ZstdDecompressor()


def encode_event(envelope: dict, payload: dict) -> bytes:
    """The stored bytes of an event."""
    form = {"envelope": _ENVELOPE, "payload": PAYLOADS[envelope["payload_type"]]}
    return _ZSTD.compress(encode_binary(_bare(form, {"envelope": envelope, "payload": payload})))


#: Short texts' and small numbers' encodings, and the names of fields as they stand before their values.
_SHORT = [encode_binary("x" * n)[:-n] if n else encode_binary("") for n in range(256)]
_SMALL = [encode_binary(n) for n in range(256)]


def _leaf(value) -> bytes:
    """``encode_binary`` of a field's value, without a call for what is usual."""
    if type(value) is str:
        raw = value.encode()
        return _SHORT[len(raw)] + raw if len(raw) < 256 else encode_binary(value)
    return _SMALL[value] if type(value) is int and 0 <= value < 256 else encode_binary(value)


def _map_head(form: dict) -> bytes:
    return encode_binary(dict.fromkeys(map(str, range(len(form)))))[:1]


#: What stands before the envelope and before the payload of an event.
_EVENT_START, _EVENT_MIDDLE = _map_head({"envelope": 0, "payload": 0}) + encode_binary("envelope"), encode_binary("payload")


def _encoded(values: pa.Array, form) -> list[bytes]:
    """Each value's binary form, a field at a time; forms of plain fields, optional ones and records of those."""
    form = form.form if isinstance(form, Optional) else form
    if not isinstance(form, dict):
        return [_leaf(v) for v in values.to_pylist()]
    parts: list = [repeat(_map_head(form))]
    for name, own in form.items():
        parts += [repeat(encode_binary(name)), _encoded(values.field(name), own)]
    whole = list(map(b"".join, zip(*parts, strict=False)))
    return [w if ok else b"\xf6" for w, ok in zip(whole, values.is_valid().to_pylist(), strict=True)] if values.null_count else whole


def _pack_events(envelopes: pa.Array, payloads: pa.Array) -> pa.Array:
    """Stored bytes of events whose payloads have the fields of all types; those of a type are encoded together."""
    kinds, heads = envelopes.field("payload_type").to_pylist(), _encoded(envelopes, _ENVELOPE)
    places: dict[str, list[int]] = {}
    for i, kind in enumerate(kinds):
        places.setdefault(kind, []).append(i)
    out: list = [None] * len(kinds)
    for kind, at in places.items():
        for i, body in zip(at, _encoded(payloads.take(pa.array(at)), PAYLOADS[kind]), strict=True):
            out[i] = _ZSTD.compress(b"".join((_EVENT_START, heads[i], _EVENT_MIDDLE, body)))
    return pa.array(out, pa.binary())


def encode_events(df: DataFrame, envelope_col: str, payload_col: str, out_col: str = "content") -> DataFrame:
    """Adds the stored bytes of events, whose payload column has the fields of all payload types."""

    @F.arrow_udf("binary")
    def pack(envelopes: pa.Array, payloads: pa.Array) -> pa.Array:
        return _pack_events(envelopes, payloads)

    pack = pack.asNondeterministic()  # so that a filter behind it doesn't run it once more
    return df.withColumn(out_col, pack(F.col(envelope_col).cast(ddl(_ENVELOPE)), F.col(payload_col).cast(ddl(_ALL))))


def _event(content: bytes | None) -> tuple[str, dict | None, dict | None]:
    if content is None:
        return "absent", None, None
    if not 0 < len(content) <= STORED_CAP:
        return "too_large", None, None
    try:
        size = zstandard.frame_content_size(content)
        if size == -1:
            return "not_canonical", None, None
        if not 0 < size <= OPEN_CAP:
            return "too_large", None, None
        raw = _UNZSTD.decompress(content, max_output_size=OPEN_CAP, allow_extra_data=False)
        value = decode_binary(raw)
        if not isinstance(value, dict) or list(value) != ["envelope", "payload"]:
            return "malformed", None, None
        envelope = _checked(_ENVELOPE, value["envelope"])
        if envelope["payload_type"] not in PAYLOADS:
            return "unregistered", None, None
        payload = _checked(PAYLOADS[envelope["payload_type"]], value["payload"])
    except (Refused, zstandard.ZstdError, RecursionError):
        return "malformed", None, None
    return ("ok", envelope, payload) if encode_binary(value) == raw else ("not_canonical", None, None)


class _Unusual(ValueError):
    """Bytes that ``_reader`` leaves to ``_event``, which says what is wrong with them, if anything is."""


_LEAST = {1: 24, 2: 1 << 8, 4: 1 << 16, 8: 1 << 32}
_HEX_BYTES = re.compile(rb"[0-9a-f]{64}")


def _reader(form) -> Callable[[bytes, int], tuple[object, int]]:
    """A function that reads a value of a form at a place and gives the value, records as tuples, and the place behind it.

    It takes only what ``_checked`` takes in the one form that ``encode_binary`` gives, and raises for all else.
    """
    if isinstance(form, Optional):
        inner = _reader(form.form)
        return lambda raw, at: (None, at + 1) if raw[at] == 0xF6 else inner(raw, at)
    if isinstance(form, dict):
        fields, head = [(encode_binary(n), _reader(f)) for n, f in form.items()], _map_head(form)

        def record(raw: bytes, at: int) -> tuple[tuple, int]:
            if not raw.startswith(head, at):
                raise _Unusual
            at, out = at + 1, []
            for name, read in fields:
                if not raw.startswith(name, at):
                    raise _Unusual
                value, at = read(raw, at + len(name))
                out.append(value)
            return tuple(out), at

        return record
    if form in ("count", "positive"):
        least = int(form == "positive")

        def number(raw: bytes, at: int) -> tuple[int, int]:
            value, end = raw[at], at + 1
            if value > 23:
                if value > 27:
                    raise _Unusual
                size = 1 << (value - 24)
                value, end = int.from_bytes(raw[end : end + size], "big"), end + size
                if end > len(raw) or value < _LEAST[size]:
                    raise _Unusual
            if not least <= value <= M.MAX_INTEGER:
                raise _Unusual
            return value, end

        return number

    def text(raw: bytes, at: int) -> tuple[str, int]:
        n, start = raw[at] - 0x60, at + 1
        if n == 24:
            n, start = raw[start], start + 1
            if n < 24:
                raise _Unusual
        elif not 0 <= n < 24:
            raise _Unusual
        own = raw[start : start + n]
        if len(own) != n or (not _HEX_BYTES.fullmatch(own) if form == "digest" else form == "name" and (not 1 <= n <= 128 or b"/" in own)):
            raise _Unusual
        return own.decode(), start + n

    return text


_READ_ENVELOPE, _READ_PAYLOADS = _reader(_ENVELOPE), {kind: _reader(form) for kind, form in PAYLOADS.items()}


def _usual(content: bytes) -> tuple[tuple, tuple] | None:
    """Envelope and payload of an event that is as it should be, or None; the same as ``_event`` says of it, in one pass."""
    try:
        if not 0 < len(content) <= STORED_CAP or not 0 < zstandard.frame_content_size(content) <= OPEN_CAP:
            return None
        raw = _UNZSTD.decompress(content, max_output_size=OPEN_CAP, allow_extra_data=False)
        if not raw.startswith(_EVENT_START):
            return None
        envelope, at = _READ_ENVELOPE(raw, len(_EVENT_START))
        if not raw.startswith(_EVENT_MIDDLE, at) or envelope[-1] not in _READ_PAYLOADS:
            return None
        payload, at = _READ_PAYLOADS[envelope[-1]](raw, at + len(_EVENT_MIDDLE))
        return (envelope, payload) if at == len(raw) else None
    except (IndexError, ValueError, zstandard.ZstdError):
        return None


def _row(values: dict, form: dict) -> tuple:
    """A record as the tuple that ``_reader`` gives."""
    inner = {n: f.form if isinstance(f, Optional) else f for n, f in form.items()}
    return tuple(_row(values[n], f) if isinstance(f, dict) and values[n] is not None else values[n] for n, f in inner.items())


def _records(rows: list[tuple | None], kind: pa.StructType) -> pa.Array:
    """Tuples as an array of records, made a column at a time."""
    none = (None,) * kind.num_fields
    columns = list(zip(*(none if r is None else r for r in rows), strict=True)) or [()] * kind.num_fields
    arrays = [_records(c, f.type) if pa.types.is_struct(f.type) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array([r is None for r in rows], pa.bool_()))


def _open_events(contents: pa.Array, kind: pa.StructType) -> pa.Array:
    """Status, envelope and payload of stored events."""
    place = {kind: [list(_ALL).index(n) for n in form] for kind, form in PAYLOADS.items()}
    status, envelopes, payloads = [], [], []
    for content in contents.to_pylist():
        found = None if content is None else _usual(content)
        verdict = "ok"
        if found is None:
            verdict, e, p = _event(content)
            found = (None, None) if e is None else (_row(e, _ENVELOPE), _row(p, PAYLOADS[e["payload_type"]]))
        row = None
        if found[0] is not None:
            row = [None] * len(_ALL)
            for i, value in zip(place[found[0][-1]], found[1], strict=True):
                row[i] = value
        status.append(verdict)
        envelopes.append(found[0])
        payloads.append(row)
    return pa.StructArray.from_arrays([pa.array(status, pa.string()), _records(envelopes, kind.field("envelope").type), _records(payloads, kind.field("payload").type)], fields=list(kind))


def decode_log(objects: DataFrame, key_col: str = "key", content_col: str = "content", scope: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored events as rows of the log, with ``status`` and the columns in ``keep``.

    An event's reference is its sequence and the digest of its stored bytes; both have to be those of its key.
    """
    schema = _parse_datatype_string(_EVENT)

    arrow = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def decode(content: pa.Array) -> pa.Array:
        return _open_events(content, arrow)

    decode = decode.asNondeterministic()  # so that a filter on the status doesn't run it once more
    at, named, canonical = parse_event_key(F.col(key_col))
    e, p = F.col("__e.envelope"), F.col("__e.payload")
    made = objects.withColumn("__e", decode(F.col(content_col))).withColumn("__digest", F.sha2(content_col, 256))
    same = F.coalesce(canonical & (at == e["sequence"]) & (named == F.col("__digest")), F.lit(False))
    status = F.when(F.col("__e.status") != "ok", F.col("__e.status"))
    if scope is not None:
        status = status.when(~F.coalesce(e["scope_id"] == scope, F.lit(False)), "unbound")
    status = status.when(~same, "reference_mismatch").otherwise("ok")
    ok = status == "ok"
    row = {
        "scope_id": e["scope_id"], "sequence": e["sequence"], "digest": F.col("__digest"), "parent_sequence": e["parent_event"]["sequence"], "parent_digest": e["parent_event"]["digest"], "operation_id": e["operation_id"],
        "writer_epoch": e["writer_epoch"], "payload_type": e["payload_type"], "stored_bytes": F.octet_length(content_col).cast("long"), "plan_digest": p["plan_digest"], "artifact_kind": p["kind"], "artifact_digest": p["digest"],
    } | {c: p[c] for c in _ALL if c not in ("plan_digest", "kind", "digest")}
    return made.select(F.col(key_col), *keep, status.alias("status"), *(F.when(ok, v).alias(c) for c, v in row.items()))


def fetch_events(references: DataFrame, objects: DataFrame) -> DataFrame:
    """Opaque events by reference (scope_id, sequence, digest): their bytes, or the verdict absent or reference_mismatch.

    ``objects`` has scope_id, sequence and content; nothing is decoded.
    """
    held = objects.select("scope_id", "sequence", "content").withColumn("held", F.sha2("content", 256))
    j = references.join(held, ["scope_id", "sequence"], "left").withColumn("match", F.coalesce(F.col("held") == F.col("digest"), F.lit(False)))
    best = j.groupBy("scope_id", "sequence", "digest").agg(F.max_by(F.struct("held", "content", "match"), "match").alias("b"))
    verdict = F.when(F.col("b.held").isNull(), "absent").when(~F.col("b.match"), "reference_mismatch").otherwise("found")
    return best.select("scope_id", "sequence", "digest", verdict.alias("verdict"), F.when(verdict == "found", F.col("b.content")).alias("content"))
