"""Events encoded by column and decoded in one pass: the same bytes, rows and verdicts as one value at a time."""

import random

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerloom import model as M
from ledgerloom.functions.scalar import event_key
from ledgerloom.sources import objects, records as R


def _type(form):
    form = form.form if isinstance(form, R.Optional) else form
    return pa.struct([(n, _type(f)) for n, f in form.items()]) if isinstance(form, dict) else pa.int64() if form in ("count", "positive") else pa.string()


KIND = pa.struct([("status", pa.string()), ("envelope", _type(R._ENVELOPE)), ("payload", _type(R._ALL))])
NUMBERS = (1, 2, 23, 24, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, M.MAX_INTEGER)
TEXTS = ("w", "ä" * 11, "x" * 23, "x" * 24, "é" * 64, "😀 b")


def _value(rng, form):
    if isinstance(form, R.Optional):
        return None if rng.random() < 0.5 else _value(rng, form.form)
    if isinstance(form, dict):
        return {n: _value(rng, f) for n, f in form.items()}
    if form in ("count", "positive"):
        return rng.choice(NUMBERS + ((0,) if form == "count" else ()))
    if form == "digest":
        return f"{rng.getrandbits(256):064x}"
    return rng.choice(TEXTS + (("", "a/b", "t" * 300) if form == "text" else ()))


def _some(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choice(list(R.PAYLOADS))
        envelope = _value(rng, R._ENVELOPE) | {"payload_type": kind}
        out.append((envelope, _value(rng, R.PAYLOADS[kind])))
    return out


def _packed(events):
    envelopes = pa.array([e for e, _ in events], KIND.field("envelope").type)
    return R._pack_events(envelopes, pa.array([{c: p.get(c) for c in R._ALL} for _, p in events], KIND.field("payload").type))


def _one_by_one(contents):
    return pa.array([dict(zip(("status", "envelope", "payload"), R._event(c), strict=True)) for c in contents], KIND).to_pylist()


def test_columns_give_the_bytes_of_single_events():
    events = _some(random.Random(1), 400)
    contents = _packed(events).to_pylist()
    assert contents == [R.encode_event(e, p) for e, p in events]
    opened = R._open_events(pa.array([*contents, None], pa.binary()), KIND).to_pylist()
    assert opened == _one_by_one([*contents, None]) and [o["status"] for o in opened].count("ok") == 400
    assert R._open_events(pa.array([], pa.binary()), KIND).to_pylist() == [] and len(_packed(events[:0])) == 0
    assert _packed(events).slice(7, 5).to_pylist() == _packed(events[7:12]).to_pylist()


@pytest.mark.parametrize("seed", range(4))
def test_damaged_bytes_get_the_verdict_of_single_events(seed):
    rng = random.Random(seed)
    contents = []
    for e, p in _some(rng, 150):
        raw = bytearray(objects.encode_binary({"envelope": e, "payload": p}))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(raw))
            raw[at : at + rng.randint(0, 2)] = bytes(rng.choice((0, 0x18, 0x19, 0x1B, 0x40, 0x60, 0x78, 0xA2, 0xF6, 0xFF, rng.randrange(256))) for _ in range(rng.randint(0, 2)))
        contents.append(R._ZSTD.compress(bytes(raw)))
        contents.append(contents[-1][: rng.randrange(len(contents[-1]))])
        contents.append(zstandard.ZstdCompressor(write_content_size=False).compress(bytes(raw)))
        contents.append(contents[-3] + b"\0")
    opened = R._open_events(pa.array(contents, pa.binary()), KIND).to_pylist()
    assert opened == _one_by_one(contents)
    assert len({o["status"] for o in opened}) >= 3


def test_what_opens_encodes_to_the_same_bytes():
    """So a second encoding, which ``_event`` compares with, tells nothing more of an event that ``_usual`` takes."""
    rng, taken = random.Random(9), 0
    for e, p in _some(rng, 300):
        raw = bytearray(objects.encode_binary({"envelope": e, "payload": p}))
        raw[rng.randrange(len(raw))] = rng.randrange(256)
        found = R._usual(R._ZSTD.compress(bytes(raw)))
        if found is not None:
            taken += 1
            assert R._event(R._ZSTD.compress(bytes(raw)))[0] == "ok"
    assert taken > 10


def test_usual_events_are_walked_once(monkeypatch):
    contents = _packed(_some(random.Random(3), 50)[:20])
    calls = []
    monkeypatch.setattr(R, "decode_binary", lambda raw: calls.append(raw) or objects.decode_binary(raw))
    usual = [c for c in contents.to_pylist() if R._usual(c)]
    R._open_events(pa.array(usual, pa.binary()), KIND)
    assert usual and not calls


def test_a_filter_behind_doesnt_run_the_functions_again(spark):
    rows = spark.createDataFrame(_some(random.Random(5), 40), f"envelope {R.ddl(R._ENVELOPE)}, payload {R.ddl(R._ALL)}")
    stored = R.encode_events(rows, "envelope", "payload").withColumn("key", event_key(F.lit("scopes/one"), F.col("envelope.sequence"), F.sha2("content", 256)))
    decoded = R.decode_log(stored.select("key", "content"))
    assert decoded.filter("status = 'ok'").count() == 40
    plan = decoded.filter("status = 'ok'").select("scope_id", "sequence")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 2, plan
