"""State of the stream in pages: few messages to the store, the same results as with small pages, and the rows as JSON."""

import json
import random
import types

import pytest
from pyspark.sql import Row

from ledgerloom.streaming import ledger

from .test_streams import _event, _events, _feed, _ledger, _Map


class _Counted(_Map):
    calls = 0

    def __getattribute__(self, name):
        if name in ("getValue", "containsKey", "updateValue", "removeKey", "iterator"):
            _Counted.calls += 1
        return super().__getattribute__(name)


def _counted(kind=ledger.Ledger):
    own, maps = kind(), []
    own.init(types.SimpleNamespace(getValueState=lambda *_: None, getMapState=lambda *_: maps.append(_Counted()) or maps[-1]))
    return own, maps


def test_a_batch_of_a_small_scope_is_few_messages_to_the_store():
    own, _ = _counted()
    events = _events(60)
    for batch in (events[::3], events[1::3], events[2::3] + events[::5]):
        _Counted.calls = 0
        _feed(own, batch)
        assert _Counted.calls <= 3
    assert own.cursor.get()[0] == 60 and not own.waiting and len(own.operations) == 60


@pytest.mark.parametrize("page", (1, 7, 256))
def test_pages_split_and_keep_all(page, monkeypatch):
    monkeypatch.setattr(ledger, "PAGE", page)
    rng, events = random.Random(page), _events(700)
    events = [_event_of(e, f"w{e.sequence % 90}") for e in events]
    claims = [Row(kind="claim", work_id=f"w{n % 40}", work_revision=1, arrival=n, fence=n, lease_until=n, now_ms=n, terminal_result_digest=None) for n in range(80)]
    own, (pages,) = _counted()
    plain = _ledger()
    for k in range(0, 700, 100):
        batch = events[k : k + 100]
        _feed(plain, batch)
        rng.shuffle(batch)
        _feed(own, batch[:30] + claims[:1] * (k == 0), batch[20:])
    _feed(own, claims[1:])
    _feed(plain, claims)
    for name in (*ledger.DEALT, ledger.WAITING):
        assert dict(getattr(own, name)) == dict(getattr(plain, name)), name
    assert own.cursor.get() == plain.cursor.get() and len(own.grants) == 90 and len(own.claims) == 40
    assert max(len(json.loads(v[0]).get("digests", {})) for v in pages.values()) <= max(page, 8)
    (rows,) = _feed(own, [events[3], events[699]])
    assert rows[0]["verdict"] == "duplicate" and rows[0]["duplicates"] == 2
    _Counted.calls = 0
    _feed(own, [events[3]])
    assert _Counted.calls <= 4  # page 0 and the one of that digest


def _event_of(e, work):
    return Row(**(e.asDict() | {"work_id": work}))


def test_rows_as_json_say_the_same():
    packed, _ = _counted(ledger.Packed)
    plain = _ledger()
    events = _events(20)
    for batch in (events[:5] + events[8:12], events[5:8], events[3:4], [_event(("s", 21, "d", "else", "op", 1, "note", None, None))]):
        (rows,) = _feed(plain, batch)
        (out,) = packed.handleInputRows(("s",), iter(Row("scope_id", "row")("s", json.dumps({k: v for k, v in e.asDict().items() if v is not None})) for e in batch), None)
        assert [{k: v for k, v in r.items() if v is not None} for r in rows] == json.loads(out["rows"])
    start = {"sequence": 12, "digest": "d", "writer_epoch": 2, "active_plan_digest": None, "events": [{"sequence": 12, "digest": "d", "operation_id": "o"}], "grants": [dict(zip(["work_id", "work_revision", *ledger._GRANT], ["w", 1, 5, 2, "g", 1, 1], strict=True))], "claims": []}
    packed, _ = _counted(ledger.Packed)
    packed.handleInitialState(("s",), Row("scope_id", "row")("s", json.dumps(start)), None)
    assert packed.cursor.get() == (12, "d", 2, None) and packed.grants["w", 1] == (5, 2, "g", 1, 1) and packed.digests[12,] == "d" and not packed.claims


def test_a_snapshot_is_few_messages_to_the_store():
    own, _ = _counted()
    events = _events(60)
    start = Row(sequence=30, digest=events[29].digest, writer_epoch=events[29].writer_epoch, active_plan_digest=events[1].plan_digest, events=[Row(sequence=e.sequence, digest=e.digest, operation_id=e.operation_id) for e in events[:30]], grants=[], claims=[])
    _Counted.calls = 0
    own.handleInitialState(("s",), start, None)
    assert _Counted.calls <= 2
    (rows,) = _feed(own, events[20:])
    assert _Counted.calls <= 5 and (rows[0]["sequence"], rows[0]["applied"], rows[0]["duplicates"]) == (60, 30, 10)
