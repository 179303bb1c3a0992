"""The stream's rules with plain dictionaries as state, and its timers in Spark."""

import random
import types

import pytest
from pyspark.sql import Row, functions as F

from ledgerloom.operators import lookups
from ledgerloom.streaming import ledger

from .test_fold import chain


class _Map(dict):
    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def _ledger(hold=ledger.HOLD):
    value = types.SimpleNamespace(now=None)
    value.get, value.update = lambda: value.now, lambda v: setattr(value, "now", v)
    out = ledger.Ledger(hold)
    out.init(types.SimpleNamespace(getValueState=lambda *_: value, getMapState=lambda *_: _Map()))
    return out


def _event(r, **changed):
    scope, seq, digest, parent, op, epoch, kind, plan, _ = r
    row = {"kind": "event", "sequence": seq, "digest": digest, "parent_digest": parent, "operation_id": op, "writer_epoch": epoch, "payload_type": kind, "plan_digest": plan, "work_id": "w", "work_revision": 1, "claim_fence": seq, "grant_digest": f"g{seq}", "attempt": 1, "units": seq}
    return Row(**(row | changed))


def _events(n):
    return [_event(r, payload_type="grant_activated") if r[1] > 2 else _event(r) for r in chain("s", n)]


def _feed(own, *batches):
    return [[r.asDict() for r in own.handleInputRows(("s",), iter(b), None)] for b in batches]


@pytest.mark.parametrize("seed", range(12))
def test_any_order_ends_alike(seed):
    """Shuffled deliveries with repeats end where one ordered delivery does, in cursor, grants and remembered operations."""
    rng, events = random.Random(seed), _events(60)
    ordered, mixed = _ledger(), _ledger()
    _feed(ordered, events)
    delivery = events + rng.sample(events, 20)
    rng.shuffle(delivery)
    cuts = sorted(rng.sample(range(1, len(delivery)), 7))
    out = _feed(mixed, *(delivery[a:b] for a, b in zip([0, *cuts], [*cuts, len(delivery)], strict=True)))
    assert mixed.cursor.get() == ordered.cursor.get() and mixed.grants == ordered.grants and mixed.operations == ordered.operations and mixed.digests == ordered.digests and not mixed.waiting
    heads = [r[0] for r in out]
    assert sum(h["applied"] for h in heads) == 60 and sum(h["duplicates"] for h in heads) == 20 and heads[-1]["verdict"] in ("applied", "duplicate")
    assert ordered.grants["w", 1] == (sum(range(3, 61)), 60, "g60", 1, 58)


def test_refusals_change_nothing():
    events = _events(12)
    for at, fault in {
        5: {"parent_digest": "else"}, 6: {"operation_id": "op-s-2"}, 7: {"writer_epoch": 1}, 8: {"payload_type": "plan_admitted"}, 9: {"payload_type": "note"}, 3: {"payload_type": "root_genesis"},
    }.items():
        own = _ledger()
        _feed(own, events[:2])
        bad = [Row(**(e.asDict() | fault)) if e.sequence == at else e for e in events]
        (rows,) = _feed(own, bad[2:])
        assert rows[0]["verdict"] == ("unregistered" if at == 9 else "conflict") and own.cursor.get()[0] == 2 and not own.grants and not own.waiting
        (rows,) = _feed(own, events[2:])
        assert rows[0]["verdict"] == "applied" and own.cursor.get()[0] == 12
    own = _ledger()
    _feed(own, events)
    (rows,) = _feed(own, [Row(**(events[4].asDict() | {"digest": "forged"}))])
    assert rows[0]["verdict"] == "conflict" and rows[0]["dropped"] == 1
    (rows,) = _feed(own, [events[4]])
    assert rows[0]["verdict"] == "duplicate"


def test_what_waits_is_bounded():
    events, own = _events(20), _ledger(hold=4)
    (rows,) = _feed(own, [events[0], *events[2:]])
    assert (rows[0]["verdict"], rows[0]["sequence"], rows[0]["held"], rows[0]["dropped"]) == ("waiting", 1, 4, 14) and sorted(own.waiting) == [(3,), (4,), (5,), (6,)]
    (rows,) = _feed(own, [events[1]])
    assert rows[0]["sequence"] == 6 and not own.waiting
    _feed(own, events)
    assert own.cursor.get()[0] == 20


def test_a_forged_event_that_waits_is_dropped_in_its_turn():
    events, own = _events(8), _ledger()
    forged = Row(**(events[4].asDict() | {"digest": "forged", "parent_digest": "else"}))
    _feed(own, events[:3], [forged, events[5]])
    (rows,) = _feed(own, [events[3]])
    assert (rows[0]["sequence"], rows[0]["dropped"], rows[0]["held"]) == (4, 1, 1) and (5,) not in own.waiting
    _feed(own, [events[4]])
    assert own.cursor.get()[0] == 6


def test_over_limit(monkeypatch):
    monkeypatch.setattr(ledger.M, "MAX_EVENTS", 10)
    own = _ledger()
    (rows,) = _feed(own, _events(12))
    assert rows[0]["verdict"] == "over_limit" and own.cursor.get() is None
    _feed(own, _events(10))
    (rows,) = _feed(own, [_events(12)[11]])
    assert rows[0]["dropped"] == 1 and not own.waiting


def test_alarms_at_each_clock(spark, tmp_path):
    """What has been emitted when the clock stands at a time is what authority_times says of that time; a renewed lease has no alarms of the old one."""
    base = 1_000_000_000
    heads = [(f"s{i}", base + i * 3_000) for i in range(12)] + [("none", None)]
    clocks = [base - 30_000, base - 12_001, base - 12_000, base + 4_000, base + 9_999, base + 60_000]
    renewed = ("s11", base + 200_000, clocks[3])
    schema = "scope_id string, lease_until long, ms long"
    files = [[(*h, clocks[0]) for h in heads]] + [[("tick", None, c)] + [renewed] * (c == clocks[3]) for c in clocks[1:]]
    for k, rows in enumerate(files):  # one file a batch, in order of their times
        spark.createDataFrame(rows, schema).coalesce(1).select("scope_id", "lease_until", F.timestamp_millis("ms").alias("at")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scope_id string, lease_until long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = ledger.run_available(ledger.lease_alarms(stream), str(tmp_path / "state"), str(tmp_path / "out")).collect()
    for c in clocks:
        lease = dict(heads) | ({"s11": renewed[1]} if c >= clocks[3] else {})
        times = {r.scope_id: r for r in lookups.authority_times(spark.createDataFrame(list(lease.items()), "scope_id string, lease_until long"), c).collect()}
        for what in ("must_stop", "renewal_due"):
            fired = {r.scope_id for r in rows if r.what == what and r.watermark_ms <= c and lease[r.scope_id] in (r.due_ms + 20_000, r.due_ms + 4_999)}
            assert fired == {s for s, r in times.items() if r[what]}, (c, what)
    assert len(rows) == len({(r.scope_id, r.what, r.due_ms) for r in rows})
