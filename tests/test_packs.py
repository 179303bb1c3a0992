"""Events in packs: the same rows as from objects of their own, few files, and only what is wanted is read."""

import hashlib
import os

import pytest
from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

from ledgerloom import model as M
from ledgerloom.plans import streams
from ledgerloom.sources import logstore as L

from .test_logstore import SCHEMA, _events

COLUMNS = ("scope_id", "sequence", "digest", "length", "status", "content")


def _rows(frame):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in frame.select(*COLUMNS).collect())


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    single, packed = (str(tmp_path_factory.mktemp(n)) for n in ("single", "packed"))
    frame = spark.createDataFrame(_events(9), SCHEMA).repartition(2, "scope_id")
    L.write_log(frame, single)
    L.write_log(frame, packed, packed=True)
    return single, packed


def test_packs_read_as_objects_do(spark, both):
    single, packed = both
    assert len(_files(packed)) == 3 and len(_files(single)) == 27
    for cap in (L.EVENT_BYTES, 6):
        assert _rows(L.read_log(spark, packed, cap=cap)) == _rows(L.read_log(spark, single, cap=cap))
    where = "scope_id IN ('a', 'b', 'zz') AND sequence > 4 AND sequence <= 6"
    assert _rows(L.read_log(spark, packed).filter(where)) == _rows(L.read_log(spark, single).filter(where)) != []
    assert _rows(L.read_log(spark, packed, content=False)) == _rows(L.read_log(spark, single, content=False))
    for budget, first in ((12, None), (10, 4), (0, None), (1000, 3)):
        a, b = (sorted((r.scope_id, r.sequence, r.running_bytes, bytes(r.content)) for r in L.fetch_within(spark, p, budget, first=first).collect()) for p in both)
        assert a == b and all(hashlib.sha256(r[3]).hexdigest() in {e[2] for e in _events(9)} for r in b)


def test_only_what_is_wanted_is_read(both, monkeypatch):
    reader = L.LogReader({"path": both[1]})
    list(reader.pushFilters([GreaterThan(("sequence",), 9)]))
    monkeypatch.setattr(L, "_index", lambda f: pytest.fail("a pack outside the range is opened"))
    assert [b for p in reader.partitions() for b in reader.read(p)] == []
    monkeypatch.undo()
    file = next(f for f in _files(both[1]) if "/a/" in f)
    with open(file, "rb") as f:
        raw = f.read()
    reader = L.LogReader({"path": both[1]})
    list(reader.pushFilters([LessThanOrEqual(("sequence",), 2)]))
    read = []

    class Spy:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            read.append((at, n))
            return self.f.read_at(n, at)

    class Files:
        def open_input_file(self, path):
            return Spy(L.store(path)[0].open_input_file(path))

    info = L.store(file)[0].get_file_info(file)
    rows = list(reader._packed(Files(), info, L._PACK.fullmatch(info.base_name)))
    assert [r[0] for r in rows] == [1, 2] and sum(n for _, n in read) == 8 + 9 * 48 + 2 + 4 < len(raw)


def test_packs_beside_objects_count_once(spark, tmp_path, monkeypatch):
    path, events = str(tmp_path), _events(9)
    frame = spark.createDataFrame(events, SCHEMA).coalesce(1)
    L.write_log(frame.filter("sequence <= 4"), path)
    L.write_log(frame, path, packed=True)
    L.write_log(frame, path, packed=True)
    assert len(_files(path)) == 3 * 5
    monkeypatch.setattr(M, "PACK_EVENTS", 2)
    L.PackWriter({"path": path}).write(iter(frame.filter("sequence >= 5").toArrow().to_batches()))
    assert len(_files(path)) == 3 * 8  # 5 and 6, 7 and 8, 9
    assert [r[:3] for r in _rows(L.read_log(spark, path))] == sorted(e[:3] for e in events)
    cursors = spark.createDataFrame([("a", 2, 9), ("b", 0, 10), ("zz", 0, 1)], "scope_id string, sequence long, tail long")
    assert {r.scope_id: r.dense for r in L.dense(L.read_log(spark, path, content=False), cursors).collect()} == {"a": True, "b": False, "zz": False}


def test_damage_is_told(spark, tmp_path):
    with pytest.raises(Exception, match="doesn't hash"):
        L.write_log(spark.createDataFrame([("a", 1, "0" * 64, b"x")], SCHEMA), str(tmp_path), packed=True)
    L.write_log(spark.createDataFrame(_events(3, ("a",)), SCHEMA).coalesce(1), str(tmp_path), packed=True)
    (file,) = _files(tmp_path)
    for size in (0, 5, 60, os.path.getsize(file) - 1):
        os.truncate(file, size)
        assert [r[1:] for r in _rows(L.read_log(spark, str(tmp_path)))] == [(None, None, size, "unparsed", None)]
        assert L.read_log(spark, str(tmp_path)).filter("sequence > 0").count() == 0
        L.write_whole(L.store(file)[0], file, b"\0" * os.path.getsize(file))


def test_the_queries_store_few_files(spark, tmp_path):
    rows = [("s%d" % k, i, hashlib.sha256(b"event|%d" % (100 * k + i)).hexdigest(), 100 * k + i) for k in range(3) for i in range(1, 41)]
    log = spark.createDataFrame(rows, "scope_id string, sequence long, digest string, event_id long").repartition(2, "scope_id")
    _, path = streams._stored_log(lambda _: log)
    assert len(_files(path)) == 3
