import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from ledgerloom.sources import logstore as L

SCHEMA = "scope_id string, sequence long, digest string, content binary"


def _events(n=6, scopes=("a", "b", "c")):
    return [(s, i, hashlib.sha256(raw).hexdigest(), raw) for s in scopes for i in range(1, n + 1) for raw in [f"{s}{i}".encode() * i]]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    events = _events()
    L.write_log(spark.createDataFrame(events, SCHEMA), path)
    L.write_log(spark.createDataFrame(events[:4], SCHEMA), path)  # what is there stays
    (tmp := L.store(path)[0]).create_dir(f"{path}/b/events")
    with tmp.open_output_stream(f"{path}/b/events/note.txt") as f:
        f.write(b"?")
    return path


def test_reads_what_was_written(spark, log):
    rows = L.read_log(spark, log).collect()
    assert sorted((r.scope_id, r.sequence, r.digest, bytes(r.content)) for r in rows if r.status == "ok") == sorted(_events())
    assert [(r.scope_id, r.status, r.sequence) for r in rows if r.status != "ok"] == [("b", "unparsed", None)]
    small = L.read_log(spark, log, cap=6).filter("scope_id = 'a'").collect()
    assert {r.sequence: (r.status, r.content is None) for r in small} == {i: ("ok", False) if i <= 3 else ("too_large", True) for i in range(1, 7)}


def test_filters_reach_the_listing(spark, log, monkeypatch):
    frame = L.read_log(spark, log).filter("scope_id IN ('a', 'b', 'zz') AND sequence > 4 AND sequence <= 6 AND length > 0")
    assert sorted((r.scope_id, r.sequence) for r in frame.collect()) == [("a", 5), ("a", 6), ("b", 5), ("b", 6)]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter (" in line]
    assert not any("sequence" in line or "scope_id" in line for line in left), plan  # Spark has nothing of them left to do
    reader = L.LogReader({"path": log})
    rest = list(reader.pushFilters([In(("scope_id",), ("a", "b")), GreaterThan(("sequence",), 4), LessThanOrEqual(("sequence",), 5), IsNotNull(("sequence",)), EqualTo(("length",), 10)]))
    assert [f.attribute for f in rest] == [("length",)]
    opened, listed = [], []
    names, own = L._names, L.LogReader._open
    monkeypatch.setattr(L, "_names", lambda fs, folder, kind: listed.append(folder) or names(fs, folder, kind))
    monkeypatch.setattr(L.LogReader, "_open", lambda self, fs, info: opened.append(info.path) or own(self, fs, info))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["scope_id"], r["sequence"]) for r in rows) == [("a", 5), ("b", 5)]
    assert len(opened) == 2 and sorted(listed) == [f"{log}/a/events", f"{log}/b/events"]  # neither the root nor another scope


def test_tasks_deal_scopes(log):
    reader = L.LogReader({"path": log, "tasks": "2"})
    assert sorted(s for p in reader.partitions() for s in p.scopes) == ["a", "b", "c"] and len(reader.partitions()) == 2


def test_digest_is_checked(spark, tmp_path):
    with pytest.raises(Exception, match="doesn't hash"):
        L.write_log(spark.createDataFrame([("a", 1, "0" * 64, b"x")], SCHEMA), str(tmp_path))


def test_dense(spark, log):
    cursors = spark.createDataFrame([("a", 2, 6), ("b", 0, 7), ("c", 6, 6), ("zz", 0, 1)], "scope_id string, sequence long, tail long")
    assert {r.scope_id: r.dense for r in L.dense(L.read_log(spark, log, content=False), cursors).collect()} == {"a": True, "b": False, "c": True, "zz": False}


def test_fetch_opens_what_fits(spark, log, tmp_path):
    """Lengths are 2, 4, 6, ... bytes: three events fit 12 bytes; the ones beyond aren't even there to be opened."""
    path = str(tmp_path / "log")
    for s, i, d, _ in _events():
        os.makedirs(f"{path}/{s}/events", exist_ok=True)
        target = f"{path}/{s}/events/{i:016d}-{d}.cbor.zst"
        if i <= 3:
            os.symlink(f"{log}/{s}/events/{i:016d}-{d}.cbor.zst", target)
        else:
            with open(target, "wb") as f:
                f.write(b"?" * 2 * i)
            os.chmod(target, 0)
    rows = L.fetch_within(spark, path, 12).orderBy("scope_id", "sequence").collect()
    assert [(r.scope_id, r.sequence, r.running_bytes) for r in rows] == [(s, i, i * (i + 1)) for s in "abc" for i in (1, 2, 3)]
    assert all(hashlib.sha256(bytes(r.content)).hexdigest() == r.digest for r in rows)
    assert {r.sequence for r in L.fetch_within(spark, log, 10, first=4).collect()} == {4}
    assert L.fetch_within(spark, log, 0).count() == 0


def test_projection_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "projection")
    assert L.read_projection(spark, path, "scopes") is None
    old = {"scopes": spark.range(5).select(F.col("id"), F.lit("old").alias("v")), "work": spark.range(0)}
    assert L.apply_projection(path, old) == 1
    listed = lambda: {f"data/{t}/{f}" for t in os.listdir(f"{path}/data") for f in os.listdir(f"{path}/data/{t}") if f.endswith(".parquet")}
    before = listed()

    @F.udf("string")
    def fails(i):
        if i == 700:
            raise ValueError("lost")
        return "new"

    broken = {"scopes": spark.range(20).select("id", F.lit("new").alias("v")), "work": spark.range(0, 1000, 1, 4).select("id", fails("id").alias("v"))}
    with pytest.raises(Exception, match="lost"):
        L.apply_projection(path, broken)
    assert [(r.id, r.v) for r in L.read_projection(spark, path, "scopes").orderBy("id").collect()] == [(i, "old") for i in range(5)]
    assert L.read_projection(spark, path, "work").collect() == [] and L.read_projection(spark, path, "other") is None
    assert {f for f in listed() if "/scopes/" in f} == {f for f in before if "/scopes/" in f}  # nothing staged is left of a table that was written
    assert L.apply_projection(path, {"scopes": broken["scopes"]}) == 2
    assert L.read_projection(spark, path, "scopes").filter("v = 'new'").count() == 20
    assert os.listdir(f"{path}/prepared") == []


def test_classes_from_footers(spark, tmp_path):
    base = str(tmp_path)
    good = spark.createDataFrame([("s1", 4), ("s2", 9)], "scope_id string, sequence long")
    good.coalesce(1).write.parquet(f"{base}/valid")
    good.withColumn("more", F.lit(1)).write.parquet(f"{base}/foreign")
    good.withColumn("sequence", F.col("sequence").cast("int")).write.parquet(f"{base}/other_type")
    good.unionByName(spark.createDataFrame([(None, 1)], good.schema)).coalesce(1).write.parquet(f"{base}/null_key")
    good.coalesce(1).write.parquet(f"{base}/cut")
    cut = next(f for f in os.listdir(f"{base}/cut") if f.endswith(".parquet"))
    with open(f"{base}/cut/{cut}", "r+b") as f:
        f.truncate(20)
    os.makedirs(f"{base}/empty")
    folders = spark.createDataFrame([(f"{base}/{n}",) for n in ("valid", "foreign", "other_type", "null_key", "cut", "empty", "gone")], "folder string")
    found = L.footers(spark, folders)
    got = {os.path.basename(r.folder): (r["class"], r.rows) for r in L.classify_projections(found, {"scope_id": "string", "sequence": "int64"}).collect()}
    assert got == {"valid": ("valid", 2), "foreign": ("foreign", 2), "other_type": ("foreign", 2), "null_key": ("rebuildable", 3), "cut": ("rebuildable", None), "empty": ("missing", None), "gone": ("missing", None)}
    ends = {r.column: (r.least, r.greatest) for r in found.filter(F.col("folder").endswith("/valid")).collect()}
    assert ends == {"scope_id": ("s1", "s2"), "sequence": ("4", "9")}
