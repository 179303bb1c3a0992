"""Stored records and publication, against hand-made cases."""

import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerloom import model as M
from ledgerloom.functions import scalar
from ledgerloom.operators import accel, audit, fold, graph, intake, publish
from ledgerloom.sources import objects, records as R
from ledgerloom.streaming import incremental

D, E = "d" * 64, "e" * 64
PLAN = {
    "scope_id": D, "objective_digest": E, "parent_plan_digest": None, "bases": [{"kind": "observation", "sequence": 3, "digest": D}, {"kind": "prior_revision", "plan_digest": E}],
    "work_specs": [{"work_id": "a", "dependencies": [], "bounds": {"max_attempts": 1, "deadline_unix_ms": 9}}, {"work_id": "b", "dependencies": ["a"], "bounds": {"max_attempts": 2, "deadline_unix_ms": M.MAX_INTEGER}}],
    "reserved_budget_units": 0,
}


def _plan(**changes):
    return R.encode("plan", PLAN | changes)


def _spec(i, work_id="a", deps=(), attempts=1):
    return {"work_id": work_id, "dependencies": list(deps), "bounds": {"max_attempts": attempts, "deadline_unix_ms": 9}}


def test_plan_forms():
    """Every rule of the form refuses, and nothing else does."""
    good = _plan()
    assert R._decoded(R.FORMS["plan"], good) == ("ok", PLAN)
    bad = {
        "prefix": b"x" + good, "cut": good[:-1], "more": good + b"\0", "scope": _plan(scope_id="D" * 64), "units": _plan(reserved_budget_units=-1), "attempts": _plan(work_specs=[_spec(0, attempts=0)]), "slash": _plan(work_specs=[_spec(0, "a/b")]),
        "order": _plan(work_specs=[_spec(0, "b"), _spec(0, "a")]), "twice": _plan(work_specs=[_spec(0), _spec(0)]), "dependencies": _plan(work_specs=[_spec(0, "c", ["b", "a"])]), "repeated": _plan(work_specs=[_spec(0, "c", ["a", "a"])]),
        "bases": _plan(bases=PLAN["bases"][::-1]), "large": _plan(reserved_budget_units=M.MAX_INTEGER + 1), "fields": R.FORMS["plan"].domain + objects.encode_binary({"scope_id": D}), "list": R.FORMS["plan"].domain + objects.encode_binary([1]),
    }
    assert {k: R._decoded(R.FORMS["plan"], v)[0] for k, v in bad.items()} == dict.fromkeys(bad, "malformed")
    assert R._decoded(R.FORMS["plan"], None) == ("absent", None) and R._decoded(R.FORMS["plan"], b"")[0] == "too_large" and R._decoded(R.FORMS["pointer"], bytes(5000))[0] == "too_large"


def test_catalog_rules():
    row = lambda a, b: {"start": a, "end": b, "pack_digest": D}
    code = lambda packs, points=(), version=1: R._decoded(R.FORMS["catalog"], R.encode("catalog", {"version": version, "scope_id": D, "packs": packs, "checkpoints": [{"sequence": s, "digest": D} for s in points]}))[0]
    assert code([row(1, 4), row(5, 5)], [2, 9]) == "ok" and code([]) == "ok"
    assert {code([row(1, 4), row(4, 5)]), code([row(3, 4), row(1, 2)]), code([row(4, 3)]), code([], [2, 2]), code([], [3, 2]), code([], version=2)} == {"malformed"}


def test_records_in_spark(spark):
    content = _plan()
    rows = [(1, content, hashlib.sha256(content).hexdigest(), D), (2, content, E, D), (3, content, hashlib.sha256(content).hexdigest(), E), (4, None, None, None), (5, b"other", E, D)]
    df = spark.createDataFrame(rows, "i int, content binary, digest string, status string")
    got = {r.i: (r.status, r.record) for r in R.decode_records(df, "plan", digest=F.col("digest"), scope=F.col("status")).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: "ok", 2: "reference_mismatch", 3: "unbound", 4: "absent", 5: "malformed"}
    assert got[1][1].work_specs[1].bounds.deadline_unix_ms == M.MAX_INTEGER and got[2][1] is None


def _event(sequence=2, kind="plan_admitted", payload=None, parent=True):
    envelope = {"scope_id": D, "sequence": sequence, "parent_event": {"sequence": sequence - 1, "digest": E} if parent else None, "writer_epoch": 1, "operation_id": "op", "payload_type": kind}
    return R.encode_event(envelope, payload or {"plan_digest": E})


def test_events(spark):
    """An event is read for its key: sequence and digest of the stored bytes have to agree; damaged, foreign and unregistered ones keep a row."""
    good = _event()
    name = lambda b, s=2: f"x/events/{s:016d}-{hashlib.sha256(b).hexdigest()}.cbor.zst"
    grant = _event(3, "grant_activated", {"work_id": "w", "work_revision": 1, "claim_fence": 2, "grant_digest": E, "attempt": 1, "units": 7, "deadline_unix_ms": M.MAX_INTEGER})
    other = zstandard.compress(objects.encode_binary({"envelope": {"scope_id": D, "sequence": 2, "parent_event": None, "writer_epoch": 1, "operation_id": "o", "payload_type": "artifact"}, "payload": {}}))
    streamed = zstandard.ZstdCompressor(write_content_size=False).compress(zstandard.decompress(good))
    rows = [(1, name(good), good), (2, name(good, 3), good), (3, name(b"x"), good), (4, "no key", good), (5, name(grant, 3), grant), (6, name(other), other), (7, name(streamed), streamed), (8, name(b""), b""), (9, name(good[:-2]), good[:-2]), (10, name(good), None)]
    rows += [(11, name(good + good), good + good)]
    got = {r.i: r for r in R.decode_log(spark.createDataFrame(rows, "i int, key string, content binary"), scope=F.lit(D), keep=("i",)).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "reference_mismatch", 3: "reference_mismatch", 4: "reference_mismatch", 5: "ok", 6: "unregistered", 7: "not_canonical", 8: "too_large", 9: "malformed", 10: "absent", 11: "malformed"}
    assert got[1].digest == hashlib.sha256(good).hexdigest() and got[1].plan_digest == E and got[1].parent_digest == E and got[1].units is None
    assert got[5].units == 7 and got[5].deadline_unix_ms == M.MAX_INTEGER and got[2].sequence is None
    assert R.decode_log(spark.createDataFrame(rows[:1], "i int, key string, content binary"), scope=F.lit(E)).first().status == "unbound"


def test_listing_limit(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"o{i}").write_bytes(b"x" * (i + 1))
    assert [r.status for r in objects.read_objects(spark, str(tmp_path), max_keys=3).collect()] == ["ok"] * 3
    assert {r.status for r in objects.read_objects(spark, str(tmp_path), max_keys=2).collect()} == {"over_limit"}


def test_unavailable_is_no_refusal(spark):
    key = "scope_id string, work_id string, work_revision long"
    names = ["ok", "lost", "blind", "gone", "absent", "owner", "size"]
    expected = spark.createDataFrame([("s", n, 1, "p", 2) for n in names], key + ", expected_plan string, minimum_fence long")
    body = {n: f"body {n}".encode() for n in names}
    digest = {n: hashlib.sha256(b).hexdigest() for n, b in body.items()}
    claims = spark.createDataFrame(
        [("s", n, 1, True, n == "lost", "sealed", "p", 2, "me", "node", "op", digest[n], len(body[n]) + (n == "size")) for n in names if n != "absent"],
        key + ", decodes boolean, unavailable boolean, state string, plan_digest string, claim_fence long, owner_actor string, owner_instance string, operation_id string, evidence_digest string, evidence_size long",
    )
    evidence = spark.createDataFrame(
        [(digest[n], n == "blind", None if n == "blind" else bytearray(body[n]), True, "s", n, 1, "p", 2, "you" if n == "owner" else "me", "node", "op") for n in names if n not in ("gone", "absent")],
        "address string, unavailable boolean, content binary, decodes boolean, " + key + ", plan_digest string, claim_fence long, owner_actor string, owner_instance string, operation_id string",
    )
    got = {r.work_id: r.verdict for r in intake.submission_intake(intake.match_submissions(expected, claims, evidence)).collect()}
    assert got == {"ok": "sealed", "lost": "unavailable", "blind": "unavailable", "gone": "missing_evidence", "absent": "absent", "owner": "evidence_mismatch", "size": "evidence_mismatch"}


def test_admission(spark):
    spec = "array<struct<work_id:string,dependencies:array<string>>>"
    plans = spark.createDataFrame(
        [("ok", "p", 1, [("a", []), ("b", ["a"])]), ("self", "p", 1, [("a", ["a"])]), ("unknown", "p", 1, [("a", ["z"])]), ("held", "q", 1, [("a", [])]), ("work", "p", 1, [("a", [])]), ("edges", "p", 1, [("a", []), ("b", [])]), ("again", "p", 1, [("a", []), ("b", ["a", "a"])])],
        f"scope_id string, plan_digest string, revision long, work_specs {spec}",
    )
    work = spark.createDataFrame([("work", "a", 1, "q"), ("edges", "a", 1, "p"), ("edges", "b", 1, "p"), ("again", "a", 1, "p"), ("again", "b", 1, "p")], "scope_id string, work_id string, work_revision long, plan_digest string")
    deps = spark.createDataFrame([(s, "b", 1, "a", 1) for s in ("edges", "again")], "scope_id string, work_id string, work_revision long, depends_on_work_id string, depends_on_work_revision long")
    scopes = spark.createDataFrame([("held", "p"), ("again", "p"), ("ok", None)], "scope_id string, active_plan_digest string")
    got = {r.scope_id: r.verdict for r in fold.admission_verdicts(plans, work, deps, scopes).collect()}
    assert got == {"ok": "ok", "self": "self_edge", "unknown": "unknown_dependency", "held": "plan_held", "work": "work_conflict", "edges": "edge_conflict", "again": "ok"}


def test_pack_status_and_ranges(spark):
    log = spark.createDataFrame([("s", i, hashlib.sha256(bytes([i] * 10)).hexdigest(), bytearray([i] * 10)) for i in range(1, 7) if i != 4], "scope_id string, sequence long, digest string, payload binary")
    packs = accel.build_packs(log.filter("sequence < 4"), "payload").unionByName(accel.build_packs(log.filter("sequence > 4"), "payload"))
    asked = spark.createDataFrame([("s", 1, 6), ("s", 2, 3), ("s", 4, 6)], "scope_id string, first long, last long")
    got = sorted((r.first, r.sequence) for r in accel.read_ranges(asked, packs).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]  # a gap ends a range
    assert sorted((r.first, r.sequence) for r in accel.read_ranges(asked, packs, 20).collect()) == [(1, 1), (1, 2), (2, 2), (2, 3)]
    short = packs.withColumn("digests", F.expr("slice(digests, 1, size(digests) - 1)"))
    assert {r.status for r in accel.pack_status(packs).collect()} == {"ok"} and {r.status for r in accel.pack_status(short).collect()} == {"bad_offsets"}


def test_projection_classes(spark):
    rows = [("a", None, None, None, None), ("b", True, None, True, 0), ("c", True, "projection", None, 0), ("d", True, "projection", True, 2), ("e", True, "projection", True, None)]
    got = audit.classify_projections(spark.createDataFrame(rows, "scope_id string, present boolean, application string, schema_ok boolean, violations long"))
    assert {r.scope_id: r.state for r in got.collect()} == {"a": "missing", "b": "foreign", "c": "rebuildable", "d": "rebuildable", "e": "valid"}


def test_certificates_and_tallies(spark):
    log = spark.createDataFrame([("s", 5, D, "projection_checkpoint_published"), ("s", 6, E, "plan_admitted")], "scope_id string, sequence long, digest string, payload_type string")
    c = spark.createDataFrame([("s", 5, D, 4), ("s", 5, D, 3), ("s", 6, E, 5), ("s", 5, E, 4)], "scope_id string, sequence long, digest string, covered_sequence long")
    assert sorted(r.verdict for r in publish.certified(c, log).collect()) == ["certified", "misplaced", "uncommitted", "uncommitted"]
    tallies, inventory = spark.createDataFrame([("a", 2), ("b", 1)], "path string, targets long"), spark.createDataFrame([("a",), ("a",), ("c",)], "path string")
    assert sorted(tuple(r) for r in publish.tally_differences(tallies, inventory).collect()) == [("b", 1, 0), ("c", 0, 1)]


def test_artifacts_and_checkpoints(spark):
    body = b"body"
    digest = hashlib.sha256(body).hexdigest()
    rows = [("new", 4, digest, body), ("same", 4, digest, body), ("other", 4, digest, body), ("size", 5, digest, body), ("digest", 4, D, body), ("large", 11, hashlib.sha256(b"x" * 11).hexdigest(), b"x" * 11), ("none", 0, D, None)]
    artifacts = spark.createDataFrame(rows, "key string, size long, digest string, content binary")
    held = spark.createDataFrame([("same", digest), ("other", D)], "key string, digest string")
    got = {r.key: (r.verdict, r.witness_size) for r in publish.publish_artifacts(held, artifacts, 10).collect()}
    assert got == {"new": ("created", 4), "same": ("already_same", 4), "other": ("conflict", 4), "size": ("unverified", None), "digest": ("unverified", None), "large": ("too_large", None), "none": ("unverified", None)}
    # of the newest two at or below the head: one beyond the head, one whose snapshot is damaged, one that is good, and a good one that is too old
    log = spark.createDataFrame([("s", n, f"d{n}", "projection_checkpoint_published") for n in (2, 4, 6, 9)], "scope_id string, sequence long, digest string, payload_type string")
    candidates = spark.createDataFrame([("s", n, f"d{n}", n - 1, digest if n != 6 else D, 4) for n in (2, 4, 6, 9)], "scope_id string, sequence long, digest string, covered_sequence long, snapshot_digest string, snapshot_length long")
    heads = spark.createDataFrame([("s", 8), ("t", 3)], "scope_id string, sequence long")
    snapshots = spark.createDataFrame([("s", digest, body), ("s", D, b"else")], "scope_id string, address string, content binary")
    install = lambda limit: {r.scope_id: (r.covered_sequence, r.suffix) for r in publish.install_checkpoints(candidates, heads, log, snapshots, limit).collect()}
    assert install(2) == {"s": (3, 5), "t": (None, 3)} and install(1) == {"s": (None, 8), "t": (None, 3)}


def test_stream_limit(monkeypatch):
    """A scope's lifetime is bounded, so is its state: events beyond the bound are refused and change nothing."""
    import pandas as pd

    monkeypatch.setattr(M, "MAX_EVENTS", 2)
    rows = [(1, "d1", None, 1, "o1", "root_genesis", None), (2, "d2", "d1", 1, "o2", "artifact_reference", None), (3, "d3", "d2", 1, "o3", "artifact_reference", None)]
    frame = pd.DataFrame(rows, columns=["sequence", "digest", "parent_digest", "writer_epoch", "operation_id", "payload_type", "plan_digest"])
    assert incremental.advance(None, frame) == (None, 0, "over_limit")
    state, applied, verdict = incremental.advance(None, frame[:2])
    assert (state[0], applied, verdict) == (2, 2, "applied") and incremental.advance(state, frame[2:]) == (state, 0, "over_limit")


@pytest.mark.parametrize("limit", [0, 1, 5, 9])
def test_bounded_text(spark, limit):
    rng = random.Random(limit)
    texts = [None, "", *("".join(rng.choice("aé中\U0001f600") for _ in range(rng.randint(0, 6))) for _ in range(60))]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", scalar.bounded_text(F.col("text"), limit).alias("t")).collect()}
    assert all(got[i] == (None if t is None else t.encode()[:limit].decode(errors="ignore")) for i, t in enumerate(texts))


def test_segments_by_bytes(spark):
    rng = random.Random(3)
    logs = {s: [rng.randint(1, 60) for _ in range(rng.randint(1, 40))] for s in "abcdef"}
    got = accel.segments_by_bytes(spark.createDataFrame([(s, i + 1, b) for s, x in logs.items() for i, b in enumerate(x)], "scope_id string, sequence long, stored_bytes long"), 5, 100)
    want = []
    for s, sizes in logs.items():
        packs = [[]]
        for i, b in enumerate(sizes, 1):
            if packs[-1] and (len(packs[-1]) == 5 or sum(x for _, x in packs[-1]) + b > 100):
                packs.append([])
            packs[-1].append((i, b))
        want += [(s, k, p[0][0], p[-1][0], len(p), sum(x for _, x in p)) for k, p in enumerate(packs)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_overlaps_meet_in_bins(spark):
    """Each overlapping pair once, however many bins it shares; ranges that are empty, nested or without a pack keep their row."""
    rng = random.Random(3)
    packs = [(rng.choice("ab"), a, a + rng.choice([0, 3, 40])) for a in (rng.randint(1, 300) for _ in range(80))]
    asks = [(rng.choice("abc"), a, a + rng.choice([-2, 0, 5, 90])) for a in (rng.randint(1, 300) for _ in range(40))]
    p = spark.createDataFrame(packs, "scope_id string, start long, end long")
    q = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "i int, scope_id string, first long, last long")
    want = sorted((i, a, b) for i, (s, first, last) in enumerate(asks) for t, a, b in packs if s == t and a <= last and b >= first)
    for width in (7, 64, 4096):
        assert sorted((r.i, r.start, r.end) for r in accel.overlaps(q, p, width=width).collect()) == want
    held = {(s, n) for s, a, b in packs for n in range(a, b + 1)}
    named = p.withColumnsRenamed({"start": "first_sequence", "end": "last_sequence"})
    rows = accel.coverage(q.select("scope_id", "first", "last").distinct(), named).collect()
    assert len(rows) == len(set(asks))
    for r in rows:
        if r.first <= r.last:
            assert r.covered == all((r.scope_id, n) in held for n in range(r.first, r.last + 1)), r


def test_packs_outside_the_ranges_stay_closed(spark):
    """With ten times the packs and the same requests the same packs are opened, and events meet requests through their bins: work grows with the packs, not with packs times requests."""
    def at(n):
        log = spark.range(1, n + 1).select(F.lit("s").alias("scope_id"), F.col("id").alias("sequence"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))
        packs = accel.build_packs(log, "payload")
        asks = spark.createDataFrame([("s", 300, 310), ("s", 500, 530), ("t", 1, 4)], "scope_id string, first long, last long")
        ranges = packs.select("scope_id", F.col("first_sequence").alias("start"), F.col("last_sequence").alias("end"))
        many = spark.range(0, n, 256).select(F.lit("s").alias("scope_id"), (F.col("id") + 1).alias("first"), (F.col("id") + 2).alias("last"))
        met = accel.overlaps(many, ranges).count()
        rows = sorted((r.sequence, r.running_bytes) for r in accel.read_ranges(asks, packs).collect())
        return sorted(r.first_sequence for r in accel.needed_packs(asks, packs).collect()), rows, met

    (few, rows, met), (more, same, met_more) = at(2_560), at(25_600)
    assert few == more == [257, 513] and rows == same and len(rows) == 42 and (met, met_more) == (10, 100)


def test_namespace_of_stored_records(spark):
    """Records stored under another namespace decode with it and with no other; kinds without a prefix have none."""
    raw = R.encode("plan", PLAN, b"house.")
    assert raw.startswith(b"house.plan.proposal\0") and R.encode("pointer", {"version": 1, "scope_id": D, "catalog_digest": D}, b"house.") == R.encode("pointer", {"version": 1, "scope_id": D, "catalog_digest": D})
    df = spark.createDataFrame([(raw,)], "content binary")
    assert R.decode_records(df, "plan", namespace=b"house.").first().status == "ok"
    assert R.decode_records(df, "plan").first().status == "malformed" == R.decode_records(df, "plan", namespace=b"home.").first().status


def test_gate_of_size_and_facts(spark):
    """Size is asked after the budget, facts of another scope before their digest; what the gate refuses isn't admitted, nor what an older epoch admits."""
    scopes = spark.createDataFrame([("s", "o", None, 3, 5), ("t", "o", None, 3, 5)], "scope_id string, objective_digest string, active_plan_digest string, sequence long, scope_epoch long")
    log = spark.createDataFrame([("s", 1, "d1", "root_genesis", "s"), ("t", 1, "d1", "root_genesis", "s")], "scope_id string, sequence long, digest string, payload_type string, fact_scope_id string")
    cases = [("s", "fine", "o", 5, 100, "d1"), ("s", "large", "o", 5, M.PLAN_BYTES + 1, "d1"), ("s", "both", "o", M.MAX_INTEGER + 1, M.PLAN_BYTES + 1, "d1"), ("s", "edge", "o", 5, M.PLAN_BYTES, "d1"), ("t", "cross", "o", 5, 100, "zz"), ("s", "stale", "o", 5, 100, "zz"), ("s", "older", "o", 5, 100, "d1")]
    proposals = spark.createDataFrame([(s, p, o, None, units, size, [("observation", d, 1)]) for s, p, o, units, size, d in cases], "scope_id string, plan_digest string, objective_digest string, parent_plan_digest string, reserved_budget_units long, stored_bytes long, bases array<struct<kind:string,digest:string,sequence:long>>")
    graphs = spark.createDataFrame([(c[1], "valid") for c in cases], "plan_digest string, verdict string")
    gate = graph.proposal_gate(proposals, scopes, log, graphs)
    want = {"fine": "admissible", "large": "plan_too_large", "both": "budget_out_of_range", "edge": "admissible", "cross": "cross_scope_basis", "stale": "stale_basis", "older": "admissible"}
    assert {r.plan_digest: r.verdict for r in gate.collect()} == want
    plans = spark.createDataFrame([(c[0], c[1], 1, 4 if c[1] == "older" else 5, [("w", [])]) for c in cases if c[1] != "edge"], "scope_id string, plan_digest string, revision long, epoch long, work_specs array<struct<work_id:string,dependencies:array<string>>>")
    work = spark.createDataFrame([], "scope_id string, work_id string, work_revision long, plan_digest string")
    deps = spark.createDataFrame([], "scope_id string, work_id string, work_revision long, depends_on_work_id string, depends_on_work_revision long")
    got = {r.plan_digest: r.verdict for r in fold.admission_verdicts(plans, work, deps, scopes, gate).collect()}
    assert got == {"fine": "ok", "older": "stale_epoch"} | dict.fromkeys(("large", "both", "cross", "stale"), "gate_refused")
    assert {r.verdict for r in fold.admission_verdicts(plans.drop("epoch"), work, deps, scopes).collect()} == {"ok"}
