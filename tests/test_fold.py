import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import accel, audit, fold, graph, measure, verify
from ledgerloom.sources import objects, sinks
from ledgerloom.streaming import incremental

SCHEMA = "scope_id string, sequence long, digest string, parent_digest string, operation_id string, writer_epoch long, payload_type string, plan_digest string, stored_bytes long"


def chain(scope, n, plan=True):
    rows, before = [], None
    for i in range(1, n + 1):
        kind = "root_genesis" if i == 1 else "plan_admitted" if i == 2 and plan else "projection_checkpoint_published"
        rows.append((scope, i, f"{scope}-{i}", before, f"op-{scope}-{i}", 1 + i // 4, kind, f"plan-{scope}" if kind == "plan_admitted" else None, 100))
        before = f"{scope}-{i}"
    return rows


def heads(spark, rows):
    last = {}
    for r in rows:
        if r[0] not in last or r[1] > last[r[0]][1]:
            last[r[0]] = r
    return spark.createDataFrame([(s, r[1], r[2], r[4], r[5] + 1, None) for s, r in last.items()], "scope_id string, sequence long, tail_event_digest string, operation_id string, scope_epoch long, active_plan_digest string")


FAULTS = {
    "valid": lambda r: r, "broken_chain": lambda r: [x for x in r if x[1] != 4], "reference_mismatch": lambda r: [*r[:-1], (*r[-1][:2], "forged", *r[-1][3:])], "unregistered_payload": lambda r: [(*x[:6], "artifact", *x[7:]) if x[1] == 5 else x for x in r],
    "operation_repeated": lambda r: [(*x[:4], r[2][4], *x[5:]) if x[1] == 6 else x for x in r], "epoch_regression": lambda r: [(*x[:5], 9, *x[6:]) if x[1] == 4 else x for x in r][:], "root_rule": lambda r: [(*x[:6], "root_genesis", *x[7:]) if x[1] == 5 else x for x in r],
}


@pytest.mark.parametrize("fault", FAULTS)
def test_verdicts(spark, fault):
    good = chain("s", 8)
    h = heads(spark, good)
    if fault == "epoch_regression":
        h = h.withColumn("scope_epoch", F.lit(20).cast("long"))
    got = verify.chain_verdicts(spark.createDataFrame(FAULTS[fault](good), SCHEMA), h).collect()
    assert [r.verdict for r in got] == [fault]


def test_whole_suffix_or_nothing(spark):
    bad = FAULTS["broken_chain"](chain("b", 6))
    log = spark.createDataFrame(chain("a", 5) + bad, SCHEMA)
    kept = fold.valid_only(log, verify.chain_verdicts(log, heads(spark, chain("a", 5) + bad)))
    assert {r.scope_id: r.sequence for r in fold.fold_cursors(kept).collect()} == {"a": 5}


def test_repeats_are_no_ops(spark):
    rows = chain("a", 5)
    clean, conflicts = fold.idempotent(spark.createDataFrame([*rows, rows[2], (*rows[3][:2], "other", *rows[3][3:])], SCHEMA))
    assert sorted(r.sequence for r in clean.collect()) == [1, 2, 3, 5] and [r.sequence for r in conflicts.collect()] == [4]


def test_claims(spark):
    ops = [("s", "w", 1, *o) for o in [(0, 3, 100, 0), (1, 2, 900, 0), (2, 3, 50, 0), (3, 3, 200, 0), (4, 4, 300, 150), (5, 4, 300, 200), (6, 3, 999, 999)]]
    (r,) = fold.fold_claims(spark.createDataFrame(ops, "scope_id string, work_id string, work_revision long, arrival long, fence long, lease_until long, now_ms long")).collect()
    assert (r.claim_fence, r.claim_lease_until, r.refused) == (4, 300, 4)


def test_claims_and_terminal_evidence(spark):
    """Evidence needs the claim's own fence; afterwards only the same evidence passes, and no claim."""
    ops = [(0, 3, 100, 0, None), (1, 2, 0, 0, "x"), (2, 3, 0, 0, "x"), (3, 3, 0, 0, "y"), (4, 3, 0, 0, "x"), (5, 3, 500, 0, None), (6, 9, 900, 999, None)]
    (r,) = fold.fold_claims(spark.createDataFrame([("s", "w", 1, *o) for o in ops], "scope_id string, work_id string, work_revision long, arrival long, fence long, lease_until long, now_ms long, terminal_result_digest string")).collect()
    assert (r.claim_fence, r.claim_lease_until, r.terminal_result_digest, r.refused) == (3, 100, "x", 4)
    (r,) = fold.fold_claims(spark.createDataFrame([("s", "w", 1, 0, 3, 0, 0, "x")], "scope_id string, work_id string, work_revision long, arrival long, fence long, lease_until long, now_ms long, terminal_result_digest string")).collect()
    assert (r.claim_fence, r.terminal_result_digest, r.refused) == (None, None, 1)


def test_restore(spark):
    """Only fresh rows and equal fences with a later lease: a higher fence over a recorded lease, terminal work, other plans and sealed claims are skipped."""
    rows = [("fresh", None, None, None), ("equal", 4, 50, None), ("longer", 4, 500, None), ("higher", 3, 50, None), ("closed", None, None, "t"), ("plan", None, None, None), ("sealed", None, None, None), ("none", None, None, None)]
    work = spark.createDataFrame([("s", w, 1, "p", f, l, t) for w, f, l, t in rows], "scope_id string, work_id string, work_revision long, plan_digest string, claim_fence long, claim_lease_until long, terminal_result_digest string")
    claims = spark.createDataFrame([("s", w, 1, "sealed" if w == "sealed" else "active", "q" if w == "plan" else "p", 4, 100) for w, *_ in rows[:-1]], "scope_id string, work_id string, work_revision long, state string, plan_digest string, claim_fence long, lease_until long")
    got = {r.work_id: (r.claim_fence, r.claim_lease_until) for r in fold.restore_claims(work, claims).collect()}
    assert got == {"fresh": (4, 100), "equal": (4, 100), "longer": (4, 500), "higher": (3, 50), "closed": (None, None), "plan": (None, None), "sealed": (None, None), "none": (None, None)}


def test_batches_extend_heads(spark):
    rows = chain("a", 8)
    head = heads(spark, rows[:5]).withColumn("scope_epoch", F.lit(rows[5][5]).cast("long"))
    tail = [(*x[:5], rows[5][5], *x[6:]) for x in rows[5:]]
    assert [r.accepted for r in verify.batch_verdicts(spark.createDataFrame(tail, SCHEMA), head).collect()] == [True]
    assert [r.accepted for r in verify.batch_verdicts(spark.createDataFrame(tail[1:], SCHEMA), head).collect()] == [False]


def test_packs(spark):
    log = spark.createDataFrame(chain("a", 300), SCHEMA)
    assert [(r.first_sequence, r.last_sequence) for r in accel.segments(log).orderBy("pack").collect()] == [(1, 256), (257, 300)]
    assert [(r.first_sequence, r.last_sequence) for r in accel.segments_by_bytes(log, 256, 1_050).orderBy("pack").limit(2).collect()] == [(1, 10), (11, 20)]
    body = log.select("scope_id", "sequence", F.sha2("digest", 256).alias("digest"), F.encode("digest", "UTF-8").alias("payload"))
    packs = accel.build_packs(body, "payload")
    assert accel.read_packs(packs).count() == 300
    torn = packs.withColumn("events", F.when(F.col("first_sequence") == 1, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("events")))
    assert accel.read_packs(torn).count() == 44
    ranges = spark.createDataFrame([("a", 1, 10), ("a", 11, 20), ("a", 31, 40)], "scope_id string, first_sequence long, last_sequence long")
    asks = spark.createDataFrame([("a", 3, 20), ("a", 3, 31), ("a", 41, 50), ("a", 31, 40)], "scope_id string, first long, last long")
    assert {(r["first"], r["last"]): (r.covered, r.packs) for r in accel.coverage(asks, ranges).collect()} == {(3, 20): (True, 2), (3, 31): (False, 0), (41, 50): (False, 0), (31, 40): (True, 1)}
    assert [(r.first_sequence, r.last_sequence) for r in accel.gaps(spark.createDataFrame([("a", 45)], "scope_id string, sequence long"), ranges).orderBy("first_sequence").collect()] == [(21, 30), (41, 45)]
    assert [r.valid for r in accel.catalog_valid(ranges.unionByName(ranges.filter("first_sequence = 31").withColumn("first_sequence", F.lit(40).cast("long")))).collect()] == [False]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = chain("a", 20) + chain("b", 9) + chain("c", 15, plan=False)
    cuts = sorted(rows, key=lambda r: r[1] + rng.random() * 0.1)
    source = tmp_path / "in"
    for k in range(0, len(cuts), 11):
        part = [r for r in cuts[k : k + 11]] + ([cuts[3]] if k else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    incremental.run_available(stream, str(tmp_path / "ck"), lambda df, i: seen.extend(df.collect()))
    last = {}
    for r in seen:
        last[r.scope_id] = (r.sequence, r.digest, r.writer_epoch, r.active_plan_digest)
    batch = {r.scope_id: (r.sequence, r.tail_event_digest, r.writer_epoch, r.active_plan_digest) for r in fold.fold_cursors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert last == batch and {r.verdict for r in seen} <= {"applied", "duplicate"}


def test_stream_refusals():
    frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    rows = chain("a", 6)
    state, n, verdict = incremental.advance(None, frame(rows[:3]))
    assert (n, verdict) == (3, "applied")
    assert incremental.advance(state, frame(rows[4:])) == (state, 0, "gap")
    assert incremental.advance(state, frame([(*rows[1][:2], "other", *rows[1][3:])])) == (state, 0, "conflict")
    assert incremental.advance(state, frame(rows[:2]))[1:] == (0, "duplicate")
    assert incremental.advance(state, frame([*rows[3:5], (*rows[5][:3], "wrong", *rows[5][4:])])) == (state, 0, "conflict")


def test_graphs(spark):
    plans = {"valid": [("a", []), ("b", ["a"])], "cyclic_dependency": [("a", ["b"]), ("b", ["a"])], "unknown_dependency": [("a", ["x"])], "duplicate_work": [("a", []), ("a", [])], "cyclic": [("a", ["a"])]}
    df = spark.createDataFrame([(p, w, d) for p, specs in plans.items() for w, d in specs], "plan_digest string, work_id string, dependencies array<string>")
    assert {r.plan_digest: r.verdict for r in graph.proposal_graph(df).collect()} == {p: p for p in plans} | {"cyclic": "cyclic_dependency"}


# Path vectors.
PATHS = [
    (b"src/main.rs", "src/main.rs"), (b"src/Main.rs", "src/main.rs"), (b"src/caf\xc3\xa9.rs", "src/café.rs"), (b"src/cafe\xcc\x81.rs", "src/café.rs"), (b"src/stra\xc3\x9fe.rs", "src/strasse.rs"), (b"src/strasse.rs", "src/strasse.rs"), (b"src/\xffbad.rs", "REJECT:invalid-utf8"),
    (b"src/../etc/passwd", "REJECT:dot-component"), (b"src/.", "REJECT:dot-component"), (b"src/a\x01b.rs", "REJECT:control-char"), (b"src/a\x7fb.rs", "REJECT:control-char"), (b'src/a"b.rs', "REJECT:forbidden-char"), (b"src/a\\b.rs", "REJECT:forbidden-char"), (b"src//main.rs", "REJECT:empty-component"),
    (b"src/" + b"a" * 177, "REJECT:path-too-long"), (b"src/" + b"a" * 176, "src/" + "a" * 176), (b"a/b/c/d/e/f/g/h/i/j/k.rs", "REJECT:path-too-deep"), (b"src/.git/config", "REJECT:git-component"), (b"a/b/c/d/e/f/g/h/i/j.rs", "a/b/c/d/e/f/g/h/i/j.rs"),
]


def test_paths(spark):
    assert [graph.path_key(raw) for raw, _ in PATHS] == [want for _, want in PATHS]
    df = spark.createDataFrame([(bytearray(raw),) for raw, _ in PATHS], "path binary")
    assert {(r.key, r.paths) for r in graph.path_collisions(df).collect()} == {("src/main.rs", 2), ("src/café.rs", 2), ("src/strasse.rs", 2)}


def test_groups_and_classes(spark):
    targets = spark.createDataFrame([("a", i, 1) for i in range(17)] + [("b", 1, i) for i in range(3)], "path string, line int, col int")
    assert sorted((r.path, r.group_no, r.targets) for r in graph.target_groups(targets).collect()) == [("a", 0, 8), ("a", 1, 8), ("a", 2, 1), ("b", 0, 3)]
    said = spark.createDataFrame([(1, 0, 9), (1, 1, 4), (1, 2, 4), (1, 3, 2), (2, 0, 1)], "run_seq long, emission long, span long")
    same = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 3)], "run_seq long, a long, b long")
    assert sorted(tuple(r) for r in graph.equivalence_classes(said, same).collect()) == [(1, 0, 0, False), (1, 1, 1, False), (1, 2, 0, True), (1, 3, 1, True), (2, 0, 0, True)]


def test_measures(spark):
    g = spark.createDataFrame([(1, 10, "supported", "supported"), (1, 11, "incorrect", "incorrect"), (1, 12, "supported", "incorrect"), (2, 1, "supported", "unresolved")], "run_seq long, artifact long, judge_one string, judge_two string")
    assert {r.run_seq: (r.supported, r.incorrect, r.unresolved, r.useful_artifacts, r.incorrect_rate) for r in measure.grades(g).collect()} == {1: (1, 1, 1, 1, 0.5), 2: (0, 0, 1, 0, 1.0)}
    spans = spark.createDataFrame([(r, *x) for r in (1, 2) for x in [("queued", 0, 10), ("busy", 3, 5), ("busy", 4, 6)]], "run_seq long, kind string, start_ms long, end_ms long")
    runs = spark.createDataFrame([(1, "C"), (2, "A"), (3, "C")], "run_seq long, cell string")
    assert sorted(tuple(r) for r in measure.idle(spans, runs).collect()) == [(1, 7), (2, 0), (3, 0)]
    m = spark.createDataFrame([("p", c, w) for c, w in [("A", 100), ("C", 50)] for _ in range(5)], "pilot string, cell string, wall_ms long")
    assert [r.speedup for r in measure.scaling(m).orderBy("cell").collect()] == [1.0, 2.0]


def test_cost(spark):
    """Cached input is input; beyond 272,000 input tokens twice the input and one and a half times the output price; unknown models leave the sum unknown."""
    rows = [(1, "treatment", "model-one", 200_000, 72_000, 10), (2, "treatment", "model-one", 200_000, 72_001, 10), (3, "treatment", "model-two", 1, 0, 1), (3, "measurement", "model-two", 0, None, 2), (4, "treatment", "model-two", 1, 0, 1), (4, "treatment", "other", 1, 0, 1)]
    calls = spark.createDataFrame(rows, "run_seq long, phase string, model string, input_tokens long, cached_input_tokens long, output_tokens long")
    costs = measure.cost(calls)
    assert {(r.run_seq, r.phase): (r.nano_usd, r.unpriced, r.calls) for r in costs.collect()} == {
        (1, "treatment"): (272_000 * 5000 + 10 * 25_000, 0, 1), (2, "treatment"): (272_001 * 10_000 + 10 * 37_500, 0, 1), (3, "treatment"): (35_000, 0, 1), (3, "measurement"): (60_000, 0, 1), (4, "treatment"): (None, 1, 2),
    }
    resolved = spark.createDataFrame([(1, 0), (3, 2), (4, 1), (5, 3)], "run_seq long, resolved long")
    assert {r.run_seq: r.nano_usd_per_target for r in measure.cost_per_resolved(costs, resolved).collect()} == {1: None, 3: 47_500, 4: None, 5: None}


def test_wall_clock(spark):
    """Research runs from the first action of an agent (not from ready) to the end of treatment, change from start to the end of measurement."""
    runs = spark.createDataFrame([(1, "research", "A", 0, 100, 130), (2, "change", "A", 5, 100, 130), (3, "research", "C", 0, 100, 130)], "run_seq long, pilot string, cell string, start_ms long, treatment_end_ms long, measurement_end_ms long")
    records = spark.createDataFrame([(1, "ready", 2), (1, "model_call", 9), (1, "dispatch", 7), (2, "dispatch", 50), (3, "integration_attempt", 1)], "run_seq long, record string, ts_ms long")
    assert {r.run_seq: r.wall_ms for r in measure.wall_clock(runs, records).collect()} == {1: 93, 2: 125, 3: None}


def test_zero_rules(spark):
    candidates = spark.createDataFrame([(1, False, False, False), (2, True, True, True), (2, True, False, False)], "run_seq long, judged boolean, corrected boolean, rejected boolean")
    integrations = spark.createDataFrame([(2, "conflict"), (2, "integrated"), (3, "conflict")], "run_seq long, outcome string")
    assert {r.run_seq: tuple(r)[1:] for r in measure.rates(candidates, integrations).collect()} == {1: (None, 0.0, None), 2: (0.5, 0.5, 0.5), 3: (None, None, 1.0)}
    reference = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 2, False), (2, 3, True)], "run_seq long, item long, struck boolean")
    matched, runs = spark.createDataFrame([(2, 2)], "run_seq long, item long"), spark.createDataFrame([(1,), (2,)], "run_seq long")
    assert {r.run_seq: tuple(r)[1:] for r in measure.omission(reference, matched, runs).collect()} == {1: (0, 0, 0.0), 2: (1, 2, 0.5)}
    counts = spark.createDataFrame([(1, 0, "p", "A", 4), (2, 0, "p", "C", 14), (3, 0, "q", "A", 0), (4, 0, "q", "B", 3)], "run_seq long, campaign long, pilot string, cell string, outcome long")
    assert {r.run_seq: r.efficiency for r in measure.efficiency(counts).collect()} == {1: 1.0, 2: 0.5, 3: None, 4: None}


def test_decisions(spark):
    """A, B and C in turn: outcome, incorrect rate, omission rate, rediscovery."""
    cases = {
        "success": ("research", (3, 0.2, 0.2, True), (4, 0.2, 0.2, False), 5), "inconclusive": ("research", (3, 0.2, 0.2, True), (4, 0.3, 0.2, True), 5), "failure": ("research", (3, 0.2, 0.2, True), (4, 0.3, 0.3, True), 5),
        "fewer": ("research", (3, 0.2, 0.2, True), (2, 0.0, 0.0, True), 5), "change": ("change", (3, 0.2, 0.2, False), (4, 0.9, 0.9, True), 5), "unclean": ("change", (3, 0.0, 0.0, True), (4, 0.0, 0.0, False), 5), "equal": ("change", (3, 0.0, 0.0, True), (3, 0.0, 0.0, True), 5),
        "short": ("change", (3, 0.0, 0.0, True), (4, 0.0, 0.0, True), 4),
    }
    rows = [(name, pilot, cell, k < n or cell != "B", *values) for name, (pilot, a, c, n) in cases.items() for cell, values in (("A", a), ("B", a), ("C", c)) for k in range(5)]
    m = spark.createDataFrame(rows, "campaign string, pilot string, cell string, measured boolean, outcome long, incorrect_rate double, omission_rate double, passed boolean")
    want = {"success": "success", "inconclusive": "inconclusive", "failure": "failure", "fewer": "failure", "change": "success", "unclean": "failure", "equal": "inconclusive", "short": "budget_stopped"}
    assert {r.campaign: r.verdict for r in measure.decide(m).collect()} == want


def test_targets_and_caps(spark):
    runs = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "run_seq long, campaign long")
    inventory = spark.createDataFrame([(9, "a", False), (9, "b", False), (9, "c", True)], "campaign long, target string, exempt boolean")
    checks = spark.createDataFrame([(1, "a", True, True), (1, "a", True, False), (1, "b", True, True), (2, "a", False, True)], "run_seq long, target string, resolved boolean, passed boolean")
    done = spark.createDataFrame([(1, "a"), (1, "c")], "run_seq long, target string")
    assert sorted(tuple(r) for r in measure.resolutions(inventory, checks, done, runs).collect()) == [(1, 1, 1), (2, 0, 2), (3, 0, 0)]
    found = spark.createDataFrame([(1, True), (2, False)], "run_seq long, exempt boolean")
    reports = spark.createDataFrame([(1, "d", "d"), (2, "d", "d"), (3, "x", "d"), (4, None, "d")], "run_seq long, rule_digest string, expected_digest string")
    assert {r.run_seq: r.verdict for r in measure.rediscovery(found, reports).collect()} == {1: "pass", 2: "fail", 3: "fail", 4: "fail"}
    follow = spark.createDataFrame([(1, 1, "a", "b"), (1, 1, "a", "b"), (1, 2, "a", "a"), (2, 3, None, None)], "run_seq long, followup long, class_before string, class_after string")
    assert {r.run_seq: r.discriminating for r in measure.discriminating(follow).collect()} == {1: 1, 2: 0}
    usage = spark.createDataFrame([(1, "A", 2.0, 400), (2, "A", 2.5, 401), (3, "C", 2.5, None)], "run_seq long, cell string, hours double, calls long")
    assert {r.run_seq: (r.exceeded, r.status) for r in measure.caps(usage).collect()} == {1: ([], "within"), 2: (["calls", "hours"], "unresolved"), 3: ([], "within")}


def test_null_rules_of_checks(spark):
    d = "a" * 64
    rows = [(d, "w", 1, d, 1, 1, 1, None, None, None, None, None, None, None, None), (d, "x", 1, d, 1, 1, 1, 3, None, None, None, None, None, None, None), (d, "y/z", 1, "A" * 64, 1, 1, 1, None, None, 1, d, 1, 1, None, d)]
    from ledgerloom import model as M

    got = {(r.check_id, r.key.split("|")[1]) for r in audit.work_checks(spark.createDataFrame(rows, M.WORK)).collect()}
    assert got == {("work.claim", "x"), ("work.work_id", "y/z"), ("work.plan", "y/z"), ("work.grant", "y/z"), ("work.terminal", "y/z")}
    log = spark.createDataFrame([("s", None, 1), ("s", None, 1), ("s", "k", 1), ("s", "k", 1)], "scope_id string, kind string, attempt long")
    assert [r["rows"] for r in audit.duplicates(log, ["scope_id", "kind", "attempt"], "x").collect()] == [2]


def test_records(spark):
    good = '{"campaign_id":"c","scope_id":"s","controller_instance_id":null,"scope_epoch":1,"lease_until":null,"sequence":1,"tail_event_digest":"' + "a" * 64 + '","active_plan_digest":null,"operation_id":"o"}'
    cases = [(good, "ok"), (None, "absent"), ("{", "malformed"), (good.replace('"operation_id"', '"other"'), "malformed"), (good.replace(":1,", ": 1,"), "not_canonical"), (good.replace('"lease_until":null', '"lease_until":5'), "unbound"), (good.replace('"s"', '"t"'), "unbound")]
    df = spark.createDataFrame([(i, j, "s") for i, (j, _) in enumerate(cases)], "i int, json string, scope string")
    assert [r.status for r in objects.bound_heads(df, "json", "scope").orderBy("i").collect()] == [w for _, w in cases]


def test_binary_events(spark):
    import zstandard

    env = {"scope_id": "s", "sequence": 2, "parent_event": {"sequence": 1, "digest": "d"}, "writer_epoch": 1, "operation_id": "o", "payload_type": "plan_admitted"}
    raw = objects.encode_binary({"envelope": env, "payload": {"plan_digest": "p" * 300, "n": [1, -5, 70000, None, True, b"x"]}})
    assert objects.encode_binary(objects.decode_binary(raw)) == raw
    pack = zstandard.ZstdCompressor().compress
    long_form = raw.replace(b"\x68sequence\x02", b"\x68sequence\x18\x02")
    files = [(pack(raw), "ok"), (None, "absent"), (b"junk", "malformed"), (pack(raw + b"\0"), "malformed"), (pack(long_form), "malformed"), (pack(b"\0" * (1 << 20) + b"\0"), "too_large"), (pack(raw.replace(b"writer_epoch", b"writer_epocx")), "malformed")]
    got = objects.decode_events(spark.createDataFrame([(i, bytearray(f) if f else None) for i, (f, _) in enumerate(files)], "i int, content binary")).orderBy("i").collect()
    assert [r.event_status for r in got] == [w for _, w in files] and got[0].envelope.parent_digest == "d"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "1")], "key string, digest string")
    new = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("b", "3")], "key string, digest string")
    rows, verdicts = sinks.create_only(old, new)
    assert [tuple(r) for r in rows.collect()] == [("b", "3")]
    assert sorted((r.key, r.digest, r.verdict) for r in verdicts.collect()) == [("a", "1", "already_same"), ("a", "2", "conflict"), ("b", "3", "already_same"), ("b", "3", "created"), ("b", "4", "conflict")]
    now = spark.createDataFrame([("k", "t1")], "key string, tag string")
    tries = spark.createDataFrame([("k", "t1", 2, "t3"), ("k", "t1", 1, "t2"), ("k", "t0", 0, "t9"), ("z", "t", 0, "u")], "key string, observed string, arrival int, proposed string")
    v = sinks.compare_and_swap(now, tries)
    assert {r.proposed: r.verdict for r in v.collect()} == {"t2": "committed", "t3": "precondition_failed", "t9": "precondition_failed", "u": "not_found"}
    assert [r.tag for r in sinks.apply_swaps(now, v).collect()] == ["t2"]
    sinks.publish(now, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        sinks.publish(now, str(tmp_path / "t"))
    assert sinks.markdown(now) == "| key | tag |\n| --- | --- |\n| k | t1 |"


def test_objects(spark, tmp_path):
    for i, n in enumerate((10, 4096, 4097)):
        (tmp_path / f"k{i}").write_bytes(b"x" * n)
    got = objects.read_objects(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.status for r in got] == ["ok", "ok", "too_large"] and got[2].content is None
    # a listing of more keys than allowed is refused, not cut
    assert [r.status for r in objects.read_objects(spark, str(tmp_path), start_after=got[0].path, max_keys=1).collect()] == ["over_limit"] * 2
    assert [r.status for r in objects.read_objects(spark, str(tmp_path), start_after=got[1].path, max_keys=1).collect()] == ["too_large"]


def test_queue(spark):
    q = spark.createDataFrame([("q", i) for i in range(5)], "queue string, arrival long")
    assert [r.verdict for r in incremental.intake_queue(q, 2, 4).orderBy("arrival").collect()] == ["accepted", "accepted", "overloaded", "overloaded", "stopped"]


def test_upsert_keeps_the_stored_epoch(spark):
    """A refused admission changes nothing, whatever its epoch; authority below the projected epoch admits nothing."""
    rows = [("a", 1, "p", 1, 0), ("a", 2, "other", 6, 0), ("a", 3, "p", 3, 0), ("a", 4, "p", 2, 0), ("b", 1, "p", 1, 2), ("b", 2, "q", 4, 2), ("c", 1, "p", 1, 2)]
    frame = spark.createDataFrame([("s", w, 1, plan, e, pe, at) for w, at, plan, e, pe in rows], "scope_id string, work_id string, work_revision long, plan_digest string, epoch long, projected_epoch long, arrival long")
    got = {r.work_id: (r.plan_digest, r.epoch, r.conflicts) for r in fold.upsert_work(frame).collect()}
    assert got == {"a": ("p", 3, 2), "b": ("q", 4, 1), "c": (None, None, 1)}
    assert {r.work_id: (r.plan_digest, r.epoch, r.conflicts) for r in fold.upsert_work(frame.drop("projected_epoch")).collect()} == {"a": ("p", 3, 2), "b": ("p", 1, 1), "c": ("p", 1, 0)}
