import pytest
from pyspark.sql import functions as F

from ledgerloom import model as M
from ledgerloom.operators import intake, lookups, scheduling

D = {c: c * 64 for c in "0123456789abcdef"}


def work(spark, *rows):
    base = {f.name: None for f in M.WORK.fields} | {"scope_id": D["1"], "work_revision": 1, "plan_digest": D["a"], "admitted_scope_epoch": 1, "max_attempts": 3, "deadline_unix_ms": 100_000}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in M.WORK.fields) for r in rows], M.WORK)


def scopes(spark, **more):
    base = {f.name: None for f in M.SCOPES.fields} | {"scope_id": D["1"], "campaign_id": "c", "sequence": 2, "tail_event_digest": D["2"], "active_plan_digest": D["a"], "scope_epoch": 2, "objective_digest": D["3"], "reserved_budget_units": 100, "claims_restored": 1}
    return spark.createDataFrame([tuple((base | more)[f.name] for f in M.SCOPES.fields)], M.SCOPES)


def deps(spark, *pairs):
    return spark.createDataFrame([(D["1"], a, 1, b, 1) for a, b in pairs], M.DEPENDENCIES)


def names(df):
    return {r.work_id for r in df.collect()}


@pytest.mark.parametrize(("a", "b", "now", "want"), [
    ({}, {}, 1_000, {"a"}),
    ({"claim_fence": 1, "claim_lease_until": 500, "terminal_result_digest": D["f"]}, {}, 1_000, {"b"}),
    ({"claim_fence": 1, "claim_lease_until": 500, "terminal_result_digest": D["f"]}, {"claim_fence": 1, "claim_lease_until": 31_000}, 1_000, set()),
    ({"claim_fence": 1, "claim_lease_until": 500, "terminal_result_digest": D["f"]}, {"claim_fence": 1, "claim_lease_until": 31_000}, 31_000, {"b"}),
    ({"claim_fence": 1, "claim_lease_until": 500, "terminal_result_digest": D["f"]}, {"claim_fence": 1, "claim_lease_until": 500, "terminal_result_digest": D["e"]}, 99_999, set()),
    ({}, {}, 99_999, {"a"}), ({}, {}, 100_000, set()),
])
def test_dependencies_gate_claims(spark, a, b, now, want):
    w = work(spark, {"work_id": "a"} | a, {"work_id": "b"} | b)
    assert names(scheduling.claimable(w, deps(spark, ("b", "a")), scopes(spark), now)) == want


def test_no_plan_no_work(spark):
    w = work(spark, {"work_id": "a"})
    assert names(scheduling.claimable(w, deps(spark), scopes(spark, active_plan_digest=None, reserved_budget_units=None), 1)) == set()
    assert names(scheduling.claimable(w, deps(spark), scopes(spark, active_plan_digest=D["b"]), 1)) == set()


GRANTED = {"claim_fence": 4, "claim_lease_until": 50_000, "grant_fence": 4, "grant_digest": D["9"], "granted_attempt": 1, "granted_units": 10, "grant_deadline_unix_ms": 40_000}


@pytest.mark.parametrize(("row", "epoch", "now", "want"), [
    ({}, 2, 39_999, [("a", "continuable")]), ({}, 2, 40_000, []), ({"claim_lease_until": 30_000}, 2, 30_000, []), ({"grant_fence": 3}, 2, 1, []), ({"admitted_scope_epoch": 3}, 2, 1, []), ({}, 1, 1, [(None, "stale_authority")]),
])
def test_continuable(spark, row, epoch, now, want):
    got = scheduling.continuable(work(spark, {"work_id": "a"} | GRANTED | row), scopes(spark), spark.createDataFrame([(D["1"], epoch)], "scope_id string, epoch long"), now).collect()
    assert [(r.work_id, r.verdict) for r in got] == want


def request(spark, *rows):
    base = {"scope_id": D["1"], "work_id": "a", "work_revision": 1, "fence": 4, "plan_digest": D["a"], "deadline_unix_ms": 40_000, "epoch": 2, "attempt": 1, "units": 40, "request_digest": D["8"], "key": 0}
    return spark.createDataFrame([base | r for r in rows], "scope_id string, work_id string, work_revision long, fence long, plan_digest string, deadline_unix_ms long, epoch long, attempt long, units long, request_digest string, key long")


CLAIMED = {"claim_fence": 4, "claim_lease_until": 50_000}


@pytest.mark.parametrize(("row", "ask", "want"), [
    ({}, {"units": 41}, False), ({}, {}, True), ({}, {"fence": 3}, False), ({}, {"attempt": 4}, False), ({}, {"epoch": 1}, False), ({}, {"plan_digest": D["b"]}, False), ({}, {"deadline_unix_ms": 100_001}, False), ({}, {"deadline_unix_ms": 1_000}, False),
    ({"claim_lease_until": 1_000}, {}, False), ({"terminal_result_digest": D["f"]}, {}, False), ({"claim_fence": None, "claim_lease_until": None}, {}, False),
    (GRANTED, {}, False), (GRANTED, {"request_digest": D["9"]}, True), (GRANTED | {"grant_fence": 3}, {"attempt": 2, "units": 30}, True), (GRANTED | {"grant_fence": 3}, {"attempt": 1, "units": 30}, False),
])
def test_grant_admissible(spark, row, ask, want):
    w = work(spark, {"work_id": "a"} | CLAIMED | row, {"work_id": "s"} | GRANTED | {"granted_units": 60})
    assert [r.admissible for r in scheduling.grant_admissible(request(spark, ask), w, scopes(spark), 1_000).collect()] == [want]


def test_refused_requests_draw_nothing(spark):
    w = work(spark, *({"work_id": x} | CLAIMED for x in "abc"), {"work_id": "s"} | GRANTED | {"granted_units": 60})
    asks = request(spark, {"work_id": "a", "units": 30, "key": 1}, {"work_id": "b", "units": 20, "key": 2}, {"work_id": "c", "units": 10, "key": 3})
    got = scheduling.admit_in_order(asks, w, scopes(spark), 1_000, "key").collect()
    assert {r.work_id: r.admitted for r in got} == {"a": True, "b": False, "c": True}


def log(spark, *rows):
    base = {f.name: None for f in M.EVENTS.fields} | {"scope_id": D["1"], "digest": D["4"], "operation_id": "op", "writer_epoch": 1, "manifest_digest": None}
    fields = [f.name for f in M.EVENTS.fields] + ["manifest_digest"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in M.EVENTS.fields) + ", manifest_digest string"
    return spark.createDataFrame([tuple((base | r)[n] for n in fields) for r in rows], schema)


def test_artifacts(spark):
    bind = {"work_id": "a", "work_revision": 1, "attempt": 1, "grant_digest": D["9"]}
    ref = lambda n, kind, **m: bind | {"sequence": n, "payload_type": "artifact_reference", "artifact_kind": f"invocation_{kind}", "artifact_digest": D["7"], "operation_id": f"o{n}"} | m
    rows = [
        ref(2, "manifest"), bind | {"sequence": 3, "payload_type": "grant_activated"}, ref(4, "trace", manifest_digest=D["6"]), ref(5, "manifest", artifact_digest=D["6"], attempt=2), bind | {"sequence": 6, "payload_type": "grant_activated", "attempt": 2, "operation_id": "x"},
        ref(7, "manifest", attempt=2, artifact_digest=D["6"]), ref(8, "trace", attempt=2, manifest_digest=D["6"]), ref(9, "trace", attempt=2, manifest_digest=D["6"]), ref(10, "manifest", work_id="z"),
    ]
    got = {r.sequence: r.verdict for r in scheduling.artifact_admissible(log(spark, *rows), work(spark, {"work_id": "a"})).collect()}
    assert got == {2: "unresolvable", 4: "manifest_missing", 5: "unresolvable", 7: "duplicate", 8: "admissible", 9: "duplicate", 10: "unresolvable"}


def test_probe(spark):
    rows = log(spark, {"sequence": 2, "payload_type": "grant_activated", "operation_id": "g", "grant_digest": D["9"]}, {"sequence": 3, "payload_type": "plan_admitted", "operation_id": "p"})
    asks = spark.createDataFrame([(D["1"], "g", D["9"]), (D["1"], "g", D["8"]), (D["1"], "p", D["9"]), (D["1"], "n", D["9"])], "scope_id string, operation_id string, grant_digest string")
    assert [r.verdict for r in scheduling.grant_probe(asks, rows).orderBy("operation_id", "grant_digest").collect()] == ["foreign_operation", "activated", "absent", "foreign_operation"]


@pytest.mark.parametrize(("lease", "stop", "renew"), [(5_999, True, True), (6_000, False, True), (21_000, False, True), (21_001, False, False), (0, True, True)])
def test_lease_margins(spark, lease, stop, renew):
    r = spark.createDataFrame([("s", lease)], "scope_id string, lease_until long")
    assert [tuple(x)[1:] for x in lookups.authority_times(r, 1_000).collect()] == [(stop, renew)]


def test_outcomes(spark):
    base = {"call_id": 0, "error": None, "status_ok": True, "prior_unknown": False, "reason": "end_turn", "text": "hi", "has_use": True, "input_tokens": 5, "output_tokens": 2, "total_tokens": 7, "cache_read_tokens": None, "cap": 10}
    cases = [
        ({}, "completed"), ({"reason": "tool_use"}, "refused"), ({"reason": "new_reason"}, "refused"), ({"reason": "content_filtered", "total_tokens": 1}, "refused"), ({"output_tokens": 11, "total_tokens": 16}, "malformed_response"), ({"total_tokens": 6}, "malformed_response"), ({"input_tokens": 0, "total_tokens": 2}, "malformed_response"),
        ({"input_tokens": 0, "total_tokens": 2, "cache_read_tokens": 4}, "completed"), ({"text": None}, "malformed_response"), ({"text": ""}, "completed"), ({"text": "", "reason": "max_tokens"}, "malformed_response"), ({"output_tokens": 0}, "malformed_response"), ({"has_use": False, "output_tokens": 0}, "completed"),
        ({"error": "construction"}, "proven_not_sent"), ({"error": "construction", "prior_unknown": True}, "unknown"), ({"error": "throttling"}, "rate_limited"), ({"error": "odd"}, "malformed_response"), ({"error": "odd", "status_ok": False}, "unknown"), ({"error": "access_denied"}, "unauthorized"),
    ]
    df = spark.createDataFrame([base | c | {"call_id": i} for i, (c, _) in enumerate(cases)], "call_id int, error string, status_ok boolean, prior_unknown boolean, reason string, text string, has_use boolean, input_tokens long, output_tokens long, total_tokens long, cache_read_tokens long, cap long")
    assert [r.outcome for r in intake.classify_outcome(df).orderBy("call_id").collect()] == [w for _, w in cases]


def test_mutations(spark):
    cases = [(200, False, "committed"), (-1, False, "proven_not_sent"), (-1, True, "unknown"), (404, True, "not_found"), (409, False, "conflict"), (412, False, "precondition_failed"), (412, True, "ambiguous_conflict"), (500, False, "unknown"), (None, False, "unknown")]
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(cases)], "i int, s int, p boolean")
    assert [r.o for r in df.select("i", intake.mutation_outcome(F.col("s"), F.col("p")).alias("o")).orderBy("i").collect()] == [w for *_, w in cases]
