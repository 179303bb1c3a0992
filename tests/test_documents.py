import json

import pytest

from ledgerloom.sources import documents as D

HEX = "ab" * 32
WHERE = {"workspace_id": "w", "campaign_id": "c", "scope_id": HEX, "work_id": "work-1", "work_revision": 1}
EVIDENCE = {"digest": HEX, "size": 7, "media_type": "application/json", "producer_attempt": "1", "creation_time_unix_ms": 5, "retention_class": None}


def _claim(record="scope_claim", state=None, **changed):
    doc = {"record": record, "campaign_id": "c", "scope_id": HEX, "plan_digest": HEX, "work_id": "work-1", "work_revision": 1, "claim_fence": 3, "owner_actor": "actor", "owner_instance": "node", "operation_id": "op \"é\"", "state": state or {"state": "active", "lease_until": 9}}
    return doc | changed


def _grant(**changed):
    return {"record": "effect_grant", "campaign_id": "c", "scope_id": HEX, "plan_digest": HEX, "work_id": "work-1", "work_revision": 1, "claim_fence": 3, "action": "write", "resource_scope": "repo", "attempt": 1, "limit_units": 10, "deadline_unix_ms": 99, "operation_id": "op"} | changed


def _text(doc):
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def _statuses(spark, decode, docs, key):
    rows = [(i, d if d is None or isinstance(d, str) else _text(d), k or key, *WHERE.values()) for i, (d, k) in enumerate(docs)]
    frame = spark.createDataFrame(rows, "i int, content string, key string, workspace_id string, campaign_id string, scope_id string, work_id string, work_revision long")
    out = decode(frame).orderBy("i").collect()
    assert all((r.record is not None) == (r.status == "ok") for r in out)
    return [r.status for r in out], out


SEALED = {"state": "sealed", "submission": EVIDENCE}


def _shared(make, name):
    good = make()
    return [
        (good, None, "ok"), (None, None, "absent"), ("", None, "limit_exceeded"), (_text(good) + " " * 5000, None, "limit_exceeded"), ("{", None, "malformed"), ("[]", None, "malformed"), ("null", None, "malformed"), (good | {"more": 1}, None, "malformed"),
        ({k: v for k, v in good.items() if k != "operation_id"}, None, "malformed"), (make(work_revision="1"), None, "malformed"), (make(claim_fence=3.0), None, "malformed"), (make(claim_fence=-3), None, "malformed"), (make(claim_fence=2**64), None, "malformed"),
        (make(operation_id=None), None, "malformed"), (_text(good)[:-1] + ',"record":"x"}', None, "malformed"), (json.dumps(good), None, "not_canonical"), (dict(reversed(good.items())), None, "not_canonical"), (_text(good).replace("work-1", "work\\u002d1"), None, "not_canonical"),
        (make(record="other"), None, "unbound"), (make(campaign_id="d"), None, "unbound"), (make(scope_id="cd" * 32), None, "unbound"), (make(work_id="work-2"), None, "unbound"), (make(work_revision=2), None, "unbound"),
        (make(plan_digest="AB" * 32), None, "invalid_value"), (make(claim_fence=0), None, "invalid_value"), (make(claim_fence=10**16), None, "invalid_value"), (make(operation_id=""), None, "invalid_value"), (make(operation_id="a/b"), None, "invalid_value"), (make(operation_id="é" * 65), None, "invalid_value"),
    ]


def test_claims(spark):
    sealed = lambda **e: _claim(state={"state": "sealed", "submission": EVIDENCE | e})
    cases = _shared(_claim, "claims") + [
        (_claim(state=SEALED), None, "ok"), (sealed(retention_class="long"), None, "ok"), (sealed(size=0), None, "ok"), (sealed(digest="x"), None, "invalid_value"), (sealed(media_type=""), None, "invalid_value"), (sealed(retention_class=""), None, "invalid_value"),
        (_claim(state={"state": "active", "lease_until": 0}), None, "invalid_value"), (_claim(state={"state": "sealed", "lease_until": 9}), None, "malformed"), (_claim(state={"state": "active", "submission": EVIDENCE}), None, "malformed"), (_claim(state={"state": "open"}), None, "malformed"),
        (_claim(state={"lease_until": 9, "state": "active"}), None, "not_canonical"), (_claim(owner_actor="a/b"), None, "invalid_value"), (_claim(), "elsewhere", "reference_mismatch"), (_claim(record="sealed_submission", state=SEALED), None, "unbound"), (sealed(producer_attempt=1), None, "malformed"),
    ]
    got, rows = _statuses(spark, D.decode_claims, [c[:2] for c in cases], f"workspace/w/campaigns/c/scopes/{HEX}/claims/work-1/1")
    assert got == [c[2] for c in cases]
    first, sealed = rows[0].record, rows[len(_shared(_claim, ""))].record
    assert (first.state, first.lease_until, first.submission, first.operation_id) == ("active", 9, None, "op \"é\"") and (sealed.state, sealed.lease_until, sealed.submission.asDict()) == ("sealed", None, EVIDENCE)


def test_submissions(spark):
    cases = [(_claim("sealed_submission", SEALED), "ok"), (_claim("sealed_submission"), "invalid_value"), (_claim(state=SEALED), "unbound"), (_claim("sealed_submission", SEALED, owner_instance=""), "invalid_value")]
    got, _ = _statuses(spark, D.decode_submissions, [(d, "anywhere") for d, _ in cases], "")
    assert got == [s for _, s in cases]


def test_grants(spark):
    cases = _shared(_grant, "grants") + [(_grant(attempt=0), None, "invalid_value"), (_grant(limit_units=0), None, "invalid_value"), (_grant(deadline_unix_ms=10**16), None, "invalid_value"), (_grant(action="a/b"), None, "invalid_value"), (_grant(claim_fence=4), None, "reference_mismatch")]
    got, rows = _statuses(spark, D.decode_grants, [c[:2] for c in cases], f"workspace/w/campaigns/c/scopes/{HEX}/grants/work-1/1/3")
    assert got == [c[2] for c in cases]
    assert rows[0].record.asDict() == _grant()


@pytest.mark.parametrize("decode", [D.decode_claims, D.decode_submissions, D.decode_grants])
def test_no_python(spark, decode):
    frame = spark.createDataFrame([], "content string, key string, workspace_id string, campaign_id string, scope_id string, work_id string, work_revision long")
    plan = decode(frame)._jdf.queryExecution().executedPlan().toString()
    assert decode(frame).collect() == [] and "Python" not in plan and "Arrow" not in plan
