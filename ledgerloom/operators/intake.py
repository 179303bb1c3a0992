"""Intake and transition verdicts: the first failing rule names the outcome, by one ordered CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import model as M
from .lookups import must_stop


def submission_intake(claims: DataFrame) -> DataFrame:
    """Sealed submissions: claim row, expected binding and evidence body joined beforehand (``match_submissions`` does); absent parts are null.

    With the columns claim_unavailable and evidence_unavailable, a read that failed is no refusal but ``unavailable``.
    """
    failed = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in claims.columns else F.lit(False)
    verdict = (
        F.when(failed("claim_unavailable"), "unavailable").when(F.col("record").isNull(), "absent").when(~F.coalesce("decodes", F.lit(False)), "malformed").when(F.col("state") != "sealed", "not_sealed").when(~F.col("plan_digest").eqNullSafe(F.col("expected_plan")), "identity_mismatch")
        .when(F.col("claim_fence") < F.col("minimum_fence"), "stale_fence").when(failed("evidence_unavailable"), "unavailable").when(F.col("stored_digest").isNull(), "missing_evidence")
        .when((F.col("stored_size") != F.col("evidence_size")) | (F.col("stored_digest") != F.col("evidence_digest")) | ~F.col("same_binding"), "evidence_mismatch").otherwise("sealed")
    )
    return claims.select("scope_id", "work_id", "work_revision", verdict.alias("verdict"))


def match_submissions(expected: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Expected bindings with their claim object and the sealed submission it names, side by side for ``submission_intake``.

    ``expected`` has the key, expected_plan and minimum_fence; ``claims`` the key, decodes, unavailable, state,
    plan_digest, claim_fence, owner_actor, owner_instance, operation_id, evidence_digest and evidence_size;
    ``evidence`` one row per object: address, unavailable, content, decodes, and the identity that the submission
    in it states (scope_id, work_id, work_revision, plan_digest, claim_fence, owner_actor, owner_instance, operation_id).
    """
    key = ["scope_id", "work_id", "work_revision"]
    identity = [*key, "plan_digest", "claim_fence", "owner_actor", "owner_instance", "operation_id"]
    c = claims.withColumnRenamed("unavailable", "claim_unavailable").withColumn("record", F.lit("claim"))
    said = evidence.select(
        F.col("address").alias("evidence_digest"), F.col("unavailable").alias("evidence_unavailable"), F.sha2("content", 256).alias("stored_digest"), F.octet_length("content").cast("long").alias("stored_size"),
        F.coalesce("decodes", F.lit(False)).alias("evidence_decodes"), *(F.col(x).alias(f"said_{x}") for x in identity),
    )
    same = F.col("evidence_decodes")
    for x in identity:
        same = same & F.col(x).eqNullSafe(F.col(f"said_{x}"))
    return expected.join(c, key, "left").join(said, "evidence_digest", "left").withColumn("same_binding", F.coalesce(same, F.lit(False)))


def match_grants(expected: DataFrame, objects: DataFrame) -> DataFrame:
    """Expected grants with the object under their key, side by side for ``grant_intake``.

    ``expected`` has the key, fence, plan_digest, action, resource_scope, attempt, operation_id, max_units and
    max_deadline_unix_ms; ``objects`` the key, fence, unavailable, too_large, content, decodes and what the grant in it states.
    """
    key = ["scope_id", "work_id", "work_revision", "fence"]
    identity = ["plan_digest", "claim_fence", "action", "resource_scope", "attempt", "operation_id"]
    said = objects.select(*key, "unavailable", "limit_units", "deadline_unix_ms", F.lit(True).alias("there"), (F.coalesce("decodes", F.lit(False)) & ~F.coalesce("too_large", F.lit(False))).alias("readable"), F.sha2("content", 256).alias("object_digest"), *(F.col(x).alias(f"said_{x}") for x in identity))
    same = F.lit(True)
    for x in identity:
        same = same & F.col("fence" if x == "claim_fence" else x).eqNullSafe(F.col(f"said_{x}"))
    j = expected.join(said, key, "left")
    return j.select(
        *key, F.coalesce("unavailable", F.lit(False)).alias("unavailable"), F.col("there").isNotNull().alias("found"), F.coalesce("readable", F.lit(False)).alias("decodes"), same.alias("same_identity"), "deadline_unix_ms", "limit_units", "max_units", "max_deadline_unix_ms", "object_digest"
    )


def grant_intake(grants: DataFrame, continuable: DataFrame, heads: DataFrame, now_ms: int) -> DataFrame:
    """Grant objects against what was expected, the controller's authority and the continuable row.

    ``grants`` has scope_id, work_id, work_revision, fence, found, decodes, same_identity, deadline_unix_ms,
    limit_units, max_units, max_deadline_unix_ms and object_digest.  An accepted grant carries the stop
    time: the shorter lease less the margin.  With the column ``unavailable``, a read that failed is no refusal.
    """
    failed = F.coalesce(F.col("unavailable"), F.lit(False)) if "unavailable" in grants.columns else F.lit(False)
    rows = continuable.filter("verdict = 'continuable'").select("scope_id", "work_id", "work_revision", F.col("claim_fence").alias("row_fence"), F.col("grant_digest").alias("row_digest"), F.col("claim_lease_until").alias("row_lease"))
    stale = continuable.filter("verdict = 'stale_authority'").select("scope_id", F.lit(True).alias("stale")).distinct()
    j = grants.join(heads.select("scope_id", "lease_until"), "scope_id", "left").join(rows, ["scope_id", "work_id", "work_revision"], "left").join(stale, "scope_id", "left")
    verdict = (
        F.when(F.col("lease_until").isNull() | must_stop(F.col("lease_until"), now_ms), "stale_authority").when(failed, "unavailable").when(~F.col("found"), "absent").when(~F.col("decodes"), "malformed").when(~F.col("same_identity"), "identity_mismatch")
        .when(F.col("deadline_unix_ms") <= now_ms, "expired").when((F.col("limit_units") > F.col("max_units")) | (F.col("deadline_unix_ms") > F.col("max_deadline_unix_ms")), "wider_than_requested")
        .when(F.col("stale"), "stale_authority").when(F.col("row_fence").isNull() | (F.col("row_lease") <= now_ms), "revoked")
        .when(F.col("row_fence") == F.col("fence"), F.when(F.col("row_digest") == F.col("object_digest"), "accepted").otherwise("identity_mismatch")).when(F.col("row_fence") > F.col("fence"), "stale_fence").otherwise("revoked")
    )
    stop = F.greatest(F.least("lease_until", "row_lease") - M.STOP_MARGIN_MS, F.lit(0))
    return j.select("scope_id", "work_id", "work_revision", verdict.alias("verdict"), F.when(verdict == "accepted", stop).alias("authority_stop_unix_ms"))


def effect_authorize(effects: DataFrame, now_ms: int) -> DataFrame:
    """Whether an accepted grant covers a request, and for how long: identity, tokens within units, stop and deadline ahead."""
    verdict = (
        F.when(~F.col("same_identity"), "identity_mismatch").when(F.col("request_tokens") > F.col("limit_units"), "narrower_than_request").when(F.col("authority_stop_unix_ms") <= now_ms, "stale_authority")
        .when(F.col("deadline_unix_ms") <= now_ms, "expired").otherwise("authorized")
    )
    left = F.least("deadline_unix_ms", "authority_stop_unix_ms") - now_ms
    return effects.select("scope_id", "work_id", "work_revision", verdict.alias("verdict"), F.when(verdict == "authorized", left).alias("remaining_ms"))


def authority_transition(heads: DataFrame, current: DataFrame, instance: str, now_ms: int) -> DataFrame:
    """What acquiring each scope comes to, given the head then (``heads``) and the head read back (``current``)."""
    c = current.select("scope_id", F.col("controller_instance_id").alias("now_owner"), F.col("scope_epoch").alias("now_epoch"))
    j = heads.join(c, "scope_id", "left")
    held = F.coalesce((F.col("controller_instance_id") != instance) & (F.col("lease_until") > now_ms), F.lit(False))
    epoch = F.col("scope_epoch") + 1
    verdict = F.when(held, "held").when((F.col("now_owner") == instance) & (F.col("now_epoch") == epoch), "acquired").when(F.col("now_epoch") >= epoch, "superseded").otherwise("unresolved")
    return j.select("scope_id", verdict.alias("verdict"), F.when(~held, epoch).alias("candidate_epoch"))


def resolve_head(candidates: DataFrame) -> DataFrame:
    """Five-way verdict of a commit whose answer was lost: candidate, parent and current head in one row."""
    same_op = F.col("current_operation") == F.col("operation_id")
    agrees = (F.col("current_tail") == F.col("tail")) & F.col("current_plan").eqNullSafe(F.col("plan")) & (F.col("current_epoch") >= F.col("epoch")) & F.col("same_bytes")
    verdict = (
        F.when(F.col("current_operation").isNull(), F.when(F.col("parent_operation").isNull(), "retry_identically").otherwise("unresolved"))
        .when(same_op, F.when(agrees, "committed").otherwise("unresolved")).when(F.col("parent_is_current"), "retry_identically")
        .when(F.col("parent_operation") == F.col("current_operation"), "unresolved").otherwise("reconcile")
    )
    return candidates.select("scope_id", verdict.alias("verdict"))


def mutation_outcome(status: Column, prior_unknown: Column) -> Column:
    """Outcome of a conditional write from its status (null: no answer, -1: never built) and whether an earlier send may have landed."""
    return (
        F.when(status.between(200, 299), "committed").when((status == -1) & ~prior_unknown, "proven_not_sent").when(status == 404, "not_found").when(status.isin(409, 412) & prior_unknown, "ambiguous_conflict")
        .when(status == 409, "conflict").when(status == 412, "precondition_failed").otherwise("unknown")
    )


# The provider's stop reasons and our names for them.
STOP_REASONS = {
    "end_turn": "end_turn", "stop_sequence": "stop_sequence", "max_tokens": "cap_reached", "model_context_window_exceeded": "context_window_exceeded", "content_filtered": "content_filtered",
    "guardrail_intervened": "guardrail_intervened", "malformed_model_output": "model_output_malformed", "malformed_tool_use": "model_output_malformed", "tool_use": "tool_use_requested",
}
# Reasons after which no text is a completion.
PRECLUDING = ("context_window_exceeded", "content_filtered", "guardrail_intervened", "model_output_malformed", "tool_use_requested", "unrecognized")
# Outcomes of failed calls by error name.
ERRORS = {
    "throttling": "rate_limited", "service_unavailable": "rate_limited", "model_not_ready": "rate_limited", "model_timeout": "timed_out", "timeout": "timed_out", "validation": "rejected", "resource_not_found": "rejected",
    "access_denied": "unauthorized", "internal_server": "unknown", "model_error": "unknown", "dispatch": "unknown",
}


def stop_reason(reason: Column) -> Column:
    out = F.lit("unrecognized")
    for name, ours in STOP_REASONS.items():
        out = F.when(reason == name, ours).otherwise(out)
    return out


def credible_use(input_tokens: Column, output_tokens: Column, total: Column, cache_read: Column) -> Column:
    """Counts that a response can mean: none negative, the total not below its parts, no input only with a cache read."""
    positive = (input_tokens >= 0) & (output_tokens >= 0) & (total >= 0) & F.coalesce(cache_read >= 0, F.lit(True))
    return positive & (total >= input_tokens + output_tokens) & ((input_tokens > 0) | (F.coalesce(cache_read, F.lit(0)) > 0))


def classify_outcome(calls: DataFrame) -> DataFrame:
    """Outcome of each model call: error (null if answered), status_ok, prior_unknown, reason, text, has_use, counts and cap."""
    reason = stop_reason(F.col("reason"))
    use = F.col("has_use") & credible_use(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens"), F.col("cache_read_tokens")) & (F.col("output_tokens") <= F.col("cap"))
    unreadable = F.col("has_use") & ~use
    empty = F.col("text") == ""
    credible = F.when(empty & (reason != "cap_reached"), True).otherwise(~empty & (~F.col("has_use") | (F.col("output_tokens") > 0)))
    failed = F.lit(None).cast("string")
    for name, outcome in ERRORS.items():
        failed = F.when(F.col("error") == name, outcome).otherwise(failed)
    outcome = (
        F.when(F.col("error") == "construction", F.when(F.col("prior_unknown"), "unknown").otherwise("proven_not_sent")).when(failed.isNotNull(), failed).when(F.col("error").isNotNull(), F.when(F.col("status_ok"), "malformed_response").otherwise("unknown"))
        .when(reason.isin(*PRECLUDING), "refused").when(unreadable, "malformed_response").when(F.col("text").isNull() | ~credible, "malformed_response").otherwise("completed")
    )
    return calls.select("call_id", reason.alias("terminal_reason"), outcome.alias("outcome"))


def shutdown_tally(owned: DataFrame) -> DataFrame:
    """What a shutdown left of each scope's work (scope_id, fate), in the order of its phases: shed, resolved, unresolved, reaped."""
    return owned.groupBy("scope_id").agg(*(F.count_if(F.col("fate") == f).alias(f) for f in ("shed", "resolved", "unresolved", "reaped")))
