"""Scheduling and budget decisions over admitted work.

Clocks are parameters; refusals are verdict columns.  Scopes are joined, not broadcast by hand: the
planner knows their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEY = ["scope_id", "work_id", "work_revision"]


def _plans(scopes: DataFrame) -> DataFrame:
    return scopes.filter(F.col("active_plan_digest").isNotNull()).select("scope_id", F.col("active_plan_digest").alias("plan_digest"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by scope and work id, as callers that take the first few want them; the lists themselves are relations without order."""
    return rows.orderBy("scope_id", "work_id", "work_revision")


def claimable(work: DataFrame, deps: DataFrame, scopes: DataFrame, now_ms: int) -> DataFrame:
    """Work that may be claimed: in time, without terminal evidence or live lease, in the active plan, every dependency resolved."""
    open_ = work.filter((F.col("deadline_unix_ms") > now_ms) & F.col("terminal_result_digest").isNull() & (F.col("claim_lease_until").isNull() | (F.col("claim_lease_until") <= now_ms)))
    done = work.filter(F.col("terminal_result_digest").isNotNull()).select("scope_id", F.col("work_id").alias("depends_on_work_id"), F.col("work_revision").alias("depends_on_work_revision"))
    blocked = deps.join(done, ["scope_id", "depends_on_work_id", "depends_on_work_revision"], "left_anti").select(*KEY).distinct()
    return open_.join(_plans(scopes), ["scope_id", "plan_digest"], "left_semi").join(blocked, KEY, "left_anti").select(*KEY)


def continuable(work: DataFrame, scopes: DataFrame, authorities: DataFrame, now_ms: int) -> DataFrame:
    """Work that a restart continues under each scope's authority epoch (scope_id, epoch); a projection ahead of the epoch gives the row stale_authority instead."""
    gate = authorities.select("scope_id", "epoch").join(scopes.select("scope_id", "scope_epoch"), "scope_id")
    live = work.filter(
        (F.col("deadline_unix_ms") > now_ms) & F.col("terminal_result_digest").isNull() & (F.col("claim_lease_until") > now_ms) & (F.col("grant_fence") == F.col("claim_fence")) & (F.col("grant_deadline_unix_ms") > now_ms)
    ).join(_plans(scopes), ["scope_id", "plan_digest"], "left_semi")
    rows = live.join(gate.filter("scope_epoch <= epoch"), "scope_id").filter("admitted_scope_epoch <= epoch")
    none = F.lit(None)
    stale = gate.filter("scope_epoch > epoch").select("scope_id", none.cast("string").alias("work_id"), none.cast("long").alias("work_revision"), none.cast("long").alias("claim_fence"), none.cast("string").alias("grant_digest"), none.cast("long").alias("claim_lease_until"), F.lit("stale_authority").alias("verdict"))
    return rows.select(*KEY, "claim_fence", "grant_digest", "claim_lease_until", F.lit("continuable").alias("verdict")).unionByName(stale)


def grant_admissible(requests: DataFrame, work: DataFrame, scopes: DataFrame, now_ms: int) -> DataFrame:
    """Dry run of each request against the state as it is; the draw of sibling revisions is the scope's sum less the own part."""
    return _judged(requests, work, scopes, now_ms).select(*KEY, "request_digest", "admissible")


def _judged(requests: DataFrame, work: DataFrame, scopes: DataFrame, now_ms: int) -> DataFrame:
    """The requests' rows with their verdict."""
    drawn = F.coalesce("granted_units", F.lit(0))
    total = F.sum(drawn).over(Window.partitionBy("scope_id"))
    own = work.withColumn("own", drawn).withColumn("siblings", total - drawn)
    cols = [c for c in own.columns if c not in KEY]
    w = own.select(*KEY, *(F.col(c).alias(f"w_{c}") for c in cols))
    s = scopes.select("scope_id", "active_plan_digest", "reserved_budget_units", "scope_epoch")
    j = requests.join(w, KEY, "left").join(s, "scope_id", "left")
    repeat = (F.col("w_grant_fence") == F.col("fence")) & (F.col("w_grant_digest") == F.col("request_digest"))
    ok = (
        F.col("w_terminal_result_digest").isNull() & (F.col("w_claim_fence") == F.col("fence")) & (F.col("w_claim_lease_until") > now_ms) & (F.col("w_deadline_unix_ms") >= F.col("deadline_unix_ms"))
        & (F.col("deadline_unix_ms") > now_ms) & (F.col("attempt") <= F.col("w_max_attempts"))
        & (F.col("w_grant_fence").isNull() | ((F.col("w_grant_fence") < F.col("fence")) & (F.col("attempt") > F.col("w_granted_attempt"))) | (repeat & (F.col("attempt") == F.col("w_granted_attempt"))))
        & (F.col("w_own") + F.when(F.coalesce(repeat, F.lit(False)), 0).otherwise(F.col("units")) + F.col("w_siblings") <= F.col("reserved_budget_units"))
        & (F.col("active_plan_digest") == F.col("plan_digest")) & (F.col("scope_epoch") <= F.col("epoch"))
    )
    return j.select(*(requests[c] if c not in KEY else F.col(c) for c in requests.columns), F.coalesce(ok, F.lit(False)).alias("admissible"))


def admit_in_order(requests: DataFrame, work: DataFrame, scopes: DataFrame, now_ms: int, order_col: str) -> DataFrame:
    """Requests admitted one after another within a scope, refused ones drawing nothing.

    The greedy draw depends on each verdict before, so a scope's fitting requests (at most those of one
    plan of 1 MiB) are folded as one ordered array; a running sum would count refused ones.
    """
    budget = scopes.select("scope_id", "reserved_budget_units").join(work.groupBy("scope_id").agg(F.sum(F.coalesce("granted_units", F.lit(0))).alias("drawn")), "scope_id")
    rows = _judged(requests, work, scopes, now_ms).filter("admissible")
    one = F.struct(F.col(order_col).alias("place"), "work_id", "work_revision", "request_digest", "units")
    queues = rows.groupBy("scope_id").agg(F.array_sort(F.collect_list(one)).alias("queue")).join(budget, "scope_id")

    def step(s, x):
        ok = s["drawn"] + x["units"] <= s["reserve"]
        return F.struct((s["drawn"] + F.when(ok, x["units"]).otherwise(0)).alias("drawn"), s["reserve"].alias("reserve"), F.concat(s["verdicts"], F.array(ok)).alias("verdicts"))

    start = F.struct(F.col("drawn").alias("drawn"), F.col("reserved_budget_units").alias("reserve"), F.array().cast("array<boolean>").alias("verdicts"))
    judged = queues.select("scope_id", F.explode(F.arrays_zip(F.col("queue").alias("q"), F.aggregate("queue", start, step, lambda s: s["verdicts"]).alias("admitted"))).alias("z"))
    return judged.select("scope_id", *(F.col(f"z.q.{c}").alias(c) for c in ("work_id", "work_revision", "request_digest")), F.col("z.admitted").alias("admitted"))


def grant_probe(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Activated, foreign_operation or absent, for each (scope_id, operation_id, grant_digest)."""
    hits = log.select("scope_id", "operation_id", (F.col("payload_type") == "grant_activated").alias("activation"), F.col("grant_digest").alias("logged"))
    j = requests.join(hits, ["scope_id", "operation_id"], "left")
    same = F.coalesce(F.col("activation") & (F.col("logged") == F.col("grant_digest")), F.lit(False))
    return j.select("scope_id", "operation_id", "grant_digest", F.when(same, "activated").when(F.col("activation").isNotNull(), "foreign_operation").otherwise("absent").alias("verdict"))


def artifact_admissible(log: DataFrame, work: DataFrame) -> DataFrame:
    """Each artifact reference against the history before it: resolvable, no duplicate of its kind, and a trace after its manifest; the first failure names the verdict."""
    refs = log.filter("payload_type = 'artifact_reference'")
    binding = ["scope_id", "work_id", "work_revision"]
    admitted = work.select(*binding).distinct().withColumn("admitted", F.lit(True))
    grants = log.filter("payload_type = 'grant_activated'").groupBy(*binding, "attempt", "grant_digest").agg(F.min("sequence").alias("granted_at"))
    manifests = refs.filter("artifact_kind = 'invocation_manifest'").groupBy(*binding, "attempt", "grant_digest", F.col("artifact_digest").alias("manifest_digest")).agg(F.min("sequence").alias("manifest_at"))
    nth = F.row_number().over(Window.partitionBy(*binding, "attempt", "artifact_kind").orderBy("sequence"))
    j = refs.withColumn("nth", nth).join(admitted, binding, "left").join(grants, [*binding, "attempt", "grant_digest"], "left").join(manifests, [*binding, "attempt", "grant_digest", "manifest_digest"], "left")
    before = lambda c: F.coalesce(F.col(c) < F.col("sequence"), F.lit(False))
    verdict = (
        F.when(F.col("admitted").isNull() | ~before("granted_at"), "unresolvable").when(F.col("nth") > 1, "duplicate").when((F.col("artifact_kind") == "invocation_trace") & ~before("manifest_at"), "manifest_missing").otherwise("admissible")
    )
    return j.select("scope_id", "sequence", verdict.alias("verdict"))
