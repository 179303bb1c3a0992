"""The fold of event logs into relations, for all scopes at once.

What an event does depends on earlier rows only through columns that no later event rewrites, so the
fold is a set of grouped aggregates; only claims, whose outcome depends on each step before, run in
order per work revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["scope_id", "work_id", "work_revision"]


def valid_only(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All or nothing: events of scopes whose whole suffix is valid."""
    return log.join(verdicts.filter("verdict = 'valid'").select("scope_id"), "scope_id", "left_semi")


def idempotent(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per (scope, sequence), and the sequences that came with different digests (conflicts)."""
    w = Window.partitionBy("scope_id", "sequence")
    marked = log.withColumn("__digests", F.size(F.collect_set("digest").over(w))).withColumn("__nth", F.row_number().over(w.orderBy("digest", "operation_id")))
    clean = marked.filter("__nth = 1 AND __digests = 1").drop("__digests", "__nth")
    return clean, marked.filter("__digests > 1").select("scope_id", "sequence").distinct()


def fold_cursors(log: DataFrame) -> DataFrame:
    """Scope rows from the log: cursor, tail and epoch."""
    last = F.max_by(F.struct("digest", "operation_id"), "sequence")
    return log.groupBy("scope_id").agg(F.max("sequence").alias("sequence"), last.alias("t"), F.max("writer_epoch").alias("writer_epoch"), F.max(F.when(F.col("payload_type") == "plan_admitted", F.col("plan_digest"))).alias("active_plan_digest")).select(
        "scope_id", "sequence", F.col("t.digest").alias("tail_event_digest"), F.col("t.operation_id").alias("operation_id"), "writer_epoch", "active_plan_digest"
    )


def plan_as_of(log: DataFrame) -> DataFrame:
    """The plan that holds at each sequence."""
    w = Window.partitionBy("scope_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("scope_id", "sequence", F.last("plan_digest", ignorenulls=True).over(w).alias("plan_digest"))


def fold_grants(log: DataFrame) -> DataFrame:
    """Per revision: units drawn in all, and the columns of the latest activation."""
    last = F.max_by(F.struct("claim_fence", "grant_digest", "attempt"), "sequence")
    g = log.filter("payload_type = 'grant_activated'").groupBy(*KEY).agg(F.sum("units").alias("granted_units"), last.alias("g"), F.count("*").alias("activations"))
    return g.select(*KEY, "granted_units", F.col("g.claim_fence").alias("grant_fence"), F.col("g.grant_digest").alias("grant_digest"), F.col("g.attempt").alias("granted_attempt"), "activations")


def upsert_work(admissions: DataFrame) -> DataFrame:
    """First admission of each revision stays; a later one under its plan and no older epoch refreshes the epoch, any other is a conflict and changes nothing.

    ``admissions`` has the key, plan_digest, epoch and ``arrival``, and may have projected_epoch, the scope's
    epoch at that time: an admission below it comes from superseded authority and is a conflict, even the first.
    A revision without an accepted admission has its conflicts alone.
    """
    w = Window.partitionBy(*KEY).orderBy("arrival")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    current = F.col("epoch") >= F.col("projected_epoch") if "projected_epoch" in admissions.columns else F.lit(True)
    r = admissions.withColumn("current", F.coalesce(current, F.lit(True)))
    r = r.withColumn("held_plan", F.first(F.when(F.col("current"), F.col("plan_digest")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.col("current") & (F.col("plan_digest") == F.col("held_plan"))
    # a refused row of the held plan has an epoch below the stored one, so all rows of that plan give the stored epoch
    ok = own & (F.col("epoch") >= F.coalesce(F.max(F.when(own, F.col("epoch"))).over(before), F.col("epoch")))
    a = r.withColumn("ok", ok).groupBy(*KEY).agg(F.min_by("plan_digest", F.when(F.col("ok"), F.col("arrival"))).alias("plan_digest"), F.max(F.when(F.col("ok"), F.col("epoch"))).alias("epoch"), F.count_if(~F.col("ok")).alias("conflicts"))
    return a.select(*KEY, F.when(F.col("epoch").isNotNull(), F.col("plan_digest")).alias("plan_digest"), "epoch", "conflicts")


def admit_plans(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work rows and edges of plan documents (scope_id, plan_digest, work_specs) that ``admission_verdicts`` lets in: canonical, sorted and without repeats."""
    spec = plans.select("scope_id", "plan_digest", F.explode("work_specs").alias("s"))
    work = spec.select("scope_id", F.col("s.work_id").alias("work_id"), F.lit(1).cast("long").alias("work_revision"), "plan_digest", F.col("s.bounds.max_attempts").alias("max_attempts"), F.col("s.bounds.deadline_unix_ms").alias("deadline_unix_ms"))
    edges = spec.select("scope_id", F.col("s.work_id").alias("work_id"), F.lit(1).cast("long").alias("work_revision"), F.explode(F.array_sort(F.array_distinct("s.dependencies"))).alias("depends_on_work_id"), F.lit(1).cast("long").alias("depends_on_work_revision"))
    return work, edges


def fold_scopes(log: DataFrame) -> DataFrame:
    """Scope rows from the log alone: genesis gives campaign and objective, the rest of the log cursor, epoch and plan; reserve comes with the plan's admission.

    ``log`` has, beside its columns, campaign_id and objective_digest at genesis and reserved_budget_units at plan_admitted.
    Scopes without a genesis event have no row.
    """
    at = lambda kind, c: F.max(F.when(F.col("payload_type") == kind, F.col(c))).alias(c)
    first = log.groupBy("scope_id").agg(at("root_genesis", "campaign_id"), at("root_genesis", "objective_digest"), at("plan_admitted", "reserved_budget_units"))
    return fold_cursors(log).join(first.filter("campaign_id IS NOT NULL"), "scope_id").withColumn("claims_restored", F.lit(0).cast("long"))


def admission_verdicts(plans: DataFrame, work: DataFrame, deps: DataFrame, scopes: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Whether each plan (scope_id, plan_digest, revision, work_specs) may be admitted over what is there; one bad row refuses it whole.

    first failing rule: gate_refused (``gate``, the verdicts of ``graph.proposal_gate`` over the same facts, doesn't admit
    it), stale_epoch (``plans`` has the column epoch and it is below the scope's), plan_held (another plan is active), self_edge, unknown_dependency, work_conflict (the revision
    is there under another plan), edge_conflict (the revision is there with other dependencies, or other revisions of them), or ok.
    """
    specs = plans.select("scope_id", "plan_digest", "revision", F.explode("work_specs").alias("s")).select("scope_id", "plan_digest", "revision", F.col("s.work_id").alias("work_id"), F.array_sort(F.array_distinct("s.dependencies")).alias("wanted"))
    known = plans.select("scope_id", "plan_digest", F.transform("work_specs", lambda s: s["work_id"]).alias("declared"))
    key = ["scope_id", "work_id", "work_revision"]
    held = work.select(*key, F.col("plan_digest").alias("held_plan"))
    edges = deps.groupBy(*key).agg(F.collect_list(F.struct(F.col("depends_on_work_id").alias("id"), F.col("depends_on_work_revision").cast("long").alias("revision"))).alias("held_edges"))
    bound = F.transform("wanted", lambda d: F.struct(d.alias("id"), F.lit(1).cast("long").alias("revision")))  # a plan binds the first revision of each work item
    s = specs.withColumnRenamed("revision", "work_revision").join(known, ["scope_id", "plan_digest"]).join(held, key, "left").join(edges, key, "left")
    faults = s.groupBy("scope_id", "plan_digest").agg(
        F.bool_or(F.array_contains("wanted", F.col("work_id"))).alias("self_edge"), F.bool_or(F.size(F.array_except("wanted", "declared")) > 0).alias("unknown"), F.bool_or(F.coalesce(F.col("held_plan") != F.col("plan_digest"), F.lit(False))).alias("other_plan"),
        F.bool_or(F.col("held_plan").isNotNull() & ~same_dependencies(bound, F.coalesce("held_edges", F.array().cast("array<struct<id:string,revision:bigint>>")))).alias("other_edges"),
    )
    active = scopes.select("scope_id", F.col("active_plan_digest").alias("active"), F.col("scope_epoch").alias("projected") if "scope_epoch" in scopes.columns else F.lit(None).cast("long").alias("projected"))
    epoch = F.col("epoch") if "epoch" in plans.columns else F.lit(None).cast("long")
    own = plans.select("scope_id", "plan_digest", epoch.cast("long").alias("epoch"))
    if gate is None:
        own = own.withColumn("gated", F.lit("admissible"))
    else:
        own = own.join(gate.select("scope_id", "plan_digest", F.col("verdict").alias("gated")), ["scope_id", "plan_digest"], "left")
    j = own.join(active, "scope_id", "left").join(faults, ["scope_id", "plan_digest"], "left")
    refused = ~F.col("gated").eqNullSafe(F.lit("admissible"))
    verdict = (
        F.when(refused, "gate_refused").when(F.col("epoch") < F.col("projected"), "stale_epoch").when(F.col("active").isNotNull() & (F.col("active") != F.col("plan_digest")), "plan_held").when(F.col("self_edge"), "self_edge").when(F.col("unknown"), "unknown_dependency")
        .when(F.col("other_plan"), "work_conflict").when(F.col("other_edges"), "edge_conflict").otherwise("ok")
    )
    return j.select("scope_id", "plan_digest", verdict.alias("verdict"))


def same_dependencies(a: Column, b: Column) -> Column:
    """Whether two lists of dependencies are equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def fold_claims(operations: DataFrame) -> DataFrame:
    """Claim state and terminal evidence of each revision after its operations in order of arrival.

    A fence never falls: a higher one needs an expired lease, an equal one only extends its own.  An
    operation with terminal_result_digest closes the revision if it names the claim's fence; then no claim
    is recorded any more, and only the same evidence again.  Each step depends on the one before, so the
    operations of one revision are folded as one ordered array; revisions spread over tasks.
    """
    if "terminal_result_digest" not in operations.columns:
        operations = operations.withColumn("terminal_result_digest", F.lit(None).cast("string"))
    one = F.struct("arrival", "fence", "lease_until", "now_ms", F.col("terminal_result_digest").alias("result"))
    steps = operations.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("steps"))
    none = F.lit(None).cast("long")

    def step(s, x):
        claim = s["result"].isNull() & (s["fence"].isNull() | ((x["fence"] > s["fence"]) & (s["lease"] <= x["now_ms"])) | ((x["fence"] == s["fence"]) & (s["lease"] <= x["lease_until"])))
        close = F.coalesce(s["fence"] == x["fence"], F.lit(False)) & (s["result"].isNull() | (s["result"] == x["result"]))
        ends = x["result"].isNotNull()
        took, refused = claim & ~ends, F.when(ends, ~close).otherwise(~claim)
        return F.struct(
            F.when(took, x["fence"]).otherwise(s["fence"]).alias("fence"), F.when(took, x["lease_until"]).otherwise(s["lease"]).alias("lease"),
            F.when(ends & close, x["result"]).otherwise(s["result"]).alias("result"), (s["refused"] + refused.cast("int")).alias("refused"),
        )

    start = F.struct(none.alias("fence"), none.alias("lease"), F.lit(None).cast("string").alias("result"), F.lit(0).cast("long").alias("refused"))
    state = steps.select(*KEY, F.aggregate("steps", start, step).alias("s"))
    return state.select(*KEY, F.col("s.fence").alias("claim_fence"), F.col("s.lease").alias("claim_lease_until"), F.col("s.result").alias("terminal_result_digest"), F.col("s.refused").alias("refused"))


def restore_claims(work: DataFrame, claims: DataFrame) -> DataFrame:
    """Claim objects put back on their rows: sealed ones, those of another plan and those of rows with terminal evidence are skipped.

    The clock of a restore is 0, so a higher fence over a recorded lease is skipped too; an equal fence extends its lease.
    """
    c = claims.filter("state = 'active'").select(*KEY, F.col("plan_digest").alias("claim_plan"), F.col("claim_fence").alias("new_fence"), F.col("lease_until").alias("new_lease"))
    j = work.join(c, KEY, "left")
    fresh = F.col("claim_fence").isNull()
    higher = (F.col("claim_fence") < F.col("new_fence")) & (F.col("claim_lease_until") <= 0)
    equal = (F.col("claim_fence") == F.col("new_fence")) & (F.col("claim_lease_until") <= F.col("new_lease"))
    take = F.coalesce((F.col("claim_plan") == F.col("plan_digest")) & F.col("terminal_result_digest").isNull() & (fresh | higher | equal), F.lit(False))
    return j.select(*[F.when(take, F.col(n)).otherwise(F.col(o)).alias(o) if n else F.col(o) for o, n in ((c, {"claim_fence": "new_fence", "claim_lease_until": "new_lease"}.get(c)) for c in work.columns)])


def sanitize_snapshot(work: DataFrame, scope_ids: DataFrame) -> DataFrame:
    """Rows of the snapshot scopes without what the log doesn't carry (claims, terminal evidence); grants stay."""
    out = work.join(scope_ids.select("scope_id"), "scope_id", "left_semi")
    return out.withColumns({"claim_fence": F.lit(None).cast("long"), "claim_lease_until": F.lit(None).cast("long"), "terminal_result_digest": F.lit(None).cast("string")})


def resume(snapshot: DataFrame, suffix: DataFrame) -> DataFrame:
    """Grant state of a snapshot (fold_grants columns) with the fold of later events on top; equals folding the whole log."""
    new = fold_grants(suffix)
    j = snapshot.alias("a").join(new.alias("b"), KEY, "full_outer")
    later = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    both = lambda c: (F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c)
    return j.select(*KEY, both("granted_units"), later("grant_fence"), later("grant_digest"), later("granted_attempt"), both("activations"))
