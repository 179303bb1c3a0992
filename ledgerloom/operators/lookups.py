"""Point lookups and predicates, answered for all scopes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import model as M


def cursors(scopes: DataFrame, expected_campaign: DataFrame | None = None) -> DataFrame:
    """Scope cursor; a row of another campaign than expected reads as blank."""
    if expected_campaign is None:
        return scopes.select("scope_id", "sequence", "tail_event_digest")
    joined = scopes.join(expected_campaign.select("scope_id", F.col("campaign_id").alias("expected")), "scope_id")
    own = F.col("campaign_id") == F.col("expected")
    return joined.select("scope_id", F.when(own, F.col("sequence")).otherwise(0).alias("sequence"), F.when(own, F.col("tail_event_digest")).alias("tail_event_digest"))


def scope_count(scopes: DataFrame) -> DataFrame:
    """How many scopes a projection holds."""
    return scopes.agg(F.count("*").alias("scopes"))


def active_plans(scopes: DataFrame) -> DataFrame:
    return scopes.select("scope_id", "active_plan_digest", "scope_epoch", "objective_digest", (F.col("claims_restored") == 1).alias("claims_restored"))


def tail_events(scopes: DataFrame, log: DataFrame) -> DataFrame:
    """The event at each scope's cursor: digest and writer epoch."""
    return scopes.select("scope_id", "sequence").join(log.select("scope_id", "sequence", "digest", "writer_epoch"), ["scope_id", "sequence"])


def dependency_lists(deps: DataFrame) -> DataFrame:
    """Dependencies of each revision, ordered, as arrays of structs."""
    pair = F.struct("depends_on_work_id", "depends_on_work_revision")
    return deps.groupBy("scope_id", "work_id", "work_revision").agg(F.sort_array(F.collect_list(pair)).alias("dependencies"))


def admitted_refs(work: DataFrame) -> DataFrame:
    return work.select("scope_id", "work_id", "work_revision", "plan_digest").orderBy("scope_id", "work_id", "work_revision")


def head_matches(heads: DataFrame, scopes: DataFrame, log: DataFrame) -> DataFrame:
    """Whether each head agrees with the projection: campaign, sequence, tail, plan (null-safe) and operation equal, projected epoch not ahead."""
    tail = log.select("scope_id", F.col("sequence").alias("at"), F.col("operation_id").alias("tail_operation"))
    s = scopes.select(*(F.col(c).alias(f"own_{c}") for c in ("campaign_id", "sequence", "tail_event_digest", "active_plan_digest", "scope_epoch")), "scope_id")
    joined = heads.join(s, "scope_id", "left").join(tail, (heads["scope_id"] == tail["scope_id"]) & (F.col("own_sequence") == F.col("at")), "left").drop(tail["scope_id"])
    same = (
        (F.col("campaign_id") == F.col("own_campaign_id")) & (F.col("sequence") == F.col("own_sequence")) & (F.col("tail_event_digest") == F.col("own_tail_event_digest"))
        & F.col("active_plan_digest").eqNullSafe(F.col("own_active_plan_digest")) & (F.col("operation_id") == F.col("tail_operation")) & (F.col("own_scope_epoch") <= F.col("scope_epoch"))
    )
    return joined.select("scope_id", F.coalesce(same, F.lit(False)).alias("matches"))


def registered(payload_type: Column) -> Column:
    return payload_type.isin(*M.PAYLOAD_TYPES)


def root_valid(payload_type: Column, sequence: Column, parent: Column) -> Column:
    """Genesis exactly at sequence 1 without a parent."""
    first = (sequence == 1) & parent.isNull()
    return (payload_type == "root_genesis") == first


def must_stop(lease_until: Column, now_ms: int) -> Column:
    return F.greatest(lease_until - F.lit(now_ms), F.lit(0)) < M.STOP_MARGIN_MS


def renewal_due(lease_until: Column, now_ms: int) -> Column:
    return F.greatest(lease_until - F.lit(now_ms), F.lit(0)) <= M.RENEW_BEFORE_MS


def authority_times(heads: DataFrame, now_ms: int) -> DataFrame:
    """Stop and renewal verdicts of each owned head."""
    lease = F.col("lease_until")
    return heads.filter(lease.isNotNull()).select("scope_id", must_stop(lease, now_ms).alias("must_stop"), renewal_due(lease, now_ms).alias("renewal_due"))


def duplicate_probe(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Whether each candidate's digest or operation is in its scope's log already."""
    by_digest = log.select("scope_id", "digest").distinct().withColumn("seen_digest", F.lit(True))
    by_operation = log.select("scope_id", "operation_id").distinct().withColumn("seen_operation", F.lit(True))
    joined = candidates.join(by_digest, ["scope_id", "digest"], "left").join(by_operation, ["scope_id", "operation_id"], "left")
    return joined.select("scope_id", "digest", "operation_id", (F.col("seen_digest").isNotNull() | F.col("seen_operation").isNotNull()).alias("duplicate"))


def payload_census(log: DataFrame) -> DataFrame:
    """Distinct payload types with their counts and whether they are registered."""
    return log.groupBy("payload_type").agg(F.count("*").alias("events")).select("payload_type", "events", registered(F.col("payload_type")).alias("registered"))


def latest_per_scope(log: DataFrame, k: int, payload_type: str) -> DataFrame:
    """The newest ``k`` events of a type in each scope (checkpoint candidates)."""
    w = Window.partitionBy("scope_id").orderBy(F.desc("sequence"))
    return log.filter(F.col("payload_type") == payload_type).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("scope_id", "sequence", "digest", "rank")
