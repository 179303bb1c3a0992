"""Chain verification by windows over (scope, sequence): one shuffle on the scope, no recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom import model as M
from .lookups import registered, root_valid


def chain_verdicts(log: DataFrame, heads: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """First failing rule of each scope's unseen events (those after the cursor in ``after``), newest event first.

    Per event: byte cap, then reference, epoch, operation and head rules, then registration, root rule
    and chain; a scope without failure is ``valid``.
    """
    w = Window.partitionBy("scope_id").orderBy("sequence")
    whole = Window.partitionBy("scope_id")
    rows = log if after is None else log.join(after.select("scope_id", F.col("sequence").alias("cursor")), "scope_id", "left").filter(F.col("cursor").isNull() | (F.col("sequence") > F.col("cursor")))
    h = heads.select("scope_id", F.col("scope_epoch").alias("head_epoch"), F.col("operation_id").alias("head_operation"), F.col("sequence").alias("head_sequence"), F.col("tail_event_digest").alias("head_tail"))
    r = rows.join(h, "scope_id")
    r = r.withColumns(
        {
            "before": F.lag("digest").over(w), "at_before": F.lag("sequence").over(w), "child_epoch": F.lead("writer_epoch").over(w), "child": F.lead("sequence").over(w),
            # from the newest event back to this one: all, less those before it
            "bytes": F.sum("stored_bytes").over(whole) - F.sum("stored_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("stored_bytes"), "events": F.count("*").over(whole) - F.row_number().over(w) + 1, "same_operation": F.count("*").over(Window.partitionBy("scope_id", "operation_id")),
        }
    )
    tail = F.col("child").isNull()
    fault = (
        F.when((F.col("bytes") > M.MAX_REPLAY_BYTES) | (F.col("events") > M.MAX_EVENTS), "over_budget")
        .when(tail & ((F.col("sequence") != F.col("head_sequence")) | (F.col("digest") != F.col("head_tail"))), "reference_mismatch")
        .when(F.col("writer_epoch") > F.col("head_epoch"), "epoch_ahead_of_head").when(F.col("writer_epoch") > F.col("child_epoch"), "epoch_regression").when(F.col("same_operation") > 1, "operation_repeated")
        .when(tail & (F.col("operation_id") != F.col("head_operation")), "head_operation_mismatch").when(~registered(F.col("payload_type")), "unregistered_payload").when(~root_valid(F.col("payload_type"), F.col("sequence"), F.col("parent_digest")), "root_rule")
        .when((F.col("sequence") > 1) & ~F.coalesce((F.col("before") == F.col("parent_digest")) & (F.col("at_before") == F.col("sequence") - 1), F.lit(False)) & (F.col("before").isNotNull() | (F.lit(after is None))), "broken_chain")
    )
    first = r.withColumn("fault", fault).groupBy("scope_id").agg(F.max_by("fault", F.when(F.col("fault").isNotNull(), F.col("sequence"))).alias("fault"), F.count("*").alias("events"))
    return first.select("scope_id", F.coalesce("fault", F.lit("valid")).alias("verdict"), "events")


def precheck(scopes: DataFrame, heads: DataFrame) -> DataFrame:
    """Unseen events of each scope, or why replay can't begin: cursor_ahead, tail_mismatch or over_budget."""
    s = scopes.select("scope_id", F.col("sequence").alias("cursor"), F.col("tail_event_digest").alias("cursor_tail"))
    j = heads.join(s, "scope_id", "left").withColumn("cursor", F.coalesce("cursor", F.lit(0).cast("long")))
    verdict = (
        F.when(F.col("cursor") > F.col("sequence"), "cursor_ahead").when((F.col("cursor") == F.col("sequence")) & (F.col("cursor_tail") != F.col("tail_event_digest")), "tail_mismatch").when(F.col("sequence") - F.col("cursor") > M.MAX_EVENTS, "over_budget").otherwise("ok")
    )
    return j.select("scope_id", verdict.alias("verdict"), F.when(verdict == "ok", F.col("sequence") - F.col("cursor")).alias("unseen"))


def batch_verdicts(batch: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether each scope's new events extend its head as one chain: dense from the tail, same epoch, operations distinct and other than the head's."""
    w = Window.partitionBy("scope_id").orderBy("sequence")
    h = heads.select("scope_id", F.col("scope_epoch").alias("head_epoch"), F.col("operation_id").alias("head_operation"), F.col("sequence").alias("head_sequence"), F.col("tail_event_digest").alias("head_tail"), F.col("active_plan_digest").alias("head_plan"))
    r = batch.join(h, "scope_id", "left").withColumns(
        {"nth": F.row_number().over(w), "before": F.lag("digest").over(w), "same_operation": F.count("*").over(Window.partitionBy("scope_id", "operation_id")), "plans": F.sum((F.col("payload_type") == "plan_admitted").cast("int")).over(Window.partitionBy("scope_id"))}
    )
    ok = (
        (F.col("sequence") == F.col("head_sequence") + F.col("nth")) & (F.col("parent_digest") == F.coalesce("before", "head_tail")) & (F.col("sequence") <= M.MAX_EVENTS) & (F.col("writer_epoch") == F.col("head_epoch"))
        & (F.col("operation_id") != F.col("head_operation")) & (F.col("same_operation") == 1) & ~((F.col("payload_type") == "plan_admitted") & (F.col("head_plan").isNotNull() | (F.col("plans") > 1)))
    )
    return r.groupBy("scope_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("accepted"), F.count("*").alias("events"))


def reconcile(candidates: DataFrame, log: DataFrame, heads: DataFrame) -> DataFrame:
    """Fate of a commit whose answer was lost, from the retained chain between its parent (``boundary``) and the current tail.

    ``candidates`` has scope_id, operation_id, digest, boundary and boundary_epoch.  The chain is a
    slice of sequences; its aggregates stand for the walk.
    """
    h = heads.select("scope_id", F.col("scope_epoch").alias("head_epoch"), F.col("operation_id").alias("head_operation"), F.col("sequence").alias("head_sequence"))
    c = candidates.select("scope_id", F.col("operation_id").alias("own_operation"), F.col("digest").alias("own_digest"), "boundary", "boundary_epoch").join(h, "scope_id")
    r = log.join(c, "scope_id").filter((F.col("sequence") > F.col("boundary")) & (F.col("sequence") <= F.col("head_sequence")))
    w = Window.partitionBy("scope_id").orderBy("sequence")
    r = r.withColumns({"epoch_before": F.lag("writer_epoch").over(w), "before": F.lag("digest").over(w)})
    mine, same = F.col("operation_id") == F.col("own_operation"), F.col("digest") == F.col("own_digest")
    good = (
        registered(F.col("payload_type")) & (F.col("writer_epoch") <= F.col("head_epoch")) & F.coalesce(F.col("writer_epoch") >= F.col("epoch_before"), F.col("writer_epoch") >= F.col("boundary_epoch")) & (mine == same)
        & F.coalesce(F.col("before") == F.col("parent_digest"), F.lit(True)) & F.when(F.col("sequence") == F.col("head_sequence"), F.col("operation_id") == F.col("head_operation")).otherwise(True)
    )
    a = r.groupBy("scope_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"), F.bool_or(mine & same).alias("found"), F.count("*").alias("hops"), F.min(F.col("head_sequence") - F.col("boundary")).alias("need"))
    j = c.join(a, "scope_id", "left")
    proven = F.coalesce(F.col("good") & (F.col("hops") == F.col("need")), F.lit(False))
    return j.select("scope_id", F.when(~proven, "unresolved").when(F.col("found"), "committed_superseded").otherwise("proven_not_committed").alias("verdict"))
