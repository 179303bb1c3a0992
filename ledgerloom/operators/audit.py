"""Integrity audit: every constraint of the data model as a query of its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import model as M
from .lookups import registered


def orphans(log: DataFrame, scopes: DataFrame) -> DataFrame:
    return log.join(scopes.select("scope_id"), "scope_id", "left_anti").select("scope_id", "sequence")


def broken_parents(log: DataFrame) -> DataFrame:
    """Events whose parent digest is not that of the event before, or whose writer epoch falls.  One sort instead of a self join."""
    w = Window.partitionBy("scope_id").orderBy("sequence")
    prev = log.select("scope_id", "sequence", "parent_digest", "writer_epoch", F.lag("digest").over(w).alias("before"), F.lag("writer_epoch").over(w).alias("epoch_before"), F.lag("sequence").over(w).alias("at_before"))
    next_to = F.col("at_before") == F.col("sequence") - 1
    bad = (F.col("sequence") > 1) & ~F.coalesce(next_to & (F.col("parent_digest") == F.col("before")) & (F.col("writer_epoch") >= F.col("epoch_before")), F.lit(False))
    return prev.filter(bad).select("scope_id", "sequence")


def broken_cursors(scopes: DataFrame, log: DataFrame) -> DataFrame:
    """Scopes whose cursor, tail or epoch disagrees with their log: one aggregate instead of four subqueries."""
    a = log.groupBy("scope_id").agg(F.count("*").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.max("writer_epoch").alias("top_epoch"), F.max_by("digest", "sequence").alias("tail"))
    j = scopes.select("scope_id", "sequence", "tail_event_digest", "scope_epoch").join(a, "scope_id", "left")
    good = (F.col("n") == F.col("sequence")) & (F.col("low") == 1) & (F.col("high") == F.col("sequence")) & (F.col("tail") == F.col("tail_event_digest")) & (F.col("top_epoch") <= F.col("scope_epoch"))
    return j.filter(~F.coalesce(good, F.lit(False))).select("scope_id")


def plan_pointers(scopes: DataFrame, log: DataFrame) -> DataFrame:
    """Scopes where holding a plan and having admitted one differ."""
    admitted = log.filter("payload_type = 'plan_admitted'").select("scope_id").distinct().withColumn("admitted", F.lit(True))
    return scopes.join(admitted, "scope_id", "left").filter(F.col("active_plan_digest").isNotNull() != F.col("admitted").isNotNull()).select("scope_id")


def unregistered(log: DataFrame) -> DataFrame:
    return log.filter(~registered(F.col("payload_type"))).select("payload_type").distinct()


def _named(df: DataFrame, constraints: dict[str, list[str]]) -> DataFrame:
    """check_id and key of each row and constraint; keys with a null part are left out, since they never collide."""
    shown = lambda keys: F.when(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))
    named = F.array(*(F.struct(F.lit(name).alias("check_id"), shown(keys).alias("key")) for name, keys in constraints.items()))
    return df.select(F.inline(named)).filter("key IS NOT NULL")


def _repeated(keys: DataFrame) -> DataFrame:
    return keys.groupBy("check_id", "key").agg(F.count("*").alias("rows")).filter("rows > 1")


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys of one constraint that occur more than once; keys with a null part never collide."""
    return _repeated(_named(df, {name: keys}))


def uniques(scopes: DataFrame, log: DataFrame, work: DataFrame, deps: DataFrame) -> DataFrame:
    """Keys of all primary keys and unique constraints that stand more than once; every table is read once, and one aggregate counts all."""
    revision = ["scope_id", "work_id", "work_revision"]
    keys = (
        _named(scopes, {"scopes.key": ["scope_id"]})
        .unionByName(_named(log, {"events.key": ["scope_id", "sequence"], "events.digest": ["scope_id", "digest"], "events.operation": ["scope_id", "operation_id"], "events.artifact": [*revision, "attempt", "artifact_kind"]}))
        .unionByName(_named(work, {"work.key": revision, "work.plan": ["scope_id", "work_id", "plan_digest"]}))
        .unionByName(_named(deps, {"deps.key": [*revision, "depends_on_work_id"]}))
    )
    return _repeated(keys)


def foreign_keys(scopes: DataFrame, log: DataFrame, work: DataFrame, deps: DataFrame) -> DataFrame:
    """Rows without their parent row."""
    own = scopes.select("scope_id")
    revision = ["scope_id", "work_id", "work_revision"]
    a = log.join(own, "scope_id", "left_anti").select(F.lit("events.scope").alias("check_id"), F.concat_ws("|", "scope_id", "sequence").alias("key"))
    b = work.join(own, "scope_id", "left_anti").select(F.lit("work.scope").alias("check_id"), F.concat_ws("|", *revision).alias("key"))
    c = deps.join(work.select(*revision), revision, "left_anti").select(F.lit("deps.work").alias("check_id"), F.concat_ws("|", *revision, "depends_on_work_id").alias("key"))
    return a.unionByName(b).unionByName(c)


def _violations(df: DataFrame, key: list[str], checks: dict[str, str]) -> DataFrame:
    """One row per broken check.  Checks are SQL; one that is null fails, and each row is read once."""
    found = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in checks.items())
    return df.select(F.expr(f"explode(array_compact(array({found}))) AS check_id"), F.expr(f"concat_ws('|', {', '.join(key)}) AS key"))


def _digest(c: str) -> str:
    return f"{c} RLIKE '^[0-9a-f]{{64}}$'"


def _identity(c: str) -> str:
    return f"octet_length({c}) BETWEEN 1 AND 128 AND instr({c}, '/') = 0"


def _stored(c: str, least: int = 1) -> str:
    return f"{c} BETWEEN {least} AND {M.MAX_INTEGER}"


def _optional(c: str, ok: str) -> str:
    return f"{c} IS NULL OR ({ok})"


def scope_checks(scopes: DataFrame) -> DataFrame:
    return _violations(
        scopes, ["scope_id"],
        {
            "scopes.claims_restored": "claims_restored IN (0, 1)", "scopes.scope_id": _digest("scope_id"), "scopes.campaign_id": _identity("campaign_id"), "scopes.parent_scope_id": "parent_scope_id IS NULL",
            "scopes.delegation_digest": "delegation_digest IS NULL", "scopes.sequence": _stored("sequence"), "scopes.tail": _digest("tail_event_digest"), "scopes.plan": _optional("active_plan_digest", _digest("active_plan_digest")),
            "scopes.epoch": _stored("scope_epoch"), "scopes.objective": _digest("objective_digest"),
            "scopes.reservation": f"(active_plan_digest IS NULL AND reserved_budget_units IS NULL) OR (active_plan_digest IS NOT NULL AND reserved_budget_units IS NOT NULL AND {_stored('reserved_budget_units', 0)})",
        },
    )


def event_checks(log: DataFrame) -> DataFrame:
    named, artifact = "payload_type IN ('grant_activated', 'artifact_reference')", "payload_type = 'artifact_reference'"
    agree = lambda kind, present: f"({kind}) = ({present})"
    kinds = ", ".join(f"'{k}'" for k in M.ARTIFACT_KINDS)
    return _violations(
        log, ["scope_id", "sequence"],
        {
            "events.sequence": _stored("sequence"), "events.digest": _digest("digest"), "events.parent": f"(sequence = 1 AND parent_digest IS NULL) OR (sequence > 1 AND parent_digest IS NOT NULL AND {_digest('parent_digest')})", "events.operation": _identity("operation_id"),
            "events.epoch": "writer_epoch > 0", "events.payload": _identity("payload_type"),
            "events.root": "(sequence = 1 AND payload_type = 'root_genesis' AND operation_id = concat('root-genesis:', scope_id)) OR (sequence > 1 AND payload_type <> 'root_genesis')",
            "events.grant_named": agree(named, "grant_digest IS NOT NULL"), "events.grant": _optional("grant_digest", _digest("grant_digest")),
            "events.work_named": agree(named, "work_id IS NOT NULL AND work_revision IS NOT NULL AND attempt IS NOT NULL"), "events.work": _optional("work_id", "octet_length(work_id) BETWEEN 1 AND 128"),
            "events.revision": _optional("work_revision", _stored("work_revision")), "events.attempt": _optional("attempt", _stored("attempt")), "events.kind_named": agree(artifact, "artifact_kind IS NOT NULL"),
            "events.kind": _optional("artifact_kind", f"artifact_kind IN ({kinds})"), "events.artifact_named": agree(artifact, "artifact_digest IS NOT NULL"), "events.artifact": _optional("artifact_digest", _digest("artifact_digest")),
        },
    )


def work_checks(work: DataFrame) -> DataFrame:
    claim, grant = ["claim_fence", "claim_lease_until"], ["grant_fence", "granted_attempt", "granted_units", "grant_deadline_unix_ms"]
    none = lambda cols: " AND ".join(f"{c} IS NULL" for c in cols)
    every = lambda cols: " AND ".join(f"coalesce({_stored(c)}, false)" for c in cols)
    return _violations(
        work, ["scope_id", "work_id", "work_revision"],
        {
            "work.work_id": _identity("work_id"), "work.revision": _stored("work_revision", 0), "work.plan": _digest("plan_digest"), "work.epoch": _stored("admitted_scope_epoch"), "work.attempts": _stored("max_attempts"),
            "work.deadline": _stored("deadline_unix_ms"), "work.claim": f"({none(claim)}) OR ({every(claim)})", "work.grant": f"({none(grant)} AND grant_digest IS NULL) OR ({every(grant)} AND grant_digest IS NOT NULL AND {_digest('grant_digest')})",
            "work.terminal": f"terminal_result_digest IS NULL OR (claim_fence IS NOT NULL AND {_digest('terminal_result_digest')})",
        },
    )


def dependency_checks(deps: DataFrame) -> DataFrame:
    return _violations(
        deps, ["scope_id", "work_id", "work_revision", "depends_on_work_id"],
        {"deps.depends_on": _identity("depends_on_work_id"), "deps.revision": _stored("depends_on_work_revision", 0), "deps.self": "depends_on_work_id <> work_id"},
    )


def checks(scopes: DataFrame, log: DataFrame, work: DataFrame, deps: DataFrame) -> DataFrame:
    """All row constraints: check_id and key of each violation."""
    return scope_checks(scopes).unionByName(event_checks(log)).unionByName(work_checks(work)).unionByName(dependency_checks(deps))


def invalid_text(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Text or binary columns that are no valid UTF-8, one row per key and column."""
    found = F.array(*(F.when(F.col(c).isNotNull() & ~F.is_valid_utf8(F.col(c).cast("string")), F.lit(c)) for c in columns))
    return df.select(key.alias("key"), F.explode(F.array_compact(found)).alias("column_name"))


def schema_equal(df: DataFrame, expected) -> bool:
    """Whether names and types of a stored relation are exactly the expected ones."""
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in expected]


def snapshot_valid(scopes: DataFrame, covered: DataFrame) -> DataFrame:
    """Per covered scope (scope_id, sequence, tail_event_digest, active_plan_digest), whether the snapshot holds exactly that state."""
    s = scopes.select("scope_id", *(F.col(c).alias(f"own_{c}") for c in ("sequence", "tail_event_digest", "active_plan_digest")))
    ok = (F.col("sequence") == F.col("own_sequence")) & (F.col("tail_event_digest") == F.col("own_tail_event_digest")) & F.col("active_plan_digest").eqNullSafe(F.col("own_active_plan_digest"))
    return covered.join(s, "scope_id", "left").select("scope_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def classify_projections(projections: DataFrame) -> DataFrame:
    """What opening each projection (scope_id, present, application, schema_ok, violations) comes to: missing, foreign, rebuildable, or valid.

    A projection of another application is never touched; one whose schema or content is at fault is built again from the log.
    """
    foreign = F.coalesce(F.col("application") != F.lit("projection"), F.lit(True))
    state = F.when(~F.coalesce("present", F.lit(False)), "missing").when(foreign, "foreign").when(~F.coalesce("schema_ok", F.lit(False)) | (F.coalesce("violations", F.lit(0)) > 0), "rebuildable").otherwise("valid")
    return projections.select("scope_id", state.alias("state"))
