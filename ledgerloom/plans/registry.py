"""Registered queries: each an operator over adapted driver tables, beside SQL of another shape for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom import model as M
from ledgerloom.functions import scalar
from ledgerloom.operators import accel, audit, fold, graph, intake, lookups, measure, scheduling, verify
from ledgerloom.sources import sinks
from ledgerloom.streaming import incremental

from .adapters import NOW_MS, dialect, prelude, relation

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: The SQL over relations that are there as tables.
_BARE: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    def take(fn: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: fn(lambda r: _tables(spark, sf_dir, r))
        if sql is not None:
            _SQL[name], _BARE[name] = prelude(sql), dialect(sql, "duckdb")
        return fn

    return take


# ---------------------------------------------------------------- scheduling


@_query(
    "claimable_work",
    f"""SELECT scope_id, work_id, work_revision FROM work AS w WHERE deadline_unix_ms > {NOW_MS} AND terminal_result_digest IS NULL AND (claim_lease_until IS NULL OR claim_lease_until <= {NOW_MS})
      AND plan_digest = (SELECT active_plan_digest FROM scopes AS s WHERE s.scope_id = w.scope_id)
      AND NOT EXISTS (SELECT 1 FROM deps AS d WHERE d.scope_id = w.scope_id AND d.work_id = w.work_id AND d.work_revision = w.work_revision
        AND NOT EXISTS (SELECT 1 FROM work AS r WHERE r.scope_id = d.scope_id AND r.work_id = d.depends_on_work_id AND r.work_revision = d.depends_on_work_revision AND r.terminal_result_digest IS NOT NULL))""",
)
def _(t):
    return scheduling.claimable(t("work"), t("deps"), t("scopes"), NOW_MS)


def _authorities(t):
    return t("scopes").select("scope_id", (F.col("scope_epoch") + F.when(F.col("k") % 5 == 0, -1).otherwise(1)).alias("epoch"))


_AUTHORITIES = "SELECT scope_id, scope_epoch, scope_epoch + CASE WHEN k % 5 = 0 THEN -1 ELSE 1 END AS epoch FROM scopes"
_CONTINUABLE = f"""SELECT w.scope_id, w.work_id, w.work_revision, w.claim_fence, w.grant_digest, w.claim_lease_until, 'continuable' AS verdict FROM work AS w JOIN au AS a ON a.scope_id = w.scope_id AND a.scope_epoch <= a.epoch
      WHERE w.deadline_unix_ms > {NOW_MS} AND w.terminal_result_digest IS NULL AND w.admitted_scope_epoch <= a.epoch AND w.claim_lease_until > {NOW_MS} AND w.grant_fence = w.claim_fence AND w.grant_deadline_unix_ms > {NOW_MS}
        AND w.plan_digest = (SELECT active_plan_digest FROM scopes AS s WHERE s.scope_id = w.scope_id)
      UNION ALL SELECT scope_id, NULL, NULL, NULL, NULL, NULL, 'stale_authority' FROM au WHERE scope_epoch > epoch"""


@_query("continuable_work", f"WITH au AS ({_AUTHORITIES}) {_CONTINUABLE}")
def _(t):
    return scheduling.continuable(t("work"), t("scopes"), _authorities(t), NOW_MS)


_ADMISSIBLE = f"""SELECT q.scope_id, q.work_id, q.work_revision, q.request_digest, q.key, q.units, EXISTS (SELECT 1 FROM work AS w WHERE w.scope_id = q.scope_id AND w.work_id = q.work_id AND w.work_revision = q.work_revision
        AND w.terminal_result_digest IS NULL AND w.claim_fence = q.fence AND w.claim_lease_until > {NOW_MS} AND w.deadline_unix_ms >= q.deadline_unix_ms AND q.deadline_unix_ms > {NOW_MS} AND q.attempt <= w.max_attempts
        AND (w.grant_fence IS NULL OR (w.grant_fence < q.fence AND q.attempt > w.granted_attempt) OR (w.grant_fence = q.fence AND w.grant_digest = q.request_digest AND q.attempt = w.granted_attempt))
        AND (CASE WHEN w.grant_fence = q.fence AND w.grant_digest = q.request_digest THEN coalesce(w.granted_units, 0) ELSE coalesce(w.granted_units, 0) + q.units END)
          + (SELECT coalesce(sum(x.granted_units), 0) FROM work AS x WHERE x.scope_id = q.scope_id AND NOT (x.work_id = q.work_id AND x.work_revision = q.work_revision))
          <= (SELECT reserved_budget_units FROM scopes AS s WHERE s.scope_id = q.scope_id)
        AND EXISTS (SELECT 1 FROM scopes AS s WHERE s.scope_id = q.scope_id AND s.active_plan_digest = q.plan_digest AND s.scope_epoch <= q.epoch)) AS admissible FROM requests AS q"""


@_query("grant_admissible", f"WITH a AS ({_ADMISSIBLE}) SELECT scope_id, work_id, work_revision, request_digest, admissible FROM a")
def _(t):
    return scheduling.grant_admissible(t("requests"), t("work"), t("scopes"), NOW_MS)


@_query(
    "grant_in_order",
    f"""WITH RECURSIVE a AS ({_ADMISSIBLE}), o AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY key, work_id, work_revision, request_digest, units) AS n FROM a WHERE admissible),
      b AS (SELECT s.scope_id, reserved_budget_units AS reserve, (SELECT CAST(sum(coalesce(granted_units, 0)) AS BIGINT) FROM work AS w WHERE w.scope_id = s.scope_id) AS drawn FROM scopes AS s),
      r AS (SELECT b.scope_id, b.reserve, 0 AS n, b.drawn, CAST(NULL AS VARCHAR) AS work_id, CAST(NULL AS BIGINT) AS work_revision, CAST(NULL AS VARCHAR) AS request_digest, false AS admitted FROM b
        UNION ALL SELECT r.scope_id, r.reserve, CAST(o.n AS INT), r.drawn + CASE WHEN r.drawn + o.units <= r.reserve THEN o.units ELSE 0 END, o.work_id, o.work_revision, o.request_digest, r.drawn + o.units <= r.reserve FROM r JOIN o ON o.scope_id = r.scope_id AND o.n = r.n + 1)
      SELECT scope_id, work_id, work_revision, request_digest, admitted FROM r WHERE n > 0""",
)
def _(t):
    return scheduling.admit_in_order(t("requests"), t("work"), t("scopes"), NOW_MS, "key")


_PROBES = "SELECT scope_id, CASE WHEN sequence % 3 = 0 THEN 'op-none' ELSE operation_id END AS operation_id, CASE WHEN sequence % 4 = 1 THEN SHA['else'] ELSE coalesce(grant_digest, digest) END AS grant_digest FROM log"


def _probes(t):
    return t("log").select("scope_id", F.when(F.col("sequence") % 3 == 0, "op-none").otherwise(F.col("operation_id")).alias("operation_id"), F.when(F.col("sequence") % 4 == 1, F.sha2(F.lit("else"), 256)).otherwise(F.coalesce("grant_digest", "digest")).alias("grant_digest"))


@_query(
    "grant_probe",
    f"""WITH p AS ({_PROBES}) SELECT scope_id, operation_id, grant_digest, CASE WHEN EXISTS (SELECT 1 FROM log AS l WHERE l.scope_id = p.scope_id AND l.operation_id = p.operation_id AND l.payload_type = 'grant_activated' AND l.grant_digest = p.grant_digest) THEN 'activated'
      WHEN EXISTS (SELECT 1 FROM log AS l WHERE l.scope_id = p.scope_id AND l.operation_id = p.operation_id) THEN 'foreign_operation' ELSE 'absent' END AS verdict FROM p""",
)
def _(t):
    return scheduling.grant_probe(_probes(t), t("log"))


@_query(
    "artifact_admissible",
    """SELECT scope_id, sequence, CASE WHEN NOT (EXISTS (SELECT 1 FROM work AS w WHERE w.scope_id = r.scope_id AND w.work_id = r.work_id AND w.work_revision = r.work_revision)
        AND EXISTS (SELECT 1 FROM log AS g WHERE g.scope_id = r.scope_id AND g.payload_type = 'grant_activated' AND g.grant_digest = r.grant_digest AND g.work_id = r.work_id AND g.work_revision = r.work_revision AND g.attempt = r.attempt AND g.sequence < r.sequence)) THEN 'unresolvable'
      WHEN EXISTS (SELECT 1 FROM log AS d WHERE d.scope_id = r.scope_id AND d.payload_type = 'artifact_reference' AND d.artifact_kind = r.artifact_kind AND d.work_id = r.work_id AND d.work_revision = r.work_revision AND d.attempt = r.attempt AND d.sequence < r.sequence) THEN 'duplicate'
      WHEN artifact_kind = 'invocation_trace' AND NOT EXISTS (SELECT 1 FROM log AS m WHERE m.scope_id = r.scope_id AND m.artifact_kind = 'invocation_manifest' AND m.work_id = r.work_id AND m.work_revision = r.work_revision AND m.attempt = r.attempt
        AND m.grant_digest = r.grant_digest AND m.artifact_digest = r.manifest_digest AND m.sequence < r.sequence) THEN 'manifest_missing' ELSE 'admissible' END AS verdict
      FROM log AS r WHERE payload_type = 'artifact_reference'""",
)
def _(t):
    return scheduling.artifact_admissible(t("log"), t("work"))


# ---------------------------------------------------------------- lookups


@_query("admitted_refs", "SELECT scope_id, work_id, work_revision, plan_digest FROM work")
def _(t):
    return lookups.admitted_refs(t("work"))


@_query("dependency_list", "SELECT scope_id, work_id, work_revision, string_agg(depends_on_work_id || '@' || depends_on_work_revision, ',' ORDER BY depends_on_work_id) AS dependencies FROM deps GROUP BY ALL")
def _(t):
    listed = lookups.dependency_lists(t("deps"))
    return listed.withColumn("dependencies", F.array_join(F.transform("dependencies", lambda d: F.concat_ws("@", d["depends_on_work_id"], d["depends_on_work_revision"].cast("string"))), ","))


@_query(
    "head_match",
    """SELECT h.scope_id, EXISTS (SELECT 1 FROM scopes AS s JOIN log AS l ON l.scope_id = s.scope_id AND l.sequence = s.sequence WHERE s.scope_id = h.scope_id AND s.campaign_id = h.campaign_id AND s.sequence = h.sequence AND s.tail_event_digest = h.tail_event_digest
      AND s.active_plan_digest IS NOT DISTINCT FROM h.active_plan_digest AND l.operation_id = h.operation_id AND s.scope_epoch <= h.scope_epoch) AS matches FROM heads AS h""",
)
def _(t):
    return lookups.head_matches(t("heads"), t("scopes"), t("log"))


@_query("scope_cursor", "SELECT s.scope_id, CASE WHEN k % 6 = 0 THEN 0 ELSE sequence END AS sequence, CASE WHEN k % 6 <> 0 THEN tail_event_digest END AS tail_event_digest FROM scopes AS s")
def _(t):
    expected = t("scopes").select("scope_id", F.when(F.col("k") % 6 == 0, "elsewhere").otherwise(F.col("campaign_id")).alias("campaign_id"))
    return lookups.cursors(t("scopes"), expected)


@_query("active_plan", "SELECT scope_id, active_plan_digest, scope_epoch, objective_digest, claims_restored = 1 AS claims_restored FROM scopes")
def _(t):
    return lookups.active_plans(t("scopes"))


@_query("tail_event", "SELECT s.scope_id, s.sequence, l.digest, l.writer_epoch FROM scopes AS s JOIN log AS l ON l.scope_id = s.scope_id WHERE l.sequence = s.sequence")
def _(t):
    return lookups.tail_events(t("scopes"), t("log"))


@_query("authority_times", f"SELECT scope_id, CASE WHEN lease_until < {NOW_MS} THEN 0 ELSE lease_until - {NOW_MS} END < 5000 AS must_stop, CASE WHEN lease_until < {NOW_MS} THEN 0 ELSE lease_until - {NOW_MS} END <= 20000 AS renewal_due FROM heads WHERE lease_until IS NOT NULL")
def _(t):
    return lookups.authority_times(t("heads"), NOW_MS)


@_query(
    "event_duplicate",
    """WITH c AS (SELECT scope_id, CASE WHEN sequence % 3 = 0 THEN SHA['new'] ELSE digest END AS digest, CASE WHEN sequence % 2 = 0 THEN 'op-new' ELSE operation_id END AS operation_id FROM log)
      SELECT scope_id, digest, operation_id, EXISTS (SELECT 1 FROM log AS l WHERE l.scope_id = c.scope_id AND (l.digest = c.digest OR l.operation_id = c.operation_id)) AS duplicate FROM c""",
)
def _(t):
    c = t("log").select("scope_id", F.when(F.col("sequence") % 3 == 0, F.sha2(F.lit("new"), 256)).otherwise(F.col("digest")).alias("digest"), F.when(F.col("sequence") % 2 == 0, "op-new").otherwise(F.col("operation_id")).alias("operation_id"))
    return lookups.duplicate_probe(t("log"), c)


@_query("distinct_payload", f"SELECT payload_type, count(*) AS events, payload_type IN {M.PAYLOAD_TYPES} AS registered FROM log GROUP BY payload_type")
def _(t):
    return lookups.payload_census(t("log"))


@_query(
    "checkpoint_candidates",
    f"SELECT scope_id, sequence, digest, (SELECT count(*) FROM log AS m WHERE m.scope_id = l.scope_id AND m.payload_type = l.payload_type AND m.sequence >= l.sequence) AS rank FROM log AS l WHERE payload_type = 'projection_checkpoint_published' AND (SELECT count(*) FROM log AS m WHERE m.scope_id = l.scope_id AND m.payload_type = l.payload_type AND m.sequence >= l.sequence) <= {M.CHECKPOINT_CANDIDATES}",
)
def _(t):
    return lookups.latest_per_scope(t("log"), M.CHECKPOINT_CANDIDATES, "projection_checkpoint_published")


# ---------------------------------------------------------------- audit, over a log with planted faults

_FAULTY = """SELECT * REPLACE (CASE WHEN sequence % 43 = 7 THEN SHA['forged'] ELSE digest END AS digest, CASE WHEN sequence % 31 = 5 THEN 1 ELSE writer_epoch END AS writer_epoch, CASE WHEN sequence % 29 = 3 THEN 'artifact' ELSE payload_type END AS payload_type,
      CASE WHEN sequence % 41 = 9 THEN 'a/b' ELSE operation_id END AS operation_id, CASE WHEN sequence % 37 = 8 THEN -1 ELSE attempt END AS attempt) FROM log WHERE (sequence + k) % 97 <> 0"""


def _faulty(t):
    s = F.col("sequence")
    return t("log").filter("(sequence + k) % 97 <> 0").withColumns(
        {
            "digest": F.when(s % 43 == 7, F.sha2(F.lit("forged"), 256)).otherwise(F.col("digest")), "writer_epoch": F.when(s % 31 == 5, 1).otherwise(F.col("writer_epoch")), "payload_type": F.when(s % 29 == 3, "artifact").otherwise(F.col("payload_type")),
            "operation_id": F.when(s % 41 == 9, "a/b").otherwise(F.col("operation_id")), "attempt": F.when(s % 37 == 8, F.lit(-1)).otherwise(F.col("attempt")),
        }
    )


@_query("audit_orphans", "SELECT l.scope_id, l.sequence FROM log AS l LEFT JOIN (SELECT scope_id FROM scopes WHERE k % 12 <> 4) AS s ON s.scope_id = l.scope_id WHERE s.scope_id IS NULL")
def _(t):
    return audit.orphans(t("log"), t("scopes").filter("k % 12 <> 4"))


@_query("audit_parents", f"WITH f AS ({_FAULTY}) SELECT c.scope_id, c.sequence FROM f AS c LEFT JOIN f AS p ON p.scope_id = c.scope_id AND p.sequence = c.sequence - 1 WHERE c.sequence > 1 AND (p.digest IS NULL OR p.digest <> c.parent_digest OR c.writer_epoch < p.writer_epoch)")
def _(t):
    return audit.broken_parents(_faulty(t))


@_query(
    "audit_cursors",
    f"""WITH f AS ({_FAULTY}) SELECT scope_id FROM scopes AS s WHERE (SELECT count(*) FROM f WHERE f.scope_id = s.scope_id) <> s.sequence OR (SELECT min(sequence) FROM f WHERE f.scope_id = s.scope_id) <> 1 OR (SELECT max(sequence) FROM f WHERE f.scope_id = s.scope_id) <> s.sequence
      OR NOT EXISTS (SELECT 1 FROM f WHERE f.scope_id = s.scope_id AND f.sequence = s.sequence AND f.digest = s.tail_event_digest) OR EXISTS (SELECT 1 FROM f WHERE f.scope_id = s.scope_id AND f.writer_epoch > s.scope_epoch)""",
)
def _(t):
    return audit.broken_cursors(t("scopes"), _faulty(t))


@_query("audit_plan_pointer", f"WITH f AS ({_FAULTY}) SELECT scope_id FROM scopes AS s WHERE (active_plan_digest IS NOT NULL) <> EXISTS (SELECT 1 FROM f WHERE f.scope_id = s.scope_id AND f.payload_type = 'plan_admitted')")
def _(t):
    return audit.plan_pointers(t("scopes"), _faulty(t))


@_query("audit_payload_types", f"WITH f AS ({_FAULTY}) SELECT DISTINCT payload_type FROM f WHERE payload_type NOT IN {M.PAYLOAD_TYPES}")
def _(t):
    return audit.unregistered(_faulty(t))


_REV = "scope_id || '|' || work_id || '|' || work_revision"


@_query(
    "audit_uniques",
    f"""WITH f AS ({_FAULTY}) SELECT 'events.digest' AS check_id, scope_id || '|' || digest AS key, count(*) AS "rows" FROM f GROUP BY scope_id, digest HAVING count(*) > 1
      UNION ALL SELECT 'events.operation', scope_id || '|' || operation_id, count(*) FROM f GROUP BY scope_id, operation_id HAVING count(*) > 1
      UNION ALL SELECT 'events.artifact', {_REV} || '|' || attempt || '|' || artifact_kind, count(*) FROM f WHERE artifact_kind IS NOT NULL AND work_id IS NOT NULL GROUP BY scope_id, work_id, work_revision, attempt, artifact_kind HAVING count(*) > 1
      UNION ALL SELECT 'events.key', scope_id || '|' || sequence, count(*) FROM f GROUP BY scope_id, sequence HAVING count(*) > 1
      UNION ALL SELECT 'work.plan', scope_id || '|' || work_id || '|' || plan_digest, count(*) FROM work GROUP BY scope_id, work_id, plan_digest HAVING count(*) > 1""",
)
def _(t):
    return audit.uniques(t("scopes"), _faulty(t), t("work"), t("deps"))


@_query(
    "audit_foreign_keys",
    f"""SELECT 'events.scope' AS check_id, scope_id || '|' || sequence AS key FROM log WHERE scope_id NOT IN (SELECT scope_id FROM scopes WHERE k % 12 <> 4)
      UNION ALL SELECT 'work.scope', {_REV} FROM work WHERE scope_id NOT IN (SELECT scope_id FROM scopes WHERE k % 12 <> 4)
      UNION ALL SELECT 'deps.work', {_REV} || '|' || depends_on_work_id FROM deps AS d WHERE NOT EXISTS (SELECT 1 FROM work AS w WHERE w.key % 50 <> 3 AND w.scope_id = d.scope_id AND w.work_id = d.work_id AND w.work_revision = d.work_revision)""",
)
def _(t):
    kept = t("scopes").filter("k % 12 <> 4")
    own = audit.foreign_keys(kept, t("log"), t("work"), t("deps")).filter("check_id <> 'deps.work'")
    return own.unionByName(audit.foreign_keys(kept, t("log"), t("work").filter("key % 50 <> 3"), t("deps")).filter("check_id = 'deps.work'"))


_HEXA = "NOT regexp_full_match(coalesce({0}, ''), '[0-9a-f]{{64}}')"
_NAMED = "payload_type IN ('grant_activated', 'artifact_reference')"


@_query(
    "audit_checks",
    f"""WITH f AS ({_FAULTY}), w AS (SELECT * REPLACE (CASE WHEN key % 11 = 2 THEN NULL ELSE claim_lease_until END AS claim_lease_until, CASE WHEN key % 13 = 6 THEN 'zz' ELSE plan_digest END AS plan_digest) FROM work)
      SELECT 'events.operation' AS check_id, scope_id || '|' || sequence AS key FROM f WHERE operation_id LIKE '%/%' OR strlen(operation_id) NOT BETWEEN 1 AND 128
      UNION ALL SELECT 'events.digest', scope_id || '|' || sequence FROM f WHERE {_HEXA.format("digest")}
      UNION ALL SELECT 'events.attempt', scope_id || '|' || sequence FROM f WHERE attempt < 1
      UNION ALL SELECT 'events.root', scope_id || '|' || sequence FROM f WHERE NOT ((sequence = 1 AND payload_type = 'root_genesis' AND operation_id = 'root-genesis:' || scope_id) OR (sequence > 1 AND payload_type <> 'root_genesis'))
      UNION ALL SELECT 'events.grant_named', scope_id || '|' || sequence FROM f WHERE ({_NAMED}) <> (grant_digest IS NOT NULL)
      UNION ALL SELECT 'events.work_named', scope_id || '|' || sequence FROM f WHERE ({_NAMED}) <> (work_id IS NOT NULL AND work_revision IS NOT NULL AND attempt IS NOT NULL)
      UNION ALL SELECT 'events.kind_named', scope_id || '|' || sequence FROM f WHERE (payload_type = 'artifact_reference') <> (artifact_kind IS NOT NULL)
      UNION ALL SELECT 'events.artifact_named', scope_id || '|' || sequence FROM f WHERE (payload_type = 'artifact_reference') <> (artifact_digest IS NOT NULL)
      UNION ALL SELECT 'work.claim', {_REV} FROM w WHERE (claim_fence IS NULL) <> (claim_lease_until IS NULL)
      UNION ALL SELECT 'work.plan', {_REV} FROM w WHERE {_HEXA.format("plan_digest")}""",
)
def _(t):
    work = t("work").withColumns({"claim_lease_until": F.when(F.col("key") % 11 == 2, None).otherwise(F.col("claim_lease_until")), "plan_digest": F.when(F.col("key") % 13 == 6, "zz").otherwise(F.col("plan_digest"))})
    return audit.checks(t("scopes"), _faulty(t), work, t("deps"))


@_query(
    "utf8_audit",
    """SELECT CAST(doc_id AS VARCHAR) AS key, 'cut' AS column_name FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0) AS d WHERE substring(h, 2 * ((n - 1) // 2) + 1, 1) >= '8'""",
)
def _(t):
    # the whole text without its middle byte: invalid where that byte was part of a longer character
    raw, n = F.encode(F.col("text"), "UTF-8"), F.octet_length("text")
    half = F.floor((n - 1) / 2).cast("int")
    cut = F.when(n > 0, F.concat(F.substring(raw, F.lit(1), half), F.substring(raw, half + 2, n)))
    return audit.invalid_text(t("texts").select("doc_id", cut.alias("cut"), "text"), F.col("doc_id").cast("string"), ["cut", "text"])


@_query("snapshot_valid", "SELECT scope_id, sequence > 5 AND k % 3 <> 1 AS valid FROM scopes")
def _(t):
    s = t("scopes")
    return audit.snapshot_valid(s, s.select("scope_id", F.when(F.col("sequence") > 5, F.col("sequence")).otherwise(0).alias("sequence"), F.when(F.col("k") % 3 == 1, "none").otherwise(F.col("tail_event_digest")).alias("tail_event_digest"), "active_plan_digest"))


# ---------------------------------------------------------------- verification and fold


@_query(
    "chain_verdict",
    f"""WITH f AS ({_FAULTY}), h AS (SELECT scope_id, scope_epoch + 1 AS head_epoch, operation_id, sequence, tail_event_digest FROM heads),
      r AS (SELECT f.scope_id, f.sequence, CASE WHEN NOT EXISTS (SELECT 1 FROM f AS n WHERE n.scope_id = f.scope_id AND n.sequence > f.sequence) AND (f.sequence <> h.sequence OR f.digest <> h.tail_event_digest) THEN 'reference_mismatch'
        WHEN f.writer_epoch > h.head_epoch THEN 'epoch_ahead_of_head' WHEN f.writer_epoch > (SELECT arg_min(n.writer_epoch, n.sequence) FROM f AS n WHERE n.scope_id = f.scope_id AND n.sequence > f.sequence) THEN 'epoch_regression'
        WHEN (SELECT count(*) FROM f AS n WHERE n.scope_id = f.scope_id AND n.operation_id = f.operation_id) > 1 THEN 'operation_repeated'
        WHEN NOT EXISTS (SELECT 1 FROM f AS n WHERE n.scope_id = f.scope_id AND n.sequence > f.sequence) AND f.operation_id <> h.operation_id THEN 'head_operation_mismatch'
        WHEN f.payload_type NOT IN {M.PAYLOAD_TYPES} THEN 'unregistered_payload' WHEN (f.payload_type = 'root_genesis') <> (f.sequence = 1 AND f.parent_digest IS NULL) THEN 'root_rule'
        WHEN f.sequence > 1 AND NOT EXISTS (SELECT 1 FROM f AS n WHERE n.scope_id = f.scope_id AND n.sequence = f.sequence - 1 AND n.digest = f.parent_digest) THEN 'broken_chain' END AS fault FROM f JOIN h ON f.scope_id = h.scope_id)
      SELECT scope_id, coalesce(arg_max(fault, sequence) FILTER (fault IS NOT NULL), 'valid') AS verdict, count(*) AS events FROM r GROUP BY scope_id""",
)
def _(t):
    return verify.chain_verdicts(_faulty(t), t("heads").withColumn("scope_epoch", F.col("scope_epoch") + 1))


@_query(
    "replay_precheck",
    "WITH c AS (SELECT h.*, CASE WHEN h.k % 5 = 1 THEN s.sequence - 3 WHEN h.k % 7 = 2 THEN s.sequence + 9 ELSE s.sequence END AS c, CASE WHEN h.k % 8 = 3 THEN 'other' ELSE s.tail_event_digest END AS t FROM heads AS h JOIN scopes AS s ON h.scope_id = s.scope_id) SELECT scope_id, CASE WHEN c > sequence THEN 'cursor_ahead' WHEN c = sequence AND t <> tail_event_digest THEN 'tail_mismatch' ELSE 'ok' END AS verdict, CASE WHEN c <= sequence AND NOT (c = sequence AND t <> tail_event_digest) THEN sequence - c END AS unseen FROM c",
)
def _(t):
    s = t("scopes")
    c = F.when(F.col("k") % 5 == 1, F.col("sequence") - 3).when(F.col("k") % 7 == 2, F.col("sequence") + 9).otherwise(F.col("sequence"))
    return verify.precheck(s.select("scope_id", c.alias("sequence"), F.when(F.col("k") % 8 == 3, "other").otherwise(F.col("tail_event_digest")).alias("tail_event_digest")), t("heads"))


@_query(
    "batch_verdict",
    """WITH b AS (SELECT l.*, s.sequence - 4 AS boundary FROM log AS l JOIN scopes AS s ON s.scope_id = l.scope_id WHERE l.sequence > s.sequence - 4),
      h AS (SELECT l.scope_id, l.sequence, l.digest, l.operation_id, l.writer_epoch + l.k % 2 AS epoch, EXISTS (SELECT 1 FROM log AS p WHERE p.scope_id = l.scope_id AND p.payload_type = 'plan_admitted' AND p.sequence <= l.sequence) AS held FROM log AS l JOIN (SELECT DISTINCT scope_id, boundary FROM b) AS x ON x.scope_id = l.scope_id AND x.boundary = l.sequence)
      SELECT b.scope_id, bool_and(b.writer_epoch = h.epoch AND b.operation_id <> h.operation_id AND NOT (b.payload_type = 'plan_admitted' AND h.held)) AS accepted, count(*) AS events FROM b JOIN h ON h.scope_id = b.scope_id GROUP BY b.scope_id""",
)
def _(t):
    log, edge = t("log"), t("scopes").select("scope_id", (F.col("sequence") - 4).alias("boundary"))
    at = log.join(edge, "scope_id")
    plan = log.filter("payload_type = 'plan_admitted'").select("scope_id", F.col("sequence").alias("plan_at"), F.col("plan_digest").alias("own_plan"))
    head = at.filter("sequence = boundary").drop("plan_digest").join(plan, "scope_id", "left").select("scope_id", "sequence", F.col("digest").alias("tail_event_digest"), "operation_id", (F.col("writer_epoch") + F.col("k") % 2).alias("scope_epoch"), F.when(F.col("plan_at") <= F.col("sequence"), F.col("own_plan")).alias("active_plan_digest"))
    return verify.batch_verdicts(at.filter("sequence > boundary").join(head.select("scope_id"), "scope_id", "left_semi"), head)


_LOST = "SELECT s.scope_id, CASE WHEN s.k % 4 = 0 THEN 'op-lost' ELSE l.operation_id END AS operation_id, CASE WHEN s.k % 4 IN (0, 1) THEN SHA['lost'] ELSE l.digest END AS digest, s.sequence - 5 AS boundary, s.k FROM scopes AS s JOIN log AS l ON l.scope_id = s.scope_id AND l.sequence = s.sequence - 2 WHERE s.sequence > 6"


@_query(
    "reconcile_verdict",
    f"""WITH c AS ({_LOST}) SELECT c.scope_id, CASE WHEN c.k % 11 = 3 OR c.k % 17 = 2 OR EXISTS (SELECT 1 FROM log AS l WHERE l.scope_id = c.scope_id AND l.sequence > c.boundary AND ((l.operation_id = c.operation_id) <> (l.digest = c.digest))) THEN 'unresolved'
      WHEN EXISTS (SELECT 1 FROM log AS l WHERE l.scope_id = c.scope_id AND l.sequence > c.boundary AND l.operation_id = c.operation_id) THEN 'committed_superseded' ELSE 'proven_not_committed' END AS verdict FROM c""",
)
def _(t):
    log, s = t("log"), t("scopes").filter("sequence > 6").select("scope_id", F.col("sequence").alias("last"), "k")
    at = log.drop("k").join(s, "scope_id").filter(F.col("sequence") == F.col("last") - 2)
    lost = at.select("scope_id", F.when(F.col("k") % 4 == 0, "op-lost").otherwise(F.col("operation_id")).alias("operation_id"), F.when(F.col("k") % 4 <= 1, F.sha2(F.lit("lost"), 256)).otherwise(F.col("digest")).alias("digest"), (F.col("last") - 5).alias("boundary"), F.lit(1).alias("boundary_epoch"))
    return verify.reconcile(lost, log, t("heads"))


@_query("cursor_fold", "SELECT scope_id, s.sequence, tail_event_digest, (SELECT operation_id FROM log AS l WHERE l.scope_id = s.scope_id AND l.sequence = s.sequence) AS operation_id, (SELECT max(writer_epoch) FROM log AS l WHERE l.scope_id = s.scope_id) AS writer_epoch, (SELECT plan_digest FROM log AS l WHERE l.scope_id = s.scope_id AND l.payload_type = 'plan_admitted') AS active_plan_digest FROM scopes AS s")
def _(t):
    return fold.fold_cursors(t("log"))


_GRANTS = "SELECT scope_id, work_id, work_revision, CAST(sum(units) AS BIGINT) AS granted_units, arg_max(claim_fence, sequence) AS grant_fence, arg_max(grant_digest, sequence) AS grant_digest, arg_max(attempt, sequence) AS granted_attempt, count(*) AS activations FROM log WHERE payload_type = 'grant_activated' GROUP BY scope_id, work_id, work_revision"


@_query("grant_fold", _GRANTS)
def _(t):
    return fold.fold_grants(t("log"))


@_query("snapshot_resume", _GRANTS)
def _(t):
    return fold.resume(fold.fold_grants(t("log").filter("sequence <= 30")), t("log").filter("sequence > 30"))


@_query("latest_grant", "SELECT scope_id, work_id, work_revision, sequence, grant_digest FROM log AS l WHERE payload_type = 'grant_activated' AND NOT EXISTS (SELECT 1 FROM log AS n WHERE n.scope_id = l.scope_id AND n.work_id = l.work_id AND n.payload_type = 'grant_activated' AND n.sequence > l.sequence)")
def _(t):
    w = Window.partitionBy("scope_id", "work_id", "work_revision").orderBy(F.desc("sequence"))
    return t("log").filter("payload_type = 'grant_activated'").withColumn("r", F.row_number().over(w)).filter("r = 1").select("scope_id", "work_id", "work_revision", "sequence", "grant_digest")


@_query("plan_as_of", "SELECT scope_id, sequence, (SELECT max(plan_digest) FROM log AS p WHERE p.scope_id = l.scope_id AND p.payload_type = 'plan_admitted' AND p.sequence <= l.sequence) AS plan_digest FROM log AS l")
def _(t):
    return fold.plan_as_of(t("log"))


_ADMISSIONS = """SELECT scope_id, work_id, work_revision, CASE WHEN fence = 6 THEN SHA['other'] ELSE SHA['plan'] END AS plan_digest, fence AS epoch,
      CAST(1 + floor((arrival - 1) / 40.0) AS BIGINT) AS projected_epoch, arrival FROM claim_ops"""


@_query(
    "work_upsert",
    f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY scope_id, work_id, work_revision ORDER BY arrival) AS n FROM ({_ADMISSIONS}) AS x),
      r AS (SELECT scope_id, work_id, work_revision, 0 AS n, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS BIGINT) AS e, 0 AS x FROM a WHERE n = 1
        UNION ALL SELECT q.scope_id, q.work_id, q.work_revision, q.n, CASE WHEN q.ok THEN q.plan_digest ELSE q.p END, CASE WHEN q.ok THEN q.epoch ELSE q.e END, q.x + CASE WHEN q.ok THEN 0 ELSE 1 END FROM (
          SELECT a.*, r.p, r.e, r.x, a.epoch >= a.projected_epoch AND (r.p IS NULL OR (r.p = a.plan_digest AND r.e <= a.epoch)) AS ok
          FROM r JOIN a ON a.scope_id = r.scope_id AND a.work_id = r.work_id AND a.work_revision = r.work_revision AND a.n = r.n + 1) AS q)
      SELECT scope_id, work_id, work_revision, coalesce(p, '') AS plan_digest, coalesce(e, -1) AS epoch, CAST(x AS BIGINT) AS conflicts FROM r QUALIFY n = max(n) OVER (PARTITION BY scope_id, work_id, work_revision)""",
)
def _(t):
    plan = F.when(F.col("fence") == 6, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.lit("plan"), 256))
    projected = (1 + F.floor((F.col("arrival") - 1) / 40)).alias("projected_epoch")
    admissions = t("claim_ops").select("scope_id", "work_id", "work_revision", plan.alias("plan_digest"), F.col("fence").alias("epoch"), projected, "arrival")
    return fold.upsert_work(admissions).na.fill("", ["plan_digest"]).na.fill(-1, ["epoch"])


_CLAIMS = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY scope_id, work_id ORDER BY arrival) AS n FROM claim_ops),
      r AS (SELECT scope_id, work_id, work_revision, 0 AS n, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS l, CAST(NULL AS VARCHAR) AS e, 0 AS x FROM o WHERE n = 1
        UNION ALL SELECT q.scope_id, q.work_id, q.work_revision, q.n, CASE WHEN q.claims THEN q.fence ELSE q.f END, CASE WHEN q.claims THEN q.lease_until ELSE q.l END, CASE WHEN q.closes THEN q.ev ELSE q.e END, q.x + CASE WHEN q.claims OR q.closes THEN 0 ELSE 1 END FROM (
          SELECT o.scope_id, o.work_id, o.work_revision, o.n, o.fence, o.lease_until, o.terminal_result_digest AS ev, r.f, r.l, r.e, r.x,
            o.terminal_result_digest IS NULL AND r.e IS NULL AND (r.f IS NULL OR (o.fence > r.f AND r.l <= o.now_ms) OR (o.fence = r.f AND r.l <= o.lease_until)) AS claims,
            o.terminal_result_digest IS NOT NULL AND coalesce(o.fence = r.f, false) AND coalesce(r.e = o.terminal_result_digest, true) AS closes
          FROM r JOIN o ON o.scope_id = r.scope_id AND o.work_id = r.work_id AND o.n = r.n + 1) AS q)
      SELECT scope_id, work_id, work_revision, arg_max(coalesce(f, -1), n) AS claim_fence, arg_max(coalesce(l, -1), n) AS claim_lease_until, arg_max(coalesce(e, ''), n) AS terminal_result_digest, CAST(arg_max(x, n) AS BIGINT) AS refused FROM r GROUP BY scope_id, work_id, work_revision"""


@_query("claim_fold", _CLAIMS)
def _(t):
    return fold.fold_claims(t("claim_ops")).na.fill(-1, ["claim_fence", "claim_lease_until"]).na.fill("", ["terminal_result_digest"])


@_query("snapshot_sanitize", "SELECT scope_id, work_id, work_revision, plan_digest, CAST(NULL AS BIGINT) AS claim_fence, CAST(NULL AS BIGINT) AS claim_lease_until, grant_fence, granted_units, CAST(NULL AS VARCHAR) AS terminal_result_digest FROM work")
def _(t):
    out = fold.sanitize_snapshot(t("work"), t("scopes"))
    return out.select("scope_id", "work_id", "work_revision", "plan_digest", "claim_fence", "claim_lease_until", "grant_fence", "granted_units", "terminal_result_digest")


@_query("edge_closure", "SELECT scope_id, work_id, depends_on_work_id FROM deps AS d WHERE NOT EXISTS (SELECT 1 FROM work AS w WHERE w.key % 6 <> 1 AND w.scope_id = d.scope_id AND w.work_id = d.depends_on_work_id AND w.work_revision = d.depends_on_work_revision)")
def _(t):
    return graph.edge_closure(t("deps"), t("work").filter("key % 6 <> 1"))


# ---------------------------------------------------------------- intake


@_query(
    "submission_intake",
    """SELECT scope_id, work_id, work_revision, CASE WHEN key % 13 = 0 THEN 'absent' WHEN key % 17 = 0 THEN 'malformed' WHEN key % 3 = 0 THEN 'not_sealed' WHEN key % 19 = 0 THEN 'identity_mismatch' WHEN key % 23 = 0 AND claim_fence IS NOT NULL THEN 'stale_fence'
      WHEN key % 29 = 0 THEN 'missing_evidence' WHEN key % 31 = 7 OR key % 37 = 0 THEN 'evidence_mismatch' ELSE 'sealed' END AS verdict FROM claims""",
)
def _(t):
    return intake.submission_intake(t("claims"))


def _grants(t):
    k = F.col("key")
    return t("work").filter("grant_fence IS NOT NULL").select(
        "scope_id", "work_id", "work_revision", (F.col("grant_fence") - F.when(k % 12 == 1, 1).otherwise(0)).alias("fence"), (k % 13 != 0).alias("found"), (k % 17 != 0).alias("decodes"), (k % 19 != 0).alias("same_identity"), F.col("grant_deadline_unix_ms").alias("deadline_unix_ms"), F.lit(10).alias("limit_units"),
        F.when(k % 23 == 0, 5).otherwise(10).alias("max_units"), F.col("grant_deadline_unix_ms").alias("max_deadline_unix_ms"), F.when(k % 29 == 0, "other").otherwise(F.col("grant_digest")).alias("object_digest"),
    )


@_query(
    "grant_intake",
    f"""WITH au AS ({_AUTHORITIES}), c AS ({_CONTINUABLE}), g AS (SELECT *, grant_fence - CASE WHEN key % 12 = 1 THEN 1 ELSE 0 END AS fence FROM work WHERE grant_fence IS NOT NULL),
      v AS (SELECT g.scope_id, g.work_id, g.work_revision, h.lease_until, c.claim_lease_until AS row_lease, CASE WHEN h.lease_until IS NULL OR h.lease_until - {NOW_MS} < 5000 THEN 'stale_authority' WHEN g.key % 13 = 0 THEN 'absent' WHEN g.key % 17 = 0 THEN 'malformed' WHEN g.key % 19 = 0 THEN 'identity_mismatch'
        WHEN g.grant_deadline_unix_ms <= {NOW_MS} THEN 'expired' WHEN g.key % 23 = 0 THEN 'wider_than_requested' WHEN EXISTS (SELECT 1 FROM au WHERE au.scope_id = g.scope_id AND scope_epoch > epoch) THEN 'stale_authority' WHEN c.claim_fence IS NULL THEN 'revoked'
        WHEN c.claim_fence = g.fence AND (g.key % 29 = 0) THEN 'identity_mismatch' WHEN c.claim_fence = g.fence THEN 'accepted' WHEN c.claim_fence > g.fence THEN 'stale_fence' ELSE 'revoked' END AS verdict
        FROM g LEFT JOIN heads AS h ON h.scope_id = g.scope_id LEFT JOIN c ON c.verdict = 'continuable' AND c.scope_id = g.scope_id AND c.work_id = g.work_id)
      SELECT scope_id, work_id, work_revision, verdict, CASE WHEN verdict = 'accepted' THEN least(lease_until, row_lease) - 5000 END AS authority_stop_unix_ms FROM v""",
)
def _(t):
    return intake.grant_intake(_grants(t), scheduling.continuable(t("work"), t("scopes"), _authorities(t), NOW_MS), t("heads"), NOW_MS)


@_query(
    "effect_authorize",
    f"""SELECT scope_id, work_id, work_revision, CASE WHEN key % 19 = 0 THEN 'identity_mismatch' WHEN key % 90 > granted_units THEN 'narrower_than_request' WHEN claim_lease_until - 5000 <= {NOW_MS} THEN 'stale_authority' WHEN grant_deadline_unix_ms <= {NOW_MS} THEN 'expired' ELSE 'authorized' END AS verdict,
      CASE WHEN NOT (key % 19 = 0 OR key % 90 > granted_units OR claim_lease_until - 5000 <= {NOW_MS} OR grant_deadline_unix_ms <= {NOW_MS}) THEN least(grant_deadline_unix_ms, claim_lease_until - 5000) - {NOW_MS} END AS remaining_ms FROM work WHERE grant_fence IS NOT NULL""",
)
def _(t):
    e = t("work").filter("grant_fence IS NOT NULL").select("scope_id", "work_id", "work_revision", (F.col("key") % 19 != 0).alias("same_identity"), (F.col("key") % 90).alias("request_tokens"), F.col("granted_units").alias("limit_units"), (F.col("claim_lease_until") - 5000).alias("authority_stop_unix_ms"), F.col("grant_deadline_unix_ms").alias("deadline_unix_ms"))
    return intake.effect_authorize(e, NOW_MS)


@_query(
    "authority_transition",
    f"""WITH c AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'node-1' WHEN k % 5 = 1 THEN 'node-9' ELSE controller_instance_id END AS now_owner, scope_epoch + CASE WHEN k % 5 IN (0, 1) THEN 1 ELSE 0 END AS now_epoch FROM heads)
      SELECT scope_id, CASE WHEN controller_instance_id <> 'node-1' AND lease_until > {NOW_MS} THEN 'held' WHEN now_owner = 'node-1' AND now_epoch = scope_epoch + 1 THEN 'acquired' WHEN now_epoch > scope_epoch THEN 'superseded' ELSE 'unresolved' END AS verdict,
        CASE WHEN NOT coalesce(controller_instance_id <> 'node-1' AND lease_until > {NOW_MS}, false) THEN scope_epoch + 1 END AS candidate_epoch FROM c""",
)
def _(t):
    h = t("heads")
    now = h.select("scope_id", F.when(F.col("k") % 5 == 0, "node-1").when(F.col("k") % 5 == 1, "node-9").otherwise(F.col("controller_instance_id")).alias("controller_instance_id"), (F.col("scope_epoch") + (F.col("k") % 5 < 2).cast("long")).alias("scope_epoch"))
    return intake.authority_transition(h, now, "node-1", NOW_MS)


_CALLS = """SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE l_partkey % 9 WHEN 0 THEN 'throttling' WHEN 1 THEN 'construction' WHEN 2 THEN 'unmodelled' WHEN 3 THEN 'validation' END AS error, l_suppkey % 2 = 0 AS status_ok, l_suppkey % 3 = 0 AS prior_unknown,
      CASE l_partkey % 5 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'tool_use' WHEN 3 THEN 'stop_sequence' ELSE 'surprise' END AS reason, CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'text' END AS text, l_linenumber % 3 <> 0 AS has_use,
      CAST(l_partkey % 7 AS BIGINT) AS input_tokens, CAST(l_suppkey % 6 - 1 AS BIGINT) AS output_tokens, CAST(l_partkey % 7 + l_suppkey % 6 - l_linenumber % 2 AS BIGINT) AS total_tokens, CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_suppkey % 3 - 1 AS BIGINT) END AS cache_read_tokens, CAST(4 AS BIGINT) AS cap FROM lineitem"""


@_query(
    "outcome_classify",
    f"""WITH c AS ({_CALLS}), r AS (SELECT *, coalesce(map_from_entries([('end_turn', 'end_turn'), ('max_tokens', 'cap_reached'), ('tool_use', 'tool_use_requested'), ('stop_sequence', 'stop_sequence')])[reason], 'unrecognized') AS tr,
        has_use AND input_tokens >= 0 AND output_tokens >= 0 AND total_tokens >= 0 AND coalesce(cache_read_tokens, 0) >= 0 AND total_tokens >= input_tokens + output_tokens AND (input_tokens > 0 OR coalesce(cache_read_tokens, 0) > 0) AND output_tokens <= cap AS use FROM c)
      SELECT call_id, tr AS terminal_reason, CASE WHEN error = 'construction' AND NOT prior_unknown THEN 'proven_not_sent' WHEN error = 'construction' THEN 'unknown' WHEN error = 'throttling' THEN 'rate_limited' WHEN error = 'validation' THEN 'rejected' WHEN error IS NOT NULL AND status_ok THEN 'malformed_response' WHEN error IS NOT NULL THEN 'unknown'
        WHEN tr IN ('tool_use_requested', 'unrecognized') THEN 'refused' WHEN has_use AND NOT use THEN 'malformed_response' WHEN text IS NULL THEN 'malformed_response' WHEN text = '' AND tr <> 'cap_reached' THEN 'completed' WHEN text = '' OR (has_use AND output_tokens = 0) THEN 'malformed_response' ELSE 'completed' END AS outcome FROM r""",
)
def _(t):
    return intake.classify_outcome(t("calls"))


@_query(
    "mutation_outcome",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN st BETWEEN 200 AND 299 THEN 'committed' WHEN st = -1 AND NOT p THEN 'proven_not_sent' WHEN st = 404 THEN 'not_found' WHEN st IN (409, 412) AND p THEN 'ambiguous_conflict' WHEN st = 409 THEN 'conflict' WHEN st = 412 THEN 'precondition_failed' ELSE 'unknown' END AS outcome
      FROM (SELECT *, CASE l_partkey % 7 WHEN 0 THEN 200 WHEN 1 THEN -1 WHEN 2 THEN 404 WHEN 3 THEN 409 WHEN 4 THEN 412 WHEN 5 THEN 500 END AS st, l_suppkey % 2 = 0 AS p FROM lineitem)""",
)
def _(t):
    m = F.col("l_partkey") % 7
    status = F.when(m == 0, 200).when(m == 1, -1).when(m == 2, 404).when(m == 3, 409).when(m == 4, 412).when(m == 5, 500)
    return t("lineitem_rows").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), intake.mutation_outcome(status, F.col("l_suppkey") % 2 == 0).alias("outcome"))


# ---------------------------------------------------------------- packs

_ASK = "SELECT scope_id, 1 + k % 5 AS first, sequence - k % 4 AS last FROM scopes"


@_query(
    "pack_coverage",
    f"""WITH q AS ({_ASK}), x AS (SELECT q.*, (SELECT count(*) FROM log AS l WHERE l.scope_id = q.scope_id AND l.sequence BETWEEN q.first AND q.last AND NOT EXISTS (SELECT 1 FROM packs AS p WHERE p.scope_id = q.scope_id AND l.sequence BETWEEN p.first_sequence AND p.last_sequence)) AS missing,
        (SELECT count(*) FROM packs AS p WHERE p.scope_id = q.scope_id AND p.first_sequence <= q.last AND p.last_sequence >= q.first) AS n FROM q)
      SELECT scope_id, "first", "last", missing = 0 AND n > 0 AS covered, CASE WHEN missing = 0 AND n > 0 THEN n ELSE 0 END AS packs FROM x""",
)
def _(t):
    return accel.coverage(t("scopes").select("scope_id", (1 + F.col("k") % 5).alias("first"), (F.col("sequence") - F.col("k") % 4).alias("last")), t("packs"))


@_query(
    "pack_gaps",
    """WITH m AS (SELECT scope_id, sequence, sequence - row_number() OVER (PARTITION BY scope_id ORDER BY sequence) AS run FROM log AS l WHERE NOT EXISTS (SELECT 1 FROM packs AS p WHERE p.scope_id = l.scope_id AND l.sequence BETWEEN p.first_sequence AND p.last_sequence))
      SELECT scope_id, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM m GROUP BY scope_id, run""",
)
def _(t):
    return accel.gaps(t("scopes"), t("packs"))


@_query("pack_segments", "SELECT scope_id, (sequence - 1) // 20 AS pack, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS events, CAST(sum(stored_bytes) AS BIGINT) AS bytes FROM log GROUP BY ALL")
def _(t):
    return accel.segments(t("log"), 20)


@_query(
    "pack_segments_bytes",
    """WITH RECURSIVE o AS (SELECT scope_id, sequence, stored_bytes, row_number() OVER (PARTITION BY scope_id ORDER BY sequence) AS n FROM log),
      r AS (SELECT scope_id, sequence, n, stored_bytes AS b, CAST(0 AS BIGINT) AS pack, CAST(1 AS BIGINT) AS held, stored_bytes AS total FROM o WHERE n = 1
        UNION ALL SELECT x.scope_id, x.sequence, x.n, x.stored_bytes, x.pack + CASE WHEN x.full THEN 1 ELSE 0 END, CASE WHEN x.full THEN 1 ELSE x.held + 1 END, CASE WHEN x.full THEN 0 ELSE x.total END + x.stored_bytes
          FROM (SELECT o.*, r.pack, r.held, r.total, r.held = 20 OR r.total + o.stored_bytes > 8000 AS full FROM r JOIN o ON o.scope_id = r.scope_id AND o.n = r.n + 1) AS x)
      SELECT scope_id, pack, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS events, CAST(sum(b) AS BIGINT) AS bytes FROM r GROUP BY scope_id, pack""",
)
def _(t):
    return accel.segments_by_bytes(t("log"), 20, 8_000)


@_query("pack_roundtrip", "SELECT scope_id, sequence, SHA[concat('body|', digest)] AS digest FROM log")
def _(t):
    body = t("log").select("scope_id", "sequence", F.concat(F.lit("body|"), "digest").alias("b"))
    packs = accel.build_packs(body.select("scope_id", "sequence", F.sha2("b", 256).alias("digest"), F.encode("b", "UTF-8").alias("payload")), "payload")
    return accel.read_packs(packs).select("scope_id", "sequence", "digest")


_CATALOGS = "SELECT scope_id, first_sequence - CASE WHEN pack_id % 5 = 2 AND last_sequence % 7 < 4 THEN 3 ELSE 0 END AS first_sequence, CASE WHEN pack_id % 11 = 4 THEN first_sequence - 4 ELSE last_sequence END AS last_sequence FROM packs"


@_query(
    "catalog_valid",
    f"""WITH c AS ({_CATALOGS}) SELECT scope_id, NOT EXISTS (SELECT 1 FROM c AS a WHERE a.scope_id = p.scope_id AND a.last_sequence < a.first_sequence)
        AND NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY first_sequence, last_sequence) AS n FROM c) AS a JOIN (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY first_sequence, last_sequence) AS n FROM c) AS b
          ON a.scope_id = b.scope_id AND b.n = a.n + 1 WHERE a.scope_id = p.scope_id AND b.first_sequence <= a.last_sequence) AS valid, count(*) AS packs FROM c AS p GROUP BY scope_id""",
)
def _(t):
    first, last, at = F.col("first_sequence"), F.col("last_sequence"), F.col("pack_id")
    damaged = t("packs").withColumns({"first_sequence": first - F.when((at % 5 == 2) & (last % 7 < 4), 3).otherwise(0), "last_sequence": F.when(at % 11 == 4, first - 4).otherwise(last)})
    return accel.catalog_valid(damaged)


@_query("running_budget", "SELECT scope_id, sequence, CAST((SELECT sum(stored_bytes) FROM log AS m WHERE m.scope_id = l.scope_id AND m.sequence <= l.sequence) AS BIGINT) AS running_bytes, (SELECT sum(stored_bytes) FROM log AS m WHERE m.scope_id = l.scope_id AND m.sequence <= l.sequence) <= 20000 AS fits FROM log AS l")
def _(t):
    return accel.within_budget(t("log"), 20_000)


# ---------------------------------------------------------------- measures


_PRICED = """SELECT a.*, p.o IS NULL AS unknown, taken * p.i * CASE WHEN taken > 272000 THEN 2 ELSE 1 END * 1000 + output_tokens * p.o * CASE WHEN taken > 272000 THEN 1500 ELSE 1000 END AS nano
      FROM (SELECT *, input_tokens + cached_input_tokens AS taken FROM attempts) AS a LEFT JOIN (VALUES ('model-one', 5, 25), ('model-two', 5, 30)) AS p(m, i, o) ON a.model = p.m"""


@_query(
    "measure_cost",
    f"""SELECT run_seq, phase, CASE WHEN NOT bool_or(unknown) THEN CAST(sum(nano) AS BIGINT) END AS nano_usd, count(*) FILTER (unknown) AS unpriced, count(*) AS calls,
        phase = 'treatment' AND count(*) > 400 AS over_cap FROM ({_PRICED}) AS p GROUP BY run_seq, phase""",
)
def _(t):
    return measure.cost(t("attempts"))


@_query(
    "measure_cost_per_resolved",
    f"""SELECT r.run_seq, CASE WHEN f <> 0 THEN c.nano // f END AS nano_usd_per_target FROM (SELECT run_seq, count(*) FILTER (status = 'F' AND flag <> 'R') AS f FROM attempts GROUP BY run_seq) AS r
      LEFT JOIN (SELECT run_seq, CASE WHEN NOT bool_or(unknown) THEN CAST(sum(nano) AS BIGINT) END AS nano FROM ({_PRICED}) AS p GROUP BY run_seq) AS c ON c.run_seq = r.run_seq""",
)
def _(t):
    return measure.cost_per_resolved(measure.cost(t("attempts")), _resolved(t))


def _resolved(t):
    return t("attempts").groupBy("run_seq").agg(F.count_if((F.col("status") == "F") & (F.col("flag") != "R")).alias("resolved"))


@_query("measure_utilization", "SELECT run_seq, CAST(sum(busy_ms) AS BIGINT) AS busy_ms, CAST(sum(life_ms) AS BIGINT) AS life_ms, CASE WHEN sum(life_ms) > 0 THEN round(CAST(sum(busy_ms) AS DOUBLE) / CAST(sum(life_ms) AS DOUBLE), 6) END AS utilization FROM attempts GROUP BY run_seq")
def _(t):
    return measure.utilization(t("attempts"))


_WALL = """SELECT r.run_seq, pilot, cell, CASE pilot WHEN 'research' THEN treatment_end_ms - (SELECT min(ts_ms) FROM attempts AS a WHERE a.run_seq = r.run_seq AND (a.record = 'dispatch' OR a.record = 'attempt' OR a.record = 'model_call' OR a.record = 'busy_interval'))
      ELSE measurement_end_ms - start_ms END AS wall_ms FROM runs AS r"""


@_query("measure_wall_clock", _WALL)
def _(t):
    return measure.wall_clock(t("runs"), t("attempts"))


@_query(
    "measure_scaling",
    f"""WITH w AS ({_WALL}), m AS (SELECT pilot, cell, count(*) AS runs, median(wall_ms) AS md FROM w GROUP BY pilot, cell)
      SELECT m.pilot, m.cell, m.runs, round(m.md, 6) AS median_ms, round(b.md / m.md, 6) AS speedup, round(b.md / m.md / CASE m.cell WHEN 'A' THEN 1 WHEN 'B' THEN 4 ELSE 7 END, 6) AS efficiency FROM m LEFT JOIN m AS b ON b.pilot = m.pilot AND b.cell = 'A'""",
)
def _(t):
    return measure.scaling(measure.wall_clock(t("runs"), t("attempts")))


@_query(
    "measure_omission",
    """SELECT r.run_seq, coalesce(omitted, 0) AS omitted, coalesce(reference, 0) AS reference, coalesce(round(omitted / reference, 6), 0) AS rate FROM runs AS r
      LEFT JOIN (SELECT run_seq, count(*) FILTER (NOT hit) AS omitted, count(*) AS reference FROM (SELECT run_seq, item, bool_or(flag <> 'R') AS hit FROM attempts WHERE item % 6 <> 1 GROUP BY run_seq, item) AS i GROUP BY run_seq) AS o ON o.run_seq = r.run_seq""",
)
def _(t):
    return _omission(t)


def _omission(t):
    return measure.omission(t("attempts").withColumn("struck", F.col("item") % 6 == 1), t("attempts").filter("flag <> 'R'"), t("runs"))


@_query(
    "measure_rates",
    """SELECT run_seq, round(count(*) FILTER (flag = 'R') / nullif(count(*) FILTER (flag <> 'N'), 0), 6) AS correction_rate, round(count(*) FILTER (flag = 'A' AND status = 'F') / count(*), 6) AS rejection_rate,
      round(count(*) FILTER (item = 6 AND status = 'O') / nullif(count(*) FILTER (item = 6), 0), 6) AS conflict_rate FROM attempts GROUP BY run_seq""",
)
def _(t):
    flag, status = F.col("flag"), F.col("status")
    candidates = t("attempts").select("run_seq", (flag != "N").alias("judged"), (flag == "R").alias("corrected"), ((flag == "A") & (status == "F")).alias("rejected"))
    integrations = t("attempts").filter("record = 'integration_attempt'").select("run_seq", F.when(status == "O", "conflict").otherwise("integrated").alias("outcome"))
    return measure.rates(candidates, integrations)


_JUDGE = ("CASE flag WHEN 'R' THEN 'incorrect' ELSE 'supported' END", "CASE WHEN status = 'O' AND item % 3 = 0 THEN 'unresolved' WHEN flag = 'R' THEN 'incorrect' ELSE 'supported' END")


def _verdicts(t):
    return t("attempts").select("run_seq", "artifact", F.expr(_JUDGE[0]).alias("judge_one"), F.expr(_JUDGE[1]).alias("judge_two"))


@_query(
    "measure_grades",
    f"""WITH v AS (SELECT run_seq, artifact, {_JUDGE[0]} AS a, {_JUDGE[1]} AS b FROM attempts)
      SELECT run_seq, count(*) FILTER (a = b AND a = 'supported') AS supported, count(*) FILTER (a = b AND a = 'incorrect') AS incorrect, count(*) FILTER (a <> b) AS unresolved, count(DISTINCT artifact) FILTER (a = b AND a = 'supported') AS useful_artifacts,
        coalesce(round(count(*) FILTER (a = b AND a = 'incorrect') / nullif(count(*) FILTER (a = b), 0), 6), 1) AS incorrect_rate FROM v GROUP BY run_seq""",
)
def _(t):
    return measure.grades(_verdicts(t))


@_query("measure_wasted", "SELECT run_seq, count(*) AS wasted FROM attempts AS a WHERE NOT EXISTS (SELECT 1 FROM attempts AS b WHERE b.run_seq = a.run_seq AND b.item = a.item AND b.status = 'F') GROUP BY run_seq")
def _(t):
    return measure.wasted(t("attempts"), t("attempts").filter("status = 'F'"))


_SPANS = "SELECT run_seq, CASE WHEN item % 2 = 0 THEN 'queued' ELSE 'busy' END AS kind, ts_ms AS start_ms, ts_ms + busy_ms * 100000 AS end_ms FROM attempts"


@_query(
    "measure_idle",
    f"""WITH s AS ({_SPANS}), p AS (SELECT DISTINCT run_seq, ts FROM (SELECT run_seq, start_ms AS ts FROM s UNION ALL SELECT run_seq, end_ms FROM s)), g AS (SELECT run_seq, ts, lead(ts) OVER (PARTITION BY run_seq ORDER BY ts) AS nxt FROM p),
      w AS (SELECT run_seq, CAST(coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.run_seq = g.run_seq AND kind = 'queued' AND start_ms <= ts AND end_ms > ts) AND NOT EXISTS (SELECT 1 FROM s WHERE s.run_seq = g.run_seq AND kind = 'busy' AND start_ms <= ts AND end_ms > ts) THEN nxt - ts END), 0) AS BIGINT) AS idle FROM g GROUP BY run_seq)
      SELECT r.run_seq, CASE WHEN cell = 'C' THEN coalesce(idle, 0) ELSE 0 END AS idle_ms FROM runs AS r LEFT JOIN w ON w.run_seq = r.run_seq""",
)
def _(t):
    s = t("attempts").select("run_seq", F.when(F.col("item") % 2 == 0, "queued").otherwise("busy").alias("kind"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.col("busy_ms") * 100000).alias("end_ms"))
    return measure.idle(s, t("runs"))


_GRADED = f"""SELECT run_seq, count(*) FILTER (a = b AND a = 'supported') AS supported, coalesce(round(count(*) FILTER (a = b AND a = 'incorrect') / nullif(count(*) FILTER (a = b), 0), 6), 1) AS wrong,
        count(*) FILTER (status = 'F' AND flag <> 'R') AS resolved, count(*) FILTER (status = 'O' AND flag = 'N' AND item = 7 AND artifact % 2 = 1) = 0 AND run_seq % 61 <> 0 AS passed
      FROM (SELECT *, {_JUDGE[0]} AS a, {_JUDGE[1]} AS b FROM attempts) AS v GROUP BY run_seq"""
_COUNTED = f"SELECT r.run_seq, campaign, pilot, cell, measured, CASE pilot WHEN 'research' THEN supported ELSE resolved END AS outcome, wrong, passed FROM runs AS r JOIN ({_GRADED}) AS g ON g.run_seq = r.run_seq"


def _counts(t):
    outcome = F.when(F.col("pilot") == "research", F.col("supported")).otherwise(F.col("resolved"))
    return t("runs").join(measure.grades(_verdicts(t)), "run_seq").join(_resolved(t), "run_seq").withColumn("outcome", outcome)


@_query(
    "measure_efficiency",
    f"""WITH c AS ({_COUNTED}), m AS (SELECT campaign, pilot, median(outcome) AS base FROM c WHERE cell = 'A' GROUP BY campaign, pilot)
      SELECT c.run_seq, c.campaign, c.pilot, c.cell, round(outcome / nullif(base, 0) / CASE c.cell WHEN 'A' THEN 1 WHEN 'B' THEN 4 ELSE 7 END, 6) AS efficiency FROM c LEFT JOIN m ON m.campaign = c.campaign AND m.pilot = c.pilot""",
)
def _(t):
    return measure.efficiency(_counts(t).select("run_seq", "campaign", "pilot", "cell", "outcome"))


def _rediscovery(t):
    found = t("attempts").filter("status = 'O' AND flag = 'N' AND record = 'final_measurement'").select("run_seq", (F.col("artifact") % 2 == 0).alias("exempt"))
    reports = t("runs").select("run_seq", F.when(F.col("run_seq") % 61 == 0, "changed").otherwise("rule").alias("rule_digest"), F.lit("rule").alias("expected_digest"))
    return measure.rediscovery(found, reports)


@_query(
    "measure_rediscovery",
    """SELECT run_seq, CASE WHEN run_seq % 61 = 0 OR run_seq IN (SELECT run_seq FROM attempts WHERE status = 'O' AND flag = 'N' AND item = 7 AND artifact % 2 = 1) THEN 'fail' ELSE 'pass' END AS verdict FROM runs""",
)
def _(t):
    return _rediscovery(t)


@_query(
    "measure_resolutions",
    """WITH c AS (SELECT a.*, campaign FROM attempts AS a JOIN runs AS r ON r.run_seq = a.run_seq), i AS (SELECT DISTINCT campaign, artifact % 20 AS target FROM c WHERE artifact % 20 <> 7)
      SELECT r.run_seq, (SELECT count(*) FROM (SELECT bool_and(status = 'F' AND flag <> 'R') AS ok FROM attempts AS e WHERE e.run_seq = r.run_seq GROUP BY artifact % 20) AS x WHERE ok) AS resolved,
        (SELECT count(*) FROM i WHERE i.campaign = r.campaign AND NOT EXISTS (SELECT 1 FROM attempts AS d WHERE d.run_seq = r.run_seq AND d.status = 'F' AND d.artifact % 20 = i.target)) AS omitted FROM runs AS r""",
)
def _(t):
    a, target = t("attempts"), (F.col("artifact") % 20).alias("target")
    inventory = a.join(t("runs").select("run_seq", "campaign"), "run_seq").select("campaign", target, (F.col("artifact") % 20 == 7).alias("exempt"))
    evaluations = a.select("run_seq", target, (F.col("flag") != "R").alias("resolved"), (F.col("status") == "F").alias("passed"))
    return measure.resolutions(inventory, evaluations, a.filter("status = 'F'").select("run_seq", target), t("runs"))


@_query("measure_discriminating", "SELECT run_seq, count(DISTINCT CASE WHEN (flag = 'R') <> (status = 'O') THEN item % 3 END) AS discriminating FROM attempts GROUP BY run_seq")
def _(t):
    grade = lambda bad: F.when(bad, "incorrect").otherwise("supported")
    return measure.discriminating(t("attempts").select("run_seq", (F.col("item") % 3).alias("followup"), grade(F.col("flag") == "R").alias("class_before"), grade(F.col("status") == "O").alias("class_after")))


@_query(
    "measure_caps",
    """WITH u AS (SELECT a.run_seq, any_value(cell) AS cell, count(*) * 70 AS calls, count(DISTINCT agent_id) + 3 AS agents, max(item) AS attempts_per_item, sum(busy_ms) / 100000.0 AS hours FROM attempts AS a JOIN runs AS r ON r.run_seq = a.run_seq GROUP BY a.run_seq),
      x AS (SELECT u.run_seq, list_sort(list_filter([CASE WHEN agents > 8 THEN 'agents' END, CASE WHEN attempts_per_item > 3 THEN 'attempts_per_item' END, CASE WHEN calls > 400 THEN 'calls' END, CASE WHEN hours > CASE cell WHEN 'C' THEN 4 ELSE 2 END THEN 'hours' END], lambda v: v IS NOT NULL)) AS e FROM u)
      SELECT run_seq, array_to_string(e, ',') AS exceeded, CASE WHEN len(e) > 0 THEN 'unresolved' ELSE 'within' END AS status FROM x""",
)
def _(t):
    usage = t("attempts").join(t("runs").select("run_seq", "cell"), "run_seq").groupBy("run_seq", "cell").agg(
        (F.count("*") * 70).alias("calls"), (F.count_distinct("agent_id") + 3).alias("agents"), F.max("item").alias("attempts_per_item"), (F.sum("busy_ms") / 100000.0).alias("hours")
    )
    return measure.caps(usage).withColumn("exceeded", F.array_join("exceeded", ","))


@_query(
    "decision_rule",
    f"""WITH o AS (SELECT run_seq, coalesce(round(count(*) FILTER (NOT hit) / count(*), 6), 0) AS omitted FROM (SELECT run_seq, item, bool_or(flag <> 'R') AS hit FROM attempts WHERE item % 6 <> 1 GROUP BY run_seq, item) AS i GROUP BY run_seq),
      c AS (SELECT x.*, coalesce(omitted, 0) AS omitted FROM ({_COUNTED}) AS x LEFT JOIN o ON o.run_seq = x.run_seq),
      m AS (SELECT campaign, pilot, cell, median(outcome) FILTER (measured) AS md, median(wrong) FILTER (measured) AS wr, median(omitted) FILTER (measured) AS om, bool_and(passed) FILTER (measured) AS ok, count(*) FILTER (measured) AS n FROM c GROUP BY campaign, pilot, cell),
      j AS (SELECT k.campaign, k.pilot, a.md AS am, a.wr AS aw, a.om AS ao, b.md AS cm, b.wr AS cw, b.om AS co, b.ok, k.full_cells FROM (SELECT campaign, pilot, count(*) FILTER (n = 5) AS full_cells FROM m GROUP BY campaign, pilot) AS k
        LEFT JOIN m AS a ON a.campaign = k.campaign AND a.pilot = k.pilot AND a.cell = 'A' LEFT JOIN m AS b ON b.campaign = k.campaign AND b.pilot = k.pilot AND b.cell = 'C')
      SELECT campaign, pilot, CASE WHEN full_cells < 3 THEN 'budget_stopped' WHEN pilot = 'change' THEN CASE WHEN cm < am OR NOT ok THEN 'failure' WHEN cm > am THEN 'success' ELSE 'inconclusive' END
        WHEN cm < am OR (cw > aw AND co > ao) THEN 'failure' WHEN cm > am AND cw <= aw AND co <= ao THEN 'success' ELSE 'inconclusive' END AS verdict FROM j""",
)
def _(t):
    m = _counts(t).join(_omission(t).select("run_seq", F.col("rate").alias("omission_rate")), "run_seq").join(_rediscovery(t), "run_seq").withColumn("passed", F.col("verdict") == "pass")
    return measure.decide(m.select("campaign", "pilot", "cell", "measured", "outcome", "incorrect_rate", "omission_rate", "passed"))


@_query("escrow_conservation", "SELECT scope_id, CAST(sum(CASE WHEN sequence % 4 = 0 THEN units ELSE 0 END) AS BIGINT) AS escrowed, CAST(sum(CASE WHEN sequence % 4 <> 0 THEN units ELSE 0 END) AS BIGINT) AS settled, sum(CASE WHEN sequence % 4 = 0 THEN units ELSE -units END) = 0 AS conserved FROM log WHERE units IS NOT NULL GROUP BY scope_id")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("escrowed", "confirmed", "returned", "quarantined"))), (F.col("sequence") % 4 + 1).cast("int"))
    return measure.escrow(t("log").filter("units IS NOT NULL").select("scope_id", kind.alias("kind"), "units"))


@_query("target_groups", "SELECT path, CAST(floor((r - 1) / 8.0) AS BIGINT) AS group_no, count(*) AS targets FROM (SELECT concat('src/', l_suppkey, '.rs') AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) GROUP BY ALL")
def _(t):
    return graph.target_groups(t("lineitem_rows").select(F.concat(F.lit("src/"), "l_suppkey", F.lit(".rs")).alias("path"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("col")))


@_query("path_collisions", "SELECT lower(path) AS key, count(DISTINCT path) AS paths FROM (SELECT concat('dir/', CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END) AS path FROM part) GROUP BY lower(path) HAVING count(DISTINCT path) > 1")
def _(t):
    name = F.col("p_name")
    return graph.path_collisions(t("part_rows").select(F.concat(F.lit("dir/"), F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).otherwise(name)).alias("path")))


@_query("text_matches", r"SELECT doc_id, n AS line, CAST(1 + length(list_reduce(list_prepend('', string_split_regex(l, 'the')[1:i]), lambda a, b: a || b)) + 3 * (i - 1) AS BIGINT) AS col FROM (SELECT doc_id, n, l, unnest(range(1, len(string_split_regex(l, 'the')))) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS n FROM documents))")
def _(t):
    return graph.text_matches(t("texts"), "the")


@_query("key_parse", "SELECT scope_id, sequence, digest, true AS canonical FROM log")
def _(t):
    key = F.concat(scalar.padded(F.col("sequence")), F.lit("-"), F.col("digest"), F.lit(".cbor.zst"))
    return t("log").select("scope_id", key.alias("key")).select("scope_id", *scalar.parse_event_key(F.col("key")))


@_query("domain_digest", "SELECT scope_id, sequence, sha256(unhex(hex(encode('event' || chr(0))) || lpad(hex(strlen(operation_id)), 16, '0') || hex(encode(operation_id)))) AS digest FROM log")
def _(t):
    return t("log").select("scope_id", "sequence", scalar.domain_digest("event", F.col("operation_id")).alias("digest"))


@_query("bounded_text", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN substring(text, 1, (SELECT max(i) FROM range(0, 101) AS x(i) WHERE strlen(substring(text, 1, CAST(i AS BIGINT))) <= 100)) END AS text FROM documents")
def _(t):
    return t("texts").select("doc_id", scalar.bounded_text(F.col("text"), 100).alias("text"))


# ---------------------------------------------------------------- proposals, commits, queues

_PROPOSALS = """SELECT s.scope_id, SHA[concat('proposal|', s.k)] AS plan_digest, CASE WHEN s.k % 13 = 1 THEN SHA['else'] ELSE s.objective_digest END AS objective_digest, CASE WHEN s.k % 11 = 2 THEN SHA['old'] ELSE s.active_plan_digest END AS parent_plan_digest,
      CASE WHEN s.k % 17 = 3 THEN 99999999999999999 ELSE 100 END AS reserved_budget_units, CASE WHEN s.k % 7 = 4 THEN 100000 WHEN s.k % 7 = 5 THEN 2 ELSE 1 END AS at, s.k FROM scopes AS s"""


def _proposals(t):
    k = F.col("k")
    s = t("scopes").withColumn("at", F.when(k % 7 == 4, 100000).when(k % 7 == 5, 2).otherwise(1).cast("long"))
    facts = t("log").select("scope_id", F.col("sequence").alias("at"), "digest")
    j = s.join(facts, ["scope_id", "at"], "left")
    basis = F.struct(F.lit("observation").alias("kind"), F.when(k % 9 == 6, F.sha2(F.lit("stale"), 256)).otherwise(F.coalesce("digest", F.lit("none"))).alias("digest"), F.col("at").alias("sequence"))
    prior = F.struct(F.lit("prior_revision").alias("kind"), F.coalesce("active_plan_digest", F.lit("none")).alias("digest"), F.lit(None).cast("long").alias("sequence"))
    return j.select(
        "scope_id", F.sha2(F.concat(F.lit("proposal|"), k), 256).alias("plan_digest"), F.when(k % 13 == 1, F.sha2(F.lit("else"), 256)).otherwise(F.col("objective_digest")).alias("objective_digest"), F.when(k % 11 == 2, F.sha2(F.lit("old"), 256)).otherwise(F.col("active_plan_digest")).alias("parent_plan_digest"),
        F.when(k % 17 == 3, 99999999999999999).otherwise(100).alias("reserved_budget_units"), F.when(F.col("active_plan_digest").isNull(), F.array(basis)).otherwise(F.array(prior, basis)).alias("bases"), "k",
    )


def _specs(t):
    """Per proposal a chain of five items, its last edge turned to the start, to itself, to nowhere, or an item doubled in some."""
    k = F.col("k")
    p = _proposals(t).select("plan_digest", "k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    name = F.when((k % 5 == 4) & (F.col("i") == 4), "w0").otherwise(F.concat(F.lit("w"), F.col("i")))
    before = F.when(F.col("i") > 0, F.array(F.concat(F.lit("w"), F.col("i") - 1))).otherwise(F.array().cast("array<string>"))
    turned = F.when((k % 5 == 1) & (F.col("i") == 0), F.array(F.lit("w3"))).when((k % 5 == 2) & (F.col("i") == 2), F.array(F.lit("w2"))).when((k % 5 == 3) & (F.col("i") == 1), F.array(F.lit("nowhere"))).otherwise(before)
    return p.select("plan_digest", name.alias("work_id"), turned.alias("dependencies"))


_GRAPH = "CASE k % 5 WHEN 0 THEN 'valid' WHEN 3 THEN 'unknown_dependency' WHEN 4 THEN 'duplicate_work' ELSE 'cyclic_dependency' END"


@_query("proposal_graph", f"WITH p AS ({_PROPOSALS}) SELECT plan_digest, {_GRAPH} AS verdict FROM p")
def _(t):
    return graph.proposal_graph(_specs(t))


@_query(
    "proposal_gate",
    f"""WITH p AS ({_PROPOSALS}) SELECT p.plan_digest, p.scope_id, CASE WHEN p.objective_digest <> s.objective_digest THEN 'objective_mismatch' WHEN p.parent_plan_digest IS DISTINCT FROM s.active_plan_digest THEN 'stale_basis'
        WHEN p.at > s.sequence THEN 'missing_basis' WHEN p.k % 9 = 6 THEN 'stale_basis' WHEN (SELECT payload_type FROM log AS l WHERE l.scope_id = p.scope_id AND l.sequence = p.at) <> 'root_genesis' THEN 'unsupported_planning_input'
        WHEN p.k % 5 <> 0 THEN CASE p.k % 5 WHEN 3 THEN 'unknown_dependency' WHEN 4 THEN 'duplicate_work' ELSE 'cyclic_dependency' END WHEN p.reserved_budget_units > {M.MAX_INTEGER} THEN 'budget_out_of_range' ELSE 'admissible' END AS verdict
      FROM p JOIN scopes AS s ON s.scope_id = p.scope_id""",
)
def _(t):
    return graph.proposal_gate(_proposals(t).drop("k"), t("scopes"), t("log"), graph.proposal_graph(_specs(t)))


@_query(
    "head_resolve",
    """SELECT scope_id, CASE WHEN k % 6 = 0 THEN CASE WHEN k % 12 = 0 THEN 'retry_identically' ELSE 'unresolved' END WHEN k % 6 = 1 THEN CASE WHEN k % 5 = 0 THEN 'unresolved' ELSE 'committed' END WHEN k % 6 = 2 THEN 'retry_identically' WHEN k % 6 = 3 THEN 'unresolved' ELSE 'reconcile' END AS verdict FROM heads""",
)
def _(t):
    k = F.col("k")
    parent = F.when(k % 12 != 0, F.lit("op-parent"))
    row = t("heads").select(
        "scope_id", F.lit("op-mine").alias("operation_id"), F.lit("t").alias("tail"), F.lit("p").alias("plan"), F.lit(3).alias("epoch"), F.when(k % 6 == 1, "op-mine").when(k % 6 == 3, "op-parent").when(k % 6 != 0, "op-other").alias("current_operation"),
        F.lit("t").alias("current_tail"), F.lit("p").alias("current_plan"), F.when(k % 5 == 0, 2).otherwise(3).alias("current_epoch"), F.lit(True).alias("same_bytes"), parent.alias("parent_operation"), (k % 6 == 2).alias("parent_is_current"),
    )
    return intake.resolve_head(row)


@_query(
    "claim_restore",
    f"""SELECT scope_id, work_id, work_revision, CASE WHEN take THEN f ELSE claim_fence END AS claim_fence, CASE WHEN take THEN l ELSE claim_lease_until END AS claim_lease_until
      FROM (SELECT *, key % 3 = 0 AND key % 4 <> 1 AND terminal_result_digest IS NULL AND CASE WHEN claim_fence IS NULL THEN true WHEN f > claim_fence THEN claim_lease_until <= 0 ELSE claim_lease_until <= l END AS take
        FROM (SELECT *, coalesce(claim_fence + key % 2, 2 + key % 9) AS f, {NOW_MS} - key % 5 * 20000000000 AS l FROM work) AS w) AS x""",
)
def _(t):
    key = F.col("key")
    fence = F.coalesce(F.col("claim_fence") + key % 2, 2 + key % 9)
    claims = t("work").select("scope_id", "work_id", "work_revision", F.when(key % 3 == 0, "active").otherwise("sealed").alias("state"), F.when(key % 4 == 1, "other").otherwise(F.col("plan_digest")).alias("plan_digest"), fence.alias("claim_fence"), (F.lit(NOW_MS) - key % 5 * 20000000000).alias("lease_until"))
    return fold.restore_claims(t("work"), claims).select("scope_id", "work_id", "work_revision", "claim_fence", "claim_lease_until")


@_query(
    "write_swap",
    """WITH a AS (SELECT scope_id AS key, arrival, concat('t', arrival, '-', work_id) AS proposed, fence % 2 = 0 AS fresh, work_id FROM claim_ops)
      SELECT key, arrival, proposed, CASE WHEN fresh AND row_number() OVER (PARTITION BY key, fresh ORDER BY arrival, work_id) = 1 THEN 'committed' ELSE 'precondition_failed' END AS verdict FROM a""",
)
def _(t):
    o = t("claim_ops")
    order = F.struct("arrival", "work_id")
    tries = o.select(F.col("scope_id").alias("key"), F.when(F.col("fence") % 2 == 0, "now").otherwise("then").alias("observed"), order.alias("arrival"), F.concat(F.lit("t"), "arrival", F.lit("-"), "work_id").alias("proposed"))
    return sinks.compare_and_swap(t("scopes").select(F.col("scope_id").alias("key"), F.lit("now").alias("tag")), tries).select("key", F.col("arrival.arrival").alias("arrival"), "proposed", "verdict")


@_query("intake_queue", "SELECT scope_id, sequence, CASE WHEN sequence >= 60 THEN 'stopped' WHEN sequence <= 40 THEN 'accepted' ELSE 'overloaded' END AS verdict FROM log")
def _(t):
    q = t("log").select(F.col("scope_id").alias("queue"), F.col("sequence").alias("arrival"))
    return incremental.intake_queue(q, 40, 60).select(F.col("queue").alias("scope_id"), F.col("arrival").alias("sequence"), "verdict")


@_query("shutdown_tally", "SELECT scope_id, count(*) FILTER (sequence >= 60) AS shed, count(*) FILTER (sequence <= 40 AND sequence % 9 <> 2) AS resolved, count(*) FILTER (sequence > 40 AND sequence < 60) AS unresolved, count(*) FILTER (sequence <= 40 AND sequence % 9 = 2) AS reaped FROM log GROUP BY scope_id")
def _(t):
    q = incremental.intake_queue(t("log").select(F.col("scope_id").alias("queue"), F.col("sequence").alias("arrival")), 40, 60)
    fate = F.when(F.col("verdict") == "stopped", "shed").when(F.col("verdict") == "overloaded", "unresolved").when(F.col("arrival") % 9 == 2, "reaped").otherwise("resolved")
    return intake.shutdown_tally(q.select(F.col("queue").alias("scope_id"), fate.alias("fate")))


@_query("measure_invalid", "SELECT run_seq, count(*) AS calls, count(*) FILTER (NOT (flag = 'R' AND item % 2 = 0)) AS slots FROM attempts GROUP BY run_seq")
def _(t):
    c = t("attempts").select("run_seq", F.when(F.col("flag") == "R", "rate_limited").otherwise("completed").alias("outcome"), (F.col("item") % 2 == 1).alias("has_content"))
    return measure.invalid_attempts(c)


@_query(
    "equivalence_classes",
    """WITH RECURSIVE a AS (SELECT run_seq, item, min(artifact) AS artifact FROM attempts GROUP BY run_seq, item), o AS (SELECT *, row_number() OVER (PARTITION BY run_seq ORDER BY item) AS n FROM a),
      r AS (SELECT run_seq, item, artifact, n, [artifact] AS firsts, CAST(0 AS BIGINT) AS class_no FROM o WHERE n = 1
        UNION ALL SELECT run_seq, item, artifact, n, CASE WHEN p = 0 THEN list_append(firsts, artifact) ELSE firsts END, CASE WHEN p = 0 THEN len(firsts) ELSE p - 1 END
          FROM (SELECT o.*, r.firsts, coalesce(list_position(list_transform(r.firsts, lambda f: (f + o.artifact) % 3 = 0), true), 0) AS p FROM r JOIN o ON o.run_seq = r.run_seq AND o.n = r.n + 1) AS x)
      SELECT run_seq, item AS emission, class_no, row_number() OVER (PARTITION BY run_seq, class_no ORDER BY artifact % 10, item) = 1 AS kept FROM r""",
)
def _(t):
    a = t("attempts").groupBy("run_seq", "item").agg(F.min("artifact").alias("artifact"))
    said = a.select("run_seq", F.col("item").alias("emission"), (F.col("artifact") % 10).alias("span"))
    same = a.alias("x").join(a.alias("y"), "run_seq").filter("x.item < y.item AND (x.artifact + y.artifact) % 3 = 0").select("run_seq", F.col("x.item").alias("a"), F.col("y.item").alias("b"))
    return graph.equivalence_classes(said, same)


@_query("dedupe_replay", "SELECT scope_id, sequence, digest FROM log WHERE sequence % 9 <> 4")
def _(t):
    log = t("log").select("scope_id", "sequence", "digest", "operation_id")
    again = log.filter("sequence % 3 = 0").unionByName(log.filter("sequence % 9 = 4").withColumn("digest", F.sha2(F.lit("other"), 256)))
    return fold.idempotent(log.unionByName(again))[0].select("scope_id", "sequence", "digest")


_CURSORS = "SELECT scope_id, s.sequence, tail_event_digest AS digest, (SELECT max(writer_epoch) FROM log AS l WHERE l.scope_id = s.scope_id) AS writer_epoch, (SELECT plan_digest FROM log AS l WHERE l.scope_id = s.scope_id AND l.payload_type = 'plan_admitted') AS active_plan_digest FROM scopes AS s"


@_query("stream_fold", _CURSORS)
def _(t):
    """The fold as a stream over two deliveries of the log; equals the batch fold."""
    log = t("log").select("scope_id", "sequence", "digest", "parent_digest", "operation_id", "writer_epoch", "payload_type", "plan_digest")
    spark = log.sparkSession
    from .streams import shared_folder

    base = shared_folder(spark)
    for part in ("sequence <= 20", "sequence > 17"):  # the second repeats some of the first
        log.filter(part).repartition(2, "scope_id").write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    incremental.run_available(source, f"{base}/state", lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out"))
    out = spark.read.parquet(f"{base}/out")
    last = F.max_by(F.struct("sequence", "digest", "writer_epoch", "active_plan_digest"), "batch")
    return out.groupBy("scope_id").agg(last.alias("s")).select("scope_id", "s.*")


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Relations of the registry that are plain tables, or one step above."""
    if name == "texts":
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if name == "lineitem_rows":
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if name == "part_rows":
        return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    if name == "calls":
        return spark.sql(_CALLS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return relation(spark, sf_dir, name)


def queries() -> dict[str, Query]:
    from . import stored, streams  # noqa: F401, register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import stored, streams  # noqa: F401

    return dict(_SQL)


def bare_sql() -> dict[str, str]:
    """The DuckDB SQL of each query for relations that are there as tables of their names."""
    oracle_sql()
    return dict(_BARE)
