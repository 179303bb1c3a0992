"""Queries over streams with state and over stored objects: the driver's tables delivered in batches, out of order, twice or with faults, or written as a log of objects and read by range."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import audit, fold, measure
from ledgerloom.sources import documents, logstore
from ledgerloom.streaming import ledger

from . import registry
from .adapters import NOW_MS
from .registry import _query


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only a local session may do without spark.checkpoint.dir."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.conf.get("spark.sql.warehouse.dir")
    return f"{own.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def deliver(parts: list[DataFrame], files: int = 4) -> tuple[DataFrame, str]:
    """A stream that hands over each of ``parts`` in turn, at most ``files`` files a batch; and the folder it lies in."""
    spark = parts[0].sparkSession
    base = shared_folder(spark)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in"), base


def _run(parts: list[DataFrame], start: DataFrame | None = None) -> DataFrame:
    stream, base = deliver(parts)
    return ledger.run_available(ledger.fold_ledger(stream, start), f"{base}/state", f"{base}/out")


@_query("stream_out_of_order", registry._GRANTS)
def _(t):
    """Three deliveries that leave gaps, repeat events and close the gaps; grants end as after an ordered one."""
    log = ledger.as_input(t("log"), "event")
    third = F.pmod(F.col("sequence") * 7, F.lit(3))
    return ledger.latest(_run([log.filter(third == 1), log.filter(third != 2), log.filter((third == 2) | (F.col("sequence") % 5 == 0))]), "grant")


@_query("stream_claims", registry._CLAIMS)
def _(t):
    """Claim operations in three deliveries; claims end as after the batch fold."""
    ops = ledger.as_input(t("claim_ops"), "claim")
    out = ledger.latest(_run([ops.filter("arrival <= 15"), ops.filter("arrival > 15 AND arrival <= 40"), ops.filter("arrival > 40")]), "claim")
    return out.na.fill(-1, ["claim_fence", "claim_lease_until"]).na.fill("", ["terminal_result_digest"])


@_query("stream_resume", registry._CURSORS)
def _(t):
    """A snapshot of the first 30 events of each scope as the state to begin with, and the events behind it alone as the stream."""
    early, late = t("log").filter("sequence <= 30"), t("log").filter("sequence > 30")
    start = ledger.snapshot(early, t("claim_ops").filter("arrival <= 30"))
    return ledger.latest(_run([ledger.as_input(late, "event")], start), "cursor", start)


@_query(
    "stream_faults",
    """WITH d AS (SELECT scope_id, sequence, CASE WHEN k % 4 = 2 AND sequence = 5 THEN SHA['forged'] ELSE digest END AS digest, parent_digest, k FROM log WHERE NOT (k % 4 = 1 AND sequence = 8)
        UNION ALL SELECT scope_id, sequence, digest, parent_digest, k FROM log WHERE k % 4 = 3 AND sequence <= 6),
      g AS (SELECT scope_id, min(sequence) AS gap FROM (SELECT DISTINCT scope_id, sequence + 1 AS sequence FROM d) AS n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.scope_id = n.scope_id AND d.sequence = n.sequence) GROUP BY scope_id),
      v AS (SELECT scope_id, gap, EXISTS (SELECT 1 FROM d AS a JOIN d AS b ON a.scope_id = b.scope_id AND b.sequence = a.sequence + 1 WHERE a.scope_id = g.scope_id AND b.sequence < gap AND b.parent_digest <> a.digest) AS bad FROM g)
      SELECT scope_id, CASE WHEN bad THEN 0 ELSE gap - 1 END AS sequence, CASE WHEN bad THEN 'conflict' WHEN EXISTS (SELECT 1 FROM d WHERE d.scope_id = v.scope_id AND d.sequence > gap) THEN 'waiting' ELSE 'applied' END AS verdict,
        CASE WHEN bad THEN 0 ELSE gap - 1 END AS applied, CASE WHEN bad THEN 0 ELSE (SELECT count(*) - count(DISTINCT sequence) FROM d WHERE d.scope_id = v.scope_id) END AS duplicates,
        CASE WHEN bad THEN 0 ELSE (SELECT count(*) FROM d WHERE d.scope_id = v.scope_id AND d.sequence > gap) END AS held FROM v""",
)
def _(t):
    """One delivery with a gap in some logs, a forged event in others and repeats in a third part."""
    k, s = F.col("k"), F.col("sequence")
    log = t("log").filter(~((k % 4 == 1) & (s == 8))).withColumn("digest", F.when((k % 4 == 2) & (s == 5), F.sha2(F.lit("forged"), 256)).otherwise(F.col("digest")))
    again = t("log").filter((k % 4 == 3) & (s <= 6))
    out = _run([ledger.as_input(log.unionByName(again), "event")]).filter("what = 'cursor'")
    return out.select("scope_id", "sequence", "verdict", "applied", "duplicates", "held")


@_query(
    "lease_alarms",
    f"""SELECT scope_id, 'renewal_due' AS what, lease_until - 20000 AS due_ms FROM heads WHERE lease_until - 20000 <= {NOW_MS} UNION ALL SELECT scope_id, 'must_stop', lease_until - 4999 FROM heads WHERE lease_until - 4999 <= {NOW_MS}""",
)
def _(t):
    """Heads written a minute ago, then a tick of the clock: timers fire as far as the watermark has come."""
    at = lambda ms: F.timestamp_millis(ms).alias("at")
    heads = t("heads").select("scope_id", F.col("lease_until").cast("long").alias("lease_until"), at(F.lit(NOW_MS - 60_000)))
    tick = heads.sparkSession.range(1).select(F.lit("clock").alias("scope_id"), F.lit(None).cast("long").alias("lease_until"), at(F.lit(NOW_MS)))
    stream, base = deliver([heads.unionByName(tick)])
    return ledger.run_available(ledger.lease_alarms(stream), f"{base}/state", f"{base}/out").select("scope_id", "what", "due_ms")


# ---------------------------------------------------------------- objects


def _stored_log(t) -> tuple[SparkSession, str]:
    """The log's events as packs of objects in a new folder, as a file for each of them takes hundreds of times their bytes; the bytes are what their digests are made of."""
    raw = F.encode(F.concat(F.lit("event|"), F.col("event_id").cast("string")), "UTF-8")
    events = t("raw_log").select("scope_id", "sequence", "digest", raw.alias("content"))
    spark = events.sparkSession
    path = f"{shared_folder(spark)}/scopes"
    logstore.write_log(events, path, packed=True)
    return spark, path


@_query("log_range_scan", "SELECT scope_id, sequence, digest, strlen(concat('event|', event_id)) AS length FROM raw_log WHERE sequence BETWEEN 11 AND 20")
def _(t):
    """A range of sequences out of the stored log: keys outside it are neither opened nor handed to Spark."""
    found = logstore.read_log(*_stored_log(t)).filter("sequence > 10 AND sequence <= 20 AND status = 'ok'")
    return found.filter(F.sha2("content", 256) == F.col("digest")).select("scope_id", "sequence", "digest", F.col("length").cast("long").alias("length"))


@_query(
    "log_fetch_budget",
    """SELECT scope_id, sequence, running_bytes, digest FROM (SELECT scope_id, sequence, digest, CAST(sum(strlen(concat('event|', event_id))) OVER (PARTITION BY scope_id ORDER BY sequence) AS BIGINT) AS running_bytes FROM raw_log WHERE sequence >= 6) AS a WHERE running_bytes <= 200""",
)
def _(t):
    """Events behind the fifth of each scope as far as 200 bytes go: lengths from the listing, then the chosen objects alone."""
    found = logstore.fetch_within(*_stored_log(t), budget=200, first=6)
    return found.select("scope_id", "sequence", "running_bytes", F.sha2("content", 256).alias("digest"))


@_query("log_dense", "SELECT scope_id, NOT (k % 5 = 2 AND sequence >= 9) AS dense FROM scopes")
def _(t):
    """Whether a listing holds every key up to the tail; in some scopes one is missing."""
    gone = t("scopes").filter("k % 5 = 2").select("scope_id", F.lit(9).cast("long").alias("sequence"))
    spark, path = _stored_log(t)
    listing = logstore.read_log(spark, path, content=False).join(gone, ["scope_id", "sequence"], "left_anti")
    return logstore.dense(listing, t("scopes").select("scope_id", F.lit(0).cast("long").alias("sequence"), F.col("sequence").alias("tail")))


@_query("projection_apply", registry._CURSORS)
def _(t):
    """Cursors and grants of the first 20 events as one projection, then of all: readers see the newest manifest's tables."""
    log = t("log")
    path = f"{shared_folder(log.sparkSession)}/projection"
    for part in (log.filter("sequence <= 20"), log):
        logstore.apply_projection(path, {"scopes": fold.fold_cursors(part), "grants": fold.fold_grants(part)})
    return logstore.read_projection(log.sparkSession, path, "scopes").select("scope_id", "sequence", F.col("tail_event_digest").alias("digest"), "writer_epoch", "active_plan_digest")


# ---------------------------------------------------------------- JSON documents


def _status_sql(docs: str, keys: list[str], numbers: list[str], rebuilt: str, record: str, values: str, place: str) -> str:
    """Status of each document by the other engine's JSON functions: the bytes are compared with the text put together anew from the fields."""
    listed = ", ".join(f"'{k}'" for k in sorted(keys))
    typed = " AND ".join(f"json_type(j, '$.{k}') IN ('UBIGINT', 'BIGINT')" for k in numbers) + " AND " + " AND ".join(f"json_type(j, '$.{k}') = 'VARCHAR'" for k in keys if k not in numbers and k != "state")
    return f"""WITH d AS (SELECT *, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM {docs})
      SELECT scope_id, work_id, CASE WHEN content IS NULL THEN 'absent' WHEN strlen(content) NOT BETWEEN 1 AND 4096 THEN 'limit_exceeded' WHEN j IS NULL OR list_sort(json_keys(j)) <> [{listed}] OR NOT ({typed}) THEN 'malformed'
        WHEN {rebuilt} <> content THEN 'not_canonical' WHEN j->>'$.record' <> '{record}' OR j->>'$.scope_id' <> scope_id OR j->>'$.campaign_id' <> campaign_id OR j->>'$.work_id' <> work_id THEN 'unbound'
        WHEN NOT regexp_full_match(j->>'$.plan_digest', '[0-9a-f]{{64}}') OR CAST(j->>'$.claim_fence' AS BIGINT) < 1 THEN 'invalid_value' WHEN key <> {place} THEN 'reference_mismatch' WHEN {values} THEN 'invalid_value' ELSE 'ok' END AS status FROM d"""


def _rebuilt(fields: dict) -> str:
    """SQL that puts the top fields of a document together again."""
    one = [f"""'"{n}":' || json_extract(j, '$.{n}')""" for n in fields]
    return "'{' || " + " || ',' || ".join(one) + " || '}'"


@_query(
    "claim_documents",
    _status_sql("claim_docs", [*documents.OWNED, "state"], ["work_revision", "claim_fence"], _rebuilt(documents.OWNED | {"state": 0}), documents.CLAIM, "j->>'$.owner_instance' LIKE '%/%'", "'workspace/one/campaigns/' || campaign_id || '/scopes/' || scope_id || '/claims/' || work_id || '/' || work_revision"),
)
def _(t):
    return documents.decode_claims(t("claim_docs").withColumn("workspace_id", F.lit("one"))).select("scope_id", "work_id", "status")


@_query(
    "grant_documents",
    _status_sql(
        "grant_docs", list(documents.GRANTED), [n for n, kind in documents.GRANTED.items() if kind == "BIGINT"], _rebuilt(documents.GRANTED), documents.GRANT, "j->>'$.resource_scope' LIKE '%/%' OR CAST(j->>'$.limit_units' AS BIGINT) < 1",
        "'workspace/one/campaigns/' || campaign_id || '/scopes/' || scope_id || '/grants/' || work_id || '/' || work_revision || '/' || (j->>'$.claim_fence')",
    ),
)
def _(t):
    return documents.decode_grants(t("grant_docs").withColumn("workspace_id", F.lit("one"))).select("scope_id", "work_id", "status")


@_query(
    "claims_from_documents",
    f"""WITH d AS (SELECT * FROM claim_docs WHERE n % 13 <> 0 AND n % 17 <> 0 AND n % 37 <> 0 AND n % 41 <> 0 AND n % 43 <> 0 AND n % 47 <> 0 AND n % 19 <> 0 AND n % 23 <> 0 AND n % 29 <> 0 AND n % 31 <> 4 AND n % 53 <> 0 AND content LIKE '%"state":"active"%')
      SELECT w.scope_id, w.work_id, CASE WHEN d.n IS NOT NULL AND w.terminal_result_digest IS NULL THEN CAST(json_extract_string(d.content, '$.state.lease_until') AS BIGINT) END AS restored_lease FROM work AS w LEFT JOIN d ON d.scope_id = w.scope_id AND d.work_id = w.work_id""",
)
def _(t):
    """Rows without claims get those back that their stored documents state: decoded, then restored."""
    read = documents.decode_claims(t("claim_docs").withColumn("workspace_id", F.lit("one"))).filter("status = 'ok'").select("record.*")
    bare = t("work").withColumns({"claim_fence": F.lit(None).cast("long"), "claim_lease_until": F.lit(None).cast("long")})
    return fold.restore_claims(bare, read).select("scope_id", "work_id", F.col("claim_lease_until").alias("restored_lease"))


# ---------------------------------------------------------------- observability


@_query(
    "ready_latency",
    """WITH c AS (SELECT *, min(now_ms) OVER (PARTITION BY scope_id) AS start_ms FROM claim_ops WHERE terminal_result_digest IS NULL), e AS (SELECT * FROM claim_ops WHERE terminal_result_digest IS NOT NULL),
      a AS (SELECT c.scope_id, c.work_id, c.arrival, c.now_ms, c.start_ms, d.depends_on_work_id AS dep, (SELECT max(e.now_ms) FROM e WHERE e.scope_id = c.scope_id AND e.work_id = d.depends_on_work_id AND e.now_ms <= c.now_ms) AS seen
        FROM c LEFT JOIN deps AS d ON d.scope_id = c.scope_id AND d.work_id = c.work_id)
      SELECT scope_id, work_id, arrival, CASE WHEN count(dep) = count(seen) THEN greatest(any_value(start_ms), coalesce(max(seen), 0)) END AS ready_ms, CASE WHEN count(dep) = count(seen) THEN any_value(now_ms) - greatest(any_value(start_ms), coalesce(max(seen), 0)) END AS latency_ms
      FROM a GROUP BY scope_id, work_id, arrival""",
)
def _(t):
    ops = t("claim_ops")
    key = ("scope_id", "work_id", "work_revision")
    claims = ops.filter("terminal_result_digest IS NULL").select(*key, F.col("arrival").alias("claim_id"), F.col("now_ms").alias("at_ms"))
    evidence = ops.filter("terminal_result_digest IS NOT NULL").select(*key, F.col("now_ms").alias("at_ms"))
    start = claims.groupBy("scope_id").agg(F.min("at_ms").alias("start_ms"))
    out = measure.ready_latency(claims, evidence, t("deps"), start)
    return out.select("scope_id", "work_id", F.col("claim_id").alias("arrival"), "ready_ms", "latency_ms")


@_query(
    "claim_collisions",
    registry._CLAIMS.replace("SELECT scope_id, work_id, work_revision, arg_max(coalesce(f, -1), n)", "SELECT scope_id, sum(n) AS operations, sum(x) AS refused, round(sum(x) / sum(n), 6) AS rate FROM (SELECT scope_id, work_id, work_revision, max(n) AS n, arg_max(x, n) AS x FROM r GROUP BY scope_id, work_id, work_revision) AS z GROUP BY scope_id --"),
)
def _(t):
    return measure.claim_collisions(fold.fold_claims(t("claim_ops")), t("claim_ops"))


@_query(
    "projection_footers",
    """SELECT 'scope_id' AS column_name, 'string' AS type, count(*) AS "rows", 0 AS nulls, min(scope_id) AS least, max(scope_id) AS greatest FROM scopes UNION ALL SELECT 'sequence', 'int64', count(*), 0, CAST(min(sequence) AS VARCHAR), CAST(max(sequence) AS VARCHAR) FROM scopes
      UNION ALL SELECT 'active_plan_digest', 'string', count(*), count(*) - count(active_plan_digest), min(active_plan_digest), max(active_plan_digest) FROM scopes""",
)
def _(t):
    """Types, counts and ends of a written projection's columns out of its files' footers alone."""
    rows = t("scopes").select("scope_id", "sequence", "active_plan_digest")
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/scopes"
    rows.coalesce(1).write.parquet(path)
    found = logstore.footers(spark, spark.range(1).select(F.lit(path).alias("folder")))
    return found.select(F.col("column").alias("column_name"), "type", "rows", F.col("nulls").cast("int").alias("nulls"), "least", "greatest")


# ---------------------------------------------------------------- every row check, each with planted faults


def _no_digest(c: str) -> str:
    return f"(length({c}) <> 64 OR regexp_matches({c}, '[^0-9a-f]'))"


def _no_name(c: str, slash: bool = False) -> str:
    return f"(strlen({c}) = 0 OR strlen({c}) > 128" + ("" if slash else f" OR contains({c}, '/')") + ")"


def _no_number(c: str, least: int = 1) -> str:
    return f"({c} < {least} OR {c} > 9999999999999999)"


#: What breaks each check, as the other engine says it; a comparison with null breaks nothing.
_BROKEN = {
    "bad_scopes": {
        "claims_restored": "claims_restored NOT BETWEEN 0 AND 1", "scope_id": _no_digest("scope_id"), "campaign_id": _no_name("campaign_id"), "parent_scope_id": "parent_scope_id IS NOT NULL", "delegation_digest": "delegation_digest IS NOT NULL", "sequence": _no_number("sequence"),
        "tail": _no_digest("tail_event_digest"), "plan": _no_digest("active_plan_digest"), "epoch": _no_number("scope_epoch"), "objective": _no_digest("objective_digest"),
        "reservation": "(active_plan_digest IS NULL) <> (reserved_budget_units IS NULL) OR reserved_budget_units < 0",
    },
    "bad_events": {
        "sequence": _no_number("sequence"), "digest": _no_digest("digest"), "parent": f"CASE WHEN sequence = 1 THEN parent_digest IS NOT NULL ELSE parent_digest IS NULL OR {_no_digest('parent_digest')} END", "operation": _no_name("operation_id"), "epoch": "writer_epoch <= 0", "payload": _no_name("payload_type"),
        "root": "CASE WHEN sequence = 1 THEN payload_type <> 'root_genesis' OR operation_id <> 'root-genesis:' || scope_id ELSE payload_type = 'root_genesis' END",
        "grant_named": "payload_type IN ('grant_activated', 'artifact_reference') AND grant_digest IS NULL OR payload_type NOT IN ('grant_activated', 'artifact_reference') AND grant_digest IS NOT NULL", "grant": _no_digest("grant_digest"),
        "work_named": "payload_type IN ('grant_activated', 'artifact_reference') AND (work_id IS NULL OR work_revision IS NULL OR attempt IS NULL) OR payload_type NOT IN ('grant_activated', 'artifact_reference') AND work_id IS NOT NULL AND work_revision IS NOT NULL AND attempt IS NOT NULL",
        "work": _no_name("work_id", slash=True), "revision": _no_number("work_revision"), "attempt": _no_number("attempt"), "kind_named": "CASE WHEN payload_type = 'artifact_reference' THEN artifact_kind IS NULL ELSE artifact_kind IS NOT NULL END",
        "kind": "NOT list_contains(['invocation_manifest', 'invocation_trace'], artifact_kind)", "artifact_named": "CASE WHEN payload_type = 'artifact_reference' THEN artifact_digest IS NULL ELSE artifact_digest IS NOT NULL END", "artifact": _no_digest("artifact_digest"),
    },
    "bad_work": {
        "work_id": _no_name("work_id"), "revision": _no_number("work_revision", 0), "plan": _no_digest("plan_digest"), "epoch": _no_number("admitted_scope_epoch"), "attempts": _no_number("max_attempts"), "deadline": _no_number("deadline_unix_ms"),
        "claim": f"(claim_fence IS NULL) <> (claim_lease_until IS NULL) OR {_no_number('claim_fence')} OR {_no_number('claim_lease_until')}",
        "grant": "len(list_filter([grant_fence, granted_attempt, granted_units, grant_deadline_unix_ms], lambda x: x BETWEEN 1 AND 9999999999999999)) + CASE WHEN grant_digest IS NULL THEN 0 WHEN regexp_full_match(grant_digest, '[0-9a-f]{64}') THEN 1 ELSE 9 END NOT IN (0, 5) OR len(list_filter([grant_fence, granted_attempt, granted_units, grant_deadline_unix_ms], lambda x: x IS NOT NULL)) NOT IN (0, 4)",
        "terminal": f"terminal_result_digest IS NOT NULL AND (claim_fence IS NULL OR {_no_digest('terminal_result_digest')})",
    },
    "bad_deps": {"depends_on": _no_name("depends_on_work_id"), "revision": _no_number("depends_on_work_revision", 0), "self": "depends_on_work_id = work_id"},
}
_SHOWN = {"bad_scopes": ("scopes", "scope_id"), "bad_events": ("events", "scope_id || '|' || sequence"), "bad_work": ("work", "scope_id || '|' || work_id || '|' || work_revision"), "bad_deps": ("deps", "scope_id || '|' || work_id || '|' || work_revision || '|' || depends_on_work_id")}


@_query("audit_every_check", " UNION ALL ".join(f"SELECT '{_SHOWN[table][0]}.{name}' AS check_id, {_SHOWN[table][1]} AS key FROM {table} WHERE {rule}" for table, rules in _BROKEN.items() for name, rule in rules.items()))
def _(t):
    return audit.checks(t("bad_scopes"), t("bad_events"), t("bad_work"), t("bad_deps"))
