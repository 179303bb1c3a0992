"""The driver's tables as scopes, event log, work, dependencies, heads and requests.

Each relation is one SQL text that both engines run: ``SHA[x]`` is the hexadecimal SHA-256 of a
string and ``MS[x]`` the epoch milliseconds of a timestamp without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW_MS = 852_000_000_000

RELATIONS: dict[str, str] = {
    "ev": """SELECT user_id AS k, SHA[concat('scope|', user_id)] AS scope_id, event_id, event_type, value,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence, MS[ts] AS ts_ms, SHA[concat('event|', event_id)] AS digest FROM events""",
    "raw_log": """SELECT k, scope_id, event_id, sequence, ts_ms, digest, lag(digest) OVER (PARTITION BY k ORDER BY sequence) AS parent_digest,
          CASE WHEN sequence = 1 THEN concat('root-genesis:', scope_id) ELSE concat('op-', event_id) END AS operation_id,
          CAST(1 + floor((sequence - 1) / 10.0) AS BIGINT) AS writer_epoch,
          CASE WHEN sequence = 1 THEN 'root_genesis' WHEN sequence = 2 AND k % 10 <> 9 THEN 'plan_admitted' WHEN event_type = 'purchase' THEN 'grant_activated'
               WHEN event_type = 'click' THEN 'artifact_reference' ELSE 'projection_checkpoint_published' END AS payload_type,
          CAST(200 + event_id % 900 AS BIGINT) AS stored_bytes FROM ev""",
    "work": """SELECT k, scope_id, work_id, work_revision, plan_digest, admitted_scope_epoch, max_attempts, deadline_unix_ms, claim_fence, claim_lease_until,
          CASE WHEN granted THEN claim_fence - CASE WHEN key % 7 = 0 THEN 1 ELSE 0 END END AS grant_fence, CASE WHEN granted THEN SHA[concat('grant|', key)] END AS grant_digest,
          CASE WHEN granted THEN CAST(1 AS BIGINT) END AS granted_attempt, CASE WHEN granted THEN CAST(20 + key % 50 AS BIGINT) END AS granted_units,
          CASE WHEN granted THEN ms + 10000000000 END AS grant_deadline_unix_ms, CASE WHEN status = 'F' AND key % 3 = 0 THEN SHA[concat('result|', key)] END AS terminal_result_digest, key
        FROM (SELECT *, claim_fence IS NOT NULL AND key % 5 < 3 AS granted FROM (
          SELECT o_custkey % n AS k, SHA[concat('scope|', o_custkey % n)] AS scope_id, concat('work-', o_orderkey) AS work_id, CAST(1 AS BIGINT) AS work_revision,
            SHA[concat('plan|', o_custkey % n, '|', o_orderkey % 3)] AS plan_digest, CAST(1 + o_orderkey % 5 AS BIGINT) AS admitted_scope_epoch,
            CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS max_attempts, MS[o_orderdate] + 31536000000 AS deadline_unix_ms,
            CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 2 = 0 THEN CAST(2 + o_orderkey % 9 AS BIGINT) END AS claim_fence,
            CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 2 = 0 THEN MS[o_orderdate] + 15768000000 END AS claim_lease_until,
            MS[o_orderdate] AS ms, o_orderkey AS key, o_orderstatus AS status
          FROM (SELECT *, (SELECT max(user_id) + 1 FROM events) AS n FROM orders) AS o) AS a) AS b""",
    "deps": """SELECT scope_id, work_id, work_revision, depends_on_work_id, CAST(1 AS BIGINT) AS depends_on_work_revision FROM (
          SELECT scope_id, work_id, work_revision, lag(work_id) OVER (PARTITION BY k, plan_digest ORDER BY deadline_unix_ms, work_id) AS depends_on_work_id FROM work) AS a WHERE depends_on_work_id IS NOT NULL""",
    "ranked_work": """SELECT k, work_id, work_revision, grant_digest, key, row_number() OVER (PARTITION BY k ORDER BY key) AS r, count(*) OVER (PARTITION BY k) AS c FROM work""",
    "log": """SELECT l.k, l.scope_id, l.sequence, l.digest, l.parent_digest, l.operation_id, l.writer_epoch, l.payload_type, l.stored_bytes, l.ts_ms,
          CASE WHEN named THEN coalesce(w.grant_digest, SHA[concat('grant|', w.key)]) END AS grant_digest, CASE WHEN named THEN w.work_id END AS work_id,
          CASE WHEN named THEN w.work_revision END AS work_revision, CASE WHEN named THEN CAST(1 + l.event_id % 3 AS BIGINT) END AS attempt,
          CASE WHEN l.payload_type = 'artifact_reference' THEN CASE WHEN l.event_id % 3 = 0 THEN 'invocation_trace' ELSE 'invocation_manifest' END END AS artifact_kind,
          CASE WHEN l.payload_type = 'artifact_reference' THEN SHA[concat('artifact|', l.event_id % 40)] END AS artifact_digest,
          CASE WHEN l.payload_type = 'artifact_reference' AND l.event_id % 3 = 0 THEN SHA[concat('artifact|', (l.event_id * 7) % 40)] END AS manifest_digest,
          CASE WHEN l.payload_type = 'grant_activated' THEN CAST(5 + l.event_id % 20 AS BIGINT) END AS units,
          CASE WHEN l.payload_type = 'grant_activated' THEN 2 + l.event_id % 9 END AS claim_fence, CASE WHEN l.payload_type = 'plan_admitted' THEN SHA[concat('plan|', l.k, '|0')] END AS plan_digest
        FROM (SELECT *, payload_type IN ('grant_activated', 'artifact_reference') AS named FROM raw_log) AS l
        LEFT JOIN ranked_work AS w ON l.k = w.k AND w.r = 1 + l.sequence % (CASE WHEN w.c > 5 THEN 5 ELSE w.c END)""",
    "scopes": """SELECT e.scope_id, concat('campaign-', e.k % 4) AS campaign_id, CAST(NULL AS VARCHAR(64)) AS parent_scope_id, CAST(NULL AS VARCHAR(64)) AS delegation_digest, e.sequence, e.digest AS tail_event_digest,
          CASE WHEN e.k % 10 <> 9 THEN SHA[concat('plan|', e.k, '|0')] END AS active_plan_digest, CAST(1 + floor((e.sequence - 1) / 10.0) AS BIGINT) + e.k % 2 AS scope_epoch,
          SHA[concat('objective|', e.k)] AS objective_digest, CASE WHEN e.k % 10 <> 9 THEN CAST(2000 + e.k % 7 * 200 AS BIGINT) END AS reserved_budget_units, CAST(e.k % 2 AS BIGINT) AS claims_restored, e.k
        FROM ev AS e JOIN (SELECT k, max(sequence) AS last FROM ev GROUP BY k) AS t ON e.k = t.k AND e.sequence = t.last""",
    "heads": """SELECT s.campaign_id, s.scope_id, CASE WHEN s.k % 4 <> 0 THEN concat('node-', s.k % 3) END AS controller_instance_id, s.scope_epoch + s.k % 3 AS scope_epoch,
          CASE WHEN s.k % 4 <> 0 THEN 852000000000 + (s.k - 20) * 1000 END AS lease_until, s.sequence + CASE WHEN s.k % 11 = 3 THEN 1 ELSE 0 END AS sequence, s.tail_event_digest,
          CASE WHEN s.k % 13 = 5 THEN NULL ELSE s.active_plan_digest END AS active_plan_digest, CASE WHEN s.k % 17 = 2 THEN 'op-none' ELSE l.operation_id END AS operation_id, s.k
        FROM scopes AS s JOIN raw_log AS l ON s.scope_id = l.scope_id AND s.sequence = l.sequence""",
    "requests": """SELECT scope_id, work_id, work_revision, claim_fence AS fence, plan_digest, deadline_unix_ms - 1000 AS deadline_unix_ms, CAST(9 AS BIGINT) AS epoch, CAST(2 AS BIGINT) AS attempt, CAST(25 AS BIGINT) AS units,
          CASE WHEN key % 4 = 0 THEN grant_digest ELSE SHA[concat('request|', key)] END AS request_digest, key FROM work""",
    "claims": """SELECT scope_id, work_id, work_revision, plan_digest AS expected_plan, claim_fence AS minimum_fence,
          CASE WHEN key % 13 = 0 THEN NULL ELSE 'claim' END AS record, key % 17 <> 0 AS decodes, CASE WHEN key % 3 = 0 THEN 'active' ELSE 'sealed' END AS state,
          CASE WHEN key % 19 = 0 THEN SHA['other plan'] ELSE plan_digest END AS plan_digest, claim_fence - CASE WHEN key % 23 = 0 THEN 1 ELSE 0 END AS claim_fence,
          CASE WHEN key % 29 = 0 THEN NULL ELSE SHA[concat('body|', key)] END AS stored_digest, SHA[concat('body|', key)] AS evidence_digest, CAST(100 + key % 31 AS BIGINT) AS stored_size, CAST(100 + key % 31 + CASE WHEN key % 31 = 7 THEN 1 ELSE 0 END AS BIGINT) AS evidence_size,
          key % 37 <> 0 AS same_binding, key FROM work""",
    "packs": """SELECT scope_id, g AS pack_id, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM (SELECT *, CAST(floor((sequence - 1) / 16.0) AS BIGINT) AS g FROM raw_log) AS a
        WHERE (k * 5 + g * 3) % 7 <> 0 GROUP BY k, scope_id, g""",
    "claim_ops": """SELECT l.scope_id, w.work_id, w.work_revision, l.sequence AS arrival, CAST(1 + (l.event_id * 3 + l.sequence * 5) % 6 AS BIGINT) AS fence, 852000000000 + (l.event_id * 7 + l.sequence * 13) % 90 * 10000 AS lease_until, 852000000000 + l.sequence * 9000 AS now_ms,
          CASE WHEN (l.event_id + l.sequence) % 8 = 0 THEN SHA[concat('end|', l.event_id % 2)] END AS terminal_result_digest
        FROM raw_log AS l JOIN ranked_work AS w ON l.k = w.k AND w.r = 1 + l.event_id % (CASE WHEN w.c > 9 THEN 9 ELSE w.c END)""",
    "claim_docs": """SELECT scope_id, campaign_id, work_id, work_revision, key AS n, concat('workspace/one/campaigns/', campaign_id, '/scopes/', scope_id, '/claims/', work_id, '/', CASE WHEN key % 31 = 4 THEN 2 ELSE work_revision END) AS key,
          CASE WHEN key % 13 = 0 THEN NULL WHEN key % 17 = 0 THEN substring(doc, 1, length(doc) - 1) WHEN key % 37 = 0 THEN concat(substring(doc, 1, length(doc) - 1), ',"more":1}') WHEN key % 41 = 0 THEN concat(doc, ' ') ELSE doc END AS content
        FROM (SELECT w.*, campaign_id, concat('{"record":"', CASE WHEN key % 47 = 0 THEN 'sealed_submission' ELSE 'scope_claim' END, '","campaign_id":"', campaign_id, '","scope_id":"', CASE WHEN key % 19 = 0 THEN SHA['elsewhere'] ELSE w.scope_id END, '","plan_digest":"',
            CASE WHEN key % 23 = 0 THEN 'short' ELSE plan_digest END, '","work_id":"', work_id, '","work_revision":', CASE WHEN key % 43 = 0 THEN '"1"' ELSE '1' END, ',"claim_fence":', CASE WHEN key % 29 = 0 THEN 0 ELSE claim_fence END, ',"owner_actor":"actor-', key % 5,
            '","owner_instance":"', CASE WHEN key % 53 = 0 THEN 'no/de' ELSE 'node-1' END, '","operation_id":"op-', key, '","state":', CASE WHEN key % 3 = 0 THEN concat('{"state":"active","lease_until":', claim_lease_until, '}')
            ELSE concat('{"state":"sealed","submission":{"digest":"', SHA[concat('body|', key)], '","size":', key % 31, ',"media_type":"application/json","producer_attempt":"1","creation_time_unix_ms":1,"retention_class":null}}') END, '}') AS doc
          FROM work AS w JOIN (SELECT scope_id AS own, campaign_id FROM scopes) AS s ON s.own = w.scope_id WHERE claim_fence IS NOT NULL) AS d""",
    "grant_docs": """SELECT scope_id, campaign_id, work_id, work_revision, key AS n, concat('workspace/one/campaigns/', campaign_id, '/scopes/', scope_id, '/grants/', work_id, '/', work_revision, '/', grant_fence + CASE WHEN key % 31 = 4 THEN 1 ELSE 0 END) AS key,
          CASE WHEN key % 13 = 0 THEN NULL WHEN key % 17 = 0 THEN substring(doc, 1, length(doc) - 1) WHEN key % 37 = 0 THEN concat(substring(doc, 1, length(doc) - 1), ',"more":1}') WHEN key % 41 = 0 THEN concat(doc, ' ') ELSE doc END AS content
        FROM (SELECT w.*, campaign_id, concat('{"record":"effect_grant","campaign_id":"', campaign_id, '","scope_id":"', CASE WHEN key % 19 = 0 THEN SHA['elsewhere'] ELSE w.scope_id END, '","plan_digest":"', plan_digest, '","work_id":"', work_id, '","work_revision":1,"claim_fence":', grant_fence,
            ',"action":"write","resource_scope":"', CASE WHEN key % 53 = 0 THEN 'a/b' ELSE 'repo' END, '","attempt":', CASE WHEN key % 43 = 0 THEN '"1"' ELSE '1' END, ',"limit_units":', key % 11, ',"deadline_unix_ms":', grant_deadline_unix_ms, ',"operation_id":"op-', key, '"}') AS doc
          FROM work AS w JOIN (SELECT scope_id AS own, campaign_id FROM scopes) AS s ON s.own = w.scope_id WHERE grant_fence IS NOT NULL AND grant_fence > 0) AS d""",
    "bad_scopes": """SELECT CASE WHEN k % 23 = 1 THEN upper(scope_id) ELSE scope_id END AS scope_id, CASE WHEN k % 23 = 2 THEN 'a/b' ELSE campaign_id END AS campaign_id, CASE WHEN k % 23 = 3 THEN 'p' END AS parent_scope_id, CASE WHEN k % 23 = 4 THEN 'd' END AS delegation_digest,
          CASE WHEN k % 23 = 5 THEN 0 ELSE sequence END AS sequence, CASE WHEN k % 23 = 6 THEN 'short' ELSE tail_event_digest END AS tail_event_digest, CASE WHEN k % 23 = 7 THEN 'short' ELSE active_plan_digest END AS active_plan_digest, CASE WHEN k % 23 = 8 THEN 0 ELSE scope_epoch END AS scope_epoch,
          CASE WHEN k % 23 = 9 THEN 'ABC' ELSE objective_digest END AS objective_digest, CASE WHEN k % 23 = 10 THEN NULL WHEN k % 23 = 11 THEN -1 ELSE reserved_budget_units END AS reserved_budget_units, CASE WHEN k % 23 = 12 THEN 2 ELSE claims_restored END AS claims_restored FROM scopes""",
    "bad_events": """SELECT scope_id, CASE WHEN m = 1 AND sequence > 1 THEN 10000000000000000 + sequence ELSE sequence END AS sequence, CASE WHEN m = 2 THEN 'x' ELSE digest END AS digest, CASE WHEN m = 3 THEN NULL WHEN m = 4 THEN 'y' ELSE parent_digest END AS parent_digest,
          CASE WHEN m = 5 THEN '' WHEN m = 19 THEN 'a/b' ELSE operation_id END AS operation_id, CASE WHEN m = 6 THEN 0 ELSE writer_epoch END AS writer_epoch, CASE WHEN m = 7 THEN 'a/b' WHEN m = 8 THEN 'root_genesis' ELSE payload_type END AS payload_type,
          CASE WHEN m = 9 THEN NULL WHEN m = 10 THEN 'g' ELSE grant_digest END AS grant_digest, CASE WHEN m = 11 THEN NULL WHEN m = 12 THEN repeat('w', 130) ELSE work_id END AS work_id, CASE WHEN m = 13 THEN 0 ELSE work_revision END AS work_revision, CASE WHEN m = 14 THEN 0 ELSE attempt END AS attempt,
          CASE WHEN m = 15 THEN NULL WHEN m = 16 THEN 'odd' ELSE artifact_kind END AS artifact_kind, CASE WHEN m = 17 THEN NULL WHEN m = 18 THEN 'z' ELSE artifact_digest END AS artifact_digest FROM (SELECT *, (sequence * 7 + k * 3) % 29 AS m FROM log) AS l""",
    "bad_work": """SELECT scope_id, CASE WHEN m = 1 THEN concat('a/', work_id) ELSE work_id END AS work_id, CASE WHEN m = 2 THEN -1 ELSE work_revision END AS work_revision, CASE WHEN m = 3 THEN 'zz' ELSE plan_digest END AS plan_digest, CASE WHEN m = 4 THEN 0 ELSE admitted_scope_epoch END AS admitted_scope_epoch,
          CASE WHEN m = 5 THEN 0 ELSE max_attempts END AS max_attempts, CASE WHEN m = 6 THEN 10000000000000000 ELSE deadline_unix_ms END AS deadline_unix_ms, CASE WHEN m = 7 THEN 0 WHEN m = 12 THEN NULL ELSE claim_fence END AS claim_fence, CASE WHEN m = 8 OR m = 12 THEN NULL ELSE claim_lease_until END AS claim_lease_until,
          CASE WHEN m = 9 THEN NULL ELSE grant_fence END AS grant_fence, CASE WHEN m = 10 THEN 'g' ELSE grant_digest END AS grant_digest, granted_attempt, CASE WHEN m = 11 THEN 0 ELSE granted_units END AS granted_units, grant_deadline_unix_ms,
          CASE WHEN m = 13 THEN 'short' ELSE terminal_result_digest END AS terminal_result_digest FROM (SELECT *, key % 17 AS m FROM work) AS w""",
    "bad_deps": """SELECT scope_id, work_id, work_revision, CASE WHEN m = 1 THEN 'a/b' WHEN m = 2 THEN '' WHEN m = 3 THEN work_id ELSE depends_on_work_id END AS depends_on_work_id, CASE WHEN m = 4 THEN -1 ELSE depends_on_work_revision END AS depends_on_work_revision
        FROM (SELECT *, CAST(substring(work_id, 6) AS BIGINT) % 13 AS m FROM deps) AS d""",
    "runs": """SELECT o_orderkey AS run_seq, CASE WHEN o_orderkey % 2 = 0 THEN 'research' ELSE 'change' END AS pilot, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS cell, MS[o_orderdate] AS start_ms, o_orderstatus,
          CAST(floor(o_orderkey / 30.0) AS BIGINT) AS campaign, MS[o_orderdate] + (100 + o_orderkey % 40) * 86400000 AS treatment_end_ms, MS[o_orderdate] + (101 + o_orderkey % 40 + o_orderkey % 3) * 86400000 AS measurement_end_ms,
          o_orderkey % 97 <> 0 AS measured FROM orders""",
    "attempts": """SELECT l_orderkey AS run_seq, CAST(l_linenumber AS BIGINT) AS item, concat('agent-', l_suppkey % 8) AS agent_id, concat('host-', l_suppkey % 3) AS host_id,
          MS[l_shipdate] AS ts_ms, CAST(l_quantity * 1000 AS BIGINT) AS busy_ms, CAST(l_quantity * 1700 AS BIGINT) AS life_ms, CAST(l_partkey % 400 AS BIGINT) * 1000 AS input_tokens, CAST(l_suppkey % 100 AS BIGINT) * 50 AS output_tokens,
          l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey % 4 AS BIGINT) * 1000 AS cached_input_tokens, CASE WHEN l_partkey % 50 = 49 THEN 'model-three' WHEN l_partkey % 2 = 0 THEN 'model-one' ELSE 'model-two' END AS model,
          CASE l_linenumber WHEN 1 THEN 'ready' WHEN 2 THEN 'dispatch' WHEN 3 THEN 'attempt' WHEN 4 THEN 'model_call' WHEN 5 THEN 'busy_interval' WHEN 6 THEN 'integration_attempt' ELSE 'final_measurement' END AS record, CASE WHEN l_linenumber = 7 THEN 'measurement' ELSE 'treatment' END AS phase, l_partkey AS artifact FROM lineitem""",
}

#: Tables of the driver that relations read.
TABLES = ("events", "orders", "lineitem", "customer", "part", "supplier", "documents", "pages", "conversations")

_MS = {
    "spark": r"(datediff(CAST(\1 AS DATE), DATE'1970-01-01') * 86400000L + hour(\1) * 3600000L + minute(\1) * 60000L + CAST(extract(SECOND FROM \1) * 1000 AS BIGINT))",
    "duckdb": r"(epoch_us(\1) // 1000)",
}
_SHA = {"spark": r"sha2(\1, 256)", "duckdb": r"sha256(\1)"}


def dialect(sql: str, engine: str) -> str:
    """A relation's or query's text for one engine."""
    out = re.sub(r"SHA\[([^\[\]]*)\]", _SHA[engine], sql)
    return re.sub(r"MS\[([^\[\]]*)\]", _MS[engine], out)


def _uses(sql: str) -> list[str]:
    return [r for r in RELATIONS if re.search(rf"\b(FROM|JOIN)\s+{r}\b", sql)]


#: Tables that hold prepared relations, by folder and relation.
_PREPARED: dict[tuple[str, str], str] = {}


def prepare(spark: SparkSession, sf_dir: str, names: list[str] | None = None, buckets: int = 8) -> None:
    """Writes relations as tables bucketed by scope (or run), which ``relation`` reads from then on.

    A log that is read more than once is worth writing once: its windows, joins and digests are not made
    again, and work on one scope or run needs no shuffle any more.
    """
    for name in names or list(RELATIONS):
        df = relation(spark, sf_dir, name)
        key = next(c for c in ("scope_id", "run_seq", "k") if c in df.columns)
        table = f"prepared_{name}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
        _PREPARED[sf_dir, name] = table


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation over the tables in ``sf_dir``."""
    if (sf_dir, name) in _PREPARED:
        return spark.table(_PREPARED[sf_dir, name])
    sql = dialect(RELATIONS[name], "spark")
    parts = {r: relation(spark, sf_dir, r) for r in _uses(sql)}
    parts |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for p in parts:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{p}\b", rf"\1 {{{p}}}", sql)
    return spark.sql(sql, **parts)


def prelude(sql: str) -> str:
    """``sql`` for DuckDB, with the relations it uses as common table expressions before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for r in _uses(text):
            add(RELATIONS[r])
            if r not in needed:
                needed.append(r)

    add(sql)
    body = dialect(sql, "duckdb").strip()
    chain = ", ".join(f"{r} AS ({dialect(RELATIONS[r], 'duckdb')})" for r in needed)
    if not chain:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {chain}, {body[15:]}"
    return f"WITH {chain}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {chain} {body}"
