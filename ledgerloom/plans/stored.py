"""Queries over stored objects and publication: the driver's tables written as binary objects, some of them damaged, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scalar import event_key
from ledgerloom.operators import accel, audit, fold, intake, lookups, measure, publish, scheduling
from ledgerloom.sources import records
from ledgerloom.streaming import incremental

from .registry import _query


def _other() -> Column:
    """A digest that nothing has."""
    return F.sha2(F.lit("other"), 256)


def _cut_short(content: Column) -> Column:
    """The bytes without the last."""
    return F.substring(content, 1, F.octet_length(content) - 1)


# ---------------------------------------------------------------- events


def _payload() -> Column:
    """Payload fields of a log row; what the log doesn't hold is fixed."""
    fixed = {"campaign_id": F.lit("campaign"), "config_digest": _other(), "deadline_unix_ms": F.lit(900_000_000_000), "size": F.lit(7), "media_type": F.lit("text"), "producer_attempt": F.lit("1"), "creation_time_unix_ms": F.lit(1), "version": F.lit(1), "snapshot_digest": _other(), "snapshot_length": F.lit(9)}
    own = {"kind": F.col("artifact_kind"), "digest": F.col("artifact_digest"), "covered_sequence": F.greatest(F.col("sequence") - 1, F.lit(1)), "covered_tail_digest": F.coalesce("parent_digest", _other())}
    held = ("plan_digest", "work_id", "work_revision", "claim_fence", "grant_digest", "attempt", "units")
    return F.struct(*((own | fixed).get(c, F.col(c) if c in held else F.lit(None)).alias(c) for c in records._ALL))


def _stored(t) -> DataFrame:
    """The log's events as objects with their keys."""
    parent = F.when(F.col("parent_digest").isNotNull(), F.struct((F.col("sequence") - 1).alias("sequence"), F.col("parent_digest").alias("digest")))
    envelope = F.struct("scope_id", "sequence", parent.alias("parent_event"), "writer_epoch", "operation_id", "payload_type")
    made = records.encode_events(t("log").withColumns({"envelope": envelope, "payload": _payload()}), "envelope", "payload")
    return made.withColumn("key", event_key(F.lit("scopes/one"), F.col("sequence"), F.sha2("content", 256)))


_ROW = "parent_digest, operation_id, writer_epoch, payload_type, work_id, work_revision, attempt, units, grant_digest, artifact_kind, artifact_digest, plan_digest"


@_query(
    "record_log",
    f"""WITH s AS (SELECT *, CASE WHEN (sequence + k) % 23 = 0 THEN 'malformed' WHEN (sequence + k) % 23 = 2 THEN 'unbound' WHEN (sequence + k) % 23 = 1 THEN 'reference_mismatch' ELSE 'ok' END AS status FROM log)
      SELECT scope_id AS asked_scope, sequence AS asked_sequence, status, {", ".join(f"CASE WHEN status = 'ok' THEN {c.strip()} END AS {c.strip()}" for c in _ROW.split(","))} FROM s""",
)
def _(t):
    fate = (F.col("sequence") + F.col("k")) % 23
    o = _stored(t).withColumns({"content": F.when(fate == 0, _cut_short(F.col("content"))).otherwise(F.col("content"))})
    wrong = event_key(F.lit("scopes/one"), F.col("sequence"), _other())
    o = o.withColumns({"key": F.when(fate == 1, wrong).otherwise(event_key(F.lit("scopes/one"), F.col("sequence"), F.sha2("content", 256))), "asked": F.when(fate == 2, _other()).otherwise(F.col("scope_id"))})
    # the reader knows what it asked for; the rows say what it got
    asked = o.select("key", "content", "asked", F.col("scope_id").alias("asked_scope"), F.col("sequence").alias("asked_sequence"))
    got = records.decode_log(asked, scope=F.col("asked"), keep=("asked_scope", "asked_sequence"))
    return got.select("asked_scope", "asked_sequence", "status", *(c.strip() for c in _ROW.split(",")))


@_query("event_fetch", "SELECT scope_id, sequence, CASE WHEN sequence % 7 = 3 THEN 'absent' WHEN sequence % 5 = 2 THEN 'reference_mismatch' ELSE 'found' END AS verdict FROM log")
def _(t):
    o = _stored(t).select("scope_id", "sequence", "content")
    asked = o.select("scope_id", "sequence", F.when(F.col("sequence") % 5 == 2, _other()).otherwise(F.sha2("content", 256)).alias("digest"))
    return records.fetch_events(asked, o.filter("sequence % 7 <> 3")).select("scope_id", "sequence", "verdict")


@_query(
    "publication_gate",
    "SELECT scope_id, sequence, CASE WHEN sequence % 9 = 4 THEN 'unregistered' WHEN (sequence + k) % 23 = 0 THEN 'undecodable' WHEN sequence % 10 = 5 AND payload_type <> 'plan_admitted' THEN 'type_mismatch' ELSE 'publishable' END AS verdict FROM log",
)
def _(t):
    o = _stored(t).withColumn("bytes", F.when((F.col("sequence") + F.col("k")) % 23 == 0, _cut_short(F.col("content"))).otherwise(F.col("content")))
    claimed = F.when(F.col("sequence") % 9 == 4, "artifact").when(F.col("sequence") % 10 == 5, "plan_admitted").otherwise(F.col("payload_type"))
    events = o.select("scope_id", "sequence", F.sha2("bytes", 256).alias("digest"), claimed.alias("payload_type"))
    keyed = o.select(event_key(F.lit("scopes/one"), F.col("sequence"), F.sha2("bytes", 256)).alias("key"), F.col("bytes").alias("content"))
    return publish.publication_gate(events, records.decode_log(keyed))


# ---------------------------------------------------------------- plans, manifests, traces


@_query(
    "record_plans",
    """WITH s AS (SELECT w.scope_id, w.plan_digest, any_value(k) AS k, count(*) AS specs, sum(max_attempts) AS attempts, sum((SELECT count(*) FROM deps AS d WHERE d.scope_id = w.scope_id AND d.work_id = w.work_id AND d.work_revision = w.work_revision)) AS edges FROM work AS w GROUP BY w.scope_id, w.plan_digest),
      v AS (SELECT *, CASE WHEN k % 7 = 1 OR (k % 7 = 4 AND specs > 1) THEN 'malformed' WHEN k % 7 = 2 THEN 'reference_mismatch' WHEN k % 7 = 3 THEN 'unbound' ELSE 'ok' END AS status FROM s)
      SELECT scope_id, plan_digest, status, CASE WHEN status = 'ok' THEN specs END AS specs, CASE WHEN status = 'ok' THEN CAST(attempts AS BIGINT) END AS attempts, CASE WHEN status = 'ok' THEN CAST(edges AS BIGINT) END AS edges FROM v""",
)
def _(t):
    key = ["scope_id", "work_id", "work_revision"]
    edges = t("deps").groupBy(*key).agg(F.array_sort(F.collect_set("depends_on_work_id")).alias("dependencies"))
    w = t("work").join(edges, key, "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    spec = F.struct("work_id", "dependencies", F.struct("max_attempts", "deadline_unix_ms").alias("bounds"))
    p = w.groupBy("scope_id", "plan_digest").agg(F.array_sort(F.collect_list(spec)).alias("specs"), F.first("k").alias("k"))
    none = F.lit(None)
    bases = F.array(F.struct(F.lit("observation").alias("kind"), F.lit(3).alias("sequence"), _other().alias("digest"), none.cast("string").alias("plan_digest")), F.struct(F.lit("prior_revision").alias("kind"), none.cast("int").alias("sequence"), none.cast("string").alias("digest"), _other().alias("plan_digest")))
    order = F.when(F.col("k") % 7 == 4, F.reverse("specs")).otherwise(F.col("specs"))
    record = F.struct("scope_id", _other().alias("objective_digest"), none.cast("string").alias("parent_plan_digest"), bases.alias("bases"), order.alias("work_specs"), F.lit(100).cast("long").alias("reserved_budget_units"))
    o = records.encode_records(p.withColumn("r", record), "plan", "r").withColumn("named", F.when(F.col("k") % 7 == 2, _other()).otherwise(F.sha2("content", 256)))
    o = o.withColumns({"content": F.when(F.col("k") % 7 == 1, _cut_short(F.col("content"))).otherwise(F.col("content")), "asked": F.when(F.col("k") % 7 == 3, _other()).otherwise(F.col("scope_id"))})
    got = records.decode_records(o.select("scope_id", "plan_digest", "content", "named", "asked"), "plan", digest=F.col("named"), scope=F.col("asked"))
    specs = F.col("record.work_specs")
    total = lambda f: F.when(F.col("status") == "ok", F.aggregate(F.transform(specs, f), F.lit(0).cast("long"), lambda a, x: a + x))
    return got.select("scope_id", "plan_digest", "status", F.when(F.col("status") == "ok", F.size(specs).cast("long")).alias("specs"), total(lambda s: s["bounds"]["max_attempts"]).alias("attempts"), total(lambda s: F.size(s["dependencies"]).cast("long")).alias("edges"))


def _binding() -> Column:
    return F.struct("scope_id", "plan_digest", "work_id", "work_revision", "claim_fence", "grant_digest", F.col("granted_attempt").alias("attempt"))


@_query(
    "record_manifests",
    """SELECT scope_id, work_id, CASE WHEN key % 11 = 0 THEN 'malformed' WHEN key % 13 = 0 THEN 'reference_mismatch' ELSE 'ok' END AS status, CASE WHEN key % 11 <> 0 AND key % 13 <> 0 THEN claim_fence END AS claim_fence,
      CASE WHEN key % 11 <> 0 AND key % 13 <> 0 THEN grant_digest END AS grant_digest, CASE WHEN key % 11 <> 0 AND key % 13 <> 0 THEN 100 + key % 7 END AS max_output_tokens FROM work WHERE granted_units IS NOT NULL""",
)
def _(t):
    key = F.col("key")
    record = F.struct(
        _binding().alias("binding"), F.lit("provider").alias("provider"), F.lit("model-one").alias("model_id"), F.lit("profile").alias("configuration_id"), _other().alias("configuration_digest"), _other().alias("request_digest"),
        (100 + key % 7).alias("max_output_tokens"), F.col("grant_deadline_unix_ms").alias("deadline_unix_ms"), F.when(key % 11 == 0, "a/b").otherwise("op").alias("operation_id"),
    )
    o = records.encode_records(t("work").filter("granted_units IS NOT NULL").withColumn("r", record), "manifest", "r")
    o = o.select("scope_id", "work_id", "content", F.when(key % 13 == 0, _other()).otherwise(F.sha2("content", 256)).alias("named"))
    got = records.decode_records(o, "manifest", digest=F.col("named"), scope=F.col("scope_id"))
    return got.select("scope_id", "work_id", "status", F.col("record.binding.claim_fence").alias("claim_fence"), F.col("record.binding.grant_digest").alias("grant_digest"), F.col("record.max_output_tokens").alias("max_output_tokens"))


@_query(
    "record_traces",
    """SELECT scope_id, work_id, CASE WHEN key % 11 = 0 THEN 'malformed' WHEN key % 13 = 0 THEN 'unbound' ELSE 'ok' END AS status, CASE WHEN key % 11 <> 0 AND key % 13 <> 0 THEN CASE WHEN key % 2 = 0 THEN 'success' ELSE 'refused' END END AS outcome,
      CASE WHEN key % 11 <> 0 AND key % 13 <> 0 AND key % 3 <> 0 THEN key % 50 END AS input_tokens, CASE WHEN key % 11 <> 0 AND key % 13 <> 0 AND key % 2 = 0 THEN concat('said ', key) END AS retained FROM work WHERE granted_units IS NOT NULL""",
)
def _(t):
    key = F.col("key")
    use = F.struct((key % 50).alias("input_tokens"), F.lit(2).alias("output_tokens"), (key % 50 + 2).alias("total_tokens"), F.lit(None).alias("cache_read_input_tokens"), F.lit(0).alias("cache_write_input_tokens"))
    said = F.concat(F.lit("said "), key.cast("string"))
    text = F.struct(said.alias("retained"), F.octet_length(said).alias("full_bytes"), F.sha2(said, 256).alias("full_digest"))
    record = F.struct(
        _binding().alias("binding"), _other().alias("manifest_digest"), F.when(key % 11 == 0, "done").when(key % 2 == 0, "success").otherwise("refused").alias("outcome"), F.lit(None).cast("string").alias("provider_request_id"),
        F.when(key % 3 != 0, use).alias("reported_use"), F.when(key % 2 == 0, text).alias("output"), F.when(key % 2 == 1, text).alias("diagnostic"),
    )
    o = records.encode_records(t("work").filter("granted_units IS NOT NULL").withColumn("r", record), "trace", "r")
    got = records.decode_records(o.select("scope_id", "work_id", "content", F.when(key % 13 == 0, _other()).otherwise(F.col("scope_id")).alias("asked")), "trace", scope=F.col("asked"))
    return got.select("scope_id", "work_id", "status", F.col("record.outcome").alias("outcome"), F.col("record.reported_use.input_tokens").alias("input_tokens"), F.col("record.output.retained").alias("retained"))


# ---------------------------------------------------------------- catalogues and packs


@_query(
    "catalog_current",
    """WITH p AS (SELECT scope_id, count(*) AS n FROM packs GROUP BY scope_id)
      SELECT s.scope_id, CASE WHEN k % 6 = 0 THEN 'absent' WHEN k % 6 = 1 OR (k % 6 = 2 AND coalesce(n, 0) > 1) THEN 'unusable' ELSE 'present' END AS state, CASE WHEN k % 6 > 2 OR (k % 6 = 2 AND coalesce(n, 0) < 2) THEN coalesce(n, 0) END AS packs FROM scopes AS s LEFT JOIN p ON p.scope_id = s.scope_id""",
)
def _(t):
    k = F.col("k")
    row = F.struct(F.col("first_sequence").alias("start"), F.col("last_sequence").alias("end"), _other().alias("pack_digest"))
    lists = t("packs").groupBy("scope_id").agg(F.array_sort(F.collect_list(row)).alias("packs"))
    s = t("scopes").select("scope_id", "k").join(lists, "scope_id", "left").withColumn("packs", F.coalesce("packs", F.array().cast("array<struct<start:bigint,end:bigint,pack_digest:string>>")))
    listed = F.when(k % 6 == 2, F.reverse("packs")).otherwise(F.col("packs"))
    r = F.struct(F.lit(1).alias("version"), "scope_id", listed.alias("packs"), F.array().cast("array<struct<sequence:bigint,digest:string>>").alias("checkpoints"))
    objects = records.encode_records(s.withColumn("r", r), "catalog", "r").withColumn("digest", F.sha2("content", 256))
    catalogs = records.decode_records(objects.select("scope_id", "digest", "content"), "catalog", digest=F.col("digest"), scope=F.col("scope_id"))
    named = F.struct(F.lit(1).alias("version"), "scope_id", F.when(k % 6 == 1, _other()).otherwise(F.col("digest")).alias("catalog_digest"))
    pointers = records.encode_records(objects.select("scope_id", "k", named.alias("r")), "pointer", "r").withColumn("content", F.when(k % 6 != 0, F.col("content")))
    got = accel.current_catalogs(records.decode_records(pointers.select("scope_id", "content"), "pointer", scope=F.col("scope_id")), catalogs)
    return got.select("scope_id", "state", F.when(F.col("state") == "present", F.size("catalog.packs").cast("long")).alias("packs"))


def _packs(t) -> DataFrame:
    body = F.concat(F.lit("body|"), "digest")
    log = t("log").select("scope_id", "sequence", F.encode(body, "UTF-8").alias("payload"), F.sha2(body, 256).alias("digest"))
    return accel.build_packs(log, "payload")


@_query(
    "packed_ranges",
    """SELECT r.scope_id, r.first, r.last, l.sequence, SHA[concat('body|', l.digest)] AS digest, CAST((l.sequence - r.first + 1) * 69 AS BIGINT) AS running_bytes FROM (SELECT scope_id, 3 AS first, sequence - 2 AS last FROM scopes WHERE k % 4 <> 1) AS r
      JOIN log AS l ON l.scope_id = r.scope_id AND l.sequence BETWEEN r.first AND r.last WHERE (l.sequence - r.first + 1) * 69 <= 2000""",
)
def _(t):
    asked = t("scopes").filter("k % 4 <> 1").select("scope_id", F.lit(3).alias("first"), (F.col("sequence") - 2).alias("last"))
    return accel.read_ranges(asked, _packs(t), 2000)


@_query(
    "pack_read_status",
    "SELECT scope_id, 1 AS first_sequence, CASE k % 5 WHEN 1 THEN 'bad_section' WHEN 2 THEN 'bad_offsets' WHEN 3 THEN 'bad_slice' ELSE 'ok' END AS status FROM scopes",
)
def _(t):
    k = F.col("k")
    p = _packs(t).filter("first_sequence = 1").join(t("scopes").select("scope_id", "k"), "scope_id")
    damaged = p.withColumns(
        {
            "events_digest": F.when(k % 5 == 1, _other()).otherwise(F.col("events_digest")), "offsets": F.when(k % 5 == 2, F.reverse("offsets")).otherwise(F.col("offsets")),
            "digests": F.when(k % 5 == 3, F.transform("digests", lambda d, i: F.when(i == 1, _other()).otherwise(d))).otherwise(F.col("digests")),
        }
    )
    return accel.pack_status(damaged).select("scope_id", F.col("first_sequence").cast("int").alias("first_sequence"), "status")


# ---------------------------------------------------------------- publication


def _batches(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each log cut behind its genesis: what is there, its heads, a batch of what follows with a fault by scope, and the readable plans."""
    log, k, s = t("log"), F.col("k"), F.col("sequence")
    old = log.filter("sequence = 1")
    heads = old.select("scope_id", "sequence", F.col("digest").alias("tail_event_digest"), "operation_id", F.col("writer_epoch").alias("scope_epoch"), F.lit(None).cast("string").alias("active_plan_digest"))
    new = log.filter((s == 2) | ((k % 6 == 1) & s.between(2, 4))).withColumns(
        {
            "parent_digest": F.when(k % 6 == 2, _other()).otherwise(F.col("parent_digest")), "operation_id": F.when(k % 6 == 3, F.concat(F.lit("root-genesis:"), "scope_id")).otherwise(F.col("operation_id")),
            "payload_type": F.when(k % 6 == 5, "root_note").otherwise(F.col("payload_type")),
        }
    )
    plans = t("scopes").filter("k % 12 <> 4").select(F.when(k % 12 == 10, "elsewhere").otherwise(F.col("scope_id")).alias("scope_id"), F.col("active_plan_digest").alias("plan_digest"))
    return old, heads, new, plans


@_query(
    "batch_append",
    """WITH b AS (SELECT k, scope_id, sequence, writer_epoch, plan_digest, CASE WHEN k % 6 = 2 THEN SHA['other'] ELSE parent_digest END AS parent, CASE WHEN k % 6 = 3 THEN 'root-genesis:' || scope_id ELSE operation_id END AS op,
        CASE WHEN k % 6 = 5 THEN 'root_note' ELSE payload_type END AS kind, digest FROM log WHERE sequence = 2 OR (k % 6 = 1 AND sequence BETWEEN 2 AND 4)),
      p AS (SELECT CASE WHEN k % 12 = 10 THEN 'elsewhere' ELSE scope_id END AS scope_id, active_plan_digest FROM scopes WHERE k % 12 <> 4),
      v AS (SELECT g.scope_id, g.digest, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.scope_id = g.scope_id AND b.kind NOT IN ('plan_admitted', 'root_genesis')) THEN 'refused_member'
        WHEN EXISTS (SELECT 1 FROM b WHERE b.scope_id = g.scope_id AND (b.op = g.operation_id OR b.writer_epoch <> g.writer_epoch
          OR b.parent IS DISTINCT FROM (SELECT l.digest FROM log AS l WHERE l.scope_id = b.scope_id AND l.sequence = b.sequence - 1))) THEN 'refused_chain'
        WHEN EXISTS (SELECT 1 FROM b WHERE b.scope_id = g.scope_id AND NOT EXISTS (SELECT 1 FROM p WHERE p.scope_id = b.scope_id AND p.active_plan_digest = b.plan_digest)) THEN 'refused_plan' ELSE 'appended' END AS verdict
        FROM log AS g WHERE g.sequence = 1 AND EXISTS (SELECT 1 FROM b WHERE b.scope_id = g.scope_id))
      SELECT scope_id, verdict, CASE WHEN verdict = 'appended' THEN 2 ELSE 1 END AS head_sequence, CASE WHEN verdict = 'appended' THEN (SELECT l.digest FROM log AS l WHERE l.scope_id = v.scope_id AND l.sequence = 2) ELSE digest END AS tail,
        CASE WHEN verdict = 'appended' THEN 2 ELSE 1 END AS events FROM v""",
)
def _(t):
    log, heads, verdicts = publish.append_batches(*_batches(t))
    held = log.groupBy("scope_id").agg(F.count("*").alias("events"))
    kept = heads.select("scope_id", F.col("sequence").cast("int").alias("head_sequence"), F.col("tail_event_digest").alias("tail"))
    return verdicts.select("scope_id", "verdict").join(kept, "scope_id").join(held, "scope_id").select("scope_id", "verdict", "head_sequence", "tail", F.col("events").cast("int").alias("events"))


@_query(
    "checkpoint_certified",
    """SELECT scope_id, sequence, CASE WHEN sequence % 5 = 0 THEN 'uncommitted' WHEN sequence % 3 = 0 THEN 'misplaced' ELSE 'certified' END AS verdict FROM log WHERE payload_type = 'projection_checkpoint_published'""",
)
def _(t):
    s = F.col("sequence")
    c = t("log").filter("payload_type = 'projection_checkpoint_published'").select("scope_id", "sequence", F.when(s % 5 == 0, _other()).otherwise(F.col("digest")).alias("digest"), F.when(s % 3 == 0, s - 2).otherwise(s - 1).alias("covered_sequence"))
    return publish.certified(c, t("log"))


@_query(
    "tally_differences",
    """SELECT path, CASE WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 5 = 0 THEN n + 1 ELSE n END AS tallied, CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE n END AS listed FROM (SELECT l_suppkey, concat('src/', l_suppkey, '.rs') AS path, count(*) AS n FROM lineitem GROUP BY l_suppkey)
      WHERE (CASE WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 5 = 0 THEN n + 1 ELSE n END) <> (CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE n END)""",
)
def _(t):
    k = F.col("l_suppkey")
    rows = t("lineitem_rows").select("l_suppkey", F.concat(F.lit("src/"), k.cast("string"), F.lit(".rs")).alias("path"))
    tallies = rows.filter(k % 7 != 0).groupBy("path", "l_suppkey").agg(F.count("*").alias("n")).select("path", (F.col("n") + F.when(k % 5 == 0, 1).otherwise(0)).alias("targets"))
    return publish.tally_differences(tallies, rows.filter(k % 11 != 0).select("path"))


# ---------------------------------------------------------------- intake with its own matching


@_query(
    "submission_match",
    """SELECT scope_id, work_id, work_revision, CASE WHEN key % 41 = 0 AND key % 13 <> 0 THEN 'unavailable' WHEN key % 13 = 0 THEN 'absent' WHEN key % 17 = 0 THEN 'malformed' WHEN key % 3 = 0 THEN 'not_sealed' WHEN key % 19 = 0 THEN 'identity_mismatch' WHEN claim_fence + 1 < coalesce(claim_fence, 0) + CASE WHEN key % 23 = 0 THEN 2 ELSE 0 END THEN 'stale_fence'
      WHEN key % 43 = 0 THEN 'unavailable' WHEN key % 29 = 0 THEN 'missing_evidence' WHEN key % 31 IN (7, 8) OR key % 37 IN (0, 1) THEN 'evidence_mismatch' ELSE 'sealed' END AS verdict FROM work""",
)
def _(t):
    key, w = F.col("key"), t("work")
    triple = ("scope_id", "work_id", "work_revision")
    expected = w.select(*triple, F.col("plan_digest").alias("expected_plan"), (F.col("claim_fence") + F.when(key % 23 == 0, 2).otherwise(0)).alias("minimum_fence"))
    body = F.encode(F.concat(F.lit("body|"), key.cast("string")), "UTF-8")
    owner = F.concat(F.lit("actor-"), (key % 5).cast("string"))
    plan = F.when(key % 19 == 0, _other()).otherwise(F.col("plan_digest"))
    own = (*triple, plan.alias("plan_digest"), (F.col("claim_fence") + 1).alias("claim_fence"), owner.alias("owner_actor"), F.lit("node-1").alias("owner_instance"), F.lit("op").alias("operation_id"))
    claims = w.filter(key % 13 != 0).select(*own, (key % 17 != 0).alias("decodes"), (key % 41 == 0).alias("unavailable"), F.when(key % 3 == 0, "active").otherwise("sealed").alias("state"), F.sha2(body, 256).alias("evidence_digest"), (F.octet_length(body) + F.when(key % 31 == 7, 1).otherwise(0)).alias("evidence_size"))
    stated = [c for c in own if not isinstance(c, Column)] + [plan.alias("plan_digest"), (F.col("claim_fence") + 1).alias("claim_fence"), F.when(key % 37 == 0, "someone").otherwise(owner).alias("owner_actor"), F.lit("node-1").alias("owner_instance"), F.lit("op").alias("operation_id")]
    evidence = w.filter(key % 29 != 0).select(*stated, F.sha2(body, 256).alias("address"), (key % 43 == 0).alias("unavailable"), F.when(key % 31 == 8, F.concat(body, F.lit(b"!"))).otherwise(body).alias("content"), (key % 37 != 1).alias("decodes"))
    # a failed read of evidence that isn't there is unavailable too
    lost = w.filter((key % 29 == 0) & (key % 43 == 0)).select(F.sha2(body, 256).alias("address"), F.lit(True).alias("unavailable"))
    joined = intake.match_submissions(expected, claims, evidence.unionByName(lost, allowMissingColumns=True))
    return intake.submission_intake(joined)


@_query(
    "grant_match",
    """SELECT scope_id, work_id, work_revision, key % 41 = 0 AND key % 13 <> 0 AS unavailable, key % 13 <> 0 AS found, key % 13 <> 0 AND key % 17 <> 0 AND key % 7 <> 2 AS decodes, key % 13 <> 0 AND key % 19 <> 0 AND key % 11 <> 5 AS same_identity FROM work WHERE grant_fence IS NOT NULL""",
)
def _(t):
    key = F.col("key")
    w = t("work").filter("grant_fence IS NOT NULL")
    base = ("scope_id", "work_id", "work_revision", F.col("grant_fence").alias("fence"), "plan_digest")
    expected = w.select(*base, F.lit("write").alias("action"), F.lit("repo").alias("resource_scope"), F.lit(1).alias("attempt"), F.lit("op").alias("operation_id"), F.lit(10).alias("max_units"), F.col("grant_deadline_unix_ms").alias("max_deadline_unix_ms"))
    objects = w.filter(key % 13 != 0).select(
        *base, (F.col("grant_fence") + F.when(key % 11 == 5, 1).otherwise(0)).alias("claim_fence"), F.when(key % 19 == 0, "read").otherwise("write").alias("action"), F.lit("repo").alias("resource_scope"), F.lit(1).alias("attempt"), F.lit("op").alias("operation_id"),
        (key % 41 == 0).alias("unavailable"), (key % 7 == 2).alias("too_large"), F.encode(key.cast("string"), "UTF-8").alias("content"), (key % 17 != 0).alias("decodes"), F.lit(10).alias("limit_units"), F.col("grant_deadline_unix_ms").alias("deadline_unix_ms"),
    )
    return intake.match_grants(expected, objects).select("scope_id", "work_id", "work_revision", "unavailable", "found", "decodes", "same_identity")


# ---------------------------------------------------------------- projection


@_query("scope_count", "SELECT count(*) AS scopes FROM scopes")
def _(t):
    return lookups.scope_count(t("scopes"))


@_query(
    "scope_rows",
    """SELECT scope_id, s.sequence, tail_event_digest, (SELECT operation_id FROM log AS l WHERE l.scope_id = s.scope_id AND l.sequence = s.sequence) AS operation_id, (SELECT max(writer_epoch) FROM log AS l WHERE l.scope_id = s.scope_id) AS writer_epoch,
      (SELECT plan_digest FROM log AS l WHERE l.scope_id = s.scope_id AND l.payload_type = 'plan_admitted') AS active_plan_digest, campaign_id, objective_digest, CASE WHEN k % 10 <> 9 THEN reserved_budget_units END AS reserved_budget_units, CAST(0 AS BIGINT) AS claims_restored FROM scopes AS s""",
)
def _(t):
    own = t("scopes").select("scope_id", "campaign_id", "objective_digest", "reserved_budget_units")
    return fold.fold_scopes(t("log").join(own, "scope_id"))


@_query(
    "plan_admission",
    """WITH p AS (SELECT scope_id, plan_digest, any_value(k) AS k, count(*) AS n FROM work GROUP BY scope_id, plan_digest), e AS (SELECT w.scope_id, w.plan_digest, count(*) AS edges FROM deps AS d JOIN work AS w ON w.scope_id = d.scope_id AND w.work_id = d.work_id AND w.work_revision = d.work_revision GROUP BY w.scope_id, w.plan_digest)
      SELECT p.scope_id, p.plan_digest, CASE WHEN s.active_plan_digest IS NOT NULL AND s.active_plan_digest <> p.plan_digest AND p.k % 3 = 0 THEN 'plan_held' WHEN p.k % 5 = 1 THEN 'self_edge' WHEN p.k % 5 = 2 THEN 'unknown_dependency' WHEN p.k % 5 = 3 AND coalesce(e.edges, 0) > 0 THEN 'edge_conflict' ELSE 'ok' END AS verdict
      FROM p JOIN scopes AS s ON s.scope_id = p.scope_id LEFT JOIN e ON e.scope_id = p.scope_id AND e.plan_digest = p.plan_digest""",
)
def _(t):
    k, key = F.col("k"), ["scope_id", "work_id", "work_revision"]
    edges = t("deps").groupBy(*key).agg(F.array_sort(F.collect_list("depends_on_work_id")).alias("deps"))
    w = t("work").join(edges, key, "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    wanted = F.when(k % 5 == 1, F.array("work_id")).when(k % 5 == 2, F.array(F.lit("nowhere"))).when(k % 5 == 3, F.array().cast("array<string>")).otherwise(F.concat("deps", "deps"))
    plans = w.groupBy("scope_id", "plan_digest").agg(F.collect_list(F.struct("work_id", wanted.alias("dependencies"))).alias("work_specs")).withColumn("revision", F.lit(1).cast("long"))
    scopes = t("scopes").withColumn("active_plan_digest", F.when(k % 3 == 0, F.col("active_plan_digest")))
    return fold.admission_verdicts(plans, t("work"), t("deps"), scopes)


@_query(
    "ready_scopes",
    """SELECT h.scope_id, h.sequence = s.sequence AND s.k % 7 <> 3 AND h.tail_event_digest = s.tail_event_digest AND h.campaign_id = s.campaign_id AND h.active_plan_digest IS NOT DISTINCT FROM s.active_plan_digest AND s.scope_epoch <= h.scope_epoch
      AND h.operation_id = (SELECT operation_id FROM log AS l WHERE l.scope_id = s.scope_id AND l.sequence = s.sequence) AS ready FROM heads AS h JOIN scopes AS s ON s.scope_id = h.scope_id""",
)
def _(t):
    cursors = fold.fold_cursors(t("log")).withColumnRenamed("tail_event_digest", "digest").join(t("scopes").select("scope_id", "k"), "scope_id").withColumn("digest", F.when(F.col("k") % 7 == 3, _other()).otherwise(F.col("digest")))
    return incremental.ready_scopes(cursors, t("heads"), t("scopes"), t("log"))


@_query(
    "projection_class",
    """SELECT s.scope_id, CASE WHEN k % 9 = 0 THEN 'missing' WHEN k % 9 = 1 THEN 'foreign' WHEN k % 9 = 2 OR EXISTS (SELECT 1 FROM log AS l WHERE l.scope_id = s.scope_id AND l.sequence % 61 = 0) THEN 'rebuildable' ELSE 'valid' END AS state FROM scopes AS s""",
)
def _(t):
    k = F.col("k")
    broken = t("log").withColumn("parent_digest", F.when(F.col("sequence") % 61 == 0, _other()).otherwise(F.col("parent_digest")))
    faults = audit.broken_parents(broken).groupBy("scope_id").agg(F.count("*").alias("violations"))
    p = t("scopes").join(faults, "scope_id", "left").select("scope_id", (k % 9 != 0).alias("present"), F.when(k % 9 == 1, "other").otherwise("projection").alias("application"), (k % 9 != 2).alias("schema_ok"), "violations")
    return audit.classify_projections(p)


@_query(
    "artifact_publish",
    """SELECT concat('a/', key) AS key, CASE WHEN key % 11 = 3 THEN 'too_large' WHEN key % 7 = 1 THEN 'unverified' WHEN key % 5 = 0 THEN 'already_same' WHEN key % 5 = 1 THEN 'conflict' ELSE 'created' END AS verdict,
      CASE WHEN key % 7 <> 1 AND key % 11 <> 3 THEN strlen(concat('body ', key)) END AS witness_size FROM work""",
)
def _(t):
    key = F.col("key")
    body = F.encode(F.concat(F.lit("body "), key.cast("string"), F.when(key % 11 == 3, F.repeat(F.lit("x"), 100)).otherwise("")), "UTF-8")
    a = t("work").select(F.concat(F.lit("a/"), key.cast("string")).alias("key"), F.octet_length(body).alias("size"), F.when(key % 7 == 1, _other()).otherwise(F.sha2(body, 256)).alias("digest"), body.alias("content"), key.alias("n"))
    held = a.filter("n % 5 < 2").select("key", F.when(F.col("n") % 5 == 1, _other()).otherwise(F.col("digest")).alias("digest"))
    return publish.publish_artifacts(held, a.drop("n"), 50).select("key", "verdict", "witness_size")


@_query(
    "checkpoint_install",
    """WITH c AS (SELECT scope_id, k, sequence, row_number() OVER (PARTITION BY scope_id ORDER BY sequence DESC) AS nth FROM log WHERE payload_type = 'projection_checkpoint_published'),
      g AS (SELECT scope_id, max(sequence - 1) AS covered FROM c WHERE nth <= 4 AND sequence % 3 <> 0 AND sequence % 4 <> 1 GROUP BY scope_id)
      SELECT s.scope_id, covered AS covered_sequence, s.sequence - coalesce(covered, 0) AS suffix FROM scopes AS s LEFT JOIN g ON g.scope_id = s.scope_id""",
)
def _(t):
    s = F.col("sequence")
    body = F.encode(F.concat_ws("|", "scope_id", "sequence"), "UTF-8")
    e = t("log").filter("payload_type = 'projection_checkpoint_published'")
    c = e.select("scope_id", "sequence", F.when(s % 3 == 0, _other()).otherwise(F.col("digest")).alias("digest"), (s - 1).alias("covered_sequence"), F.sha2(body, 256).alias("snapshot_digest"), F.octet_length(body).cast("long").alias("snapshot_length"))
    kept = e.select("scope_id", F.sha2(body, 256).alias("address"), F.when(s % 4 == 1, F.concat(body, F.lit(b"!"))).otherwise(body).alias("content"))
    return publish.install_checkpoints(c, t("scopes"), t("log"), kept)


@_query(
    "catalog_records",
    """SELECT p.scope_id, n AS packs, first, last, coalesce(c, 0) AS checkpoints FROM (SELECT scope_id, count(*) AS n, min(first_sequence) AS first, max(last_sequence) AS last FROM packs GROUP BY scope_id) AS p
      LEFT JOIN (SELECT scope_id, count(*) AS c FROM log WHERE payload_type = 'projection_checkpoint_published' GROUP BY scope_id) AS q ON q.scope_id = p.scope_id""",
)
def _(t):
    packs = t("packs").select("scope_id", F.col("first_sequence").alias("start"), F.col("last_sequence").alias("end"), _other().alias("pack_digest"))
    points = t("log").filter("payload_type = 'projection_checkpoint_published'").select("scope_id", "sequence", "digest").join(packs.select("scope_id").distinct(), "scope_id", "left_semi")
    made = records.encode_records(publish.catalog_records(packs, points), "catalog", "record")
    got = records.decode_records(made.select("scope_id", "content"), "catalog", scope=F.col("scope_id")).filter("status = 'ok'")
    p = F.col("record.packs")
    return got.select("scope_id", F.size(p).cast("long").alias("packs"), F.element_at(p, 1)["start"].alias("first"), F.element_at(p, -1)["end"].alias("last"), F.size("record.checkpoints").cast("long").alias("checkpoints"))


@_query(
    "run_schedule",
    """SELECT campaign, run_no, CASE WHEN run_no > 30 THEN 'beyond' WHEN pilot = CASE WHEN run_no <= 15 THEN 'research' ELSE 'change' END AND cell = substring('CABACBBACCABBCACABCABABCCABABC', run_no, 1) THEN 'scheduled' ELSE 'misplaced' END AS verdict
      FROM (SELECT campaign, run_seq % 30 + 1 + CASE WHEN run_seq % 90 = 89 THEN 1 ELSE 0 END AS run_no, CASE WHEN run_seq % 30 < 15 THEN 'research' ELSE 'change' END AS pilot, cell FROM runs) AS r""",
)
def _(t):
    s = F.col("run_seq")
    return measure.schedule_verdicts(t("runs").select("campaign", (s % 30 + 1 + F.when(s % 90 == 89, 1).otherwise(0)).alias("run_no"), F.when(s % 30 < 15, "research").otherwise("change").alias("pilot"), "cell"))


@_query("work_in_order", "SELECT scope_id, work_id, work_revision, plan_digest FROM work ORDER BY scope_id, work_id, work_revision")
def _(t):
    return scheduling.in_order(t("work").select("scope_id", "work_id", "work_revision", "plan_digest"))
