"""Claims, submissions and grants out of their JSON, by variants: closed shapes, canonical form, values, and the binding to key and scope.

A document keeps its row whatever becomes of it; ``status`` is the first rule it breaks:
absent, limit_exceeded (empty or over the cap), malformed (no JSON of the shape: other or missing fields, other
types), not_canonical (encoding it again gives other bytes), unbound (another record, campaign, scope or work
than expected), invalid_value, reference_mismatch (stored under another key), or ok.  ``record`` is null but for ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import model as M

# Names of the records, and their fields in the order in which they are stored.
CLAIM, SUBMISSION, GRANT = "scope_claim", "sealed_submission", "effect_grant"
IDENTITY = {"record": "STRING", "campaign_id": "STRING", "scope_id": "STRING", "plan_digest": "STRING", "work_id": "STRING", "work_revision": "BIGINT", "claim_fence": "BIGINT"}
OWNED = IDENTITY | {"owner_actor": "STRING", "owner_instance": "STRING", "operation_id": "STRING"}
EVIDENCE = {"digest": "STRING", "size": "BIGINT", "media_type": "STRING", "producer_attempt": "STRING", "creation_time_unix_ms": "BIGINT", "retention_class": "STRING"}
GRANTED = IDENTITY | {"action": "STRING", "resource_scope": "STRING", "attempt": "BIGINT", "limit_units": "BIGINT", "deadline_unix_ms": "BIGINT", "operation_id": "STRING"}
ACTIVE = {"state": "STRING", "lease_until": "BIGINT"}


def _shape(fields: dict) -> str:
    """What schema_of_variant says of an object with just these fields."""
    inner = ", ".join(f"{n}: {_shape(t) if isinstance(t, dict) else t}" for n, t in sorted(fields.items()))
    return f"OBJECT<{inner}>"


def _fields(v: Column, fields: dict, at: str = "$") -> list[Column]:
    """The fields as columns in their stored order; nested ones as structs."""
    return [F.struct(*_fields(v, t, f"{at}.{n}")).alias(n) if isinstance(t, dict) else F.try_variant_get(v, f"{at}.{n}", "long" if t == "BIGINT" else "string").alias(n) for n, t in fields.items()]


def _unsigned(record: Column, fields: dict) -> Column:
    """No number below zero."""
    ok = F.lit(True)
    for n, t in fields.items():
        if isinstance(t, dict):
            ok = ok & _unsigned(record[n], t)
        elif t == "BIGINT":
            ok = ok & (record[n] >= 0)
    return ok


def _text(c: Column) -> Column:
    """1 to 128 bytes; unlike a part of a key it may hold slashes."""
    return F.octet_length(c).between(1, 128)


def _all(*rules: Column) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & r
    return F.coalesce(out, F.lit(False))


def _decoded(objects: DataFrame, variants: dict[str, tuple[dict, list[dict]]], content_col: str, cap: int) -> DataFrame:
    """Adds ``_v`` (the variant), ``_state`` (the name of the variant it has, if any) and, for each of ``variants``, its fields; each has a shape that is stored and shapes that are read."""
    raw = F.col(content_col)
    out = objects.withColumn("_v", F.try_parse_json(raw)).withColumn("_kind", F.schema_of_variant("_v"))
    state = F.lit(None).cast("string")
    for name, (fields, shapes) in variants.items():
        out = out.withColumn(f"_{name}", F.struct(*_fields(F.col("_v"), fields)))
        tag = F.col(f"_{name}.state.state") == name if "state" in fields else F.lit(True)
        fits = F.col("_kind").isin(*map(_shape, shapes)) & tag & _unsigned(F.col(f"_{name}"), fields)
        same = F.to_json(F.col(f"_{name}"), {"ignoreNullFields": "false"}) == raw
        state = F.when(F.coalesce(fits, F.lit(False)), F.when(same, name).otherwise("not_canonical")).otherwise(state)
    early = F.when(raw.isNull(), "absent").when(~F.octet_length(raw).between(1, cap), "limit_exceeded").when(state.isNull(), "malformed").when(state == "not_canonical", "not_canonical")
    return out.withColumn("_early", early).withColumn("_state", state)


def _claims(objects: DataFrame, record: str, key: Column | None, content_col: str) -> DataFrame:
    kept = EVIDENCE | {"retention_class": "VOID"}
    sealed = lambda evidence: OWNED | {"state": {"state": "STRING", "submission": evidence}}
    variants = {"active": (OWNED | {"state": ACTIVE}, [OWNED | {"state": ACTIVE}]), "sealed": (sealed(EVIDENCE), [sealed(EVIDENCE), sealed(kept)])}
    d = _decoded(objects, variants, content_col, M.OBJECT_BYTES)
    sealed_now = F.col("_state") == "sealed"
    at = lambda n: F.when(sealed_now, F.col(f"_sealed.{n}")).otherwise(F.col(f"_active.{n}"))
    lease, e = F.col("_active.state.lease_until"), F.col("_sealed.state.submission")
    bound = _all(at("record") == record, *(at(n) == F.col(n) for n in ("campaign_id", "scope_id", "work_id", "work_revision")))
    named = _all(M.is_digest(at("plan_digest")), M.is_stored(at("claim_fence")))
    evidence = _all(M.is_digest(e["digest"]), _text(e["media_type"]), _text(e["producer_attempt"]), F.coalesce(_text(e["retention_class"]), F.lit(True)))
    state = F.when(sealed_now, evidence).otherwise(F.lit(record == CLAIM) & (lease >= 1))  # a submission is always sealed
    values = _all(state, *(M.is_identity(at(n)) for n in ("owner_actor", "owner_instance", "operation_id")))
    placed = F.lit(True) if key is None else F.col("key") == key
    status = F.coalesce(F.col("_early"), F.when(~bound, "unbound").when(~named, "invalid_value").when(~F.coalesce(placed, F.lit(False)), "reference_mismatch").when(~values, "invalid_value").otherwise("ok"))
    fields = [at(n).alias(n) for n in OWNED] + [F.col("_state").alias("state"), F.when(~sealed_now, lease).alias("lease_until"), F.when(sealed_now, e).alias("submission")]
    return _finish(d, objects.columns, status, F.struct(*fields))


def _finish(d: DataFrame, columns: list[str], status: Column, record: Column) -> DataFrame:
    """``columns`` with status and record.  They come out of a generator, through which later filters on them aren't pushed: there each would be replaced by all that it is made of, many times over."""
    one = d.withColumn("_status", status).select(*columns, F.explode(F.array(F.struct(F.col("_status").alias("status"), record.alias("record")))).alias("_z"))
    return one.select(*columns, F.col("_z.status").alias("status"), F.when(F.col("_z.status") == "ok", F.col("_z.record")).alias("record"))


def _prefix() -> list[Column]:
    return [F.lit("workspace/"), F.col("workspace_id"), F.lit("/campaigns/"), F.col("campaign_id"), F.lit("/scopes/"), F.col("scope_id")]


def decode_claims(objects: DataFrame, content_col: str = "content") -> DataFrame:
    """Claim objects: ``objects`` has content and key, and what is expected there: workspace_id, campaign_id, scope_id, work_id and work_revision."""
    return _claims(objects, CLAIM, F.concat(*_prefix(), F.lit("/claims/"), "work_id", F.lit("/"), F.col("work_revision").cast("string")), content_col)


def decode_submissions(objects: DataFrame, content_col: str = "content") -> DataFrame:
    """Submission records, which are addressed by their digest: content, and the expected campaign_id, scope_id, work_id and work_revision; an active claim is an invalid_value."""
    return _claims(objects, SUBMISSION, None, content_col)


def decode_grants(objects: DataFrame, content_col: str = "content") -> DataFrame:
    """Grant objects, whose key holds the fence they state; columns as for claims."""
    d = _decoded(objects, {"grant": (GRANTED, [GRANTED])}, content_col, M.OBJECT_BYTES)
    g = F.col("_grant")
    bound = _all(g["record"] == GRANT, *(g[n] == F.col(n) for n in ("campaign_id", "scope_id", "work_id", "work_revision")))
    named = _all(M.is_digest(g["plan_digest"]), M.is_stored(g["claim_fence"]))
    key = F.concat(*_prefix(), F.lit("/grants/"), "work_id", F.lit("/"), F.col("work_revision").cast("string"), F.lit("/"), g["claim_fence"].cast("string"))
    values = _all(*(M.is_identity(g[n]) for n in ("action", "resource_scope", "operation_id")), *(M.is_stored(g[n]) for n in ("attempt", "limit_units", "deadline_unix_ms")))
    late = F.when(~bound, "unbound").when(~named, "invalid_value").when(~F.coalesce(F.col("key") == key, F.lit(False)), "reference_mismatch").when(~values, "invalid_value").otherwise("ok")
    return _finish(d, objects.columns, F.coalesce(F.col("_early"), late), g)
