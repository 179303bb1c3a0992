"""Relation schemas, registered values and bounds of the coordination data model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Registered event payload types.
PAYLOAD_TYPES = ("root_genesis", "plan_admitted", "grant_activated", "artifact_reference", "projection_checkpoint_published")
# Artifact kinds.
ARTIFACT_KINDS = ("invocation_manifest", "invocation_trace")

# Bounds.
MAX_INTEGER = 9_999_999_999_999_999
MAX_EVENTS = 4_096
MAX_REPLAY_BYTES = 64 * 1024 * 1024
PLAN_BYTES = 1024 * 1024
PACK_EVENTS = 256
PACK_BYTES = 8 * 1024 * 1024
CHECKPOINT_CANDIDATES = 4
STOP_MARGIN_MS = 5_000
RENEW_BEFORE_MS = 20_000
LEASE_MS = 30_000
OBJECT_BYTES = 4_096
GROUP_TARGETS = 8


def _struct(text: str) -> StructType:
    kinds = {"s": StringType(), "l": LongType()}
    out = []
    for word in text.split():
        name, kind = word.split(":")
        out.append(StructField(name, kinds[kind[0]], kind.endswith("?")))
    return StructType(out)


SCOPES = _struct("scope_id:s campaign_id:s parent_scope_id:s? delegation_digest:s? sequence:l tail_event_digest:s active_plan_digest:s? scope_epoch:l objective_digest:s reserved_budget_units:l? claims_restored:l")
EVENTS = _struct("scope_id:s sequence:l digest:s parent_digest:s? operation_id:s writer_epoch:l payload_type:s grant_digest:s? work_id:s? work_revision:l? attempt:l? artifact_kind:s? artifact_digest:s?")
WORK = _struct(
    "scope_id:s work_id:s work_revision:l plan_digest:s admitted_scope_epoch:l max_attempts:l deadline_unix_ms:l claim_fence:l? claim_lease_until:l? grant_fence:l? grant_digest:s? granted_attempt:l? granted_units:l? grant_deadline_unix_ms:l? terminal_result_digest:s?"
)
DEPENDENCIES = _struct("scope_id:s work_id:s work_revision:l depends_on_work_id:s depends_on_work_revision:l")
HEAD = _struct("campaign_id:s scope_id:s controller_instance_id:s? scope_epoch:l lease_until:l? sequence:l tail_event_digest:s active_plan_digest:s? operation_id:s")
GRANT = _struct("record:s campaign_id:s scope_id:s plan_digest:s work_id:s work_revision:l claim_fence:l action:s resource_scope:s attempt:l limit_units:l deadline_unix_ms:l operation_id:s")
TARGET = _struct("source_revision:s rule_digest:s target_id:s path:s semantic_locator:s context_digest:s")
EVIDENCE = _struct("digest:s size:l media_type:s producer_attempt:l creation_time_unix_ms:l retention_class:s?")
CLAIM = StructType(
    [*_struct("record:s campaign_id:s scope_id:s plan_digest:s work_id:s work_revision:l claim_fence:l owner_actor:s owner_instance:s operation_id:s").fields, StructField("state", StructType([StructField("state", StringType()), StructField("lease_until", LongType()), StructField("submission", EVIDENCE)]))]
)
SPEC = StructType([StructField("work_id", StringType()), StructField("dependencies", ArrayType(StringType())), StructField("bounds", _struct("max_attempts:l deadline_unix_ms:l"))])


def is_digest(c: Column) -> Column:
    """64 lower-case hexadecimal characters."""
    return F.rlike(c, F.lit("^[0-9a-f]{64}$"))


def is_identity(c: Column) -> Column:
    """1 to 128 bytes without a slash."""
    return F.octet_length(c).between(1, 128) & (F.instr(c, F.lit("/")) == 0)


def is_stored(c: Column, least: int = 1) -> Column:
    """An integer that the store can hold."""
    return c.between(least, MAX_INTEGER)
