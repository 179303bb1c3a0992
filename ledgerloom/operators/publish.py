"""Publication: validated appends of whole batches, certificates and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom import model as M
from ledgerloom.sources import sinks

from . import verify

# Payload types that a batch may not hold; each has a publication of its own.
SINGLE = ("grant_activated", "artifact_reference", "projection_checkpoint_published")


def append_batches(log: DataFrame, heads: DataFrame, batch: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log and the heads after all acceptable batches, and a verdict per scope: appended, refused_member, refused_chain or refused_plan.

    A scope's batch is proven whole before anything of it is written: members of an unregistered type or of one
    that has a publication of its own, one broken link, or an admission whose plan isn't among the readable
    ``plans`` (scope_id, plan_digest) of that scope refuse all of it.  ``batch`` has the columns of ``log``.
    An operation id or digest that the log holds anywhere refuses too; that is stricter than comparing with the
    head's operation alone, and spares replays a repeated operation that they would refuse.
    """
    chain = verify.batch_verdicts(batch, heads)
    wrong = ~F.col("payload_type").isin(*M.PAYLOAD_TYPES) | F.col("payload_type").isin(*SINGLE)
    members = batch.groupBy("scope_id").agg(F.bool_or(F.coalesce(wrong, F.lit(True))).alias("wrong_member"))
    held = lambda c: batch.join(log.select("scope_id", c), ["scope_id", c], "left_semi").select("scope_id")
    seen = held("digest").union(held("operation_id")).distinct().withColumn("seen", F.lit(True))
    admitting = batch.filter("payload_type = 'plan_admitted'").select("scope_id", "plan_digest")
    unread = admitting.join(plans.select("scope_id", "plan_digest"), ["scope_id", "plan_digest"], "left_anti").select("scope_id").distinct().withColumn("unread", F.lit(True))
    j = chain.join(members, "scope_id").join(seen, "scope_id", "left").join(unread, "scope_id", "left")
    verdict = F.when(F.col("wrong_member"), "refused_member").when(~F.col("accepted") | F.col("seen").isNotNull(), "refused_chain").when(F.col("unread").isNotNull(), "refused_plan").otherwise("appended")
    verdicts = j.select("scope_id", verdict.alias("verdict"), "events")
    new = batch.join(verdicts.filter("verdict = 'appended'").select("scope_id"), "scope_id", "left_semi")
    tip = new.groupBy("scope_id").agg(F.max_by(F.struct("sequence", "digest", "operation_id"), "sequence").alias("tip"), F.max(F.when(F.col("payload_type") == "plan_admitted", F.col("plan_digest"))).alias("new_plan"))
    moved = heads.join(tip, "scope_id", "left").withColumns(
        {"sequence": F.coalesce("tip.sequence", "sequence"), "tail_event_digest": F.coalesce("tip.digest", "tail_event_digest"), "operation_id": F.coalesce("tip.operation_id", "operation_id"), "active_plan_digest": F.coalesce("new_plan", "active_plan_digest")}
    )
    return log.unionByName(new.select(*log.columns)), moved.select(*heads.columns), verdicts


def publication_gate(events: DataFrame, decoded: DataFrame) -> DataFrame:
    """Whether each event may be published: its type is registered and its stored bytes decode to the same reference and type.

    ``events`` has scope_id, sequence, digest and payload_type, ``decoded`` the rows of ``decode_log``.
    """
    d = decoded.filter("status = 'ok'").select("scope_id", "sequence", "digest", F.col("payload_type").alias("stored_type"))
    j = events.join(d, ["scope_id", "sequence", "digest"], "left")
    verdict = F.when(~F.col("payload_type").isin(*M.PAYLOAD_TYPES), "unregistered").when(F.col("stored_type").isNull(), "undecodable").when(F.col("stored_type") != F.col("payload_type"), "type_mismatch").otherwise("publishable")
    return j.select("scope_id", "sequence", verdict.alias("verdict"))


def certified(certificates: DataFrame, log: DataFrame) -> DataFrame:
    """Checkpoint certificates (scope_id, sequence, digest, covered_sequence) and whether the log commits them: that very event, right behind what it covers."""
    e = log.filter("payload_type = 'projection_checkpoint_published'").select("scope_id", "sequence", "digest").withColumn("there", F.lit(True))
    j = certificates.join(e, ["scope_id", "sequence", "digest"], "left")
    verdict = F.when(F.col("there").isNull(), "uncommitted").when(F.col("sequence") != F.col("covered_sequence") + 1, "misplaced").otherwise("certified")
    return j.select("scope_id", "sequence", verdict.alias("verdict"))


def tally_differences(tallies: DataFrame, inventory: DataFrame) -> DataFrame:
    """Paths whose independent tally (path, targets) differs from the number of inventory rows, absent ones as 0."""
    i = inventory.groupBy("path").agg(F.count("*").alias("listed"))
    j = tallies.select("path", F.col("targets").alias("tallied")).join(i, "path", "full_outer").na.fill(0, ["tallied", "listed"])
    return j.filter("tallied <> listed")


def publish_artifacts(existing: DataFrame, artifacts: DataFrame, cap: int = 10 << 20) -> DataFrame:
    """Verdict and witness of each artifact (key, size, digest, content): too_large, unverified, created, already_same or conflict.

    The witness is the size and digest that were read back from the bytes; ``existing`` has key and digest.
    """
    own = artifacts.withColumns({"own_size": F.octet_length("content").cast("long"), "own_digest": F.sha2("content", 256)})
    sound = F.coalesce((F.col("own_size") == F.col("size")) & (F.col("own_digest") == F.col("digest")), F.lit(False))
    fit = own.filter((F.col("own_size") <= cap) & sound)
    _, written = sinks.create_only(existing, fit.select("key", "digest"))
    refused = own.filter(~((F.col("own_size") <= cap) & sound) | F.col("own_size").isNull())
    verdicts = refused.select("key", "digest", F.when(F.col("own_size") > cap, "too_large").otherwise("unverified").alias("verdict"), F.lit(None).cast("long").alias("witness_size"))
    sizes = fit.select("key", "digest", F.col("own_size").alias("witness_size")).distinct()
    return verdicts.unionByName(written.join(sizes, ["key", "digest"]))


def install_checkpoints(candidates: DataFrame, heads: DataFrame, log: DataFrame, snapshots: DataFrame, limit: int = M.CHECKPOINT_CANDIDATES) -> DataFrame:
    """The checkpoint that each scope installs: of its newest ``limit`` candidates at or below the head the newest that the log commits and whose snapshot has the certified length and digest.

    ``candidates`` has scope_id, sequence, digest, covered_sequence, snapshot_digest and snapshot_length; ``snapshots``
    scope_id, address and content.  A scope without a usable one has nulls and starts from its whole log.
    """
    near = candidates.join(heads.select("scope_id", F.col("sequence").alias("tail")), "scope_id").filter(F.col("sequence") <= F.col("tail"))
    tried = near.withColumn("nth", F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("sequence")))).filter(F.col("nth") <= limit)
    proven = certified(tried, log).filter("verdict = 'certified'").select("scope_id", "sequence").distinct()
    held = snapshots.select("scope_id", F.col("address").alias("snapshot_digest"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("own"))
    good = tried.join(proven, ["scope_id", "sequence"], "left_semi").join(held, ["scope_id", "snapshot_digest"]).filter((F.col("length") == F.col("snapshot_length")) & (F.col("own") == F.col("snapshot_digest")))
    best = good.groupBy("scope_id").agg(F.max("covered_sequence").alias("covered_sequence"))
    return heads.select("scope_id", "sequence").join(best, "scope_id", "left").select("scope_id", "covered_sequence", (F.col("sequence") - F.coalesce("covered_sequence", F.lit(0))).alias("suffix"))


def catalog_records(packs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Catalogue records of each scope, in the order that readers ask for: packs (scope_id, start, end, pack_digest) by start, checkpoints (scope_id, sequence, digest) by sequence."""
    listed = lambda df, cols, name: df.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    j = listed(packs, ("start", "end", "pack_digest"), "packs").join(listed(checkpoints, ("sequence", "digest"), "checkpoints"), "scope_id", "full_outer")
    filled = j.withColumns({"packs": F.coalesce("packs", F.array().cast("array<struct<start:bigint,end:bigint,pack_digest:string>>")), "checkpoints": F.coalesce("checkpoints", F.array().cast("array<struct<sequence:bigint,digest:string>>"))})
    return filled.select("scope_id", F.struct(F.lit(1).cast("long").alias("version"), "scope_id", "packs", "checkpoints").alias("record"))
