"""Sinks: create-only and compare-and-swap writes as verdicts, digest-keyed appends, snapshots and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def create_only(existing: DataFrame, new: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows that may be written (the first of each new key, by digest) and verdicts: created, already_same or conflict."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("digest"))
    lead = F.first("digest").over(Window.partitionBy(key).orderBy("digest"))
    old = existing.select(key, F.col("digest").alias("held"))
    j = new.withColumns({"__nth": first, "__lead": lead}).join(old, key, "left")
    verdict = F.when(F.col("held").isNull(), F.when(F.col("__nth") == 1, "created").when(F.col("digest") == F.col("__lead"), "already_same").otherwise("conflict")).when(F.col("held") == F.col("digest"), "already_same").otherwise("conflict")
    j = j.withColumn("verdict", verdict)
    return j.filter("verdict = 'created'").select(*new.columns), j.select(key, "digest", "verdict")


def compare_and_swap(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """Verdict of each attempt (key, observed, arrival, proposed) on a register (key, tag): of those that observed the current tag the first to arrive commits, the rest fail their precondition."""
    j = attempts.join(current.select("key", "tag"), "key", "left")
    fresh = F.coalesce(F.col("observed") == F.col("tag"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("key", fresh).orderBy("arrival"))
    return j.withColumn("verdict", F.when(F.col("tag").isNull(), "not_found").when(fresh & (rank == 1), "committed").otherwise("precondition_failed")).select("key", "arrival", "proposed", "verdict")


def apply_swaps(current: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The register after its committed swaps."""
    won = verdicts.filter("verdict = 'committed'").select("key", "proposed")
    return current.join(won, "key", "left").select("key", F.coalesce("proposed", "tag").alias("tag"))


def sound(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Blobs whose declared size and digest are those of their bytes."""
    return blobs.filter((F.octet_length(content) == F.col("size")) & (F.sha2(content, 256) == F.col("digest")))


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A relation written once: an existing one is never overwritten."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition) if partition else w).parquet(path)


def report(df: DataFrame, path: str) -> None:
    """CSV with a header, for tables of measures."""
    df.write.mode("errorifexists").option("header", "true").csv(path)


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A table of measures as Markdown; reports are small, and ``limit`` holds them so."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
