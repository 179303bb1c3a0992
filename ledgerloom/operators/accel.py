"""Packs, coverage and gaps over sequence ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import model as M


#: Sequences of one bin of interval joins; a pack of PACK_EVENTS events lies in two bins at most.
BIN = M.PACK_EVENTS


def _bins(first: Column, last: Column, width: int) -> Column:
    """Bins that a range touches; a range that ends before it begins lies in the bin of its beginning."""
    at = lambda c: F.floor(c / width)
    return F.sequence(at(first), at(F.greatest(first, last)))


def overlaps(requests: DataFrame, packs: DataFrame, how: str = "inner", width: int = BIN) -> DataFrame:
    """Requests (scope_id, first, last) with the packs (scope_id, start, end, ...) that overlap them, each pair once.

    Both sides are cut into bins of ``width`` sequences and meet on (scope, bin), so that a scope with very
    many packs spreads over its bins and a request meets the packs of its own bins alone; a pair that shares
    several bins counts in the first of them.  With ``how`` left, bins without a pack keep a row of nulls.
    """
    q = requests.withColumn("bin", F.explode(_bins(F.col("first"), F.col("last"), width)))
    p = packs.withColumnRenamed("scope_id", "pack_scope").withColumn("pack_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    once = F.col("bin") == F.greatest(F.floor(F.col("first") / width), F.floor(F.col("start") / width))
    on = (F.col("scope_id") == F.col("pack_scope")) & (F.col("bin") == F.col("pack_bin")) & (F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first")) & once
    return q.join(p, on, how).drop("bin", "pack_scope", "pack_bin")


def coverage(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """Whether packs cover each range [first, last] of a scope without a gap, and how many they take: overlap join, then neighbours have to touch."""
    p = packs.select("scope_id", F.col("first_sequence").alias("start"), F.col("last_sequence").alias("end"))
    j = overlaps(requests, p, "left")
    w = Window.partitionBy("scope_id", "first", "last").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start") > F.coalesce(F.max("end").over(w), F.col("first") - 1) + 1
    a = j.withColumn("gap", gap).groupBy("scope_id", "first", "last").agg(F.bool_or("gap").alias("gap"), F.max("end").alias("reach"), F.count("start").alias("packs"))
    covered = F.coalesce(~F.col("gap") & (F.col("reach") >= F.col("last")), F.lit(False))
    return a.select("scope_id", "first", "last", covered.alias("covered"), F.when(covered, F.col("packs")).otherwise(0).cast("long").alias("packs"))


def gaps(scopes: DataFrame, packs: DataFrame) -> DataFrame:
    """Ranges of each scope's sequences that no pack holds."""
    p = packs.select("scope_id", F.col("first_sequence").alias("start"), F.col("last_sequence").alias("end"))
    ends = scopes.select("scope_id", (F.col("sequence") + 1).alias("start"), F.lit(None).cast("long").alias("end"))
    w = Window.partitionBy("scope_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    r = p.unionByName(ends).withColumn("reach", F.coalesce(F.max("end").over(w), F.lit(0).cast("long")))
    return r.filter("start > reach + 1").select("scope_id", (F.col("reach") + 1).alias("first_sequence"), (F.col("start") - 1).alias("last_sequence"))


def segments(log: DataFrame, events: int = M.PACK_EVENTS) -> DataFrame:
    """Packs of at most ``events`` events: a pack closes by count alone."""
    w = Window.partitionBy("scope_id").orderBy("sequence")
    g = log.select("scope_id", "sequence", "stored_bytes", F.floor((F.row_number().over(w) - 1) / events).cast("long").alias("pack"))
    return g.groupBy("scope_id", "pack").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("events"), F.sum("stored_bytes").alias("bytes"))


def segments_by_bytes(log: DataFrame, events: int = M.PACK_EVENTS, size: int = M.PACK_BYTES) -> DataFrame:
    """Packs that close at ``events`` events or before exceeding ``size`` bytes.

    Where a pack starts depends on the one before, so a scope's events (at most MAX_EVENTS) are folded
    as one ordered array; scopes spread over tasks.
    """
    queue = log.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "stored_bytes"))).alias("queue"))

    def step(s, x):
        close = (s["n"] > 0) & ((s["n"] == events) | (s["total"] + x["stored_bytes"] > size))
        pack = s["pack"] + close.cast("long")
        return F.struct(
            pack.alias("pack"), (F.when(close, 0).otherwise(s["n"]) + 1).cast("long").alias("n"), (F.when(close, 0).otherwise(s["total"]) + x["stored_bytes"]).cast("long").alias("total"), F.concat(s["packs"], F.array(pack)).alias("packs")
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("pack"), zero.alias("n"), zero.alias("total"), F.array().cast("array<bigint>").alias("packs"))
    each = queue.select("scope_id", F.explode(F.arrays_zip(F.col("queue").alias("q"), F.aggregate("queue", start, step, lambda s: s["packs"]).alias("p"))).alias("z"))
    return each.groupBy("scope_id", F.col("z.p").alias("pack")).agg(F.min("z.q.sequence").alias("first_sequence"), F.max("z.q.sequence").alias("last_sequence"), F.count("*").alias("events"), F.sum("z.q.stored_bytes").alias("bytes"))


def build_packs(log: DataFrame, payload_col: str) -> DataFrame:
    """Pack rows with the concatenated payloads, their offsets and the section's digest."""
    w = Window.partitionBy("scope_id").orderBy("sequence")
    g = log.withColumn("pack", F.floor((F.row_number().over(w) - 1) / M.PACK_EVENTS))
    item = F.struct("sequence", "digest", F.col(payload_col).alias("payload"))
    items = g.groupBy("scope_id", "pack").agg(F.array_sort(F.collect_list(item)).alias("items"))  # a pack holds at most PACK_EVENTS
    payloads = F.transform("items", lambda x: x["payload"])
    section = F.aggregate(payloads, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    sizes = F.transform(payloads, lambda x: F.octet_length(x).cast("long"))
    offsets = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return items.select(
        "scope_id", F.element_at("items", 1)["sequence"].alias("first_sequence"), F.element_at("items", -1)["sequence"].alias("last_sequence"), F.transform("items", lambda x: x["digest"]).alias("digests"), offsets.alias("offsets"), section.alias("events"), F.sha2(section, 256).alias("events_digest")
    )


def read_packs(packs: DataFrame) -> DataFrame:
    """The events of sound packs: section digest right, offsets rising and complete, each slice hashing to its digest."""
    sound = (F.sha2("events", 256) == F.col("events_digest")) & (F.element_at("offsets", -1) == F.octet_length("events")) & F.forall(
        F.zip_with(F.slice("offsets", 1, F.size("offsets") - 1), F.slice("offsets", 2, F.size("offsets") - 1), lambda a, b: a < b), lambda x: x
    )
    each = packs.filter(sound).select("scope_id", "first_sequence", "offsets", "events", F.posexplode("digests").alias("i", "digest"))
    start = F.get("offsets", F.col("i"))
    payload = F.substring(F.col("events"), start.cast("int") + 1, (F.get("offsets", F.col("i") + 1) - start).cast("int"))
    return each.select("scope_id", (F.col("first_sequence") + F.col("i")).alias("sequence"), "digest", payload.alias("payload")).filter(F.sha2("payload", 256) == F.col("digest"))


def pack_status(packs: DataFrame) -> DataFrame:
    """What reading each pack comes to: bad_section, bad_offsets, bad_slice, or ok.  Unsound packs give no events but keep their row."""
    rising = F.forall(F.zip_with(F.slice("offsets", 1, F.size("offsets") - 1), F.slice("offsets", 2, F.size("offsets") - 1), lambda a, b: a < b), lambda x: x)
    framed = (F.size("offsets") == F.size("digests") + 1) & (F.element_at("offsets", 1) == 0) & (F.element_at("offsets", -1) == F.octet_length("events")) & rising
    place = F.transform("digests", lambda d, i: F.sha2(F.substring(F.col("events"), F.get("offsets", i).cast("int") + 1, (F.get("offsets", i + 1) - F.get("offsets", i)).cast("int")), 256) == d)
    status = F.when(F.sha2("events", 256) != F.col("events_digest"), "bad_section").when(~F.coalesce(framed, F.lit(False)), "bad_offsets").when(~F.forall(place, lambda x: x), "bad_slice").otherwise("ok")
    return packs.select("scope_id", "first_sequence", "last_sequence", status.alias("status"))


def current_catalogs(pointers: DataFrame, catalogs: DataFrame) -> DataFrame:
    """State of each scope's current catalogue: absent (no pointer), unusable (pointer or catalogue refused, or no such catalogue), or present.

    Both are decoded records (status and record) of a scope_id; catalogues are found by ``digest``.
    """
    c = catalogs.select("scope_id", F.col("digest").alias("named"), F.col("status").alias("catalog_status"), F.col("record").alias("catalog"))
    j = pointers.withColumn("named", F.col("record.catalog_digest")).join(c, ["scope_id", "named"], "left")
    state = F.when(F.col("status") == "absent", "absent").when((F.col("status") == "ok") & F.coalesce(F.col("catalog_status") == "ok", F.lit(False)), "present").otherwise("unusable")
    return j.select("scope_id", state.alias("state"), F.when(state == "present", F.col("catalog")).alias("catalog"))


def needed_packs(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs that overlap a request, with their contents; which they are comes from their ranges alone."""
    ranges = packs.select("scope_id", F.col("first_sequence").alias("start"), F.col("last_sequence").alias("end"))
    hit = overlaps(requests.select("scope_id", "first", "last"), ranges).select("scope_id", F.col("start").alias("first_sequence"), F.col("end").alias("last_sequence"))
    return packs.join(hit, ["scope_id", "first_sequence", "last_sequence"], "left_semi")


def read_ranges(requests: DataFrame, packs: DataFrame, size: int = M.MAX_REPLAY_BYTES) -> DataFrame:
    """Events first to last of each request (scope_id, first, last) out of sound packs, in order, as far as they are without a gap and fit the byte budget.

    Packs outside all requests aren't opened; events and requests meet on (scope, bin).  Events of packs that
    overlap count once.
    """
    opened = read_packs(needed_packs(requests, packs))
    events = opened.groupBy("scope_id", "sequence").agg(F.min_by(F.struct("digest", F.octet_length("payload").cast("long").alias("bytes")), "digest").alias("e")).select("scope_id", "sequence", "e.*")
    at = lambda c: F.floor(c / BIN).alias("bin")
    asked = requests.select("scope_id", "first", "last", F.explode(_bins(F.col("first"), F.col("last"), BIN)).alias("bin"))
    j = asked.join(events.select("*", at(F.col("sequence"))), ["scope_id", "bin"]).filter((F.col("sequence") >= F.col("first")) & (F.col("sequence") <= F.col("last")))
    w = Window.partitionBy("scope_id", "first", "last").orderBy("sequence")
    placed = j.withColumns({"nth": F.row_number().over(w), "running": F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.filter((F.col("sequence") - F.col("first") + 1 == F.col("nth")) & (F.col("running") <= size)).select("scope_id", "first", "last", "sequence", "digest", F.col("running").alias("running_bytes"))


def catalog_valid(catalog: DataFrame) -> DataFrame:
    """Whether each scope's pack ranges are ordered and apart."""
    w = Window.partitionBy("scope_id").orderBy("first_sequence", "last_sequence")
    ok = (F.col("last_sequence") >= F.col("first_sequence")) & F.coalesce(F.lag("last_sequence").over(w) < F.col("first_sequence"), F.lit(True))
    return catalog.withColumn("ok", ok).groupBy("scope_id").agg(F.bool_and("ok").alias("valid"), F.count("*").alias("packs"))


def within_budget(log: DataFrame, size: int) -> DataFrame:
    """Running bytes of each scope in sequence order, and whether they still fit (inclusive)."""
    w = Window.partitionBy("scope_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("stored_bytes").over(w)
    return log.select("scope_id", "sequence", total.alias("running_bytes"), (total <= size).alias("fits"))
