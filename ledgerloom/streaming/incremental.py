"""The fold as a stream: each micro-batch advances the cursors of the scopes that it extends.

State is one row per scope.  A repeated event is a no-op, a gap or another digest at a known sequence
gives a verdict and changes nothing, and a scope's batch applies as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom import model as M
from ledgerloom.operators import lookups

OUTPUT = "scope_id string, sequence long, digest string, writer_epoch long, active_plan_digest string, applied long, verdict string"
STATE = "sequence long, digest string, writer_epoch long, active_plan_digest string, operations array<string>, digests array<string>"


def advance(state: tuple | None, events: pd.DataFrame) -> tuple[tuple | None, int, str]:
    """State, events applied and verdict after one scope's batch."""
    seq, digest, epoch, plan, operations, digests = state or (0, None, 0, None, [], [])
    operations, digests, applied = list(operations), list(digests), 0
    known = set(operations)
    for e in events.sort_values(["sequence", "digest"], kind="stable").itertuples(index=False):
        if e.sequence <= seq:
            if digests[int(e.sequence) - 1] != e.digest:
                return state, 0, "conflict"
            continue
        if e.sequence != seq + 1:
            return state, 0, "gap"
        if e.sequence > M.MAX_EVENTS:
            return state, 0, "over_limit"
        parent = None if pd.isna(e.parent_digest) else e.parent_digest
        if parent != digest or e.writer_epoch < epoch or e.operation_id in known or (e.payload_type == "root_genesis") != (e.sequence == 1):
            return state, 0, "conflict"
        if e.payload_type == "plan_admitted":
            if plan is not None:
                return state, 0, "conflict"
            plan = None if pd.isna(e.plan_digest) else e.plan_digest
        seq, digest, epoch, applied = int(e.sequence), e.digest, int(e.writer_epoch), applied + 1
        operations.append(e.operation_id)
        known.add(e.operation_id)
        digests.append(e.digest)
    return (seq, digest, epoch, plan, operations, digests), applied, "applied" if applied else "duplicate"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames))
    old = state.get if state.exists else None
    new, applied, verdict = advance(old, rows)
    if new is not None:
        state.update(new)
    seq, digest, epoch, plan = (new or (0, None, 0, None))[:4]
    yield pd.DataFrame({"scope_id": [key[0]], "sequence": [seq], "digest": [digest], "writer_epoch": [epoch], "active_plan_digest": [plan], "applied": [applied], "verdict": [verdict]})


def fold_stream(events: DataFrame) -> DataFrame:
    """A stream of cursor rows from a stream of events; a scope's lifetime is at most MAX_EVENTS events, so is its state."""
    return events.groupBy("scope_id").applyInPandasWithState(_step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Folds what is there in micro-batches and hands each batch of cursor rows to ``sink``."""
    query = fold_stream(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def readiness(cursors: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether each scope's cursor has reached its head."""
    c = cursors.select("scope_id", F.col("sequence").alias("own"), F.col("digest").alias("own_digest"))
    return heads.join(c, "scope_id", "left").select("scope_id", F.coalesce((F.col("own") == F.col("sequence")) & (F.col("own_digest") == F.col("tail_event_digest")), F.lit(False)).alias("ready"))


def ready_scopes(cursors: DataFrame, heads: DataFrame, scopes: DataFrame, log: DataFrame) -> DataFrame:
    """Scopes whose cursor has reached the head and whose projection agrees with it in campaign, plan, operation and epoch."""
    agrees = lookups.head_matches(heads, scopes, log)
    return readiness(cursors, heads).join(agrees, "scope_id", "left").select("scope_id", (F.col("ready") & F.coalesce("matches", F.lit(False))).alias("ready"))


def intake_queue(arrivals: DataFrame, capacity: int, stopped_at: int | None = None) -> DataFrame:
    """accepted, overloaded or stopped, for arrivals (queue, arrival) at a bounded queue that nothing drains meanwhile."""
    from pyspark.sql import Window

    late = F.lit(False) if stopped_at is None else F.col("arrival") >= stopped_at
    place = F.row_number().over(Window.partitionBy("queue", late).orderBy("arrival"))
    return arrivals.withColumn("verdict", F.when(late, "stopped").when(place <= capacity, "accepted").otherwise("overloaded"))
