"""Connected components over a table of links, and the written table that cuts lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Different links that one task joins, at most.
LOCAL = 500_000
#: Ids that a join may broadcast, at most, and bytes of their written table.
BROADCAST, BROADCAST_BYTES = 1_000_000, 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the folder in spark.checkpoint.dir and read back.

    All executors share that folder, so the loss of one undoes nothing, and the plan starts anew from
    a table of known size.  The tables of an application lie in one folder of its name, which may be
    deleted when it has ended.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that only later tables of ``cut`` were made from."""
    for table in tables:
        store, path = _store(table)
        store.delete(path, True)


def _store(table: DataFrame) -> tuple:
    """File system and path of a table of ``cut``."""
    session = table.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(table.written_to)
    return path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()), path


def checked(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """A table of ``cut`` with ids or lists of ids, marked for broadcast if its bytes and the ids it holds (rows, or the sum of ``weight``) are few enough; without the mark a join shuffles."""
    store, path = _store(rows)
    if store.getContentSummary(path).getLength() > BROADCAST_BYTES:
        return rows
    held = rows.count() if weight is None else rows.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(rows) if held <= BROADCAST else rows


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written tables.  Without the setting, a local session uses its warehouse; a cluster is refused, since its machines may not share that."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return own.rstrip("/")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest reachable node) of every node that a link touches.

    Up to LOCAL different links are joined in one task; the count is checked first.  Beyond that,
    rounds hand the smallest label over every link, then jump to the label of the label, so the
    rounds grow with the logarithm of the longest path; aggregates combine before shuffling and
    joins meet a table of one row per node, so a node with very many links splits over tasks.
    Links with a null end are ignored.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    ends = cut(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low.alias("node"), high.alias("other")).distinct())
    return _in_one_task(ends) if ends.count() <= LOCAL else _in_rounds(ends)


def _in_one_task(ends: DataFrame) -> DataFrame:
    kind = ends.schema["node"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        values, code = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("node", "other")]), return_inverse=True)
        x, y = np.split(code, 2)
        label = np.arange(len(values))
        while True:
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            np.minimum.at(new, label, new)  # a root follows the lowest of its own
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(v, type=table.schema.field("node").type) for v in (values, values[label])], ["node", "component"])

    return cut(ends.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))


def _in_rounds(ends: DataFrame) -> DataFrame:
    ends = cut(ends.union(ends.select("other", "node")))
    labels = cut(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")))
    while True:
        heard = ends.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("jumped"))
        new = cut(lower.join(jump, "via", "left").select("node", F.least("via", "jumped").alias("component"), (F.least("via", "jumped") < F.col("old")).alias("moved")))
        moved = not new.filter("moved").isEmpty()
        labels = new.drop("moved")
        if not moved:
            return labels
