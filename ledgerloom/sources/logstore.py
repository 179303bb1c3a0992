"""The event log as objects under scope prefixes, and projections published by one manifest, as Spark data sources.

``event_log`` lists and opens only what filters on scope and sequence leave: with a scope named no other
prefix is listed, with a range of sequences no other key is opened.  An event is an object of its own or lies in a
pack, an object of up to PACK_EVENTS events of one scope behind an index.  ``projection`` stages the files of a
table; nothing of them is visible before ``publish`` has written one manifest that names all tables.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ledgerloom import model as M

#: Stored bytes of one event, at most.
EVENT_BYTES = 256 * 1024
#: Bytes that a reader holds before it hands over a batch.
BATCH_BYTES = 8 << 20

_KEY = re.compile(r"([0-9]{16})-([0-9a-f]{64})\.cbor\.zst")
#: A pack holds the number of its events, their entries in order of sequences, and their bytes one after the other.
_PACK = re.compile(r"([0-9]{16})-([0-9]{16})-([0-9a-f]{64})\.pack")
_COUNT, _ENTRY = struct.Struct(">Q"), struct.Struct(">Q32sQ")
#: The key of a packed event: its pack, and where its bytes lie there.
_WITHIN = re.compile(r"(.*\.pack)#([0-9]+)\+([0-9]+)", re.DOTALL)
LOG_SCHEMA = "scope_id string, sequence long, digest string, key string, length long, status string, content binary"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a URI (file, hdfs, s3, ...) or a local path."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (pafs.LocalFileSystem(), path)


def _names(fs: pafs.FileSystem, folder: str, kind: pafs.FileType) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((i for i in found if i.type == kind), key=lambda i: i.base_name)


def write_whole(fs: pafs.FileSystem, path: str, raw: bytes) -> None:
    """An object that others see whole or not at all."""
    part = f"{path}.part-{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(raw)
    fs.move(part, path)


# ---------------------------------------------------------------- log


@dataclass
class Prefixes(InputPartition):
    """Scopes that one task lists."""

    scopes: list[str]

    def __hash__(self) -> int:
        return hash(tuple(self.scopes))


@dataclass
class Wanted:
    """What filters leave of scopes and sequences."""

    scopes: set[str] | None = None
    first: int | None = None
    last: int | None = None
    keyed: bool = False

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that listing can apply."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "scope_id" and isinstance(f, EqualTo | In):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.scopes = named if self.scopes is None else self.scopes & named
        elif name == "sequence" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.value is not None:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                low = f.value + isinstance(f, GreaterThan)
                self.first = low if self.first is None else max(self.first, low)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = f.value - isinstance(f, LessThan)
                self.last = high if self.last is None else min(self.last, high)
        elif name in ("scope_id", "sequence") and isinstance(f, IsNotNull):
            self.keyed |= name == "sequence"
        else:
            return False
        return True

    def meets(self, first: int, last: int) -> bool:
        return (self.first is None or last >= self.first) and (self.last is None or first <= self.last)

    def holds(self, sequence: int | None) -> bool:
        if sequence is None:
            return self.first is None and self.last is None and not self.keyed
        return (self.first is None or sequence >= self.first) and (self.last is None or sequence <= self.last)


class LogReader(DataSourceReader):
    """A row per key: status ok, too_large, not_found (gone since the listing), unparsed (no event key), or listed where contents aren't asked for."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.content = options.get("content", "true") == "true"
        self.cap = int(options.get("cap", EVENT_BYTES))
        self.tasks = int(options.get("tasks", 200))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Prefixes]:
        if self.wanted.scopes is not None:
            scopes = sorted(s for s in self.wanted.scopes if s is not None)
        else:
            fs, root = store(self.path)
            scopes = [i.base_name for i in _names(fs, root, pafs.FileType.Directory)]
        n = max(1, min(self.tasks, len(scopes)))
        return [Prefixes(scopes[k::n]) for k in range(n)]

    def read(self, partition: Prefixes) -> Iterator[pa.RecordBatch]:
        fs, root = store(self.path)
        rows, held = [], 0
        for scope in partition.scopes:
            seen: set[tuple] = set()  # an event that several packs hold counts once
            for info in _names(fs, f"{root}/{scope}/events", pafs.FileType.File):
                packed = _PACK.fullmatch(info.base_name)
                for row in self._packed(fs, info, packed) if packed else self._single(fs, info):
                    if row[0] is not None and row[:2] in seen:
                        continue
                    seen.add(row[:2])
                    rows.append((scope, *row))
                    held += len(row[-1] or b"") + 256
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _single(self, fs: pafs.FileSystem, info: pafs.FileInfo) -> Iterator[tuple]:
        key = _KEY.fullmatch(info.base_name)
        sequence = int(key[1]) if key else None
        if not self.wanted.holds(sequence):
            return
        status, raw = ("ok", None) if key else ("unparsed", None)
        if status == "ok" and not self.content:
            status = "listed"
        elif status == "ok":
            status, raw = self._open(fs, info)
        yield sequence, key and key[2], info.path, info.size, status, raw

    def _packed(self, fs: pafs.FileSystem, info: pafs.FileInfo, name: re.Match) -> Iterator[tuple]:
        """The events of a pack; one that no filter wants is not opened, and of others only the index and the bytes that are wanted are read."""
        if not self.wanted.meets(int(name[1]), int(name[2])):
            return
        try:
            with fs.open_input_file(info.path) as f:
                entries = _index(f)
                if entries is None:
                    if self.wanted.holds(None):
                        yield None, None, info.path, info.size, "unparsed", None
                    return
                for sequence, digest, at, length in entries:
                    if self.wanted.holds(sequence):
                        fits = length <= self.cap
                        raw = f.read_at(length, at) if self.content and fits else None
                        yield sequence, digest, f"{info.path}#{at}+{length}", length, "listed" if not self.content else "ok" if fits else "too_large", raw
        except FileNotFoundError:
            if self.wanted.holds(None):
                yield None, None, info.path, info.size, "not_found", None

    def _open(self, fs: pafs.FileSystem, info: pafs.FileInfo) -> tuple[str, bytes | None]:
        if info.size > self.cap:
            return "too_large", None
        try:
            with fs.open_input_stream(info.path, compression=None) as f:
                raw = f.read(self.cap + 1)
        except FileNotFoundError:
            return "not_found", None
        return ("ok", raw) if len(raw) <= self.cap else ("too_large", None)


_LOG_ARROW = pa.schema([("scope_id", pa.string()), ("sequence", pa.int64()), ("digest", pa.string()), ("key", pa.string()), ("length", pa.int64()), ("status", pa.string()), ("content", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LOG_ARROW, strict=True)], schema=_LOG_ARROW)


def _index(f: pa.NativeFile) -> list[tuple[int, str, int, int]] | None:
    """Sequence, digest, place and length of each event of a pack; None for bytes that are no pack."""
    size = f.size()
    n = _COUNT.unpack(f.read_at(_COUNT.size, 0))[0] if size >= _COUNT.size else 0
    at = _COUNT.size + n * _ENTRY.size
    if not n or at > size:
        return None
    out = []
    for sequence, digest, length in _ENTRY.iter_unpack(f.read_at(n * _ENTRY.size, _COUNT.size)):
        out.append((sequence, digest.hex(), at, length))
        at += length
    return out if at == size else None


class PackWriter(DataSourceArrowWriter):
    """Writes the events of one scope that follow one another in a task as packs; bytes that don't hash to their digest fail the task."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = store(self.path)
        rows = (r for batch in iterator for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for scope, own in groupby(rows, key=lambda r: r[0]):
            held, size = [], 0
            for _, sequence, digest, raw in own:
                if hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"event {sequence} of {scope} doesn't hash to its digest")
                if held and (len(held) >= M.PACK_EVENTS or size + len(raw) > M.PACK_BYTES):
                    self._put(fs, f"{root}/{scope}/events", held)
                    held, size = [], 0
                held.append((sequence, digest, raw))
                size += len(raw)
            self._put(fs, f"{root}/{scope}/events", held)
        return WriterCommitMessage()

    @staticmethod
    def _put(fs: pafs.FileSystem, folder: str, events: list[tuple[int, str, bytes]]) -> None:
        events = sorted(events)
        raw = b"".join((_COUNT.pack(len(events)), *(_ENTRY.pack(s, bytes.fromhex(d), len(r)) for s, d, r in events), *(r for _, _, r in events)))
        key = f"{folder}/{events[0][0]:016d}-{events[-1][0]:016d}-{hashlib.sha256(raw).hexdigest()}.pack"
        fs.create_dir(folder, recursive=True)
        if fs.get_file_info(key).type == pafs.FileType.NotFound:
            write_whole(fs, key, raw)


class LogWriter(DataSourceWriter):
    """Writes each event once under its key; an object that is there is left as it is, bytes that don't hash to their digest fail the task."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, root = store(self.path)
        made: set[str] = set()
        for r in iterator:
            raw = bytes(r.content)
            if hashlib.sha256(raw).hexdigest() != r.digest:
                raise ValueError(f"event {r.sequence} of {r.scope_id} doesn't hash to its digest")
            folder = f"{root}/{r.scope_id}/events"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            key = f"{folder}/{r.sequence:016d}-{r.digest}.cbor.zst"
            if fs.get_file_info(key).type == pafs.FileType.NotFound:
                write_whole(fs, key, raw)
        return WriterCommitMessage()


class LogSource(DataSource):
    """Events as objects ``<path>/<scope>/events/<sequence>-<digest>.cbor.zst`` or in packs ``<first>-<last>-<digest of the pack>.pack`` beside them."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LogWriter | PackWriter:
        if overwrite:
            raise ValueError("events are written once")
        return (PackWriter if self.options.get("packed") == "true" else LogWriter)(dict(self.options))


def read_log(spark: SparkSession, path: str, content: bool = True, cap: int = EVENT_BYTES) -> DataFrame:
    """Events under ``path``; filters on scope_id and sequence reach the listing."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("event_log").option("path", path).option("content", str(content).lower()).option("cap", cap).load()


def write_log(events: DataFrame, path: str, packed: bool = False) -> None:
    """Stores events (scope_id, sequence, digest, content), each as an object of its own or ``packed``.

    A file system keeps a block, an entry and a name for each object, many times what a small event holds; packs
    share them.  Events of a scope share a pack if one task has them, so ``events`` should be dealt by scope.
    """
    events.sparkSession.dataSource.register(LogSource)
    rows = events.select("scope_id", "sequence", "digest", "content")
    if packed:
        rows = rows.sortWithinPartitions("scope_id", "sequence")
    rows.write.format("event_log").mode("append").option("path", path).option("packed", str(packed).lower()).save()


def dense(listing: DataFrame, cursors: DataFrame) -> DataFrame:
    """Whether the keys listed behind each cursor (scope_id, sequence, tail) hold every sequence up to the tail once; if not, the listing is no use and the scope's chain has to be walked."""
    key = listing.filter("sequence IS NOT NULL").select("scope_id", F.col("sequence").alias("at"))
    j = cursors.join(key, "scope_id", "left").filter(F.col("at").isNull() | ((F.col("at") > F.col("sequence")) & (F.col("at") <= F.col("tail"))))
    a = j.groupBy("scope_id").agg(F.count("at").alias("n"), F.count_distinct("at").alias("d"))
    out = cursors.join(a, "scope_id", "left")
    return out.select("scope_id", (F.coalesce("n", F.lit(0)) == F.coalesce("d", F.lit(0))) & (F.coalesce("d", F.lit(0)) == F.col("tail") - F.col("sequence")).alias("dense")).toDF("scope_id", "dense")


def fetch_within(spark: SparkSession, path: str, budget: int = M.MAX_REPLAY_BYTES, first: int | None = None) -> DataFrame:
    """Events of each scope in order from ``first`` on, as far as their stored bytes together stay within ``budget`` (inclusive).

    Lengths come from the listing, so an event beyond the budget is never opened; the first one that
    doesn't fit ends its scope.
    """
    listing = read_log(spark, path, content=False).filter("sequence IS NOT NULL")
    if first is not None:
        listing = listing.filter(F.col("sequence") >= first)
    w = Window.partitionBy("scope_id").orderBy("sequence", "digest").rowsBetween(Window.unboundedPreceding, 0)
    chosen = listing.withColumn("running_bytes", F.sum("length").over(w)).filter(F.col("running_bytes") <= budget).select("scope_id", "sequence", "digest", "key", "running_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 32):  # an event has at most EVENT_BYTES
                piece = batch.slice(i, 32)
                raw = []
                for key, parts in groupby(map(_place, piece.column("key").to_pylist()), key=lambda p: p[0]):
                    with fs.open_input_file(key) as f:
                        raw += [f.read_at(f.size() if length is None else length, at) for _, at, length in parts]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(raw, pa.binary())], [*piece.schema.names, "content"])

    return chosen.mapInArrow(run, "scope_id string, sequence long, digest string, key string, running_bytes long, content binary")


def _place(key: str) -> tuple[str, int, int | None]:
    """The object that a key names, and where in it the event lies; no length stands for the whole."""
    within = _WITHIN.fullmatch(key)
    return (within[1], int(within[2]), int(within[3])) if within else (key, 0, None)


# ---------------------------------------------------------------- projections


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task."""

    files: list[str] = field(default_factory=list)
    rows: int = 0


class ProjectionWriter(DataSourceArrowWriter):
    """Tasks stage files; commit notes them for the transaction, abort deletes them."""

    def __init__(self, options: dict, schema: str):
        self.path, self.table, self.transaction, self.kind = options["path"], options["table"], options["transaction"], schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = store(self.path)
        name, writer, rows = f"data/{self.table}/{self.transaction}-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if writer is None:
                    fs.create_dir(f"{root}/data/{self.table}", recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if writer is not None:
                out.close()
                fs.delete_file(f"{root}/{name}")
            raise
        if writer is None:
            return Staged()
        writer.close()
        out.close()
        return Staged([name], rows)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = store(self.path)
        fs.create_dir(f"{root}/prepared/{self.transaction}", recursive=True)
        note = {"files": sorted(f for m in messages if m for f in m.files), "rows": sum(m.rows for m in messages if m), "schema": self.kind}
        write_whole(fs, f"{root}/prepared/{self.transaction}/{self.table}.json", json.dumps(note).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = store(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


class ProjectionSource(DataSource):
    """Writes tables of a projection; ``read_projection`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "projection"

    def writer(self, schema, overwrite: bool) -> ProjectionWriter:
        return ProjectionWriter(dict(self.options), schema.json())


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    return [i.path for i in _names(fs, f"{root}/manifests", pafs.FileType.File) if i.base_name.endswith(".json")]


def _manifest(path: str) -> dict | None:
    fs, root = store(path)
    found = _manifests(fs, root)
    if not found:
        return None
    with fs.open_input_stream(found[-1]) as f:
        return json.loads(f.read())


def apply_projection(path: str, tables: dict[str, DataFrame]) -> int:
    """Replaces all tables of the projection at once, or none; returns the number of its manifest.

    If a task or a table fails, what has been staged is deleted (tasks that end later may leave files that no
    manifest names) and readers keep the last manifest.  A projection has one writer at a time.
    """
    fs, root = store(path)
    transaction = uuid.uuid4().hex
    try:
        for name, df in tables.items():
            df.sparkSession.dataSource.register(ProjectionSource)
            df.write.format("projection").mode("append").options(path=path, table=name, transaction=transaction).save()
        notes = {}
        for name in tables:
            with fs.open_input_stream(f"{root}/prepared/{transaction}/{name}.json") as f:
                notes[name] = json.loads(f.read())
        version = 1 + (_manifest(path) or {"version": 0})["version"]
        fs.create_dir(f"{root}/manifests", recursive=True)
        write_whole(fs, f"{root}/manifests/{version:016d}.json", json.dumps({"version": version, "tables": notes}).encode())
    except BaseException:
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True, recursive=True)):
            if info.base_name.startswith(transaction):
                fs.delete_file(info.path)
        raise
    finally:
        if fs.get_file_info(f"{root}/prepared/{transaction}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/prepared/{transaction}")
    return version


def read_projection(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """A table of the newest manifest, read by Spark's own reader of files (columns and filters reach it); None before the first."""
    from pyspark.sql.types import StructType

    manifest = _manifest(path)
    if manifest is None or table not in manifest["tables"]:
        return None
    note = manifest["tables"][table]
    schema = StructType.fromJson(json.loads(note["schema"]))
    files = [f"{path.rstrip('/')}/{f}" for f in note["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


# ---------------------------------------------------------------- files' metadata


def footers(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """One row a file and column of Parquet folders (folder): type, rows, nulls, least and greatest value, all from the footers; no data is read.

    A folder without files has one row of nulls, a file that is no Parquet one with the status unreadable.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for folder in batch.column("folder").to_pylist() for r in _footer_rows(folder)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["folder", "file", "status", "column", "type", "rows", "nulls", "least", "greatest"]
    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 2
    return folders.select("folder").mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, kinds, strict=True)))


def _footer_rows(folder: str) -> list[tuple]:
    fs, root = store(folder)
    files = [i for i in _names(fs, root, pafs.FileType.File) if i.base_name.endswith(".parquet")]
    if not files:
        there = fs.get_file_info(root).type != pafs.FileType.NotFound
        return [(folder, None, "empty" if there else "missing", *[None] * 6)]
    out = []
    for info in files:
        try:
            with fs.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
                for c, spec in enumerate(meta.schema.to_arrow_schema()):
                    parts = [meta.row_group(g).column(c).statistics for g in range(meta.num_row_groups)] if not pa.types.is_nested(spec.type) and meta.num_columns == len(meta.schema.to_arrow_schema()) else []
                    known = [s for s in parts if s is not None]
                    ends = [s for s in known if s.has_min_max]
                    nulls = sum(s.null_count for s in known) if len(known) == len(parts) and parts else None
                    out.append((folder, info.base_name, "ok", spec.name, str(spec.type), meta.num_rows, nulls, str(min(s.min for s in ends)) if ends else None, str(max(s.max for s in ends)) if ends else None))
        except (pa.ArrowInvalid, OSError):
            out.append((folder, info.base_name, "unreadable", *[None] * 6))
    return out


def classify_projections(found: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Class of each folder of ``footers``: missing, foreign (other columns or types than the table's), rebuildable (a file is unreadable, or a key is null), or valid.

    ``columns`` gives the Arrow type of each column; the first is the key.
    """
    key = next(iter(columns))
    expected = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    files = found.groupBy("folder", "file").agg(
        F.first("status").alias("status"), F.count_if(F.col("column").isNotNull() & (expected[F.col("column")] == F.col("type"))).alias("same"), F.count("column").alias("n"),
        F.max("rows").alias("rows"), F.max(F.when(F.col("column") == key, F.col("nulls"))).alias("null_keys"),
    )
    foreign = F.bool_or((F.col("status") == "ok") & ((F.col("same") != len(columns)) | (F.col("n") != len(columns))))
    broken = F.bool_or((F.col("status") == "unreadable") | (F.coalesce("null_keys", F.lit(0)) > 0))
    gone = F.bool_and(F.col("status").isin("missing", "empty"))
    return files.groupBy("folder").agg(F.when(gone, "missing").when(foreign, "foreign").when(broken, "rebuildable").otherwise("valid").alias("class"), F.sum("rows").alias("rows"))
