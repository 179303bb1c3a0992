"""The fold as a stream with keyed state: cursor, plan, grants and claims of each scope, and timers for its lease.

State lies in the state store in pages of about PAGE entries (operations, events, work revisions); a batch reads
and writes the pages of the entries it names and copies nothing else.  Events beyond a gap wait in state, up to
a bound, and are released in order when the gap closes.  A snapshot can be handed over as the state to begin
with, so that only the events behind it are read.
"""

from __future__ import annotations

import json
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerloom import model as M
from ledgerloom.operators import fold

#: Events of a scope that wait beyond a gap, at most; later ones are refused and have to be delivered again.
HOLD = 256
#: Entries of a page of state, about; more make twice as many pages, up to 2 ** DEPTH.
PAGE = 256
DEPTH = 10
WAITING, DEALT = "waiting", ("operations", "digests", "grants", "claims")


def _schema(ddl: str) -> StructType:
    """Fields of strings and longs; Python workers have no parser for them."""
    kinds = {"string": StringType(), "long": LongType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


EVENT = "sequence long, digest string, parent_digest string, operation_id string, writer_epoch long, payload_type string, plan_digest string, work_id string, work_revision long, claim_fence long, grant_digest string, attempt long, units long"
INPUT = _schema(f"scope_id string, kind string, {EVENT}, arrival long, fence long, lease_until long, now_ms long, terminal_result_digest string")
OUTPUT = _schema(
    "scope_id string, what string, work_id string, work_revision long, sequence long, digest string, writer_epoch long, active_plan_digest string, granted_units long, grant_fence long, grant_digest string, granted_attempt long, activations long, "
    "claim_fence long, claim_lease_until long, terminal_result_digest string, refused long, verdict string, applied long, duplicates long, held long, dropped long"
)
GRANT = "granted_units long, grant_fence long, grant_digest string, granted_attempt long, activations long"
CLAIM = "claim_fence long, claim_lease_until long, terminal_result_digest string, refused long"

_FIELDS, _GRANT, _CLAIM = (_schema(ddl).names for ddl in (EVENT, GRANT, CLAIM))
_Event = namedtuple("_Event", _FIELDS)
_ROW = Row(*OUTPUT.names)


def _out(scope: str, what: str, **values) -> Row:
    values |= {"scope_id": scope, "what": what}
    return _ROW(*map(values.get, OUTPUT.names))


class _Refused(Exception):
    """A suffix that may not be applied; nothing of it has been."""


class Pages:
    """The cursor and the maps of one scope in few entries of the state store, as each read and write of one is a message to the store.

    Page 0 holds the cursor, the depth, what waits (every batch asks for that) and, at depth 0, all entries of the other
    maps; at a greater one they lie by a hash of map and key in pages 1 to 2 ** depth.  Pages that were read are kept until the next scope, changes until ``flush``.
    """

    def __init__(self, state):
        self._state = state
        self.forget()

    def forget(self) -> None:
        """What was read of another scope."""
        self._held: dict[int, dict] = {}
        self._changed: set[int] = set()

    def _page(self, n: int) -> dict:
        if n not in self._held:
            found = self._state.getValue((n,)) if self._state.containsKey((n,)) else None  # Spark logs a warning for a key that isn't there
            self._held[n] = json.loads(found[0]) if found else {}
        return self._held[n]

    @property
    def depth(self) -> int:
        return self._page(0).get("depth", 0)

    def _place(self, table: str, key: str) -> int:
        return 0 if table == WAITING or not self.depth else 1 + zlib.crc32(f"{table} {key}".encode()) % (1 << self.depth)

    def finder(self, table: str) -> Callable:
        """A function that gives the entry of a key of a map, or None."""
        if table == WAITING or not self.depth:
            return self._page(0).get(table, {}).get
        return lambda key: self._page(self._place(table, key)).get(table, {}).get(key)

    def tables(self, table: str) -> Iterator[dict]:
        """All entries of a map."""
        for n in range(1, 1 + (1 << self.depth)) if self.depth and table != WAITING else (0,):
            yield self._page(n).get(table, {})

    def put(self, table: str, entries: dict) -> None:
        """Entries of a map, new or in place of old ones; those of None go."""
        for n, part in self._dealt(table, entries):
            own = self._page(n).setdefault(table, {})
            own.update(part)
            for key in (k for k, v in part.items() if v is None):
                del own[key]
            self._changed.add(n)

    def _dealt(self, table: str, entries: dict) -> Iterator[tuple[int, dict]]:
        if table == WAITING or not self.depth:
            return iter([(0, entries)] if entries else [])
        parts: dict[int, dict] = {}
        for key, value in entries.items():
            parts.setdefault(self._place(table, key), {})[key] = value
        return iter(parts.items())

    def note(self, name: str, value) -> None:
        """A value of page 0 beside the maps."""
        self._page(0)[name] = value
        self._changed.add(0)

    def flush(self) -> None:
        """Writes the pages that changed, dealt anew if one of them has grown too large."""
        size = lambda page: sum(len(page.get(t, ())) for t in DEALT)
        while self.depth < DEPTH and any(size(self._held[n]) > PAGE for n in self._changed):
            old = {t: {k: v for part in self.tables(t) for k, v in part.items()} for t in DEALT}
            head = {k: v for k, v in self._page(0).items() if k not in DEALT}
            self._held = {0: head} | {1 + n: {} for n in range(2 << self.depth)}
            head["depth"] = (len(self._held) - 1).bit_length() - 1
            self._changed = set(self._held)
            for table, entries in old.items():
                self.put(table, entries)
        for n in sorted(self._changed):
            self._state.updateValue((n,), (json.dumps(self._held[n], separators=(",", ":")),))
        self._changed.clear()


class Table(Mapping):
    """One map of ``Pages``: keys are tuples, values what JSON gives back, lists as tuples."""

    def __init__(self, pages: Pages, name: str, text: Callable = lambda k: json.dumps(k, separators=(",", ":")), key: Callable = lambda t: tuple(json.loads(t))):
        self._pages, self._name, self._text, self._key = pages, name, text, key

    def __getitem__(self, key: tuple):
        value = self._pages.finder(self._name)(self._text(key))
        if value is None:
            raise KeyError(key)
        return tuple(value) if isinstance(value, list) else value

    def __iter__(self) -> Iterator[tuple]:
        return (self._key(text) for part in self._pages.tables(self._name) for text in part)

    def __len__(self) -> int:
        return sum(map(len, self._pages.tables(self._name)))

    def finder(self) -> Callable:
        """A function that gives the value of a key, or None, for many keys of one state."""
        find, text = self._pages.finder(self._name), self._text
        return lambda key: find(text(key))

    def put(self, entries: Iterable[tuple[tuple, object]]) -> None:
        """Keys with their values; None takes a key out."""
        self._pages.put(self._name, {self._text(k): v for k, v in entries})


class Cursor:
    """Sequence, digest, epoch and plan of the last event applied, in page 0."""

    def __init__(self, pages: Pages):
        self._pages = pages

    def get(self) -> tuple | None:
        at = self._pages._page(0).get("cursor")
        return tuple(at) if at else None

    def update(self, at: tuple) -> None:
        self._pages.note("cursor", at)


_SEQUENCE = {"text": lambda k: str(k[0]), "key": lambda t: (int(t),)}


class Ledger(StatefulProcessor):
    """Applies the events and claim operations of one scope.

    The events of a batch that follow the cursor without a gap apply as a whole or not at all.  A repeated event
    is counted and changes nothing; another digest at a known sequence, a broken link, an older epoch, a repeated
    operation or a second plan refuses the batch (conflict).  Events behind a gap wait; what waits beyond ``hold``
    is dropped and counted, and so is a waiting event that doesn't fit when its turn comes.
    """

    def __init__(self, hold: int = HOLD):
        self._hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = Pages(handle.getMapState("pages", "page long", "entries string"))
        self.cursor = Cursor(self.pages)
        self.operations = Table(self.pages, "operations", lambda k: "" if k[0] is None else f"={k[0]}", lambda t: (t[1:] if t else None,))
        self.digests = Table(self.pages, "digests", **_SEQUENCE)
        self.waiting = Table(self.pages, WAITING, **_SEQUENCE)
        self.grants = Table(self.pages, "grants")
        self.claims = Table(self.pages, "claims")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        s = initialState
        self.pages.forget()
        self.cursor.update((s.sequence, s.digest, s.writer_epoch, s.active_plan_digest))
        self.operations.put(((e["operation_id"],), e["sequence"]) for e in s.events)
        self.digests.put(((e["sequence"],), e["digest"]) for e in s.events)
        for rows, state, fields in ((s.grants, self.grants, _GRANT), (s.claims, self.claims, _CLAIM)):
            state.put(((r["work_id"], r["work_revision"]), tuple(r[f] for f in fields)) for r in rows)
        self.pages.flush()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        scope, events, claims = key[0], [], []
        self.pages.forget()
        for r in rows:
            r = r.asDict() if isinstance(r, Row) else r
            (events if r["kind"] == "event" else claims).append(r)
        out = (self._events(scope, events) if events else []) + (self._claims(scope, claims) if claims else [])
        self.pages.flush()
        yield from out

    def _events(self, scope: str, events: list[dict]) -> list[Row]:
        was = at = self.cursor.get() or (0, None, 0, None)
        waiting = {k[0]: _Event._make(v) for k, v in self.waiting.items()}
        try:
            at, made, new, counts = self._suffix(at, [_Event._make(map(e.get, _FIELDS)) for e in events], waiting)
        except _Refused as e:
            return [_out(scope, "cursor", sequence=at[0], digest=at[1], writer_epoch=at[2], active_plan_digest=at[3], verdict=str(e), applied=0, duplicates=0, held=len(waiting), dropped=len(events))]
        grants: dict[tuple, tuple] = {}
        for e in made:
            if e.payload_type == "grant_activated":
                k = (e.work_id, e.work_revision)
                g = grants.get(k) or self.grants.get(k) or (0, None, None, None, 0)
                grants[k] = (g[0] + (e.units or 0), e.claim_fence, e.grant_digest, e.attempt, g[4] + 1)
        self.operations.put(((e.operation_id,), e.sequence) for e in made)
        self.digests.put(((e.sequence,), e.digest) for e in made)
        self.grants.put(grants.items())
        self.waiting.put(((s,), new.get(s)) for s in waiting.keys() ^ new.keys())
        if at != was:
            self.cursor.update(at)
        verdict = "waiting" if new else "applied" if made else "duplicate" if counts["duplicates"] else "dropped"
        head = _out(scope, "cursor", sequence=at[0], digest=at[1], writer_epoch=at[2], active_plan_digest=at[3], verdict=verdict, applied=len(made), held=len(new), **counts)
        return [head, *(_out(scope, "grant", work_id=work, work_revision=revision, **dict(zip(_GRANT, g, strict=True))) for (work, revision), g in grants.items())]

    def _suffix(self, at: tuple, events: list[_Event], waiting: dict[int, _Event]) -> tuple[tuple, list[_Event], dict[int, _Event], dict[str, int]]:
        """Cursor after the events, the events applied, those that wait, and counts of the rest; touches no state."""
        new: dict[int, _Event] = {}
        counts = {"duplicates": 0, "dropped": 0}
        digest = self.digests.finder()
        for e in events:
            held = digest((e.sequence,)) if e.sequence <= at[0] else getattr(new.get(e.sequence) or waiting.get(e.sequence), "digest", None)
            if held is None:
                new[e.sequence] = e
            elif held != e.digest:
                raise _Refused("conflict")
            else:
                counts["duplicates"] += 1
        made: list[_Event] = []
        known: set[str] = set()
        left = dict(waiting)
        operation = self.operations.finder()
        while (own := new.get(at[0] + 1)) or left.get(at[0] + 1):
            e = own or left.pop(at[0] + 1)
            fault = self._fault(at, e, e.operation_id in known or operation((e.operation_id,)) is not None)
            if fault and own:
                raise _Refused(fault)
            if fault:
                counts["dropped"] += 1
                break
            new.pop(e.sequence, None)
            at = (e.sequence, e.digest, e.writer_epoch, e.plan_digest if e.payload_type == "plan_admitted" else at[3])
            known.add(e.operation_id)
            made.append(e)
        for s in sorted(new):
            if s > M.MAX_EVENTS or len(left) >= self._hold:
                counts["dropped"] += 1
            else:
                left[s] = new[s]
        return at, made, left, counts

    @staticmethod
    def _fault(at: tuple, e: _Event, again: bool) -> str | None:
        if e.sequence > M.MAX_EVENTS:
            return "over_limit"
        if e.payload_type not in M.PAYLOAD_TYPES:
            return "unregistered"
        chained = e.parent_digest == at[1] and e.writer_epoch >= at[2] and (e.payload_type == "root_genesis") == (e.sequence == 1)
        second = e.payload_type == "plan_admitted" and at[3] is not None
        return None if chained and not again and not second else "conflict"

    def _claims(self, scope: str, rows: list[dict]) -> list[Row]:
        """Claim operations in order of arrival, by the rules of ``fold.fold_claims``."""
        changed: dict[tuple, tuple] = {}
        named = ("work_id", "work_revision", "arrival", "fence", "lease_until", "now_ms", "terminal_result_digest")
        for work, revision, _, by, until, now, end in sorted((tuple(map(r.get, named)) for r in rows), key=lambda r: (*r[2:6], r[6] or "")):
            k = (work, revision)
            fence, lease, result, refused = changed.get(k) or self.claims.get(k) or (None, None, None, 0)
            if end is not None:
                ok = fence is not None and fence == by and result in (None, end)
                result = end if ok else result
            else:
                ok = result is None and (fence is None or (by > fence and lease <= now) or (by == fence and lease <= until))
                fence, lease = (by, until) if ok else (fence, lease)
            changed[k] = (fence, lease, result, refused + (not ok))
        self.claims.put(changed.items())
        return [_out(scope, "claim", work_id=work, work_revision=revision, **dict(zip(_CLAIM, c, strict=True))) for (work, revision), c in changed.items()]


class Packed(Ledger):
    """The same over rows as JSON, ``row`` in and ``rows`` out: Spark makes a Python value of each column of each row, and a batch of its own of each scope's rows out."""

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        super().handleInitialState(key, Row(**json.loads(initialState.row)), timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made = [r.asDict() for r in super().handleInputRows(key, (json.loads(r[1]) for r in rows), timerValues)]
        yield Row("rows")(json.dumps([{k: v for k, v in r.items() if v is not None} for r in made]))


class Leases(StatefulProcessor):
    """Emits, for the newest lease of each scope, when its renewal falls due and when its holder must stop."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "lease_until long")

    @staticmethod
    def times(lease: int) -> dict[int, str]:
        return {lease - M.RENEW_BEFORE_MS: "renewal_due", lease - M.STOP_MARGIN_MS + 1: "must_stop"}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r.at, r.lease_until or 0)).lease_until
        old = self.lease.get() if self.lease.exists() else None
        for t in self.times(old[0]) if old else ():
            self.handle.deleteTimer(t)
        if newest is None:
            self.lease.clear()
            return iter([])
        self.lease.update((newest,))
        for t in self.times(newest):
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        t = expiredTimerInfo.getExpiryTimeInMs()
        lease = self.lease.get() if self.lease.exists() else None
        what = self.times(lease[0]).get(t) if lease else None
        if what:
            yield Row("scope_id", "what", "due_ms", "watermark_ms")(key[0], what, t, timerValues.getCurrentWatermarkInMs())


# ---------------------------------------------------------------- input, snapshot, runs


def as_input(rows: DataFrame, kind: str) -> DataFrame:
    """Log events ("event") or claim operations ("claim") in the stream's columns."""
    names = {c.lower() for c in rows.columns}
    own = set(_FIELDS) if kind == "event" else {"work_id", "work_revision", "arrival", "fence", "lease_until", "now_ms", "terminal_result_digest"}
    value = lambda f: F.col(f.name) if f.name == "scope_id" or (f.name in own and f.name in names) else F.lit(kind) if f.name == "kind" else F.lit(None)
    return rows.select(*(value(f).cast(f.dataType).alias(f.name) for f in INPUT))


def snapshot(log: DataFrame, claims: DataFrame) -> DataFrame:
    """State of each scope after a valid log and claim operations, one row a scope, by the batch fold."""
    listed = lambda df, cols, name: df.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    names = lambda ddl: _schema(ddl).names
    cursors = fold.fold_cursors(log).select("scope_id", "sequence", F.col("tail_event_digest").alias("digest"), "writer_epoch", "active_plan_digest")
    key = ["work_id", "work_revision"]
    out = cursors.join(listed(log, ["sequence", "digest", "operation_id"], "events"), "scope_id")
    for name, rows, ddl in (("grants", fold.fold_grants(log), GRANT), ("claims", fold.fold_claims(claims), CLAIM)):
        out = out.join(listed(rows, key + names(ddl), name), "scope_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def fold_ledger(stream: DataFrame, start: DataFrame | None = None, hold: int = HOLD) -> DataFrame:
    """A stream of changed cursors, grants and claims from a stream of INPUT rows, beginning with a ``snapshot`` if there is one."""
    row = lambda df, nulls: df.select("scope_id", F.to_json(F.struct(*(c for c in df.columns if c != "scope_id")), {"ignoreNullFields": str(not nulls).lower()}).alias("row"))
    first = None if start is None else row(start, True).groupBy("scope_id")
    out = row(stream, False).groupBy("scope_id").transformWithState(Packed(hold), "rows string", "update", "none", first)
    return out.select(F.inline(F.from_json("rows", ArrayType(OUTPUT))))


def lease_alarms(heads: DataFrame) -> DataFrame:
    """A stream of alarms from a stream of heads (scope_id, lease_until, at): the watermark of ``at`` is the clock."""
    timed = heads.withWatermark("at", "0 seconds")
    return timed.groupBy("scope_id").transformWithState(Leases(), "scope_id string, what string, due_ms long, watermark_ms long", "append", "eventTime")


@contextmanager
def _by_key(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps maps and timers, for queries that are started within; a batch commits what it changed and no copy of all files."""
    store = "spark.sql.streaming.stateStore."
    own = {f"{store}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}rocksdb.changelogCheckpointing.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """What the stream gives for the input that is there: the rows of each batch are written once, with its number in ``batch``."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a batch that runs again replaces its rows

    with _by_key(spark):
        query = stream.writeStream.outputMode("append" if "due_ms" in stream.columns else "update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).schema(StructType.fromJson(stream.schema.jsonValue()).add("batch", "long")).parquet(out)


def latest(rows: DataFrame, what: str, start: DataFrame | None = None) -> DataFrame:
    """The newest cursor, grant or claim of each key, of ``run_available`` and of the snapshot that it began with."""
    key = ["scope_id"] if what == "cursor" else ["scope_id", "work_id", "work_revision"]
    fields = _schema({"cursor": "sequence long, digest string, writer_epoch long, active_plan_digest string", "grant": GRANT, "claim": CLAIM}[what]).names
    found = rows.filter(F.col("what") == what).select(*key, *fields, "batch")
    if start is not None:
        old = start if what == "cursor" else start.select("scope_id", F.explode(f"{what}s").alias("r")).select("scope_id", "r.*")
        found = found.unionByName(old.select(*key, *fields, F.lit(-1).cast("long").alias("batch")))
    return found.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*key, "r.*")
