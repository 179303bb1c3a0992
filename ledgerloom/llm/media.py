"""Media columns: ISO base media containers as binary columns.

``write_media`` wraps any bytes as an uncompressed video track (24 x 24 one-byte frames, codec
``uncv``); ``probe_media`` walks the nested boxes of any ISO media file, decodes the sample tables
and stores codec, duration and the byte ranges of keyframes.  Payloads are never decoded: sample
bytes are only addressed, or copied out unchanged by ``read_samples``.

Null text counts as empty and yields one frame of padding.  A null media value gives status
``missing``; a file that is cut short or has contradicting tables gives ``malformed`` and no
tracks.  Repeated rows give repeated results; no row depends on another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import free_name, map_slices, narrow

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
TIMESCALE = 25
#: Frames in a chunk of the files written here.
CHUNK = 64

# Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}


class Malformed(ValueError):
    """The bytes are no readable ISO media file."""


# ---------------------------------------------------------------- writing


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso6")
_ENTRY = _box(
    b"uncv",
    bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII", SIDE, SIDE, 0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1),
    _box(b"cmpd", struct.pack(">IH", 1, 0)),
    _full(b"uncC", struct.pack(">IIHBBBBBBB5I", 0, 1, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
)


def pad_payload(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return data + PAD * (unit - len(data) if len(data) < unit else -len(data) % unit)


def _moov(frames: int, first: int, wide: bool) -> bytes:
    chunks = -(-frames // CHUNK)
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    at = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _ENTRY),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def wrap(payload: bytes) -> bytes:
    """An ISO media file whose samples are the frames of ``payload`` (a positive multiple of FRAME)."""
    frames = len(payload) // FRAME
    wide = len(payload) > 0xF0000000
    lead = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(_FTYP) + len(_moov(frames, 0, wide)) + len(lead)
    return b"".join((_FTYP, _moov(frames, first, wide), lead, payload))


# ---------------------------------------------------------------- reading


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, body start and body end of each box in a range."""
    while start < end:
        if end - start < 8:
            raise Malformed("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a long box header is cut short")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise Malformed(f"box {kind!r} leaves its parent")
        yield kind, start + head, start + size
        start += size


def _table(data: memoryview, at: int, end: int, kind: str, columns: int, count: int) -> np.ndarray:
    width = np.dtype(kind).itemsize * columns
    if at + width * count > end:
        raise Malformed("a table is cut short")
    return np.frombuffer(data, kind, columns * count, at).astype(np.int64).reshape(count, columns)


def _boxes(data: memoryview, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """The first box of each type below a range, containers opened."""
    found: dict[bytes, tuple[int, int]] = {}
    todo = [(start, end)]
    while todo:
        for kind, a, b in walk(data, *todo.pop()):
            found.setdefault(kind, (a, b))
            if kind in CONTAINERS:
                todo.append((a, b))
    return found


def _samples(data: memoryview, box: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample, from stsz/stz2, stsc and stco/co64."""
    if b"stsz" in box:
        a, b = box[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, a + 4)
        if fixed and fixed * count > len(data):
            raise Malformed("more samples than the file can hold")
        sizes = np.full(count, fixed, np.int64) if fixed else _table(data, a + 12, b, ">u4", 1, count)[:, 0]
    elif b"stz2" in box:
        a, b = box[b"stz2"]
        width, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if width == 4:
            raw = _table(data, a + 12, b, ">u1", 1, -(-count // 2))[:, 0]
            sizes = np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:count]
        elif width in (8, 16):
            sizes = _table(data, a + 12, b, f">u{width // 8}", 1, count)[:, 0]
        else:
            raise Malformed("stz2 has an unknown field size")
    else:
        raise Malformed("no sample sizes")
    if not len(sizes):
        return sizes, sizes
    if b"stsc" not in box or not {b"stco", b"co64"} & box.keys():
        raise Malformed("samples without chunks")
    name, kind = (b"stco", ">u4") if b"stco" in box else (b"co64", ">u8")
    a, b = box[name]
    at = _table(data, a + 8, b, kind, 1, struct.unpack_from(">I", data, a + 4)[0])[:, 0]
    a, b = box[b"stsc"]
    runs = _table(data, a + 8, b, ">u4", 3, struct.unpack_from(">I", data, a + 4)[0])
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(at):
        raise Malformed("stsc is out of order")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(at) + 1)))
    if per_chunk.sum() != len(sizes):
        raise Malformed("stsc and the sample sizes disagree")
    chunk = np.repeat(np.arange(len(at)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    return at[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk], sizes


def _track(data: memoryview, start: int, end: int) -> Track:
    box = _boxes(data, start, end)
    t = Track()
    if b"tkhd" in box:
        a = box[b"tkhd"][0]
        t.track_id = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
    if b"mdhd" not in box or b"stbl" not in box or b"stsd" not in box:
        raise Malformed("a track without media header or sample table")
    a = box[b"mdhd"][0]
    t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    if b"hdlr" in box:
        a = box[b"hdlr"][0]
        t.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    a, b = box[b"stsd"]
    for kind, x, _ in walk(data, a + 8, b):
        t.codec = kind.decode("latin-1").strip()
        if t.handler == "vide":
            t.width, t.height = struct.unpack_from(">HH", data, x + 24)
        break
    t.offsets, t.sizes = _samples(data, box)
    if len(t.sizes) and ((t.offsets < 0) | (t.offsets + t.sizes > len(data))).any():
        raise Malformed("a sample lies outside the file")
    if b"stts" in box:
        a, b = box[b"stts"]
        runs = _table(data, a + 8, b, ">u4", 2, struct.unpack_from(">I", data, a + 4)[0])
        if runs[:, 0].sum() != len(t.sizes):
            raise Malformed("stts and the sample sizes disagree")
        t.duration = int((runs[:, 0] * runs[:, 1]).sum())
    if b"stss" in box:  # without it, every sample is a sync sample
        a, b = box[b"stss"]
        t.sync = _table(data, a + 8, b, ">u4", 1, struct.unpack_from(">I", data, a + 4)[0])[:, 0] - 1
        if len(t.sync) and (t.sync.min() < 0 or t.sync.max() >= len(t.sizes)):
            raise Malformed("a sync sample does not exist")
    else:
        t.sync = np.arange(len(t.sizes))
    return t


def _fragments(data: memoryview, top: list[tuple[bytes, int, int]], defaults: dict[int, tuple[int, int, int]], tracks: dict[int, Track]) -> None:
    """Adds the samples of movie fragments (moof, traf, trun) to their tracks; sync samples are those without the non-sync flag."""
    for kind, start, end in top:
        if kind != b"moof":
            continue
        for part, a, b in walk(data, start, end):
            if part != b"traf":
                continue
            boxes = list(walk(data, a, b))
            head = next((x for name, x, _ in boxes if name == b"tfhd"), None)
            if head is None:
                raise Malformed("a fragment without header")
            flags, track_id = struct.unpack_from(">II", data, head)
            flags &= 0xFFFFFF
            if track_id not in tracks:
                raise Malformed("a fragment of no track")
            at, values = head + 8, {}
            for bit, name, form in ((1, "base", ">Q"), (2, "entry", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                if flags & bit:
                    values[name] = struct.unpack_from(form, data, at)[0]
                    at += struct.calcsize(form)
            duration, size, sample_flags = (values.get(n, d) for n, d in zip(("duration", "size", "flags"), defaults.get(track_id, (0, 0, 0)), strict=True))
            # without a base, offsets count from the first byte of the moof box
            base = values.get("base", start - (16 if bytes(data[max(0, start - 16) : start - 8]) == b"\0\0\0\1moof" else 8))
            nxt = base
            for name, x, y in boxes:
                if name == b"trun":
                    nxt = _run(data, x, y, base, nxt, duration, size, sample_flags, tracks[track_id])


def _run(data: memoryview, x: int, y: int, base: int, nxt: int, duration: int, size: int, sample_flags: int, track: Track) -> int:
    """Adds one run of samples; returns where its bytes end."""
    flags, count = struct.unpack_from(">II", data, x)
    flags &= 0xFFFFFF
    at, first_flags = x + 8, None
    if flags & 1:
        nxt, at = base + struct.unpack_from(">i", data, at)[0], at + 4
    if flags & 4:
        first_flags, at = struct.unpack_from(">I", data, at)[0], at + 4
    present = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if not present and size * count > len(data):
        raise Malformed("more samples than the file can hold")
    if not present and not size and count > len(data):
        raise Malformed("more samples than the file can hold")
    table = dict(zip(present, _table(data, at, y, ">u4", len(present), count).T, strict=True)) if present else {}
    sizes = table.get("size", np.full(count, size, np.int64))
    kinds = table.get("flags", np.full(count, sample_flags, np.int64)).copy()
    if first_flags is not None and count:
        kinds[0] = first_flags
    track.sync = np.concatenate([track.sync, len(track.sizes) + np.flatnonzero(kinds & 0x10000 == 0)])
    track.offsets = np.concatenate([track.offsets, nxt + np.cumsum(sizes) - sizes])
    track.sizes = np.concatenate([track.sizes, sizes])
    track.duration += int(table.get("duration", np.full(count, duration, np.int64)).sum())
    if len(sizes) and (track.offsets[-count:].min() < 0 or (track.offsets[-count:] + sizes).max() > len(data)):
        raise Malformed("a sample lies outside the file")
    return nxt + int(sizes.sum())


def read_tracks(media: bytes) -> list[Track]:
    """All tracks of a file with a moov box, movie fragments included; raises Malformed otherwise."""
    data = memoryview(media)
    try:
        top = list(walk(data, 0, len(data)))
        moov = [(a, b) for kind, a, b in top if kind == b"moov"]
        if not moov:
            raise Malformed("no moov box")
        tracks = [_track(data, a, b) for kind, a, b in walk(data, *moov[0]) if kind == b"trak"]
        extends = [(a, b) for kind, a, b in walk(data, *moov[0]) if kind == b"mvex"]
        defaults = {}
        for a, b in extends:
            for kind, x, _ in walk(data, a, b):
                if kind == b"trex":
                    track_id, _, duration, size, flags = struct.unpack_from(">5I", data, x + 4)
                    defaults[track_id] = duration, size, flags
        _fragments(data, top, defaults, {t.track_id: t for t in tracks})
        return tracks
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise Malformed(str(e)) from e


def read_samples(media: bytes, track: Track) -> bytes:
    """The sample bytes of a track in order; adjoining samples are copied together."""
    return b"".join(media[a : a + n] for a, n in ranges(track.offsets, track.sizes))


def ranges(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges with those that adjoin joined."""
    if not len(offsets):
        return []
    new = np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1])
    total = np.add.reduceat(sizes, np.flatnonzero(new))
    return list(zip(offsets[new].tolist(), total.tolist(), strict=True))


# ---------------------------------------------------------------- operators


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and ``media``: each text's UTF-8 bytes, padded to whole frames, as an ISO media file."""

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in piece.column("text").cast(pa.binary())]
        return {"id": piece.column("id"), "n_bytes": [len(x) for x in texts], "media": [wrap(pad_payload(x)) for x in texts]}

    src = narrow(docs, id_col, text_col)
    return map_slices(src, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, media binary", fn).withColumnRenamed("id", id_col)


TRACK = "struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,width:int,height:int,n_samples:long,keyframes:array<struct<offset:long,size:long>>>"


def probe_media(df: DataFrame, media_col: str = "media", payload: bool = False) -> DataFrame:
    """Adds ``status``, ``tracks`` and ``media_digest`` to the rows of ``df``; with ``payload`` also what the stored samples of the first track hold.

    Columns of those names that ``df`` has already are replaced.
    """
    added = ["status", "tracks", "media_bytes", "media_sha256"] + ["payload_bytes", "payload_sha256", "tail_crc32"] * payload
    kept = [c for c in df.columns if c not in added and c != media_col]
    held = free_name(df, "__media")
    src = df.select(*kept, F.col(media_col).alias(held))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != held]
    schema = ", ".join([*fields, "status string", f"tracks array<{TRACK}>", "media_bytes long", "media_sha256 string"] + ["payload_bytes long", "payload_sha256 string", "tail_crc32 long"] * payload)

    def one(media: bytes | None) -> tuple:
        if media is None:
            return ("missing",) + (None,) * (3 + 3 * payload)
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            tracks = read_tracks(media)
        except Malformed:
            return ("malformed", [], *own) + (None,) * (3 * payload)
        rows = [
            {"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "width": t.width, "height": t.height, "n_samples": len(t.sizes),
             "keyframes": [{"offset": a, "size": n} for a, n in zip(t.offsets[t.sync].tolist(), t.sizes[t.sync].tolist(), strict=True)]}
            for t in tracks
        ]
        if not payload:
            return ("ok", rows, *own)
        data = read_samples(media, tracks[0]) if tracks else b""
        return ("ok", rows, *own, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        got = list(zip(*(one(x.as_buffer().to_pybytes() if x.is_valid else None) for x in piece.column(held)), strict=True))
        return {c: piece.column(c) for c in kept} | dict(zip(added, got, strict=True))

    return map_slices(src, schema, fn, held)


def media_query(docs: DataFrame) -> DataFrame:
    """The digest of ``documents``: each text stored as media, the stored bytes probed and read back."""
    t = F.element_at("tracks", 1)
    frames = F.transform(t["keyframes"], lambda k: F.concat_ws("+", k["offset"].cast("string"), k["size"].cast("string")))
    return probe_media(write_media(docs), payload=True).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(
            ";", F.concat(F.lit("codec="), t["codec"]), F.concat(F.lit("size="), t["width"].cast("string"), F.lit("x"), t["height"].cast("string")),
            F.concat(F.lit("duration="), t["duration"].cast("string"), F.lit("/"), t["timescale"].cast("string")),
            F.concat(F.lit("samples="), t["n_samples"].cast("string")), F.concat(F.lit("keyframes="), F.array_join(frames, ",")),
        ).alias("feature"),
    )
