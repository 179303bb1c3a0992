import hashlib
import struct
import zlib

import pytest

from ledgerloom.llm import media as M
from .conftest import AWKWARD


def test_round_trip(awkward):
    rows = M.media_query(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r, text in ((r, dict_[1]) for r in rows for dict_ in AWKWARD if dict_[0] == r.doc_id):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) if len(raw) < 576 else -len(raw) % 576)
        assert r.n_bytes == len(raw) and r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(M.wrap(payload)).hexdigest()
        assert r.feature.startswith(f"codec=uncv;size=24x24;duration={len(payload) // 576}/25;samples={len(payload) // 576};keyframes=")
        # every frame is a keyframe; together they are the payload, which ends the file
        stored = M.wrap(payload)
        spans = [tuple(map(int, x.split("+"))) for x in r.feature.rpartition("=")[2].split(",")]
        assert spans == [(len(stored) - len(payload) + i, 576) for i in range(0, len(payload), 576)] and b"".join(stored[a : a + n] for a, n in spans) == payload


def test_empty(nothing):
    assert M.media_query(nothing).collect() == []


def _file(stbl: bytes, version: int = 0) -> bytes:
    mdhd = M._full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90000, 7), b"\0\0\0\0", version=1) if version else M._full(b"mdhd", struct.pack(">IIII", 0, 0, 90000, 7), b"\0\0\0\0")
    trak = M._box(b"trak", M._box(b"mdia", mdhd, M._full(b"hdlr", bytes(4), b"soun", bytes(13)), M._box(b"minf", M._box(b"stbl", stbl))))
    # a 64-bit box, a uuid box and a box to the end of the file
    return M._FTYP + struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + M._box(b"uuid", bytes(20)) + M._box(b"moov", trak) + struct.pack(">I4s", 0, b"mdat") + b"0123456789" * 5


def _stbl(sizes, chunks, runs, sync=None, wide=False):
    out = M._full(b"stsd", struct.pack(">I", 1), M._box(b"mp4a", bytes(28))) + M._full(b"stts", struct.pack(">III", 1, len(sizes), 1024))
    out += M._full(b"stsz", struct.pack(">II", 0, len(sizes)), b"".join(struct.pack(">I", s) for s in sizes)) + M._full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r, 1) for r in runs))
    out += M._full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), *(struct.pack(">Q" if wide else ">I", c) for c in chunks))
    return out + (M._full(b"stss", struct.pack(">I", len(sync)), *(struct.pack(">I", s) for s in sync)) if sync else b"")


@pytest.mark.parametrize("wide", [False, True])
def test_tables(wide):
    base = len(_file(_stbl([1] * 5, [0, 0, 0], [(1, 2), (3, 1)], [1, 4], wide), int(wide))) - 50
    data = _file(_stbl([3, 4, 5, 2, 6], [base, base + 20, base + 30], [(1, 2), (3, 1)], [1, 4], wide), int(wide))
    (t,) = M.read_tracks(data)
    assert (t.codec, t.handler, t.timescale, t.duration) == ("mp4a", "soun", 90000, 5 * 1024)
    assert t.offsets.tolist() == [base, base + 3, base + 20, base + 25, base + 30] and t.sync.tolist() == [0, 3]
    assert M.read_samples(data, t) == data[base : base + 7] + data[base + 20 : base + 27] + data[base + 30 : base + 36]


def test_malformed(spark):
    good = M.wrap(M.pad_payload(b"hello"))
    assert M.read_samples(good, M.read_tracks(good)[0])[:5] == b"hello"
    files = [(0, good), (1, None), (2, b""), (3, good[: len(good) // 2]), (4, b"no media at all"), (5, good.replace(b"stsz", b"stzz")), (6, good[:-300])]
    got = {r.i: (r.status, r.tracks, r.kept) for r in M.probe_media(spark.createDataFrame([(i, bytearray(f) if f is not None else None, "x", "y") for i, f in files], "i int, media binary, status string, kept string"), payload=True).collect()}
    assert got[0][0] == "ok" and got[0][1][0].n_samples == 1 and got[1][0] == "missing"
    assert all(got[i][0] == "malformed" and got[i][1] == [] for i in (2, 3, 4, 5, 6)) and got[0][2] == "y"


def test_sizes_beyond_the_file():
    """A fixed sample size with a huge count is refused before anything is allocated."""
    huge = _stbl([], [0], [(1, 1)]).replace(M._full(b"stsz", struct.pack(">II", 0, 0)), M._full(b"stsz", struct.pack(">II", 7, 2**32 - 1)))
    with pytest.raises(M.Malformed):
        M.read_tracks(_file(huge))


def _fragmented(base_given: bool, first_flags: int | None) -> tuple[bytes, int]:
    trex = M._full(b"trex", struct.pack(">5I", 1, 1, 10, 4, 0x10000))
    mdhd = M._full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), b"\0\0\0\0")
    stbl = M._full(b"stsd", struct.pack(">I", 1), M._box(b"mp4a", bytes(28))) + M._full(b"stts", struct.pack(">I", 0)) + M._full(b"stsz", struct.pack(">II", 0, 0)) + M._full(b"stss", struct.pack(">I", 0))
    trak = M._box(b"trak", M._full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 0)), M._box(b"mdia", mdhd, M._full(b"hdlr", bytes(4), b"soun", bytes(13)), M._box(b"minf", M._box(b"stbl", stbl))))
    lead = M._FTYP + M._box(b"moov", trak, M._box(b"mvex", trex))

    def moof(offset: int) -> bytes:
        tfhd = M._full(b"tfhd", struct.pack(">I", 1), struct.pack(">Q", len(lead)) if base_given else b"", flags=1 if base_given else 0x20000)
        # sizes are listed in the first run, durations in the second, which follows the first
        one = M._full(b"trun", struct.pack(">Ii", 3, offset), struct.pack(">I", first_flags) if first_flags is not None else b"", struct.pack(">III", 2, 3, 5), flags=0x201 | (4 if first_flags is not None else 0))
        two = M._full(b"trun", struct.pack(">III", 2, 7, 8), flags=0x100)
        return M._box(b"moof", M._full(b"mfhd", struct.pack(">I", 1)), M._box(b"traf", tfhd, one, two))

    at = len(moof(0)) + 8
    return lead + moof(at) + M._box(b"mdat", bytes(range(18))), len(lead) + at


@pytest.mark.parametrize("base_given", [False, True])
@pytest.mark.parametrize("first_flags", [None, 0])
def test_fragments(base_given, first_flags):
    """Samples of movie fragments: listed and default sizes, durations and flags, and a second run behind the first."""
    data, at = _fragmented(base_given, first_flags)
    (t,) = M.read_tracks(data)
    assert t.sizes.tolist() == [2, 3, 5, 4, 4] and t.offsets.tolist() == [at, at + 2, at + 5, at + 10, at + 14]
    assert t.duration == 3 * 10 + 7 + 8 and t.sync.tolist() == ([0] if first_flags == 0 else [])
    assert M.read_samples(data, t) == bytes(range(18))
    with pytest.raises(M.Malformed):
        M.read_tracks(data[:-20] + M._box(b"free", bytes(4)))
