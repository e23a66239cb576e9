"""Media columns: ISO base media containers, written and read box by box.

A payload is stored as one track of 8-bit samples, in access units of 64 bytes,
some of them keyframes. Reading walks the nested boxes, decodes the sample tables and
yields codec, duration and the byte ranges of keyframes. Payload bytes are
located and copied, never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import texts
from .common import table

#: Bytes of an access unit; units between keyframes; units of a chunk; 8-bit samples a second.
UNIT, KEY_EVERY, CHUNK_UNITS, RATE = 64, 16, 32, 8000
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")
_HDLR = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0")
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_STSD = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def build(payload: bytes) -> bytes:
    """A container that stores ``payload``, whose length is a positive multiple of the unit."""
    units, rest = divmod(len(payload), UNIT)
    if rest or not units:
        raise ValueError("the payload must be a positive multiple of the unit")
    chunks, last = -(-units // CHUNK_UNITS), (units - 1) % CHUNK_UNITS + 1
    runs = [(1, min(units, CHUNK_UNITS), 1)]
    if chunks > 1 and last != CHUNK_UNITS:
        runs.append((chunks, last, 1))
    keys = range(1, units + 1, KEY_EVERY)
    duration = units * UNIT
    wide = len(payload) >= 1 << 31

    def moov(base: int) -> bytes:
        offsets = range(base, base + len(payload), CHUNK_UNITS * UNIT)
        stbl = _box(
            b"stbl",
            _STSD,
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        mdia = _box(b"mdia", _full(b"mdhd", bytes(8), struct.pack(">IIHH", RATE, duration & 0xFFFFFFFF, 0x55C4, 0)), _HDLR, _box(b"minf", _full(b"smhd", bytes(4)), _DINF, stbl))
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, duration & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(_FTYP) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return b"".join((_FTYP, moov(head), _box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """``(path, begin, end)`` of the body of every box, in order; a box that overruns what holds it is an error."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} overruns what holds it")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


@dataclass(frozen=True)
class Track:
    codec: str
    timescale: int
    duration: int
    samples: int
    #: (offset, length) of each sync sample, and of each run of samples that lie on end in the file, in decoding order.
    keyframes: list[tuple[int, int]]
    runs: list[tuple[int, int]]


def probe(data: bytes) -> Track:
    """The first track."""
    return tracks(data)[0]


def tracks(data: bytes) -> list[Track]:
    """All tracks, each from the tables in its own box; optional tables that one lacks are not taken from another."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path:
            found[-1].setdefault(path[-1], (a, b))
    if not found:
        raise ValueError("no track")
    return [_track(data, boxes) for boxes in found]


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    if missing := {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - boxes.keys():
        raise ValueError(f"no box {sorted(missing)}")
    at = lambda kind, fmt, skip=4: struct.unpack_from(fmt, data, boxes[kind][0] + skip)
    wide = data[boxes[b"mdhd"][0]] == 1
    timescale = at(b"mdhd", ">I", 20 if wide else 12)[0]
    codec = at(b"stsd", ">4s", 12)[0].decode("latin-1")
    fixed, count = at(b"stsz", ">II")
    sizes = [fixed] * count if fixed else list(at(b"stsz", f">{count}I", 12))
    n = at(b"stts", ">I")[0]
    times = at(b"stts", f">{2 * n}I", 8)
    duration = sum(a * b for a, b in zip(times[::2], times[1::2]))
    co = b"co64" if b"co64" in boxes else b"stco"
    chunks = at(co, ">I")[0]
    offsets = at(co, f">{chunks}{'Q' if co == b'co64' else 'I'}", 8)
    n = at(b"stsc", ">I")[0]
    table_ = at(b"stsc", f">{3 * n}I", 8)
    firsts = [*table_[::3], chunks + 1]
    places, runs, k = [], [], 0
    for i in range(n):
        for c in range(firsts[i] - 1, firsts[i + 1] - 1):
            place = begin = offsets[c]
            for size in sizes[k : k + table_[3 * i + 1]]:
                places.append(place)
                place += size
            k += table_[3 * i + 1]
            if runs and sum(runs[-1]) == begin:
                runs[-1] = (runs[-1][0], place - runs[-1][0])
            else:
                runs.append((begin, place - begin))
    if len(places) != count:
        raise ValueError("sample tables disagree")
    n = at(b"stss", ">I")[0] if b"stss" in boxes else count
    keys = at(b"stss", f">{n}I", 8) if b"stss" in boxes else range(1, n + 1)
    return Track(codec, timescale, duration, count, [(places[x - 1], sizes[x - 1]) for x in keys], runs)


def payload(data: bytes, track: Track) -> bytes:
    return b"".join(data[a : a + n] for a, n in track.runs)


def padded(text: bytes) -> bytes:
    """``text`` and zero bytes up to a positive multiple of the unit."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def feature(track: Track) -> str:
    keys = ",".join(f"{a}+{n}" for a, n in track.keyframes)
    return f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={track.samples};keyframes={keys}"


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text, null as empty, in a container. Rows that repeat give equal rows."""

    def write(batches):
        for batch in batches:
            codes, offsets = texts(batch.column(1))
            raw, ends = codes.tobytes(), offsets.tolist()
            at = 0
            while at < len(ends) - 1:
                end = at + 1  # some MB at a time, however long a text is
                while end < len(ends) - 1 and ends[end + 1] - ends[at] < 4 << 20:
                    end += 1
                media = [build(padded(raw[ends[i] : ends[i + 1]])) for i in range(at, end)]
                sizes = [ends[i + 1] - ends[i] for i in range(at, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                at = end

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(write, "doc_id bigint, n_bytes bigint, media binary")


_PROBED = "doc_id bigint, n_bytes bigint, codec string, timescale bigint, duration bigint, samples bigint, keyframes array<struct<offset:bigint,length:bigint>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def probed(media: DataFrame) -> DataFrame:
    """What the containers in ``(doc_id, n_bytes, media)`` say, and digests of the payloads read back. A broken container is an error."""
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def read(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2):
                data = data.as_py()
                track = probe(data)
                body = payload(data, track)
                rows.append((track.codec, track.timescale, track.duration, track.samples, [{"offset": a, "length": n} for a, n in track.keyframes], len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)))
            columns = list(zip(*rows)) if rows else [()] * 11
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in _PROBED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, _PROBED)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    out = probed(stored(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
