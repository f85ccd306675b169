"""ISO media containers: write texts as sample tracks, walk nested boxes, index codec, duration and keyframe bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import in_slices

#: Bytes of an access unit, access units in a chunk, access units from one sync sample to the next, samples a second.
UNIT, CHUNK, SYNC, RATE = 192, 32, 16, 8000
#: Boxes that hold only boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: The 3x3 unity matrix of track and movie headers.
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(raw: bytes) -> bytes:
    """raw with bytes 32 up to a positive multiple of 192."""
    return raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def write_container(payload: bytes) -> bytes:
    """An audio file with one track of uncompressed 8-bit samples, 192 to an access unit, chunks in file order."""
    units = len(payload) // UNIT
    sizes = [min(CHUNK, units - i) for i in range(0, units, CHUNK)]
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")

    def moov(at: int) -> bytes:
        runs = [(i + 1, n) for i, n in enumerate(sizes) if i == 0 or n != sizes[i - 1]]
        offsets = [at + i * CHUNK * UNIT for i in range(len(sizes))]
        syncs = range(1, units + 1, SYNC)
        wide = bool(offsets) and offsets[-1] >= 1 << 32
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(f">I{len(syncs)}I", len(syncs), *syncs)),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", c, n, 1) for c, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
        )
        ticks = units * UNIT
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), box(b"minf", full(b"smhd", bytes(4)), dinf, stbl))
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), UNITY, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, ticks, 0x10000, 256), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(head) + box(b"mdat", payload)


def walk(raw: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, body end) of every box, depth first; 64-bit and to-the-end sizes are followed."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind, head = *struct.unpack_from(">I4s", raw, start), 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        stop = end if size == 0 else start + size
        if stop > end or stop < start + head:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield (*path, kind), start + head, stop
        if kind in NESTS:
            yield from walk(raw, start + head, stop, (*path, kind))
        start = stop


def _table(raw: bytes, at: int, end: int, form: str) -> list[tuple]:
    n, size = struct.unpack_from(">I", raw, at)[0], struct.calcsize(">" + form)
    if at + 4 + n * size > end:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(">" + form, raw[at + 4 : at + 4 + n * size]))


def tracks(raw: bytes) -> list[dict]:
    """Each track's codec, handler, timescale, duration and samples as (offset, size, sync): no payload is decoded."""
    out: list[dict] = []
    for path, a, b in walk(raw):
        kind = path[-1]
        if kind == b"trak":
            out.append({"codec": "", "handler": "", "timescale": 0, "duration": 0, "stts": [], "stsc": [], "sizes": [], "offsets": [], "sync": None})
        if not out or b"trak" not in path:
            continue
        t, at = out[-1], a + 4
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if raw[a] else ">II", raw, a + (20 if raw[a] else 12))
        elif kind == b"hdlr":
            t["handler"] = raw[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = raw[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _table(raw, at, b, "II")
        elif kind == b"stsc":
            t["stsc"] = _table(raw, at, b, "III")
        elif kind == b"stss":
            t["sync"] = {x[0] for x in _table(raw, at, b, "I")}
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", raw, at)
            t["sizes"] = [size] * n if size else [x[0] for x in _table(raw, at + 4, b, "I")]
        elif kind in (b"stco", b"co64"):
            t["offsets"] = [x[0] for x in _table(raw, at, b, "I" if kind == b"stco" else "Q")]
    for t in out:
        t["samples"] = _samples(t)
    return out


def _samples(t: dict) -> list[tuple[int, int, bool]]:
    out, k = [], 0
    runs = [*t["stsc"], (len(t["offsets"]) + 1, 0, 0)]
    for (first, each, _), (until, _, _) in zip(runs, runs[1:], strict=False):
        for chunk in range(first, until):
            at = t["offsets"][chunk - 1]
            for _ in range(min(each, len(t["sizes"]) - k)):
                out.append((at, t["sizes"][k], t["sync"] is None or k + 1 in t["sync"]))
                at += t["sizes"][k]
                k += 1
    return out


def payload_of(raw: bytes, track: dict) -> bytes:
    """A track's bytes, by its sample table; neighbouring samples are read at once."""
    parts, start, stop = [], 0, 0
    for at, size, _ in track["samples"]:
        if at != stop:
            parts.append(raw[start:stop])
            start = at
        stop = at + size
    return b"".join([*parts, raw[start:stop]])


def describe(raw: bytes) -> str:
    """codec, seconds, number of keyframes and their byte ranges, one track after another."""
    out = []
    for t in tracks(raw):
        keys = [f"{at}-{at + size}" for at, size, sync in t["samples"] if sync]
        seconds = t["duration"] / t["timescale"] if t["timescale"] else 0.0
        out.append(f"codec={t['codec'].strip()};handler={t['handler']};seconds={seconds:.3f};samples={len(t['samples'])};keyframes={len(keys)};ranges={','.join(keys)}")
    return "|".join(out)


def media_index(df: DataFrame, media: str = "media", to: str = "media_index") -> DataFrame:
    """df with an array of a struct for each track of a container: codec, handler, seconds, samples, keyframes.

    A null or malformed container gives null. Rows and other columns stay as they are; a column named `to` is replaced; an
    empty table stays empty.
    """
    @F.pandas_udf("array<struct<codec: string, handler: string, seconds: double, samples: bigint, keyframes: array<struct<start: bigint, end: bigint>>>>")
    def index(s: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return [{"codec": t["codec"].strip(), "handler": t["handler"], "seconds": t["duration"] / t["timescale"] if t["timescale"] else 0.0, "samples": len(t["samples"]), "keyframes": [{"start": a, "end": a + n} for a, n, k in t["samples"] if k]} for t in tracks(bytes(raw))]
            except (ValueError, IndexError, struct.error, TypeError):
                return None

        return s.map(lambda raw: None if raw is None else one(raw))

    return df.withColumn(to, index(media))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty), padded, as an ISO media file."""

    def run(batches):
        for b in batches:
            for ids, texts in in_slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_container(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """The stored files' digests: payload read back by the sample tables, and what the tables say."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for key, n, media in zip(*(b.column(i) for i in range(3)), strict=True):
                raw = media.as_py()
                data = payload_of(raw, tracks(raw)[0])
                rows.append((key.as_py(), n.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(raw)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stored.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every document and read it back; one row per document row, an empty text has one unit of blanks.

    A null text counts as empty; null and repeated doc_ids (of bigint, as the query's) keep a row each; other columns are not
    looked at; an empty table gives an empty one. No row is shuffled, so copies of a text are no hot group.
    """
    return read_media(store_texts(docs))
