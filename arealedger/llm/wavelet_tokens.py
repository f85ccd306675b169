"""Token ids in wavelet-matrix files: a bit plane for each bit of an id, with rank and select over each."""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, text_slices

#: Ids in a shard; a document's ids are never split, so one longer document makes a longer shard.
SHARD_IDS = 500_000
#: Bits to a rank, ones (or zeros) to a kept select.
BLOCK, SAMPLED = 512, 4096
MAGIC = b"WVM2"
SCHEMA = "part int, seq bigint, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, matrix binary"
_BYTES = BLOCK // 8


class Plane:
    """One bit of every id. ranks: ones before each block of 512 bits; samples: the block of each 4096th zero and one."""

    def __init__(self, n: int, zeros: int, ranks: np.ndarray, samples: tuple[np.ndarray, np.ndarray], packed: bytes):
        self.n, self.zeros, self.ranks, self.samples, self.packed = n, zeros, ranks, samples, packed

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        raw, blocks = np.packbits(bits), -(-len(bits) // BLOCK)
        padded = np.zeros(blocks * _BYTES, np.uint8)
        padded[: len(raw)] = raw
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BYTES // 8).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        starts = np.minimum(np.arange(blocks + 1) * BLOCK, len(bits))
        samples = tuple(np.searchsorted(r, np.arange(0, r[-1], SAMPLED), "right") - 1 for r in (starts - ranks, ranks))
        return cls(len(bits), int(len(bits) - ranks[-1]), ranks, samples, zstandard.ZstdCompressor(level=1).compress(padded.tobytes()))

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed), np.uint8)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.bytes, count=self.n).astype(bool)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the block's rank, and the bits of the block's bytes before it."""
        block = at // BLOCK
        rows = self.bytes.reshape(-1, _BYTES)[np.minimum(block, max(len(self.ranks) - 2, 0))] if len(self.bytes) else np.zeros((len(at), _BYTES), np.uint8)
        before = np.clip((at - block * BLOCK)[:, None] - 8 * np.arange(_BYTES)[None, :], 0, 8)
        inside = np.bitwise_count(rows & ((0xFF00 >> before) & 0xFF).astype(np.uint8)).sum(axis=1, dtype=np.int64)
        return self.ranks[block] + inside

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of each k-th (from 0) one or zero: its sample bounds the blocks, their ranks are halved down to one."""
        starts = np.minimum(np.arange(len(self.ranks)) * BLOCK, self.n)
        ranks, kept = (self.ranks if bit else starts - self.ranks), self.samples[bit]
        lo, hi = kept[k // SAMPLED], np.append(kept, len(self.ranks) - 2)[k // SAMPLED + 1] + 1
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            less = ranks[mid] <= k
            lo, hi = np.where(less, mid, lo), np.where(less, hi, np.maximum(mid, lo + 1))
        rows = self.bytes.reshape(-1, _BYTES)[lo]
        rows, left = (rows if bit else ~rows), k - ranks[lo]
        sums = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        byte = (sums <= left[:, None]).sum(axis=1)
        each = np.arange(len(k))
        left = left - np.where(byte > 0, sums[each, byte - 1], 0)
        inner = np.cumsum(np.unpackbits(rows[each, byte][:, None], axis=1), axis=1)
        return lo * BLOCK + 8 * byte + (inner <= left[:, None]).sum(axis=1)


class WaveletMatrix:
    """Succinct sequence of unsigned ints. A plane holds one bit of every id, highest bit first; ids with a 0 go, in
    order, before those with a 1 in the next plane. Queries take many places at once."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        now = ids.astype(np.uint32)
        bits = max(1, int(now.max()).bit_length()) if len(now) else 1
        now = now.astype(np.uint16) if bits <= 16 else now
        planes = []
        for k in range(bits - 1, -1, -1):
            b = (now & now.dtype.type(1 << k)) != 0
            planes.append(Plane.of(b))
            now = np.concatenate([now[~b], now[b]])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        """One file: sizes, each plane's rank and select directories, each plane compressed by itself."""
        kind = "<u4" if self.n < 1 << 32 else "<u8"
        out = [MAGIC, struct.pack("<QB", self.n, len(self.planes))]
        for p in self.planes:
            out += [struct.pack("<4Q", p.zeros, len(p.samples[0]), len(p.samples[1]), len(p.packed)), *[x.astype(kind).tobytes() for x in (p.ranks, *p.samples)], p.packed]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        """Reads the directories; a plane is decompressed when a query first needs it."""
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        n, bits = struct.unpack_from("<QB", raw, 4)
        at, kind, width, planes = 13, *(("<u4", 4) if n < 1 << 32 else ("<u8", 8)), []
        for _ in range(bits):
            zeros, n0, n1, size = struct.unpack_from("<4Q", raw, at)
            at, found = at + 32, []
            for k in (-(-n // BLOCK) + 1, n0, n1):
                found.append(np.frombuffer(raw, kind, k, at).astype(np.int64))
                at += k * width
            planes.append(Plane(n, zeros, found[0], (found[1], found[2]), raw[at : at + size]))
            at += size
        return cls(n, planes)

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.atleast_1d(np.asarray(at, np.int64)), 0
        for p in self.planes:
            b, r = p.bit(at), p.rank1(at)
            out, at = (out << 1) | b.astype(np.int64), np.where(b == 1, p.zeros + r, at - r)
        return out

    def _range(self, c: int, bounds: np.ndarray) -> np.ndarray:
        """Where places `bounds` of the sequence stand in the last order, among the ids equal to c."""
        top = len(self.planes) - 1
        for k, p in enumerate(self.planes):
            r = p.rank1(bounds)
            bounds = p.zeros + r if c >> (top - k) & 1 else bounds - r
        return bounds

    def count(self, c: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of id c at places start to end."""
        if c >> len(self.planes) or not self.n:
            return 0
        a, b = self._range(c, np.array([start, self.n if end is None else end], np.int64))
        return max(0, int(b - a))

    def select(self, c: int, k: np.ndarray) -> np.ndarray:
        """Places of the occurrences k (from 0) of id c, which must be there."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        if not len(k):
            return k
        first, last = self._range(c, np.array([0, self.n], np.int64)) if self.n and not c >> len(self.planes) else (0, 0)
        if (k < 0).any() or (first + k >= last).any():
            raise IndexError("no such occurrence")
        at = first + k
        for j, p in enumerate(reversed(self.planes)):
            bit = c >> j & 1
            at = p.select(bit, at - (p.zeros if bit else 0))
        return at

    def occurrences(self, c: int) -> np.ndarray:
        return self.select(c, np.arange(self.count(c)))

    def all(self) -> np.ndarray:
        """Every id, by undoing the planes from the last to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, p in enumerate(reversed(self.planes)):
            b = p.bits()
            back = np.empty_like(now)
            back[~b] = now[: p.zeros]
            back[b] = now[p.zeros :] | now.dtype.type(1 << k)
            now = back
        return now


def write_shards(docs: DataFrame, path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode documents in ascending doc_id order into wavelet-matrix shards; the table of shard files, read back.

    Range partitions follow doc_id (null first), then text hash and text, so the order of repeated ids is fixed and a
    much repeated id is spread; each partition writes its shards one after another, so a task holds one shard. Rows
    equal in all three are alike in every result. `ends` says the how-manieth end id of its shard ends each document.
    """
    keys = ["doc_id", "_hash"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        enc, seq, part = encoder(path), 0, 0
        ids, parts, sizes, n = [], [], [], 0

        def shard():
            whole = np.concatenate(parts)
            ends = (np.cumsum(whole == end_id) - 1)[np.cumsum(sizes) - 1]
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([WaveletMatrix.build(whole).to_bytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "n_ids", "doc_ids", "ends", "matrix"])

        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
            keys, col = b.column(1).to_pylist(), b.column(2)
            for lo, hi in text_slices(col):
                flat, own = enc.flat(col.slice(lo, hi - lo))
                flat, own = np.insert(flat, np.cumsum(own), end_id), own + 1
                ends, i, at = np.cumsum(own), 0, 0
                while i < len(own):
                    j = int(np.searchsorted(ends, at + shard_ids - n, "right"))
                    if j == i and n:
                        yield shard()
                        seq, ids, parts, sizes, n = seq + 1, [], [], [], 0
                        continue
                    j = max(j, i + 1)
                    ids += keys[lo + i : lo + j]
                    parts.append(flat[at : ends[j - 1]])
                    sizes += own[i:j].tolist()
                    n, i, at = n + int(ends[j - 1]) - at, j, int(ends[j - 1])
        if n:
            yield shard()

    return materialize(ordered.mapInArrow(run, SCHEMA), "wavelet-shards")


def read_shards(shards: DataFrame, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files: its bounds by select of the end id."""
    # Two levels again: partition totals, then shards within a partition.
    of_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(of_parts), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))

    def run(batches):
        for b in batches:
            for part, seq, ids, ends, raw in zip(*(b.column(i) for i in range(5)), strict=True):
                m = WaveletMatrix.from_bytes(raw.as_py())
                stops = m.select(end_id, ends.values.to_numpy(zero_copy_only=False)) + 1
                starts, data, k = np.append(0, stops[:-1]), memoryview(m.all().astype("<u4").tobytes()), len(stops)
                crcs = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int64()), pa.array(ids.values, pa.int64()), pa.array(starts), pa.array(stops - starts), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    # A shard is a megabyte or so: few of them go into one batch of the worker.
    rows = shards.select("part", "seq", "doc_ids", "ends", "matrix").mapInArrow(run, "part int, seq bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def wavelet_tokens(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write and read back: one row per document row.

    Null or empty texts hold the end id alone. doc_id is a bigint; null ones come first. Rows that repeat a doc_id go by text hash, then
    text (null first). Other columns of docs are not looked at; an empty table gives an empty one.
    """
    return read_shards(write_shards(docs, path, end_id), end_id)


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """(part, seq, n, places): how often and where an id stands in each shard, by rank and select alone."""

    def run(batches):
        for b in batches:
            for part, seq, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = WaveletMatrix.from_bytes(raw).occurrences(token)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": [seq], "n": [len(found)], "places": pa.array([found], pa.list_(pa.int64()))})

    return shards.select("part", "seq", "matrix").mapInArrow(run, "part int, seq bigint, n bigint, places array<bigint>")
