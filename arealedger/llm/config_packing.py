"""Packing token sequences by the configuration linear program over the length histogram.

The program is solved by multiplicative weights with knapsack dynamic-programming prices, then rounded; only the
histogram, of at most `size` rows, is looked at outside Spark.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_totals
from .tokens import CACHE_PIECES, encoder, let_go, text_slices, trimmed

#: The program ends once every length is covered so many times over (the result is scaled), or after ROUNDS rounds.
PASSES, ROUNDS = 2, 400
#: How fast a covered length loses its weight, and how far over the least covered one it still counts.
RATE, SLACK = 0.5, 1.0
#: A round raises up to FAN patterns whose value is within NEAR of the best one's.
FAN, NEAR = 32, 0.02
#: Bytes of text whose ids are put together at once.
SLICE = 1_500_000
#: Times the program is solved, each time for what rounding left.
RESOLVES = 4
#: Parts of a rounding after each of which the closing is tried.
PARTS = 4


class Knapsack:
    """Unbounded knapsack by dynamic programming: best[c] is the most value that capacity c holds.

    Among patterns of equal value the one with longer items is taken, so short ones stay for later.
    """

    def __init__(self, value: np.ndarray, size: int):
        lengths = np.flatnonzero(value > 0)[::-1].copy()
        v, self.best, self.choice = value[lengths], np.zeros(size + 1), np.zeros(size + 1, np.int64)
        firsts = len(lengths) - np.searchsorted(lengths[::-1], np.arange(size + 1), side="right")
        for c in range(1, size + 1):
            k = firsts[c]
            self.best[c] = self.best[c - 1]
            if k < len(lengths):
                tried = self.best[c - lengths[k:]] + v[k:]
                j = int(tried.argmax())
                if tried[j] > self.best[c] + 1e-12:
                    self.best[c], self.choice[c] = tried[j], lengths[k + j]

    def pattern(self, c: int) -> dict[int, int]:
        """length -> count of a best filling of capacity c."""
        out: dict[int, int] = {}
        while c > 0:
            length = int(self.choice[c])
            if length:
                out[length] = out.get(length, 0) + 1
            c -= length or 1
        return out


def program(n: np.ndarray, size: int, passes: int = PASSES, rounds: int = ROUNDS) -> tuple[dict[tuple, float], np.ndarray, float]:
    """(x, covered, bound) of the covering program min sum(x), sum(pattern * x) >= n, by multiplicative weights.

    x: weight of each pattern, a sorted tuple of (length, count). covered: how many times over x covers each length. A
    length's price falls by the factor exp(-RATE) for each time it is covered, from a start that grows with the length;
    lengths over SLACK times better covered than the worst one have no price. Each round runs the knapsack once and
    reads from its table the best pattern with each of the worst covered lengths. bound: the largest value of the dual that
    prices gave, each scaled so that no pattern is worth more than 1; no packing takes fewer sequences.
    """
    used = np.flatnonzero(n)
    covered, x = np.zeros(size + 1), {}
    bound = float(n @ np.arange(size + 1)) / size
    for _ in range(rounds):
        low = covered[used].min()
        if low >= passes:
            break
        live = used[covered[used] <= low + SLACK]
        price = np.zeros(size + 1)
        price[live] = live * (1 + live / size) * np.exp(-RATE * (covered[live] - low))
        table = Knapsack(price, size)
        bound = max(bound, float(price @ n) / table.best[size])
        near = live[price[live] + table.best[size - live] >= (1 - NEAR) * table.best[size]]
        for length in near[np.lexsort((-near, np.round(covered[near], 1)))][:FAN].tolist():
            p = table.pattern(size - length)
            p[length] = p.get(length, 0) + 1
            if any(covered[a] > low + SLACK for a in p):
                continue
            step = min(float(n[a]) / k for a, k in p.items())
            key = tuple(sorted(p.items()))
            x[key] = x.get(key, 0.0) + step
            for a, k in p.items():
                covered[a] += k * step / n[a]
    return x, covered, bound


def fill(left: np.ndarray, first: int, size: int) -> np.ndarray:
    """A sequence with one item of length `first` and the fullest choice of what is left (bounded subset sum)."""
    pattern = np.zeros(size + 1, np.int64)
    pattern[first] = 1
    reach = np.full(size - first + 1, -1, np.int64)  # the last length that brought a sum within reach
    reach[0] = 0
    for length in np.flatnonzero(left)[::-1]:
        n = int(left[length]) - (1 if length == first else 0)
        for _ in range(min(n, (size - first) // int(length))):
            new = np.flatnonzero((reach[length:] < 0) & (reach[: len(reach) - length] >= 0)) if length < len(reach) else ()
            if not len(new):
                break
            reach[new + length] = length
        if reach[-1] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        pattern[reach[at]] += 1
        at -= int(reach[at])
    return pattern


def best_fit(left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Best fit, longest first, over counts: sequences that look alike are one group, so equal items move at once."""
    groups: dict[int, dict[bytes, int]] = {}  # free ids -> pattern -> sequences

    def put(free: int, p: np.ndarray, n: int) -> None:
        if n:
            own = groups.setdefault(free, {})
            own[p.tobytes()] = own.get(p.tobytes(), 0) + n

    for length in map(int, np.flatnonzero(left)[::-1]):
        n = int(left[length])
        for free in sorted(f for f in groups if f >= length):
            each = free // length
            for key, have in sorted(groups[free].items()):
                if not n:
                    break
                p = np.frombuffer(key, np.int64)
                for take, times in ((each, min(have, n // each)), (n % each, 1)):
                    if take and times and n >= take and groups[free].get(key, 0) >= times and (take == each or n < each):
                        more = p.copy()
                        more[length] += take
                        groups[free][key] -= times
                        put(free - take * length, more, times)
                        n -= take * times
                if not groups[free][key]:
                    del groups[free][key]
            if not groups[free]:
                del groups[free]
        each = size // length
        for take, times in ((each, n // each), (n % each, 1)):
            if take:
                p = np.zeros(size + 1, np.int64)
                p[length] = take
                put(size - take * length, p, times)
    return [(np.frombuffer(k, np.int64), n) for own in groups.values() for k, n in own.items()]


def fullest(left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Each time the longest item left with the fullest choice of the others."""
    left, out = left.copy(), []
    while left.any():
        p = fill(left, int(np.flatnonzero(left)[-1]), size)
        k = int((left[p > 0] // p[p > 0]).min())
        out.append((p, k))
        left = left - p * k
    return out


@dataclass
class Plan:
    """patterns: (length -> count, times); program: sequences that come from the program; bound: no packing has fewer."""

    patterns: list[tuple[dict[int, int], int]]
    program: int
    bound: float

    @property
    def sequences(self) -> int:
        return sum(k for _, k in self.patterns)


def closed(left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """What is left, packed longest first: by best fit, or by fullest choice where there is little and that takes fewer."""
    ways = [best_fit(left, size)] + ([fullest(left, size)] if left.sum() < 1500 else [])
    return min(ways, key=lambda ps: sum(k for _, k in ps))


def solve(counts: dict[int, int], size: int, resolves: int = RESOLVES) -> Plan:
    """Patterns that use each length exactly as often as counts says, in as few sequences as it can.

    The program's x is scaled so that no length is used more often than it occurs, and its patterns that fill a sequence are
    rounded, as far as items last; what is left is a smaller program, solved again, up to `resolves` times. The rest is
    closed longest first. Rounding can go too far, so after each of PARTS parts of it the closing is tried, and the end
    with the fewest sequences in all is kept, the last among equals.
    """
    left = np.zeros(size + 1, np.int64)
    for length, k in counts.items():
        left[length] = k
    taken: list[tuple[dict[int, int], int]] = []
    rest = closed(left, size)
    best, bound = (sum(k for _, k in rest), 0, rest), 0.0
    for step in range(resolves):
        if not left.any():
            break
        x, covered, found = program(left, size)
        bound = found if step == 0 else bound
        scaled = [(key, int(times / covered.max() + 0.5)) for key, times in sorted(x.items(), key=lambda kv: (-kv[1], kv[0])) if sum(a * c for a, c in key) == size]
        whole, seen, part = sum(times for _, times in scaled), 0, 1
        for key, times in scaled:
            k = min(times, *(int(left[a]) // c for a, c in key))
            if k > 0:
                for a, c in key:
                    left[a] -= c * k
                taken.append((dict(reversed(key)), k))
            seen += times
            if times and seen * PARTS >= whole * part:
                part, rest = part + 1, closed(left, size)
                total = sum(k for _, k in taken) + sum(k for _, k in rest)
                if total <= best[0]:
                    best = (total, len(taken), rest)
    patterns = taken[: best[1]] + [({int(i): int(p[i]) for i in np.flatnonzero(p)[::-1]}, k) for p, k in best[2]]
    return Plan(patterns, sum(k for _, k in taken[: best[1]]), bound)


def pieces(docs: DataFrame, path: str, end_id: int, size: int, kept: int = CACHE_PIECES, most: int = SLICE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents in pieces of at most `size` ids, the first one shorter."""

    def run(batches):
        enc = encoder(path, kept)
        for b in batches:
            keys, col = b.column(0).to_pylist(), b.column(1)
            for lo, hi in text_slices(col, most):
                ids, own = enc.flat(col.slice(lo, hi - lo))
                raw, at, rows = memoryview(np.insert(ids, np.cumsum(own), end_id).astype("<u4").tobytes()), 0, []
                for key, n in zip(keys[lo:hi], (own + 1).tolist(), strict=True):
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    rows += [(key, k, a, z - a, zlib.crc32(raw[4 * (at + a) : 4 * (at + z)])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
                    at += n
                doc, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            let_go()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(items: DataFrame, size: int, order: tuple[str, ...]) -> DataFrame:
    """items (column length, 1 to size) with sequence_id and offset.

    Only the histogram, of at most `size` rows, comes to the driver. Items take places by their rank among equal
    lengths, so the plan is a table of rank intervals (a few for each pattern and length) and any number of items
    is placed by one join.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(size, 0)
    taken, base, plan = {}, full, [(size, 0, full, 0, 1, 0)] if full else []
    for pattern, times in solve(counts, size).patterns:
        at = 0
        for length, each in pattern.items():
            first = taken.get(length, 0)
            taken[length] = first + each * times
            plan.append((length, first, taken[length], base, each, at))
            at += each * length
        base += times
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "_length bigint, _from bigint, _to bigint, _base bigint, _each bigint, _at bigint")
    ranked = running_totals(items.withColumn("_one", F.lit(1)), ["length"], list(order), {"_rank": "_one"}, "packing-ranks")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    inside = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(table), on).select(*items.columns, (F.col("_base") + F.floor(inside / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_at") + F.pmod(inside, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, kept: int = CACHE_PIECES, most: int = SLICE) -> DataFrame:
    """One row per piece of each document row (doc_id of bigint); an empty or null text is a piece of the end id alone.

    Rows that repeat a doc_id are packed as documents of their own; pieces of equal length are interchangeable, so which
    of them stands where follows doc_id (null first), piece and checksum. Other columns are not looked at. `kept` pieces of text
    that a worker knows and `most` bytes encoded at once trade time for memory and change no result.
    """
    cut = materialize(pieces(docs, path, end_id, size, kept, most), "packing-pieces")
    return pack(cut, size, ("doc_id", "piece", "ids_crc32"))
