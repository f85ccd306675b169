"""SimHash near-duplicate groups: Golay-code fuzzy keys, pigeonholed segments, join and verify."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .shingle_groups import LEAST, WORDS, keep_one
from .tokens import in_slices

#: Generator polynomial of the binary [23, 12, 7] Golay code.
GENERATOR = 0xAE3
#: (lowest bit, width) of a fingerprint's segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints under one key beyond which the one-flip meeting points link them instead of their pairs.
PAIRED = 64


def _remainder(v: int) -> int:
    for b in range(22, 10, -1):
        if v >> b & 1:
            v ^= GENERATOR << (b - 11)
    return v


class Golay:
    """Nearest codeword index of 23-bit words, vectorised."""

    def __init__(self):
        self.part = [np.array([_remainder(x << s) for x in range(256 if s < 16 else 128)], np.int64) for s in (0, 8, 16)]
        self.error = np.zeros(2048, np.int64)
        for k in range(4):
            for bits in combinations(range(23), k):
                e = sum(1 << b for b in bits)
                self.error[_remainder(e)] = e

    def decode(self, v: np.ndarray) -> np.ndarray:
        s = self.part[0][v & 255] ^ self.part[1][v >> 8 & 255] ^ self.part[2][v >> 16 & 127]
        return (v ^ self.error[s]) >> 11

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): indices of the codewords nearest to v and to each word one bit away, each once.

        There are one to six. Two words at distance 2 or less have a word within one bit of both, so they share one.
        """
        flips = np.array([0, *(1 << b for b in range(23))], np.int64)
        found = np.sort(self.decode(v[:, None] ^ flips[None, :]), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        row, col = np.nonzero(first)
        return row, found[row, col]


def fingerprint(text: str) -> int:
    """64-bit SimHash of 3-word shingles, repeats included; 0 without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only; splits at \x20 \x09-\x0d
    if not w:
        return 0
    s = [b" ".join(x) for x in zip(w, w[1:], w[2:])] if len(w) > 2 else [b" ".join(w)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 16):
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s[i : i + (1 << 16)]), "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(s), bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """df with a bigint SimHash of each whole text (null: empty; no words: 0).

    Rows and other columns stay as they are; `to` has to be a name that df doesn't have; an empty table stays empty.
    """
    out = df.select("*", F.lit(0).cast("long").alias(to)).schema

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            hashes = []
            for _, part in in_slices([None] * len(col), col.to_pylist()):
                hashes += [fingerprint(t) for t in part]
            a = pa.array(np.array(hashes, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, a], names=[*b.schema.names, to])

    return df.mapInArrow(run, out)


def _keys(fps: DataFrame) -> DataFrame:
    """(fp, key): an exact segment with a Golay index of the next one.

    Two differing bits leave one of three segments exact, and the next has at most two of them, so it shares an index.
    """

    def run(batches):
        code = Golay()
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seg = [(v >> lo) & ((1 << w) - 1) for lo, w in SEGMENTS]
            for s in range(3):
                row, index = code.keys(seg[(s + 1) % 3])
                yield pa.RecordBatch.from_arrays([pa.array(v[row]), pa.array((s << 40) | (seg[s][row] << 12) | index)], names=["fp", "key"])

    return fps.mapInArrow(run, "fp bigint, key bigint")


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) at 2 or fewer differing bits, enough for all components.

    Under a key of up to `paired` fingerprints every pair is verified. A larger bucket would square, so each of its
    fingerprints goes to the 65 words within one bit, and those that meet at a word link to the smallest there: two
    fingerprints meet exactly if they differ in 2 bits or fewer. No bucket is cut.
    """
    keys = materialize(_keys(fps), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keys.join(sizes, "key"), "simhash-shared")
    small = shared.where(F.col("n") <= paired).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    large = shared.where(F.col("n") > paired).select("fp").distinct()
    words = large.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("word"))
    meets = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    return pairs.union(words.join(meets, "word").where("a <> fp").select("a", F.col("fp").alias("b"))).distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for rows (doc_id, fp): the smallest doc_id reachable over links of 2 or fewer bits.

    Null doc_ids count only where a component has no other: its component_id is null then. Equal fingerprints are
    one node. An empty table gives an empty one.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")), "simhash-edges")
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(ids, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Null and empty texts, and such without words, have fingerprint zero and are linked like any other. Repeated rows each keep
    their row, null doc_ids count only where a component has no other; other columns are not looked at; an empty table gives
    an empty one. Rows meet their fingerprint's component by a join on the fingerprint: a hot one (empty texts, copies) has one
    row on the other side, and Spark splits its partition while it joins.
    """
    prints = materialize(with_fingerprint(docs.select("doc_id", "text"), to="fp").select("doc_id", "fp"), "simhash-prints")
    out = prints.join(components(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, fp) whose fingerprints differ in 2 bits or fewer: a node with the least one of its own fingerprint,
    and that one with the one of the smallest fingerprint that `links` joins to its own. So there is about a pair for each node."""
    nodes = materialize(nodes, "simhash-near")
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("b"))
    same = nodes.join(firsts, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    next_to = links(firsts.select("fp")).groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("to"))
    own = next_to.join(firsts.withColumnRenamed("b", "a"), "fp")
    return same.union(own.select("a", F.col("to").alias("fp")).join(firsts, "fp").select("a", "b"))


def keep_one_per_group(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id (among equal ids, one).

    Documents whose fingerprints meet under op8's Golay keys at 2 bits or fewer are verified first, by exact shingle likeness,
    `least` or more over `words` words. Most such copies differ in 3 to 11 bits, so those that the keys miss are found exactly,
    by the shingles themselves.
    """
    return keep_one(docs, words, least, fingerprint, near_pairs)
