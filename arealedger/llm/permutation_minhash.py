"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, materialize

#: Bins (a power of two, so many of the hash's bits name the bin), kept bits of a bin, words in a shingle.
BINS, BITS, WORDS = 128, 8, 5
SPACE = r"[\x20\x09-\x0D]+"
_LOW = 56  # bits below the bin's name in a 63-bit hash
_PER = 64 // BITS  # bins in a packed long


def shingle_hashes(text: Column) -> Column:
    """Hash of every run of 5 words, of the whole sequence where there are fewer: non-negative and even."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    one = F.transform(words, lambda w: F.xxhash64(w))

    def hashes(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
        return F.when(F.size(h) >= WORDS, many).otherwise(F.array(F.xxhash64(F.concat_ws(",", F.transform(h, lambda x: x.cast("string"))))))

    return F.transform(bound(one, hashes), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFE)))


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin, in order; an odd one, the bin's end, where the bin is empty.

    Each bin's end is put among the hashes; after one sort the first of each bin is its minimum.
    """
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.call_function("shiftleft", b.cast("long"), F.lit(_LOW)) + F.lit((1 << _LOW) - 1))
    ordered = F.sort_array(F.concat(hashes, ends))
    name = lambda x: F.shiftright(x, _LOW)
    firsts = lambda a: F.filter(a, lambda x, i: (i == 0) | (name(x) != name(F.get(a, i - 1))))
    return bound(ordered, firsts)


#: Bins that an empty one asks at once, and how often it asks so.
PROBES, ASKED = 8, 2


def densified(minima: Column) -> Column:
    """Low-order bits of each bin. An empty bin takes those of the first full bin in a random order of its own.

    The order is the same for all texts, as in densification by probing at random till a full bin is met: bins that hashes
    of (empty bin, attempt) name, PROBES at once, and after ASKED such rounds all bins by the hash of (empty bin, bin).
    Some bin is always full.
    """
    low = lambda x: F.shiftright(x, 1).bitwiseAND(F.lit((1 << BITS) - 1))
    full = lambda x: x.bitwiseAND(F.lit(1)) == 0

    def fill(m: Column) -> Column:
        def met(bin_: Column, k: int) -> Column:
            tries = F.sequence(F.lit(k * PROBES), F.lit((k + 1) * PROBES - 1))
            return F.get(F.filter(F.transform(tries, lambda j: F.get(m, F.xxhash64(bin_, j).bitwiseAND(F.lit(BINS - 1)).cast("int"))), full), F.lit(0))

        def last(bin_: Column) -> Column:
            return F.array_min(F.transform(F.filter(m, full), lambda x: F.struct(F.xxhash64(bin_, F.shiftright(x, _LOW)).alias("o"), x.alias("v"))))["v"]

        def borrowed(bin_: Column) -> Column:
            return low(F.coalesce(*[met(bin_, k) for k in range(ASKED)], last(bin_)))

        return F.transform(m, lambda x: F.when(full(x), low(x)).otherwise(borrowed(F.shiftright(x, _LOW))))

    return bound(minima, fill)


def packed(bits: Column) -> Column:
    """Array of longs, eight bins to each."""
    def word(b: Column, w: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(_PER):
            out = out.bitwiseOR(F.call_function("shiftleft", F.get(b, w * _PER + k), F.lit(BITS * (_PER - 1 - k))))
        return out

    return bound(bits, lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER - 1)), lambda w: word(b, w)))


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text (array of longs); equal texts have equal ones."""
    return packed(densified(bin_minima(shingle_hashes(text))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two packed fingerprints: the share of equal bins, less the chance of equal low bits."""
    full = (1 << BITS) - 1
    xors = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    same = F.aggregate(xors, F.lit(0), lambda s, x: s + sum((F.when(F.shiftright(x, BITS * k).bitwiseAND(F.lit(full)) == 0, 1).otherwise(0) for k in range(_PER)), F.lit(0)))
    chance = 2.0**-BITS
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def to_hex(packs: Column) -> Column:
    return F.lower(F.array_join(F.transform(packs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, need) of docs (doc_id, n): the next larger doc_id (after the last, the first), and a quarter of
    n, the largest one of a repeated id's.

    Narrow rows only: range partitions of ids, the next one inside a partition, and the first id of each partition
    (one row for each) for those at its end.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    tagged = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "minhash-order")
    heads = tagged.groupBy("part").agg(F.min("doc_id").alias("head"))
    on = Window.orderBy("part")
    ahead = heads.select("part", F.coalesce(F.lead("head").over(on), F.min("head").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = tagged.select("doc_id", "n", "part", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")).alias("lead"))
    return inside.join(ahead, "part").select("doc_id", F.coalesce("lead", "after").alias("next_id"), F.floor(F.col("n") / 4).alias("need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likenesses.

    Null text: empty. A row with a null doc_id has no neighbour: its edited text just loses its end, and near_next is
    null. Rows that repeat a doc_id each have a row; as the next document such an id stands for the one of its texts
    with the least SHA-256. With one document the next one is itself. Other columns are not looked at; an empty table
    gives an empty one. Each text is shuffled once, and a quarter of it once more,
    by doc_id: an id that much of the table repeats would be split by Spark's skew handling alone.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = every.where("doc_id is not null")  # the same rows in both joins below, so that one exchange serves both
    order = materialize(next_ids(every.select("doc_id", F.length("text").alias("n"))), "minhash-next")
    before = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), "need")
    key = F.sha2("text", 256)
    heads = base.join(before, "doc_id").select(F.col("to_id").alias("doc_id"), key.alias("key"), F.substring(F.col("text"), F.lit(1), F.col("need").cast("int")).alias("head"))
    heads = heads.groupBy("doc_id").agg(F.min_by("head", "key").alias("head"))
    q = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - q), F.substring(F.coalesce("head", F.lit("")), F.lit(1), q))
    both = base.join(heads, "doc_id", "left").union(every.where("doc_id is null").withColumn("head", F.lit(""))).select("doc_id", "text", edited.alias("edited"))
    prints = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), key.alias("key"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("efp"))
    prints = materialize(prints, "minhash-prints")
    firsts = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("fp", "key").alias("next_fp"))
    follow = firsts.join(before.select("doc_id", "to_id"), "doc_id").select(F.col("to_id").alias("doc_id"), "next_fp")
    out = prints.join(follow, "doc_id", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
