"""Near-duplicate groups by exact Jaccard likeness of word shingles: prefix keys, pivots, verification, components."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop_tables, fresh, materialize, small
from .tokens import sole, text_slices, trimmed

#: Words in a shingle, and the likeness from which two documents are near copies.
WORDS, LEAST = 5, 0.8
#: One in so many sets tells which elements are common: those that OFTEN of them hold, about LATE at most.
SAMPLE, OFTEN, LATE = 32, 3, 500_000
#: Bytes of text whose sets are made at once.
SLICE = 1_000_000
#: Elements of a set under which its first pivots are looked for, and rounds of them; then rounds over whole prefixes.
FIRST, EARLY, PIVOTS = 32, 1, 1
#: One in so many of a node's tokens have to have a pivot for the two to be tried.
TRIED = 8
#: 64-bit words of a set's parity map.
MAP = 16
#: Texts that one pivot's set is compared with in a row, and rows of one key that a join task meets.
SPREAD, WIDE = 128, 4096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words (A-Z lowered); of the whole sequence where there are fewer."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), len(w))], np.uint64).view(np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in w), np.uint64, len(w))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):  # the order of words counts: each place mixes before the next is added
        out = (out + h[k : k + n]) * _ODD[k % len(_ODD)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(t) < len(s):
        s, t = t, s
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0


def parity_map(s: np.ndarray, words: int = MAP) -> np.ndarray:
    """For each of 64 * words bits whether an odd number of elements fall on it: sets differ in as many elements as maps in bits, or more."""
    v = s.view(np.uint64) * _ODD[1]
    bit = (v >> np.uint64(40)) % np.uint64(64 * words)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def in_order(s: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, int]:
    """A sorted set in the order of hashes, but for the sorted `late` elements, which go last; and how many stand before those."""
    if not len(late) or not len(s):
        return s, len(s)
    last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
    return np.concatenate([s[~last], s[last]]), int((~last).sum())


def common_elements(texts: DataFrame, words: int) -> np.ndarray:
    """Elements that many sets hold, sorted: those that at least OFTEN sets of a sample have, the most frequent LATE, about.

    They only set the order in which prefixes are taken, and any common order is exact; so a bounded list will do. Who is
    on it is settled by a count that a histogram of counts gives.
    """

    def run(batches):
        sole(("shingles",), dict)
        for b in batches:
            for lo, hi in text_slices(b.column(0), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, words) for t in b.column(0).slice(lo, hi - lo).to_pylist()]))], names=["token"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0).select("text")
    counts = materialize(some.mapInArrow(trimmed(run), "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN), "near-often")
    size = F.floor(F.log2("n") * 4).cast("int")  # counts grow by a fifth from class to class
    classes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("m")).orderBy(F.desc("size")).collect()
    least, total = None, 0
    for r in classes:
        if (total := total + r["m"]) > LATE:
            break
        least = r["size"]
    found = np.zeros(0, np.int64)
    if least is not None:
        found = np.sort(counts.where(size >= least).select("token").toArrow().column(0).to_numpy().astype(np.int64))
    drop_tables(counts)
    return found


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def with_set(texts: DataFrame, words: int, least: Fraction, late: np.ndarray, fingerprint: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, th, node, size, early, fp, map, prefix) of texts (doc_id, th, text): hash of a text's shingle set, its size, elements
    that aren't late, fingerprint (0 without a function), parity map and prefix. Of rows with equal texts in a slice one is looked at."""
    num, den = least.numerator, least.denominator
    sent = texts.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        import xxhash

        sole(("shingles",), dict)
        for b in batches:
            for lo, hi in text_slices(b.column(2), SLICE):
                node, size, early, fp, maps, first = [], [], [], [], [], []
                hashes = b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                at = np.sort(np.unique(hashes, return_index=True)[1])  # one row of each text
                for t in b.column(2).slice(lo, hi - lo).take(pa.array(at)).to_pylist():
                    s = shingle_set(t, words)
                    node.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                    size.append(len(s))
                    maps.append(parity_map(s))
                    ordered, n = in_order(s, sent.value)
                    first.append(ordered[: len(s) + (-num * len(s) // den) + 1].copy())
                    early.append(n)
                    fp.append(fingerprint(t or "") if fingerprint else 0)
                made = [pa.array(np.array(node, np.uint64).view(np.int64), pa.int64()), pa.array(size, pa.int32()), pa.array(early, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64()), pa.array(maps, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(lo, hi - lo).take(pa.array(at)) for i in (0, 1)], *made], names=["doc_id", "th", "node", "size", "early", "fp", "map", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "th", "text").mapInArrow(trimmed(run), f"doc_id {kind}, th bigint, node bigint, size int, early int, fp bigint, map array<bigint>, prefix array<bigint>")


def _prefix(size: Column, least: Fraction) -> Column:
    """Elements of a set's prefix."""
    return (size - F.ceil(size * least.numerator / F.lit(least.denominator)) + 1).cast("int")


def _sized(a: Column, b: Column, least: Fraction) -> Column:
    return (F.least(a, b) * least.denominator) >= (F.greatest(a, b) * least.numerator)


def may_be_alike(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and parity maps allow: no pair of that likeness is lost."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}n"), F.col("map").alias(f"{x}m")), x)
    apart = F.aggregate(F.zip_with("am", "bm", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    # |a and b| = (|a| + |b| - differing) / 2, and likeness asks for |a and b| * (1 + least) >= least * (|a| + |b|).
    both = F.col("an") + F.col("bn")
    return pairs.where(_sized(F.col("an"), F.col("bn"), least) & ((both - apart) * (least.numerator + least.denominator) >= both * 2 * least.numerator)).select("a", "b")


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, late: np.ndarray) -> DataFrame:
    """(a, b, shared, extra) of distinct pairs (a, b) of nodes: common elements of their sets, and late ones of a that b lacks.

    Each text goes once to every block of SPREAD of b's pairs that it is in, as text; blocks are read in order, so a task
    holds the set of one b at a time.
    """
    names = "a bigint, b bigint, an int, bn int, shared int, extra int"
    pairs = materialize(pairs, "near-pairs")
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([], names)
    each = pairs.groupBy("b").agg(F.floor(F.count("*") / SPREAD).alias("top"))
    left = pairs.join(each, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("top") + 1).alias("part"), F.lit(1).alias("side"))
    right = each.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("part"), F.lit(0).alias("side"))
    wanted = materialize(left.union(right).join(nodes.select("node", "doc_id", "th"), "node"), "near-wanted")
    sent = pairs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        sole(("shingles",), dict)
        own = None
        for batch in batches:
            for lo, hi in text_slices(batch.column(3), SLICE):
                part, out = batch.slice(lo, hi - lo), []
                for node, b, side, text in zip(*[c.to_pylist() for c in part.columns[:4]], strict=True):
                    s = shingle_set(text, words)
                    if side == 0:
                        own = s
                    else:
                        end = s[overlap_mask(s, sent.value)]
                        out.append((node, b, len(s), len(own), overlap(s, own), len(end) - overlap(end, own)))
                cols = [*zip(*out, strict=True)] or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)], names=["a", "b", "an", "bn", "shared", "extra"])

    found = texts.alias("t").join(small(wanted).alias("w"), same_row("t", "w")).select("w.node", "w.b", "w.side", "t.text", "w.part")
    blocks = found.repartition("b", "part").sortWithinPartitions("b", "part", "side", "node")
    out = materialize(blocks.mapInArrow(trimmed(run), names).distinct(), "near-tried")
    drop_tables(pairs, wanted)
    return out


def overlap_mask(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which elements of a sorted set are late."""
    return late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)


def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (node, ..) with the root of each node's component."""
    return rows.join(connected_components(links, "near-edges"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def live_tokens(rows: DataFrame) -> DataFrame:
    """(token) under which nodes of several components stand."""
    return rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")


def pivot_pairs(rows: DataFrame, least: Fraction, outside: bool) -> DataFrame:
    """(a, b): each node of rows (token, node, size, root) with the pivot that most of its tokens have, of another component.

    A token's pivot is the node whose tokens are the most frequent: of near copies of one text that text itself, or what is
    nearest to it; with `outside` of those outside of the token's largest component. A node that shares few of its tokens
    with it isn't tried: what these rounds leave out meets in full in the end.
    """
    counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "n")
    live = rows.join(counts, "token")
    scores = live.groupBy("node").agg(F.sum("n").alias("score"), F.count("*").alias("all"))
    live = live.join(scores, "node")
    if outside:
        main = live.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
        pivots = live.join(main, "token").where("root <> main")
    else:
        pivots = live
    pivots = pivots.groupBy("token").agg(F.max(F.struct("score", "node", "size", "root")).alias("p"))
    met = live.join(pivots, "token").where((F.col("root") != F.col("p.root")) & _sized(F.col("size"), F.col("p.size"), least))
    each = met.groupBy(F.col("node").alias("a"), F.col("p.node").alias("b"), "all").agg(F.count("*").alias("n")).where(F.col("n") * TRIED >= F.col("all"))
    return each.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def links(sets: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, least: Fraction, late: np.ndarray, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) links among sets (doc_id, th, node, size, map, prefix) that are alike, enough for all components; sets are used up.

    Alike sets share an element of their prefixes in any common order of elements. Here common elements go last, so that a
    line which many documents have gives no pairs unless a document has little else. Pairs are tried in rounds, those of one
    component no more: first those that `near` gives of (node, fp), then each set with one pivot, under its first elements, then under all of its prefix; at last sets of
    different components under one element meet, as far as sizes, pivots, what prefixes share and parity maps allow.
    """
    spark = nodes.sparkSession
    tried = materialize(spark.createDataFrame([], "a bigint, b bigint, an int, bn int, shared int, extra int"), "near-all")
    alike = (F.col("shared") * least.denominator) >= (F.col("an") + F.col("bn") - F.col("shared")) * least.numerator

    def found() -> DataFrame:
        return tried.where(alike).select("a", "b")

    def take(pairs: DataFrame) -> None:
        nonlocal tried
        more = verify(may_be_alike(pairs, nodes, least), nodes, texts, words, late)
        both = materialize(tried.union(more), "near-all")
        drop_tables(tried, more)
        tried = both

    if near is not None:
        take(near(nodes.select("node", "fp")))
    rows = materialize(sets.select("node", "size", F.explode(F.slice("prefix", 1, FIRST)).alias("token")), "near-first")
    for k in range(EARLY):
        now = materialize(rooted(rows, found()), "near-rooted")
        take(pivot_pairs(now, least, k > 0))
        drop_tables(now)
    drop_tables(rows)
    every = rooted(sets.select("node", "size", "early", "prefix"), found()).select("node", "size", "early", "root", F.posexplode("prefix").alias("place", "token"))
    live = materialize(live_tokens(every), "near-live")
    rows = materialize(every.withColumn("late", F.col("place") >= F.col("early")).join(small(live), "token").select("token", "node", "size", "root", "late", (_prefix(F.col("size"), least) - F.least(_prefix(F.col("size"), least), "early")).alias("lates")), "near-shared")
    drop_tables(live, sets)
    for _ in range(PIVOTS):
        take(pivot_pairs(rows, least, True))
        before, rows = rows, materialize(rooted(rows.drop("root"), found()), "near-rooted")
        drop_tables(before)
    take(all_pairs(rows, tried, least))
    drop_tables(rows)
    return found()


def all_pairs(rows: DataFrame, tried: DataFrame, least: Fraction) -> DataFrame:
    """Distinct (a, b) of rows (token, node, size, root, late, lates) of different components under one token that may be alike.

    Those of the token's largest component meet only the others; rows of a token are dealt to parts of WIDE, each of the
    others to all parts. Two bounds thin out what meets, and lose no alike pair.

    Under a late token a pair need only be looked at if it is the first that the two share: then they share late elements
    alone. With what both share with a pivot p known (tried), they have min(|a p|, |b p|) of p's elements in common at
    most, and of other late ones the smaller number of either. So the far members of a large group of near copies, which
    share its middle's elements with everyone, don't meet each other and the rest.

    Of two sets the one whose prefix ends first has no common element between its prefix and the other's rest, so what
    prefixes share, and the larger rest, bound the overlap.
    """
    need = lambda c: c * (least.numerator + least.denominator) >= (F.col("an") + F.col("bn")) * least.numerator
    own = tried.select("a", "b", "shared", "extra").union(tried.select("b", "b", "bn", F.lit(0)).distinct())
    own = own.groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct(F.col("b").alias("p"), F.col("shared").alias("s"), F.col("extra").alias("e"))).alias("known"))  # a few for each node
    rows = rows.join(own, "node", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<p:bigint,s:int,e:int>>")))
    sums = rows.groupBy("token", "root").agg(F.count("*").alias("m"))
    live = sums.groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main"), F.floor(F.sum("m") / WIDE).alias("top")).where("roots > 1")
    met = rows.join(live.drop("roots"), "token")
    side = lambda x, *more: [F.col(c).alias(f"{x}{t}") for c, t in (("node", ""), ("size", "n"), ("root", "r"), ("lates", "l"), ("known", "k"))] + list(more)
    outer = met.where("root <> main").select("token", "late", *side("a"), F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("part"))
    inner = met.select("token", *side("b"), (F.col("root") == F.col("main")).alias("in_main"), F.pmod(F.xxhash64("node"), F.col("top") + 1).alias("part"))
    possible = F.forall("ak", lambda u: F.forall("bk", lambda v: (u["p"] != v["p"]) | need(F.least(u["s"], v["s"]) + F.least(u["e"], v["e"]))))
    on = (F.col("o.token") == F.col("i.token")) & (F.col("o.part") == F.col("i.part")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (F.col("ar") != F.col("br")) & _sized(F.col("an"), F.col("bn"), least) & (~F.col("late") | possible)
    pairs = outer.alias("o").join(inner.alias("i"), on)
    swap = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    ends = [swap("a", "b").alias("a"), swap("b", "a").alias("b"), swap("an", "bn").alias("an"), swap("bn", "an").alias("bn"), F.when(possible, 0).otherwise(F.least("al", "bl")).alias("unseen")]
    shared = pairs.select(*ends).groupBy("a", "b", "an", "bn", "unseen").agg(F.count("*").alias("c"))
    rest = lambda n: n - _prefix(n, least)
    return shared.where(need(F.col("c") + F.col("unseen") + F.greatest(rest(F.col("an")), rest(F.col("bn"))))).select("a", "b").distinct()


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LEAST, fingerprint: Callable[[str], int] | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with one row of each group of documents linked by a shingle likeness of `least` or more.

    It is the one with the smallest doc_id (a null one only where the group has no other), then the least text hash, then the
    least hash of the whole row. Likeness is exact: equal sets are one node, and no pair at `least` or above is missed. Null
    texts count as empty, and empty texts are alike. Columns of any name pass through; an empty table stays empty. Narrow
    rows are shuffled, and of texts those whose sets are compared. near (a, b) of (node, fingerprint of its text) are the pairs
    to be verified first; whatever they leave out is found by prefixes.
    """
    share = Fraction(least).limit_denominator(1000)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = materialize(texts.select("doc_id", "th"), "near-docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("m")
    late = common_elements(texts, words)
    sets = materialize(with_set(texts, words, share, late, fingerprint), "near-sets")
    nodes = materialize(sets.groupBy("node").agg(first, F.first("size").alias("size"), F.first("map").alias("map"), F.min("fp").alias("fp")).select("node", "m.doc_id", "m.th", "size", "map", "fp"), "near-nodes")
    own = materialize(sets.select("node", "doc_id", "th"), "near-own")
    found = links(sets, nodes, texts, words, share, late, near)
    named = materialize(rooted(own, found), "near-roots")
    drop_tables(own, nodes, found)
    placed = materialize(rows.join(named.select("th", "root").distinct(), "th"), "near-placed")
    marks = placed.groupBy("root").agg(first).select("root", F.col("m.doc_id").alias("kept"), F.col("m.th").alias("kept_th"))
    stays = F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("th") == F.col("kept_th"))
    each = materialize(placed.join(marks, "root").groupBy("doc_id", "th").agg(F.max(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "near-marks")
    drop_tables(rows, named, placed)
    hashed = fresh(docs, "_th")
    own = docs.withColumn(hashed, F.xxhash64("text"))
    is_row = F.col("o.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col(f"o.{hashed}") == F.col("m.th"))
    alone = own.alias("o").join(small(each.select("doc_id", "th")).alias("m"), is_row, "left_anti").select(*docs.columns)
    # Rows equal in id and text are told apart by the rest.
    number = fresh(docs, "_number")
    order = Window.partitionBy("doc_id", hashed).orderBy(F.xxhash64(*docs.columns))
    several = own.alias("o").join(small(each.where("stays").select("doc_id", "th")).alias("m"), is_row, "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return alone.union(several.select(*docs.columns))
