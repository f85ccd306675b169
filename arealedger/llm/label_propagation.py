"""Balanced label propagation: linked documents move towards their neighbours' shards. SQL functions only.

A node is a distinct text with as many rows as hold it; a link is a run of words that several texts share. Nodes of a
link are neighbours through it, never pair by pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, materialize, running_totals

SHARDS, ROUNDS = 24, 6
#: Words in a run, runs of a text that can link it, and one in so many words begins a run.
WORDS, KEYS, ANCHORS = 5, 4, 4
#: Room of a shard while labels move, as a multiple of an even share; the last step then makes sizes even.
SLACK = 1.0
#: Nodes of one link that a join task meets under one key.
SPREAD = 256


def share(*cols: Column) -> Column:
    """A fixed number in [0, 1) for the columns' values."""
    return F.shiftright(F.xxhash64(*cols), 11).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)


def link_keys(text: Column) -> Column:
    """The least KEYS hashes of runs of WORDS words that begin at an anchor: a word whose own hash says so.

    Near copies share most runs, so they share a least one as a rule; texts of fewer words have no key.
    """
    hashes = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def least(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.pmod(F.get(h, i), F.lit(ANCHORS)) == 0)
        return F.slice(F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)])))), 1, KEYS)

    return F.coalesce(bound(hashes, lambda h: F.when(F.size(h) >= WORDS, least(h))), F.array().cast("array<bigint>"))


def linked_nodes(members: DataFrame, label: str = "propagation") -> DataFrame:
    """members (node, link, ...) of links that two or more nodes hold, with n, the number of them.

    Counted in pieces first, as many as the square root of the nodes: no task of these joins meets a whole link.
    """
    rows = members.select("node").distinct().count()
    cut = members.withColumn("_piece", F.pmod(F.xxhash64("node"), F.lit(math.isqrt(rows) + 1)))
    pieces = cut.groupBy("link", "_piece").agg(F.count("*").alias("n"))
    sizes = pieces.groupBy("link").agg(F.sum("n").alias("n")).where("n > 1")
    return materialize(cut.join(pieces.select("link", "_piece").join(sizes, "link"), ["link", "_piece"]).drop("_piece"), label)


def propagate(linked: DataFrame, room: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, label) for linked (node, link, w, n): labels 0 to shards - 1, each with about `room` of the weight w at most.

    Nodes start evenly over the labels. In each round a link wishes for the label that most of its weight has, among those
    with room left (a fixed draw among equals, new in each round). A node asks for the label that its links wish for most,
    a link counting by the share of it that stands there, so that a run of words that everything holds says little. A
    label admits as large a part of those that ask as it has room for, by link, so that links move whole. It ends when no
    node asks for another label, or after `rounds` rounds. A link is only ever counted by label, and its wish goes out to
    its nodes in parts of some SPREAD nodes, so that a link with most of the nodes is spread over tasks. What is broadcast
    are counts by label: `shards` rows.
    """
    now = materialize(linked.select("node", "link", "n", "w").withColumn("label", F.floor(share("node", F.lit(-1)) * shards).cast("int")), "propagation-linked")
    for k in range(rounds):
        load = now.groupBy("node").agg(F.first("label").alias("label"), F.first("w").alias("w")).groupBy("label").agg(F.sum("w").alias("load"))
        load = materialize(load, "propagation-load")
        votes = now.groupBy("link", "label").agg(F.sum("w").alias("votes")).join(F.broadcast(load), "label", "left")
        free = F.when(F.coalesce("load", F.lit(0)) < room, F.col("votes")).otherwise(0)
        wish = votes.groupBy("link").agg(F.max_by(F.struct("label", "votes"), F.struct(free, "votes", F.xxhash64("link", "label", F.lit(k)))).alias("top"), F.sum("votes").alias("whole"))
        sizes = now.groupBy("link").agg(F.first("n").alias("n"))
        wish = wish.join(sizes, "link").select("link", F.col("top.label").alias("to"), (F.col("top.votes") / F.col("whole")).alias("pull"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SPREAD))).alias("part"))
        asks = now.withColumn("part", F.pmod(F.xxhash64("node"), F.floor(F.col("n") / SPREAD) + 1)).join(wish, ["link", "part"])
        pulls = asks.groupBy("node", "to").agg(F.sum("pull").alias("pull"), F.max_by("link", F.struct("pull", "link")).alias("link"), F.first("label").alias("label"), F.first("w").alias("w"))
        best = pulls.groupBy("node").agg(F.max_by(F.struct("to", "link"), F.struct(F.round("pull", 9), F.col("to") == F.col("label"), F.xxhash64("link", F.lit(k)))).alias("b"), F.first("label").alias("label"), F.first("w").alias("w"))
        best = materialize(best.select("node", "label", "w", "b.*"), "propagation-asks")
        moves = best.where(F.col("to") != F.col("label"))
        want = moves.groupBy(F.col("to").alias("label")).agg(F.sum("w").alias("want"), F.count("*").alias("n"))
        leave = moves.groupBy("label").agg(F.sum("w").alias("leave"))
        quota = want.join(load, "label", "left").join(leave, "label", "left")
        left = F.lit(float(room)) - F.coalesce("load", F.lit(0)) + F.coalesce("leave", F.lit(0)) / 2
        quota = materialize(quota.select(F.col("label").alias("to"), F.greatest(F.lit(0.0), left / F.greatest("want", F.lit(1))).alias("part")), "propagation-quota")
        if quota.isEmpty():
            break
        moved = best.join(F.broadcast(quota), "to", "left")
        enter = share("link", F.lit(k)) < F.coalesce("part", F.lit(0.0))
        moved = moved.select("node", F.when((F.col("to") != F.col("label")) & enter, F.col("to")).otherwise(F.col("label")).alias("label"))
        now = materialize(now.drop("label").join(moved, "node"), "propagation-linked")
    return now.groupBy("node").agg(F.first("label").alias("label"))


def cut_links(placed: DataFrame) -> DataFrame:
    """(links, cut): links of two or more rows (link, shard), and those that stand in more than one shard."""
    each = placed.groupBy("link").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b")).where("n > 1")
    return each.agg(F.count("*").alias("links"), F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).alias("cut"))


def fill(rows: DataFrame, nodes: DataFrame, total: int, shards: int, labels: int) -> DataFrame:
    """rows (with node) with a shard each, counts at most one apart. nodes: (node, w, label), labels from 0 to `labels` - 1.

    A shard takes whole the nodes of its label, in a fixed order, as far as its count allows. The others' rows, in the order
    label (-1 first, null last), node, fill the places left, those of shards without a label first; only there a node can
    be split.
    """
    low, more = total // shards, total % shards  # the first `more` shards hold one row more
    room = F.lit(low) + F.when(F.col("label") < more, 1).otherwise(0)
    known = running_totals(nodes.where("label >= 0"), ["label"], ["node"], {"before": "w"}, "sharding-nodes")
    known = materialize(known.withColumn("stays", F.col("before") + F.col("w") <= room).select("node", "label", "stays", "w"), "sharding-kept")
    taken = {r["label"]: r["w"] for r in known.where("stays").groupBy("label").agg(F.sum("w").alias("w")).collect()}  # a number for each shard
    holes, at = [], 0
    for s in [*range(labels, shards), *range(labels)]:
        free = low + (s < more) - taken.get(s, 0)
        holes.append((s, at, at + free))
        at += free
    own = rows.join(nodes.select("node", "label").join(known.select("node", "stays"), "node", "left"), "node")
    stay = own.where("stays").select(*rows.columns, F.col("label").alias("shard"))
    loose = own.where(~F.coalesce("stays", F.lit(False))).select(*rows.columns, F.coalesce("label", F.lit(shards)).alias("_label"), F.lit(1).alias("_one"))
    placed = running_totals(loose, [], ["_label", "node", "doc_id"], {"_place": "_one"}, "sharding-loose")
    table = F.broadcast(rows.sparkSession.createDataFrame(holes, "shard int, _from bigint, _to bigint"))
    filled = placed.join(table, (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))).select(*rows.columns, "shard")
    return stay.union(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law `rows`.

    Equal texts are one node, and nodes that share a run of words are linked. Propagation labels the linked nodes; shards
    then take nodes whole, so that equal texts are split only where they are more than a shard holds, or where the last
    places of a shard are filled. A null text is a node of its own with size 8 and the checksum of the empty text. Rows that repeat a
    doc_id keep a row each, and a null doc_id counts like any other; other columns are not looked at. An empty table gives
    an empty one. A text takes part by its few least anchored runs; rows join their text's shards on its hash, where a hot
    text (all null ones are one) has a row for each of its shards on the other side and Spark splits its partition.
    """
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text, F.length(text)).alias("node"), link_keys(text).alias("_keys"))
    narrow = materialize(narrow, "sharding-docs")
    nodes = materialize(narrow.groupBy("node").agg(F.count("*").alias("w"), F.first("_keys").alias("_keys")), "sharding-nodes")
    total = narrow.count()
    low = total // shards
    heavy = nodes.where(F.col("w") > low).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()["w"]
    free = max(1, shards - heavy // (low + 1))  # a text of more rows than a shard holds has whole shards, the others labels
    linked = linked_nodes(nodes.where(F.col("w") <= low).select("node", "w", F.explode("_keys").alias("link")))
    labels = propagate(linked, SLACK * max(1, total / shards), free, rounds)
    # A repeated text is a group though nothing else links it: it gets a label by its hash.
    by_hash = F.when(F.col("w") > low, -1).when(F.col("w") > 1, F.floor(share("node", F.lit(-1)) * free).cast("int"))
    named = materialize(nodes.select("node", "w").join(labels, "node", "left").withColumn("label", F.coalesce("label", by_hash)), "sharding-named")
    placed = fill(narrow.drop("_keys"), named, total, shards, free).withColumn("_one", F.lit(1))
    out = running_totals(placed, ["shard"], ["node", "doc_id"], {"slot": "_one"}, "sharding-slots")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
