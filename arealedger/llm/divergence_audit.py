"""How far sources of a language diverge in their words, by three-dimensional cube partitioning.

A task owns a cell (block of groups, block of groups, block of terms): it gets the two groups' slices of that block of
terms, computes the partial divergence of every pair of groups, and partials are added up along the axis of terms.
All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small
from .tokens import text_slices

#: Documents of its language that a term must be in to be kept.
LEAST_DOCS = 10
#: Groups and terms in a block, about; a cell has two blocks of groups and one of terms.
GROUPS, TERMS = 8, 512
#: Terms that are listed for a group.
TOP = 10
#: A term is a run of other characters than these.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are counted at once.
SLICE = 4_000_000


def slice_counts(lang: list[str], source: list[str], text: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents: occurrences and documents of each term by group."""
    names: dict[tuple[str, str], int] = {}
    group = np.array([names.setdefault(k, len(names)) for k in zip(lang, source, strict=True)], np.int64)
    lists = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(text), BETWEEN, " "), " ")
    words = lists.flatten().dictionary_encode()
    width = max(len(words.dictionary), 1)
    doc = np.repeat(np.arange(len(group)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if (blank := pc.index(words.dictionary, "").as_py()) >= 0:
        doc, at = doc[at != blank], at[at != blank]
    pairs, n = np.unique(doc * width + at, return_counts=True)
    cells, where = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
    keys = list(names)
    made = [pa.array([k[i] for k in keys], pa.string()).take(pa.array(cells // width)) for i in (0, 1)]
    term = words.dictionary.take(pa.array(cells % width)).cast(pa.string())
    sums = [np.bincount(where, weights=n, minlength=len(cells)).astype(np.int64), np.bincount(where, minlength=len(cells)).astype(np.int64)]
    return pa.RecordBatch.from_arrays([*made, term, *map(pa.array, sums)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents (lang, source, text), added up in each slice before they are shuffled."""

    def run(batches):
        for b in batches:
            text = b.column(2).cast(pa.large_string())
            for lo, hi in text_slices(text, SLICE):
                yield slice_counts(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), text.slice(lo, hi - lo))

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact; null if nothing is kept."""
    top = (F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")).cast("decimal(29,0)")
    return F.when(kept > 0, F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def cell_pairs(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value): what this cell's terms add to each of its pairs of groups.

    A row without a term is a group: its value for terms that it lacks. Terms that no group of the cell has are alike but
    for that value, so they are counted, not listed.
    """
    lang, left, right, _ = key
    head = cell[cell["term"].isna()].sort_values(["block", "source"])
    rows = cell[cell["term"].notna()]
    place = pd.Index(head["source"])
    lacking, block = head["p"].to_numpy(np.int64), head["block"].to_numpy()
    code, terms = pd.factorize(rows["term"])
    p = np.repeat(lacking[:, None], len(terms), axis=1)
    p[place.get_indexer(rows["source"]), code] = rows["p"].to_numpy(np.int64)
    others = int(head["size"].iloc[0]) - len(terms) if len(head) else 0
    names = head["source"].to_numpy(dtype=object)
    made: tuple[list, list, list] = ([], [], [])
    for i in np.flatnonzero(block == left):
        js = np.flatnonzero(block == right)
        js = js[js > i] if left == right else js
        value = ((p[js] - p[i]) ** 2 // (p[js] + p[i])).sum(axis=1) + others * ((lacking[js] - lacking[i]) ** 2 // (lacking[js] + lacking[i]))
        made[0].extend([names[i]] * len(js))
        made[1].extend(names[js])
        made[2].extend(value.tolist())
    return pd.DataFrame({"lang": pd.Series([lang] * len(made[0]), dtype=object), "a": pd.Series(made[0], dtype=object), "b": pd.Series(made[1], dtype=object), "value": pd.Series(made[2], dtype="int64")})


def ranked(df: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = df.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= top) if top else out).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, groups_in_block: int = GROUPS, terms_in_block: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each group (lang, source) from the others of its language, and its own terms.

    Null lang, source and text count as ''. Groups without terms, and languages that keep none, have their pairs with value 0
    (or that of terms they lack). Repeated rows count each; ties are ranked by the item's bytes; other columns are not looked
    at; an empty table gives an empty one. Terms, records and cells are spread by hashes of terms and blocks; a group
    with much of the corpus has one row for each of its terms by then.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(docs), "audit-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "audit-kept")
    records = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "audit-records")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("of_lang"))
    totals = records.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "of_lang"])
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    blocks_of = lambda n, size: F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")
    groups = groups.join(sizes, "lang").withColumn("blocks", blocks_of(F.col("groups"), groups_in_block)).withColumn("term_blocks", blocks_of(F.col("v"), terms_in_block))
    groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).drop("groups"), "audit-groups")
    known = small(groups)

    in_block = lambda term, blocks: F.pmod(F.xxhash64(term), blocks).cast("int")
    of_lang = small(groups.select("lang", "term_blocks").distinct())
    filled = kept.join(of_lang, "lang").groupBy("lang", in_block("term", F.col("term_blocks")).alias("t")).agg(F.count("*").alias("size"))
    shared = records.join(known, ["lang", "source"])
    own = share(F.col("n"), F.col("total"), F.col("v"))
    heads = groups.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).join(small(filled), ["lang", "t"], "left")
    heads = heads.select("lang", "source", "block", "blocks", "t", F.lit(None).cast("string").alias("term"), F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("v")), F.lit(1)).alias("p"), F.coalesce("size", F.lit(0)).alias("size"))
    slices = heads.union(shared.select("lang", "source", "block", "blocks", in_block("term", F.col("term_blocks")).alias("t"), "term", own.alias("p"), F.lit(0).cast("long")))
    copies = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = copies.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "t", "source", "block", "term", "p", "size")
    partial = copies.groupBy("lang", "left", "right", "t").applyInPandas(cell_pairs, "lang string, a string, b string, value bigint")
    pairs = materialize(partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    terms = shared.select("lang", "source", F.col("term").alias("item"), own.alias("p"), share(F.col("in_lang"), F.col("of_lang"), F.col("v")).alias("q")).where("p > q")
    return ranked(both, "pair").union(ranked(terms.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value")), "term", top))
