"""Neighbourhood clusters at every point of time: k-means of all keys at once, agreement over time, aligned labels, paths.

Tables here have a row for each neighbourhood and point of time. A fit is a few rounds of sums over the points for every key,
number of clusters and start together; what goes out to rows are a key's centres.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.store import stored

STARTS, ROUNDS = 10, 10
#: Rows whose distances to all centres are held at once.
BLOCK = 1024


def standardized(matrix: DataFrame, features: Sequence[str], keys: Sequence[str], item: str = "dong", least: int = 50) -> DataFrame:
    """(keys, item, x, w): features less their key's mean, over its deviation (0 where there is none), with weight 1.

    Rows with a null feature are left out, then keys with fewer than `least` rows.
    """
    by = Window.partitionBy(*keys)
    kept = matrix.dropna(subset=list(features)).withColumn("_n", F.count(F.lit(1)).over(by)).where(F.col("_n") >= least)
    z = [F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(by), F.stddev_pop(c).over(by)), F.lit(0.0)) for c in features]
    return kept.select(*keys, item, F.array(*z).alias("x"), F.lit(1.0).alias("w"))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squares of the distances of rows to centres (starts, k, width), to nine digits; a centre that isn't there lies at infinity."""
    d = np.zeros((len(x), *centres.shape[:2]))
    for i in range(x.shape[1]):
        d += (x[:, i, None, None] - centres[None, :, :, i]) ** 2
    return np.floor(d * 1e9 + 0.5) / 1e9


def _by_key(batches, keys: Sequence[str]):
    """(key, x, w, rows) of a batch's rows of one key, at most BLOCK of them."""
    for b in batches:
        x = np.asarray(b.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
        w = b.column("w").to_numpy(zero_copy_only=False) if "w" in b.schema.names else None
        for key, rows in b.select(list(keys)).to_pandas().groupby(list(keys), sort=False).indices.items():
            for at in (rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)):
                yield key if isinstance(key, tuple) else (key,), x[at], None if w is None else w[at], b.take(pa.array(at))


def _first_centres(points: DataFrame, ks: Sequence[int], width: int, keys: Sequence[str], item: str, starts: int) -> dict[tuple, np.ndarray]:
    """By key an array (number of ks, starts, most of ks, width): of each start the points with the least MD5 of start and item.

    A task keeps the least few of each key and start, so max(ks) points of each come together.
    """
    names, most = [*keys, "start", "md5", "x"], max(ks)

    def least(batches):
        kept: dict[tuple, list] = {}
        for key, x, _, rows in _by_key(batches, keys):
            items = rows.column("_item").to_pylist()
            for s in range(starts):
                own = ((hashlib.md5((str(s) if i is None else f"{s}:{i}").encode()).hexdigest(), n) for n, i in enumerate(items))
                own = [(h, x[n].tolist()) for h, n in heapq.nsmallest(most, own)]
                kept[(*key, s)] = heapq.nsmallest(most, kept.get((*key, s), []) + own)
        yield pd.DataFrame([(*k, *v) for k, found in kept.items() for v in found], columns=names)

    def batches_of(batches):
        for frame in least(batches):
            yield from pa.Table.from_pandas(frame, schema=to_arrow_schema(out), preserve_index=False).to_batches()

    out = points.select(*keys, F.lit(0).alias("start"), F.lit("").alias("md5"), "x").schema
    rows = points.select(*keys, F.col(item).cast("string").alias("_item"), "x").mapInArrow(batches_of, out)
    place = F.row_number().over(Window.partitionBy(*keys, "start").orderBy("md5"))
    made: dict[tuple, np.ndarray] = {}
    for r in rows.withColumn("c", place).where(F.col("c") <= most).collect():  # a few points of each key and start
        own = made.setdefault(tuple(r[k] for k in keys), np.full((len(ks), starts, most, width), np.inf))
        for n, k in enumerate(ks):
            if r["c"] <= k:
                own[n, r["start"], r["c"] - 1] = r["x"]
    return made


def keyed_kmeans(points: DataFrame, ks: Sequence[int], width: int, keys: Sequence[str] = ("as_of",), item: str = "dong", starts: int = STARTS, rounds: int = ROUNDS) -> DataFrame:
    """(keys, k, item, cluster) of points (keys, item, x of `width` numbers, weight w), for each k the cheapest of `starts`.

    A start's first centres are the k points with the least MD5 of start and item; `rounds` rounds follow. Of clusters at
    one distance (to nine digits) the first counts, of starts at one cost the first; a cluster without points stays.

    A round reads the points once: a task adds up its own points by key, start and cluster, and the sums of the tasks are
    added up by key. Only the centres come to the driver, as many for a key as there are starts and clusters.
    """
    points = stored(points.dropna(subset=list(keys)), "points")
    centres = _first_centres(points, ks, width, keys, item, starts)
    runs, most = len(ks) * starts, max(ks)
    centres = {key: c.reshape(runs, most, width) for key, c in centres.items()}
    sums = points.select(*keys, F.array(F.lit(0.0)).alias("sums")).schema

    def totals(of: dict[tuple, np.ndarray], cost: bool) -> dict[tuple, np.ndarray]:
        """By key the sums of w * x and w by start and cluster, or of what the starts cost."""

        def own(batches):
            kept: dict[tuple, np.ndarray] = {}
            for key, x, w, _ in _by_key(batches, keys):
                d = _distances(x, of[key])
                if cost:
                    add = w @ d.min(axis=2)
                else:
                    slot = (d.argmin(axis=2) + most * np.arange(runs)).ravel()
                    weigh = lambda v: np.bincount(slot, np.repeat(v, runs), runs * most)
                    add = np.stack([*[weigh(w * x[:, i]) for i in range(width)], weigh(w)])
                kept[key] = kept.get(key, 0.0) + add
            rows = pd.DataFrame([(*k, v.ravel().tolist()) for k, v in kept.items()], columns=[*keys, "sums"])
            yield from pa.Table.from_pandas(rows, schema=to_arrow_schema(sums), preserve_index=False).to_batches()

        def added(key: tuple, parts: pa.Table) -> pa.Table:  # a row for each task
            flat = parts.column("sums").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1)
            rows = pd.DataFrame([(*[k.as_py() for k in key], flat.sum(axis=0).tolist())], columns=[*keys, "sums"])
            return pa.Table.from_pandas(rows, schema=to_arrow_schema(sums), preserve_index=False)

        got = points.select(*keys, "x", "w").mapInArrow(own, sums).groupBy(*keys).applyInArrow(added, sums).collect()
        return {tuple(r[k] for k in keys): np.array(r["sums"]) for r in got}

    for _ in range(rounds):
        for key, got in totals(centres, False).items():
            got = got.reshape(width + 1, runs, most)
            means = np.moveaxis(got[:width] / np.where(got[width] == 0, 1.0, got[width]), 0, 2)
            centres[key] = np.where((got[width] == 0)[:, :, None], centres[key], means)
    best = {}
    for key, got in totals(centres, True).items():
        first = [min(range(starts), key=lambda s: (round(own[s], 6), s)) for own in got.reshape(len(ks), starts)]
        best[key] = centres[key].reshape(len(ks), starts, most, width)[range(len(ks)), first]
    out = points.select(*keys, F.lit(0).alias("k"), item, F.lit(0).alias("cluster")).schema
    order = [*keys, item, "k", "cluster"]

    def assigned(batches):
        for key, x, _, rows in _by_key(batches, keys):
            of = _distances(x, best[key]).argmin(axis=2)
            for n, k in enumerate(ks):
                made = dict(zip(order, [*[rows.column(c) for c in (*keys, item)], pa.array(np.full(len(x), k), pa.int32()), pa.array(of[:, n], pa.int32())], strict=True))
                yield pa.RecordBatch.from_arrays([made[f.name] for f in out], names=out.names)

    return points.select(*keys, item, "x").mapInArrow(assigned, out)


def adjacent(membership: DataFrame, by: Sequence[str] = ("k",), item: str = "dong") -> DataFrame:
    """(by, as_of, item, before, now): labels of items that stand at neighbouring points of time, by their order."""
    times = membership.select(*by, "as_of").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("as_of")))  # one row for each time
    placed = membership.join(times, [*by, "as_of"])
    before = placed.select(*by, item, (F.col("pos") + 1).alias("pos"), F.col("cluster").alias("before"))
    return placed.join(before, [*by, item, "pos"]).select(*by, "as_of", item, "before", F.col("cluster").alias("now"))


def agreement(labels: DataFrame, by: Sequence[str], a: str = "before", b: str = "now") -> DataFrame:
    """(by, n, ari): adjusted Rand index of two labellings within each group; 1 where nothing can be set apart."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("m"))
    whole = cells.groupBy(*by).agg(F.sum("m").alias("n"), pairs("m").alias("s"))
    for c, to in ((a, "sa"), (b, "sb")):
        whole = whole.join(cells.groupBy(*by, c).agg(F.sum("m").alias("m")).groupBy(*by).agg(pairs("m").alias(to)), list(by))
    chance = F.try_divide(F.col("sa") * F.col("sb"), F.col("n") * (F.col("n") - 1) / 2)
    return whole.select(*by, "n", F.coalesce(F.try_divide(F.col("s") - chance, (F.col("sa") + F.col("sb")) / 2 - chance), F.lit(1.0)).alias("ari"))


def stability(membership: DataFrame) -> DataFrame:
    """(k, median, low, least, chosen): agreement of neighbouring times by k, and the k with the best median, then tenth percentile."""
    each = agreement(adjacent(membership), ["k", "as_of"]).groupBy("k").agg(F.median("ari").alias("median"), F.percentile("ari", F.lit(0.1)).alias("low"), F.min("ari").alias("least"))
    order = Window.orderBy(F.desc(F.round("median", 9)), F.desc(F.round("low", 9)), "k")  # one row for each k
    return each.withColumn("chosen", F.row_number().over(order) == 1)


def matched_labels(labels: DataFrame, by: Sequence[str], k: Column) -> DataFrame:
    """(by, match): match[c] is the earlier label that label c continues, greedily by the number of common items.

    Ties go to the smaller earlier label, then the smaller label; labels without common items are paired last.
    """
    cells = labels.groupBy(*by, "before", "now").agg(F.count(F.lit(1)).alias("m"))
    counts = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("before").alias("a"), F.col("now").alias("b")), "m"))).alias("m"))  # k * k entries
    numbers = F.sequence(F.lit(0), k - 1)
    at = lambda a, b: F.coalesce(F.try_element_at("m", F.struct(a.alias("a"), b.alias("b"))), F.lit(0))
    every = F.array_sort(F.flatten(F.transform(numbers, lambda a: F.transform(numbers, lambda b: F.struct((-at(a, b)).alias("m"), a.alias("a"), b.alias("b"))))))
    none = F.array().cast("array<struct<m:bigint,a:int,b:int>>")
    taken = F.aggregate(every, none, lambda s, x: F.when(F.exists(s, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"])), s).otherwise(F.array_append(s, x)))
    return counts.select(*by, F.transform(F.array_sort(F.transform(taken, lambda y: F.struct(y["b"].alias("b"), y["a"].alias("a")))), lambda y: y["a"]).alias("match"))


def aligned(membership: DataFrame, by: Sequence[str] = ("k",), item: str = "dong") -> DataFrame:
    """membership with `label`: numbers carried on from the earlier time, so that a cluster keeps its number while it lasts.

    Each pair of neighbouring times is matched by itself; labels at a time are the matches up to it applied in turn, one
    short array for each time.
    """
    k = F.max("k").over(Window.partitionBy(*by, "as_of"))
    labels = adjacent(membership, by, item)
    sized = labels.withColumn("_k", F.lit(None).cast("int")) if "k" not in by else labels.withColumn("_k", F.col("k"))
    if "k" not in by:
        sized = labels.join(membership.select(*by, "as_of", k.alias("_k")).distinct(), [*by, "as_of"])
    match = matched_labels(sized.select(*by, "as_of", "_k", "before", "now"), [*by, "as_of", "_k"], F.col("_k"))
    times = membership.select(*by, "as_of", *([] if "k" in by else ["k"])).distinct().join(match.drop("_k"), [*by, "as_of"], "left")
    so_far = F.sort_array(F.collect_list(F.struct("as_of", "match")).over(Window.partitionBy(*by).orderBy("as_of")))  # one row for each time
    carried = F.aggregate(so_far, F.sequence(F.lit(0), F.col("k") - 1), lambda s, x: F.coalesce(F.transform(x["match"], lambda c: F.element_at(s, c + 1)), s))
    labels = times.select(*by, "as_of", carried.alias("_labels"))
    return membership.join(labels, [*by, "as_of"]).withColumn("label", F.element_at("_labels", F.col("cluster") + 1)).drop("_labels")


def delta_paths(vintage: DataFrame, weights: DataFrame, end_lag: int = 4, steps: int = 4) -> DataFrame:
    """(as_of, dong, x): the dong's quarterly changes over the `steps` quarters that end end_lag before as_of, less the common
    one (weighted; plain where no weight stands). x is null unless every change is known; vintage (origin, dong, q, log_index)."""
    lag = F.col("origin") - F.col("q")
    at = lambda k: F.max(F.when(lag == k, F.col("log_index")))
    ends = range(end_lag + steps, end_lag - 1, -1)
    wide = vintage.where(lag.between(end_lag, end_lag + steps)).groupBy(F.col("origin").alias("as_of"), "dong").agg(*[at(k).alias(f"_{k}") for k in ends])
    wide = wide.select("as_of", "dong", *[(F.col(f"_{k - 1}") - F.col(f"_{k}")).alias(f"c{k}") for k in ends if k > end_lag]).join(weights, "dong", "left")
    by, cols = Window.partitionBy("as_of"), [f"c{k}" for k in ends if k > end_lag]
    w = F.coalesce("w", F.lit(0))
    common = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w).over(by), F.sum(F.when(F.col(c).isNotNull(), w)).over(by)), F.avg(c).over(by))
    x = F.array(*[F.col(c) - common(c) for c in cols])
    return wide.select("as_of", "dong", F.when(~F.exists(x, F.isnull), x).alias("x"))


def delta_clusters(paths: DataFrame, now: DataFrame, structure: DataFrame, k: int, width: int = 4, least: int = 50, **fit) -> DataFrame:
    """(as_of, dong, cluster, core): k-means of the paths of eligible dongs, weighted by 1 / se^2; others follow the most
    frequent cluster (of those the smallest) of the core dongs in their structure cluster, or have none.

    paths (as_of, dong, x), now (as_of, dong, eligible, se), structure (as_of, dong, cluster). Times with fewer than `least`
    core dongs have none.
    """
    known = paths.join(now, ["as_of", "dong"], "left")
    core = known.where(F.col("eligible") & F.col("x").isNotNull() & (F.col("se") > 0)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("as_of"))).where(F.col("_n") >= least)
    own = stored(keyed_kmeans(core.select("as_of", "dong", "x", F.pow("se", -2).alias("w")), [k], width, **fit).select("as_of", "dong", "cluster"), "delta-core")
    mates = structure.select("as_of", "dong", F.col("cluster").alias("_s"))
    counts = own.join(mates, ["as_of", "dong"]).groupBy("as_of", "_s", "cluster").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("as_of", "_s").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"))
    rest = paths.select("as_of", "dong").join(own, ["as_of", "dong"], "left_anti").join(mates, ["as_of", "dong"]).join(usual, ["as_of", "_s"])
    return own.withColumn("core", F.lit(True)).unionByName(rest.select("as_of", "dong", "cluster", F.lit(False).alias("core")))
