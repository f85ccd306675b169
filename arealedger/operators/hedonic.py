"""Hedonic and repeat-sales indexes, their standard errors and block bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import index_se
from ..sources.store import stored
from .cluster import keyed_kmeans, standardized
from .windows import numbered_rows, spearman

#: Cells whose counts one group of a first solve holds, about.
CELLS = 20_000
KEYS = "sgg_cd string, origin int, dong string"
BLOCKS = "sgg_cd string, origin int, a array<double>, r array<double>, n array<double>"
INDEX = f"{KEYS}, q int, gq_effect double, dq_effect double, n_sales bigint"
#: Dongs, and dongs x cells x quarters, that are solved at once.
CHUNK, ENTRIES = 512, 250_000


def compress(valid: DataFrame) -> DataFrame:
    """Counts and sums of log prices by cell, gu, dong and quarter: all that the fit needs."""
    return valid.groupBy("cell", "sgg_cd", "dong", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("log_ppm2").alias("s"))


def _without_cells(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations (w, v) of dongs' quarters once the cells' own levels are taken out; n, s: [dongs x] cells x quarters."""
    whole = n.sum(axis=-1)
    share = np.divide(1.0, whole, out=np.zeros(whole.shape), where=whole > 0)[..., None]
    across = np.swapaxes(n, -1, -2)
    w = n.sum(axis=-2)[..., None] * np.eye(n.shape[-1]) - across @ (n * share)
    return w, s.sum(axis=-2) - (across @ (s.sum(axis=-1)[..., None] * share))[..., 0]


def _arrays(col: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(x, float).reshape(width, -1) for x in col])


def large_dongs(rows: DataFrame) -> DataFrame:
    """(sgg_cd, dong, _parts) of dongs with so many cells that their equations are added up from parts."""
    return rows.groupBy("sgg_cd", "dong").agg((F.floor(F.approx_count_distinct("cell") / CELLS) + 1).cast("int").alias("_parts")).where("_parts > 1")


def dong_equations(rows: DataFrame, large: DataFrame, first: int, origins: list[int]) -> DataFrame:
    """(sgg_cd, origin, dong, w, v, n): a large dong's equations as seen at each origin, arrays over the quarters from `first` on.

    A cell lies in one dong, so its level is taken out within the dong; sums over parts of a dong's cells add up. A dong has
    more cells than there are quarters in a square, so these are fewer numbers than its rows.
    """
    width = max(origins) - first + 1

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, cells = pd.factorize(pdf["cell"])
        n, s = np.zeros((len(cells), width)), np.zeros((len(cells), width))
        np.add.at(n, (cell, pdf["q"].to_numpy() - first), pdf["n"].to_numpy(float))
        np.add.at(s, (cell, pdf["q"].to_numpy() - first), pdf["s"].to_numpy(float))
        out = []
        for o in origins:
            k = o - first + 1
            if n[:, :k].any():
                w, v = np.zeros((width, width)), np.zeros(width)
                w[:k, :k], v[:k] = _without_cells(n[:, :k], s[:, :k])
                out.append((key[0], o, key[1], w.ravel().tolist(), v.tolist(), np.where(np.arange(width) < k, n.sum(axis=0), 0.0).tolist()))
        return pd.DataFrame(out, columns=["sgg_cd", "origin", "dong", "w", "v", "n"])

    seen = rows.join(large, ["sgg_cd", "dong"])
    each = seen.groupBy("sgg_cd", "dong", F.pmod(F.xxhash64("cell"), "_parts").alias("part")).applyInPandas(fit, f"{KEYS}, w array<double>, v array<double>, n array<double>")
    long = each.select("sgg_cd", "origin", "dong", F.posexplode(F.concat("w", "v", "n")).alias("i", "x"))
    sums = long.groupBy("sgg_cd", "origin", "dong", "i").agg(F.sum("x").alias("x")).groupBy("sgg_cd", "origin", "dong")
    flat = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("a"))  # one array of numbers, as wide as a part's
    cut = lambda at, n, to: F.slice("a", at + 1, n).alias(to)
    return flat.select("sgg_cd", "origin", "dong", cut(0, width * width, "w"), cut(width * width, width, "v"), cut(width * width + width, width, "n"))


def packed_dongs(rows: DataFrame) -> DataFrame:
    """(sgg_cd, dong, cells): one row for each dong, its cells' counts and sums by quarter in arrays."""
    dealt = rows.repartition("sgg_cd", "dong")
    cells = dealt.groupBy("sgg_cd", "dong", "cell").agg(F.collect_list(F.struct("q", "n", "s")).alias("c"))
    return cells.groupBy("sgg_cd", "dong").agg(F.collect_list("c").alias("cells"))  # CELLS of them at most, about


def _dense(batch: pa.RecordBatch, first: int, width: int):
    """(rows, n, s) for some dongs of a batch at a time: their places in it, and dongs x cells x quarters, short ones filled with zeros."""
    cells = batch.column(batch.schema.get_field_index("cells"))
    seen = cells.flatten()
    size, length = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (cells, seen))
    q, n, s = (pc.struct_field(seen.flatten(), c).to_numpy(zero_copy_only=False) for c in ("q", "n", "s"))
    ends, upto = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(length)])
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        # Dongs come by size, so those of a chunk have about as many cells.
        some = order[at : at + CHUNK]
        some = some[: max(1, int(np.searchsorted(size[some] * np.arange(1, len(some) + 1) * width, ENTRIES, "right")))]
        at += len(some)
        own = [np.arange(upto[ends[i]], upto[ends[i + 1]]) for i in some.tolist()]
        dong = np.repeat(np.arange(len(some)), [len(x) for x in own])
        cell = np.concatenate([np.repeat(np.arange(size[i]), length[ends[i] : ends[i + 1]]) for i in some.tolist()])
        own = np.concatenate(own)
        to = np.zeros((2, len(some), int(size[some].max()), width))
        to[0][dong, cell, q[own] - first] = n[own]
        to[1][dong, cell, q[own] - first] = s[own]
        yield some, to[0], to[1]


def _blocks(dongs: DataFrame, lam: float, first: int, origins: list[int]) -> DataFrame:
    """(sgg_cd, origin, a, r, n): a task's sums of what its dongs leave of their gu's equations, ridge deviations taken out."""
    width = max(origins) - first + 1

    def run(batches):
        total: dict[tuple, list] = {}
        for b in batches:
            names, gu = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for some, n, s in _dense(b, first, width):
                some, n, s = (x[np.argsort(gu[some], kind="stable")] for x in (some, n, s))
                for o in origins:
                    k = o - first + 1
                    w, v = _without_cells(n[:, :, :k], s[:, :, :k])
                    # Without sales a quarter's row and column are zeros, and what comes out of them is zero too.
                    left = lam * np.linalg.solve(w + lam * np.eye(k), np.concatenate([w, v[..., None]], axis=2))
                    at = np.flatnonzero(np.r_[True, gu[some][1:] != gu[some][:-1]])
                    for i, x, m in zip(gu[some][at].tolist(), np.add.reduceat(left, at), np.add.reduceat(n[:, :, :k].sum(axis=1), at), strict=True):
                        own = total.setdefault((names[i], o), [np.zeros((width, width)), np.zeros(width), np.zeros(width)])
                        own[0][:k, :k] += x[:, :k]
                        own[1][:k] += x[:, k]
                        own[2][:k] += m
        rows = [(*k, a.ravel(), r, n) for k, (a, r, n) in total.items() if n.any()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 3), strict=True)], names=["sgg_cd", "origin", "a", "r", "n"])

    return dongs.mapInArrow(run, BLOCKS)


def _large_blocks(equations: DataFrame, lam: float, width: int) -> DataFrame:
    """The same of large dongs' equations."""

    def blocks(batches):
        total: dict[tuple, list] = {}
        for b in batches:
            for gu, origin, w, v, n in zip(b["sgg_cd"], b["origin"], b["w"], b["v"], b["n"], strict=True):
                w, v, n = np.asarray(w).reshape(width, width), np.asarray(v), np.asarray(n)
                at = np.flatnonzero(n > 0)
                inv = lam * np.linalg.inv(w[np.ix_(at, at)] + lam * np.eye(len(at)))
                own = total.setdefault((gu, origin), [np.zeros((width, width)), np.zeros(width), np.zeros(width)])
                own[0][np.ix_(at, at)] += inv @ w[np.ix_(at, at)]
                own[1][at] += inv @ v[at]
                own[2] += n
        yield pd.DataFrame([(*k, a.ravel().tolist(), r.tolist(), n.tolist()) for k, (a, r, n) in total.items()], columns=["sgg_cd", "origin", "a", "r", "n"])

    return equations.select("sgg_cd", "origin", "w", "v", "n").mapInPandas(blocks, BLOCKS)


def gu_effects(sums: DataFrame, width: int) -> DataFrame:
    """(sgg_cd, origin, g, seen): quarter effects of a gu from its tasks' blocks; so a gu of any size is a few sums."""

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, r, n = (sum(_arrays(pdf[c], width)) for c in "arn")
        at, g = np.flatnonzero(n.ravel() > 0), np.full(width, np.nan)
        # A gu's level is free; at the usual bound rounding decides whether it counts as such.
        g[at] = np.linalg.lstsq(a[np.ix_(at, at)], r.ravel()[at], rcond=1e-10)[0]
        return pd.DataFrame([(key[0], key[1], g.tolist(), (n.ravel() > 0).tolist())], columns=["sgg_cd", "origin", "g", "seen"])

    return sums.groupBy("sgg_cd", "origin").applyInPandas(solve, "sgg_cd string, origin int, g array<double>, seen array<boolean>")


def _deviations(dongs: DataFrame, gus: DataFrame, lam: float, first: int, origins: list[int]) -> DataFrame:
    """The index's rows of dongs, their equations set up once more: of a dong only its cells' sums are ever written."""
    width = max(origins) - first + 1
    by_gu = gus.groupBy("sgg_cd").agg(F.collect_list(F.struct("origin", "g", "seen")).alias("gus"))  # a few numbers for each origin

    def run(batches):
        for b in batches:
            names, gu = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            effects = {}
            for i in np.unique(gu, return_index=True)[1].tolist():
                for x in b.column(b.schema.get_field_index("gus"))[i].as_py():
                    effects[int(gu[i]), x["origin"]] = (np.array([np.nan if y is None else y for y in x["g"]], float), np.array(x["seen"], bool))
            for some, n, s in _dense(b, first, width):
                for o in origins:
                    k = o - first + 1
                    at = np.flatnonzero(n[:, :, :k].any(axis=(1, 2)))
                    if not len(at):
                        continue
                    w, v = _without_cells(n[at][:, :, :k], s[at][:, :, :k])
                    g, seen = (np.stack([effects[i, o][j][:k] for i in gu[some[at]].tolist()]) for j in (0, 1))
                    known = np.where(seen, g, 0.0)  # a gu's quarter without sales has none in any of its dongs
                    d = np.linalg.solve(w + lam * np.eye(k), (v - (w @ known[..., None])[..., 0])[..., None])[..., 0]
                    row, col = np.nonzero(seen)
                    took = pa.array(some[at][row])
                    sales = n[at][:, :, :k].sum(axis=1)
                    d = np.where(sales > 0, d, 0.0)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(took), pa.array(np.full(len(row), o, np.int32)), b.column(1).take(took), pa.array((first + col).astype(np.int32)), pa.array(g[row, col]), pa.array(d[row, col]), pa.array(sales[row, col].astype(np.int64))],
                        names=["sgg_cd", "origin", "dong", "q", "gq_effect", "dq_effect", "n_sales"],
                    )

    return dongs.join(F.broadcast(by_gu), "sgg_cd").select("sgg_cd", "dong", "cells", "gus").mapInArrow(run, INDEX)


def _large_deviations(equations: DataFrame, gus: DataFrame, lam: float, first: int, width: int) -> DataFrame:
    """The same of large dongs."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                w, v, n = np.asarray(r.w).reshape(width, width), np.asarray(r.v), np.asarray(r.n)
                at, g, d = np.flatnonzero(n > 0), np.asarray(r.g, float), np.zeros(width)
                own = w[np.ix_(at, at)]
                d[at] = np.linalg.solve(own + lam * np.eye(len(at)), v[at] - own @ g[at])
                out += [(r.sgg_cd, r.origin, r.dong, first + int(i), g[i], d[i], int(n[i])) for i in np.flatnonzero(r.seen)]
            yield pd.DataFrame(out, columns=["sgg_cd", "origin", "dong", "q", "gq_effect", "dq_effect", "n_sales"])

    return equations.join(F.broadcast(gus), ["sgg_cd", "origin"]).mapInPandas(run, INDEX)  # a row for each gu and origin


def hedonic_index(valid: DataFrame, lam: float = 5.0, origins: list[int] | None = None) -> DataFrame:
    """log price = cell + gu x quarter + dong x quarter, deviations shrunk by ridge `lam`; as seen at each origin.

    Each origin sees the quarters up to it (without origins: one, the last quarter). A dong's quarters without sales have
    deviation 0. Levels are arbitrary; differences within a dong are what is estimated. The least squares are exact: cells are
    taken out by dong, dongs by gu, and what is solved are systems as wide as there are quarters.
    """
    return compressed_index(compress(valid), lam, origins)


def compressed_index(rows: DataFrame, lam: float = 5.0, origins: list[int] | None = None) -> DataFrame:
    """hedonic_index from rows as `compress` gives them.

    Dongs are packed into a row each and go through twice, first for their gus' sums and then for their own deviations; their
    equations, a square of quarters for each origin, are set up in the task both times instead of being stored.
    """
    rows = stored(rows, "cells")
    ends = rows.agg(F.min("q").alias("first"), F.max("q").alias("last")).first()
    if ends["first"] is None:
        return rows.sparkSession.createDataFrame([], INDEX).withColumn("log_index", F.col("gq_effect"))
    first, seen_at = ends["first"], sorted(origins or [ends["last"]])
    width = max(seen_at) - first + 1
    seen, large = rows.where(F.col("q") <= max(seen_at)), large_dongs(rows)
    some = not large.isEmpty()
    dongs = stored(packed_dongs(seen.join(large, ["sgg_cd", "dong"], "left_anti") if some else seen), "dongs")
    sums = _blocks(dongs, lam, first, seen_at)
    if some:
        equations = stored(dong_equations(seen, large, first, seen_at), "equations")
        sums = sums.union(_large_blocks(equations, lam, width))
    gus = stored(gu_effects(sums, width), "gus")
    out = _deviations(dongs, gus, lam, first, seen_at)
    if some:
        out = out.union(_large_deviations(equations, gus, lam, first, width))
    return out.withColumn("log_index", F.col("gq_effect") + F.col("dq_effect"))


def residual_scale(valid: DataFrame) -> DataFrame:
    """(sigma): spread of log prices within a dong's quarter, pooled over all; one row."""
    each = valid.groupBy("dong", "q").agg(F.count(F.lit(1)).alias("n"), F.var_pop("log_ppm2").alias("v"))
    return each.agg(F.sqrt(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") - 1))).alias("sigma"))


def deviation_scale(index: DataFrame, sigma: DataFrame, lam: float = 5.0) -> DataFrame:
    """(sigma, tau, used): scale of true deviations, by moments over the upper half of sale counts; sigma and result: one row."""
    some = index.where("n_sales > 0").crossJoin(F.broadcast(sigma))
    mid = some.agg(F.median("n_sales").alias("mid"))
    raw = F.pow(F.col("dq_effect") * (F.col("n_sales") + lam) / F.col("n_sales"), 2) - F.col("sigma") * F.col("sigma") / F.col("n_sales")
    return some.crossJoin(F.broadcast(mid)).where("n_sales >= mid").agg(F.first("sigma").alias("sigma"), F.sqrt(F.greatest(F.avg(raw), F.lit(1e-8))).alias("tau"), F.count(F.lit(1)).alias("used"))


def attach_se(index: DataFrame, scales: DataFrame, lam: float = 5.0) -> DataFrame:
    """index with log_index_se; scales (sigma, tau): one row."""
    kept = index.columns
    return index.crossJoin(F.broadcast(scales.select("sigma", "tau"))).select(*kept, index_se(F.col("n_sales"), F.col("sigma"), F.col("tau"), lam).alias("log_index_se"))


def eb_lambda(scales: DataFrame) -> DataFrame:
    """(lam): the shrinkage that the two scales ask for."""
    return scales.select(F.try_divide(F.pow("sigma", 2), F.pow("tau", 2)).alias("lam"))


def se_by_count_bin(index: DataFrame, edges: Sequence[int] = (1, 5, 10, 20, 50)) -> DataFrame:
    """(bin, n, median_se, mean_se, falls): errors by sale count, and whether the mean is below the bin's before."""
    b = F.lit(0)
    for i, e in enumerate(edges):
        b = F.when(F.col("n_sales") >= e, i + 1).otherwise(b)
    out = index.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.median("log_index_se").alias("median_se"), F.avg("log_index_se").alias("mean_se"))
    return out.withColumn("falls", F.col("mean_se") < F.lag("mean_se").over(Window.orderBy("bin")))  # one row for each bin


def index_check(a: DataFrame, b: DataFrame, first: int, last: int) -> DataFrame:
    """(n, spearman): how two indexes (dong, q, x) agree on the dongs' changes from quarter first to quarter last; one row."""
    change = lambda df, to: df.where(F.col("q").isin(first, last)).groupBy("dong").agg((F.max(F.when(F.col("q") == last, F.col("x"))) - F.max(F.when(F.col("q") == first, F.col("x")))).alias(to))
    both = change(a, "a").join(change(b, "b"), "dong").withColumn("_all", F.lit(1))
    return spearman(both, "a", "b", ["_all"]).drop("_all")


def repeat_sales_index(pairs: DataFrame, damp: float = 1e-4) -> DataFrame:
    """pairs (dong, q0, q, change): quarter effects of each dong by damped least squares on +1 and -1 dummies."""
    moments = pairs.groupBy("dong", "q0", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("change").alias("s"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        quarters = np.unique(pdf[["q0", "q"]].to_numpy())
        a, b = np.searchsorted(quarters, pdf["q0"]), np.searchsorted(quarters, pdf["q"])
        m, v = damp * damp * np.eye(len(quarters)), np.zeros(len(quarters))
        n, s = pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)
        for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
            np.add.at(m, (i, j), sign * n)
        np.add.at(v, b, s)
        np.add.at(v, a, -s)
        return pd.DataFrame({"dong": pdf["dong"].iloc[0], "q": quarters.astype("int32"), "repeat_index": np.linalg.solve(m, v)})

    return moments.groupBy("dong").applyInPandas(fit, "dong string, q int, repeat_index double")


def drawn(n: Column, *parts) -> Column:
    """A number below n from the MD5 of the parts, joined by colons: the same wherever and in whatever order it is drawn."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def block_bootstrap(errors: DataFrame, unit: str, a: str, b: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """Mean error difference a - b and its 95 % interval over draws of units with replacement; one row.

    Units are summed first. Slot s of a draw takes the unit at hash(seed, draw, s), so a run repeats exactly under any
    partitioning; draws x units rows are made on the executors. Spark takes them for few, so the join says that the units
    are the side to be held, by parts: else the draws would go through the driver.
    """
    units = errors.groupBy(unit).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count(F.lit(1)).alias("n"))
    numbered = numbered_rows(units, unit, "slot")
    size = numbered.agg(F.count(F.lit(1)).alias("units"))
    picks = errors.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size)).select("draw", "units", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("k"))
    picks = picks.select("draw", drawn(F.col("units"), seed, F.col("draw"), F.col("k")).alias("slot"))
    each = picks.join(numbered.hint("shuffle_hash"), "slot").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("diff"))
    mean = units.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return each.agg(F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high")).crossJoin(mean)


def structure_clusters(matrix: DataFrame, features: list[str], ks: Sequence[int] = (4,), tries: int = 10, least: int = 50) -> DataFrame:
    """(k, dong, cluster) by k-means on standardized features, for each k the best of `tries` starts; nothing under `least` rows.

    All numbers of clusters and starts are fitted together, so there are as many jobs as rounds.
    """
    matrix = stored(matrix, "matrix").withColumn("_all", F.lit(0))
    if matrix.count() < least:
        return matrix.select(F.lit(0).alias("k"), "dong", F.lit(0).alias("cluster")).where("false")
    points = standardized(matrix, features, ["_all"], least=1)
    return keyed_kmeans(points, list(ks), len(features), ["_all"], starts=tries, rounds=20).select("k", "dong", "cluster")


def choose_k(agreement: DataFrame) -> DataFrame:
    """(k) with the best median agreement (k, ari), then the best tenth percentile, then the smallest; one row."""
    each = agreement.groupBy("k").agg(F.median("ari").alias("m"), F.percentile("ari", F.lit(0.1)).alias("p"))
    return each.orderBy(F.desc("m"), F.desc("p"), "k").limit(1).select("k")


def cluster_profile(matrix: DataFrame, membership: DataFrame, price: str, others: Sequence[str]) -> DataFrame:
    """(cluster, n, price, medians): members, exp of the median log price, and medians of the others."""
    return matrix.join(membership.select("dong", "cluster"), "dong").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.exp(F.median(price)).alias("price"), *[F.median(c).alias(c) for c in others])
