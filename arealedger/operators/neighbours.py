"""Exact nearest neighbours within groups: boxes of near rows, and only those boxes are compared that a row's ball reaches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.store import stored

#: Rows of a box, about, and rows drawn by a hash of their item to place the boxes' edges; every row is then compared.
BOX, DRAWN = 512, 20_000
#: Boxes whose rows call at another box in one group, and callers compared at once.
ABREAST, BLOCK = 32, 256
#: What a bound is widened by, so that rounding loses no neighbour.
SLACK = 1e-6


def distances(a: np.ndarray, b: np.ndarray, digits: int | None) -> np.ndarray:
    """Distances of rows a to rows b, to nine digits, their squares by column to `digits` first; a column that is null on a side counts 0."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = (a[:, i, None] - b[None, :, i]) ** 2
        d = np.where(np.isnan(d), 0.0, d)
        total += d if digits is None else np.floor(d * 10.0**digits + 0.5) / 10.0**digits
    return np.floor(np.sqrt(total) * 1e9 + 0.5) / 1e9


def _split(x: np.ndarray, rows: float) -> tuple | None:
    """A tree of (column, edge, below, above) over drawn rows that stand for so many; None is a leaf."""
    if rows <= BOX or len(x) < 4:
        return None
    wide = x.max(axis=0) - x.min(axis=0)
    i = int(wide.argmax())
    edge = float(np.median(x[:, i]))
    low = x[:, i] <= edge
    if wide[i] == 0 or low.all():
        low = x[:, i] < edge
        if wide[i] == 0 or not low.any():
            return None
        edge = float(x[low, i].max())
    return i, edge, _split(x[low], rows * low.mean()), _split(x[~low], rows * (~low).mean())


def _leaf(tree: tuple | None, x: np.ndarray, at: np.ndarray, out: np.ndarray, number: int) -> int:
    """Numbers the leaves of rows `at` from `number` on, the same for the same tree; gives the next number."""
    if tree is None:
        out[at] = number
        return number + 1
    low = x[at, tree[0]] <= tree[1]
    return _leaf(tree[3], x, at[~low], out, _leaf(tree[2], x, at[low], out, number))


def _x(table) -> np.ndarray:
    col = table.column("x")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1)


def _boxed(rows: DataFrame) -> DataFrame:
    """rows (group, item, x) with `box`, stored. A leaf of many equal rows is several boxes."""
    sizes = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each group
    every = max(1, -(-sum(sizes.values()) // DRAWN))
    drawn: dict = {}
    for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(every)) == 0).select("group", "x").collect():
        drawn.setdefault(r["group"], []).append(r["x"])
    trees, start, number = {}, {}, 0
    for g, n in sizes.items():
        x = np.nan_to_num(np.array(drawn.get(g, []), float)) if drawn.get(g) else np.zeros((0, 1))
        trees[g], start[g] = _split(x, n), number
        number += _leaf(trees[g], np.zeros((1, 1024)), np.arange(0), np.zeros(1, int), 0)
    out = rows.withColumn("leaf", F.lit(0)).schema

    def placed(batches):
        for b in batches:
            x, leaf = np.nan_to_num(_x(b)), np.zeros(b.num_rows, int)
            for g, at in pd.Series(b.column("group").to_pylist()).groupby(b.column("group").to_pylist(), sort=False).indices.items():
                _leaf(trees[g], x, np.asarray(at), leaf, start[g])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=out.names)

    leaves = stored(rows.mapInArrow(placed, out), "leaves")
    counts = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * BOX)).cast("int").alias("_parts"))
    first = counts.withColumn("_first", F.sum("_parts").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_parts"))  # one row for each leaf
    box = (F.col("_first") + F.pmod(F.xxhash64("item", F.lit(1)), F.col("_parts"))).cast("int").alias("box")
    return stored(leaves.join(F.broadcast(first), "leaf").select("group", "item", "x", box), "boxes")


def nearest(rows: DataFrame, item: str, group: str, x: str, k: int, digits: int | None = None) -> DataFrame:
    """(item, peer, distance, rank): the k nearest other rows of the same group by distance (to nine digits), then by name.

    x is an array of numbers; items are distinct. Rows lie in boxes of about BOX, by halving at medians of drawn rows. The
    k-th distance within its own box bounds a row's neighbours, and the row calls only at boxes of its group that this
    ball reaches; nobody nearer is left out. What is held at once are a box and its callers, ABREAST boxes of them.
    """
    boxed = _boxed(rows.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(x).cast("array<double>").alias("x")))
    spread = boxed.select("group", "box", F.posexplode("x").alias("i", "v")).groupBy("box", "group", "i").agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.count_if(F.col("v").isNull() | F.isnan("v")) > 0).alias("gaps"))
    edges: dict = {}
    for r in spread.collect():  # a row for each box and column: a few for every BOX rows
        edges.setdefault(r["group"], {}).setdefault(r["box"], {})[r["i"]] = (-np.inf, np.inf) if r["gaps"] else (r["low"], r["high"])
    boxes = {g: (np.array(sorted(own)), np.array([[own[b][i] for i in sorted(own[b])] for b in sorted(own)])) for g, own in edges.items()}
    bounded, call = boxed.withColumn("bound", F.lit(0.0)).schema, boxed.withColumn("bound", F.lit(0.0)).withColumn("at", F.lit(0)).schema

    def bounds(key: tuple, own: pa.Table) -> pa.Table:
        a, bound = _x(own), np.full(own.num_rows, np.inf)
        if len(a) > k:
            for i in range(0, len(a), BLOCK):
                bound[i : i + BLOCK] = np.partition(distances(a[i : i + BLOCK], a, digits), k, axis=1)[:, k]  # itself counts as one
        return own.append_column("bound", pa.array(bound)).cast(to_arrow_schema(bounded))

    def calls(batches):
        for b in batches:
            x, bound = _x(b), b.column("bound").to_numpy()
            for g, rows_ in pd.Series(range(b.num_rows)).groupby(b.column("group").to_pylist(), sort=False).indices.items():
                numbers, edge = boxes[g]
                for at in (np.asarray(rows_)[i : i + BLOCK] for i in range(0, len(rows_), BLOCK)):
                    gap = np.zeros((len(at), len(numbers)))
                    for i in range(x.shape[1]):
                        v = x[at, i, None]
                        d = np.maximum(np.maximum(edge[None, :, i, 0] - v, v - edge[None, :, i, 1]), 0.0)
                        gap += np.where(np.isnan(d), 0.0, d) ** 2
                    who, where = np.nonzero(np.sqrt(gap) <= bound[at, None] * (1 + SLACK) + SLACK)
                    out = b.take(pa.array(at[who]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers[where], pa.int32())], names=call.names)

    found = "item string, peer string, distance double"

    def meet(key: tuple, callers: pa.Table, own: pa.Table) -> pa.Table:
        a, b, bound = _x(callers), _x(own), callers.column("bound").to_numpy()
        names, peers = callers.column("item").to_pylist(), np.array(own.column("item").to_pylist(), object)
        places = {n: i for i, n in enumerate(peers)}
        order = np.argsort(peers, kind="stable")  # by name, so that of equal distances the first names count
        out: list[tuple] = []
        for i in range(0, len(a), BLOCK):
            d = distances(a[i : i + BLOCK], b, digits)
            for r in range(len(d)):
                if (me := places.get(names[i + r])) is not None:
                    d[r, me] = np.inf
            d = d[:, order]
            for r, cols in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
                out += [(names[i + r], peers[order[c]], float(d[r, c])) for c in cols if d[r, c] < np.inf and d[r, c] <= bound[i + r] + SLACK]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["item", "peer", "distance"])

    sure = stored(boxed.groupBy("box").applyInArrow(bounds, bounded), "bounds")
    callers = stored(sure.mapInArrow(calls, call).withColumn("lot", F.floor(F.col("box") / ABREAST).cast("int")), "calls")
    hosts = boxed.select("item", "x", F.col("box").alias("at")).join(callers.select("at", "lot").distinct(), "at").select(F.col("at").alias("of"), F.col("lot").alias("for"), "item", "x")
    near = callers.select("at", "lot", "item", "x", "bound").groupBy("at", "lot").cogroup(hosts.groupBy("of", "for")).applyInArrow(meet, found)
    place = F.row_number().over(Window.partitionBy("item").orderBy("distance", "peer"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item").alias(item), "peer", "distance", "rank")
