"""Whitening of embeddings with multiplicities: equal vectors are grouped, and every product is made once for each.

Entries become integers, so that equal vectors meet exactly. The covariance is a weighted product of centred blocks, one
partial matrix for each task; a distinct vector is whitened once and its values are joined back to its rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components at most.
COMPONENTS = 8
#: A vector with one in so many of all rows, or more, is joined back by broadcast; there are no more than so many of them.
HOT = 64
#: Larger entries take the end of this range, so that integers stay exact in doubles.
LARGEST = float(1 << 42)
#: Eigenvalues up to this share of the trace are no variance.
FLAT = 1e-12


def levels(vector: Column) -> Column:
    """A vector's integers."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def block(col: pa.Array) -> np.ndarray:
    """A list array of equally long rows as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def column_sums(distinct: DataFrame) -> list[int]:
    """The exact weighted sum of each place of x."""

    def run(batches):
        total: list[int] = []
        for b in batches:
            if not b.num_rows:
                continue
            x, w = block(b.column(0)), b.column(1).to_numpy()
            safe = largest(x) * int(w.sum()) < 1 << 62
            part = [int(v) for v in ((x * w[:, None]).sum(axis=0) if safe else (x.astype(object) * w[:, None].astype(object)).sum(axis=0))]
            total = [s + t for s, t in zip(total, part, strict=True)] if total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["place", "s"])

    found = distinct.select("x", "w").mapInArrow(run, "place int, s decimal(38,0)").groupBy("place").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(found, key=lambda r: r["place"])]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers, or Python's where those don't do."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    low = x - base
    if (largest(low) + 1) * n < 1 << 62:
        return low * n - rest
    return low.astype(object) * n - rest.astype(object)


def covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance of x, divisor n: partial products of centred blocks, added up by cell of the matrix.

    What reaches the driver is the matrix itself, as large as the vectors are wide.
    """

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            y = (centred(block(b.column(0)), n, sums) / n).astype(float)
            part = (y * b.column(1).to_numpy()[:, None]).T @ y
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = distinct.select("x", "w").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((len(sums), len(sums)))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pylist():
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling; a vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def whiten(df: DataFrame, vec: str = "embedding", key: str = "vec_id", k: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and each of up to k components.

    weights: "counts" fits on all rows, "one" on each distinct vector once. deviation is exact (decimal; null beyond 38
    digits). A component without variance has null whitened values and explains 0; identity_error is over the others, null
    if there are none. Rows with a null vector, or with a null, NaN or infinite entry, are left out, and so are rows of
    another width than the most frequent one (of those the least). Entries beyond 2^42 count as that. Repeated rows and
    null keys keep a row each; other columns are not looked at; a table without usable rows gives an empty one.
    """
    spark, vector = df.sparkSession, F.col(vec)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kept = df.where(usable(vector)).select(F.col(key).alias("key"), vector.alias("v"))
    width = kept.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("m")).agg(F.max_by("width", F.struct("m", -F.col("width"))).alias("width")).first()["width"]
    if not width:
        return spark.createDataFrame([], schema)
    rows = kept.where(F.size("v") == width).select("key", levels(F.col("v")).alias("x"))
    distinct = rows.groupBy("x").agg(F.count("*").alias("m")).select("x", "m", (F.col("m") if weights == "counts" else F.lit(1)).cast("long").alias("w"))
    distinct = materialize(distinct, "white-distinct")
    n, all_rows = distinct.agg(F.sum("w"), F.sum("m")).first()
    sums = column_sums(distinct)
    cov = covariance(distinct, n, sums)
    values, vectors = components(cov, min(k, width))
    trace = float(np.trace(cov))
    flat = values <= FLAT * trace
    scale = vectors / np.sqrt(np.where(flat, 1.0, values))

    def run(batches):
        for b in batches:
            d = centred(block(b.column(0)), n, sums)
            if d.dtype == object or largest(d) ** 2 * max(width, 1) >= 1 << 63:
                own = [int((row * row).sum()) for row in d.astype(object)]
                far = pa.array([Decimal(v) if v < 10**38 else None for v in own], pa.decimal128(38, 0))
            else:
                far = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
            z = (d / n).astype(float) @ scale
            z[:, flat] = np.nan
            yield pa.RecordBatch.from_arrays([*b.columns, far, pa.array(list(z), pa.list_(pa.float64()))], names=["x", "m", "w", "deviation", "z"])

    whitened = materialize(distinct.mapInArrow(run, "x array<bigint>, m bigint, w bigint, deviation decimal(38,0), z array<double>"), "white-values")
    live = np.flatnonzero(~flat).tolist()
    error = None
    if live:
        z = lambda i: F.element_at("z", i + 1)
        means = whitened.agg(*[(F.sum(F.col("w") * z(i)) / n).alias(str(i)) for i in live]).first()
        cells = [(i, j) for i in live for j in live if i <= j]
        found = whitened.agg(*[(F.sum(F.col("w") * (z(i) - means[str(i)]) * (z(j) - means[str(j)])) / n).alias(f"{i}_{j}") for i, j in cells]).first()
        error = max(abs(found[f"{i}_{j}"] - (i == j)) for i, j in cells)

    # The few vectors that make up much of the table go out whole; of any other a small share of the rows meets its values.
    often = F.col("m") * HOT >= all_rows
    hot = F.broadcast(whitened.where(often).select("x", "deviation", "z"))
    joined = rows.join(hot, "x").unionByName(rows.join(hot, "x", "left_anti").join(whitened.where(~often).select("x", "deviation", "z"), "x"))
    share = F.element_at(F.array(*[F.lit(0.0 if f else float(e) / trace) for e, f in zip(values, flat, strict=True)]), F.col("i") + 1)
    each = joined.select("key", "deviation", F.posexplode("z").alias("i", "v"))
    return each.select(
        F.col("key").alias(key),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("v"), F.col("v")).alias("whitened"),
        share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def whitened_rows(embeddings: DataFrame) -> DataFrame:
    """`whiten` of vec_id and embedding; a deviation beyond 64 bits is null."""
    return whiten(embeddings).withColumn("deviation", F.col("deviation").try_cast("long"))
