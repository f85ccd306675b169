"""Helpers shared by the training-data operators: shared storage, tables, running totals, components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store

#: Rows of a narrow table that is broadcast; a larger one is joined by a shuffle.
FEW = 250_000
#: Bytes of rows that Spark hands to a Python worker at once within small_batches, and the setting for it.
BATCH, BATCH_KEY = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, see sources.store."""
    return store.shared_dir(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: it cuts lineage and survives lost executors."""
    return store.stored(df, label)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside passes texts to Python in small batches, which executor and worker hold twice each."""
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, before)


def drop_tables(*tables: DataFrame) -> None:
    """Remove what materialize has written and no later step reads; tables of other origin are left alone."""
    for df in tables:
        if path := vars(df).get("stored_at"):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have few rows; else a join with it shuffles both sides."""
    return F.broadcast(df) if df.count() <= FEW else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text of df, a null text as the empty one."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, str], label: str) -> DataFrame:
    """df with, for each item new_name: column, the total of column over earlier rows of the row's group.

    Two levels: rows are range partitioned, summed inside each partition, and the partition totals (one row for
    each group and partition) give each partition its start. So a group with most of the rows is spread over
    tasks. Rows that tie in `order` get the positions of some fixed order among them. Nulls come first.
    """
    tagged = materialize(df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_part", F.spark_partition_id()), label)
    keys = [*group, "_part"]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tagged.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in values.items()])
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.coalesce(F.sum(f"_sum_{n}").over(of_parts), F.lit(0)).alias(f"_base_{n}") for n in values])
    local = tagged.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_in_{n}") for n, c in values.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = local.join(parts, on)
    return out.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_base_{n}")).cast("long").alias(n) for n in values])


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint); root is the component's smallest node.

    Large-star and small-star rounds: each node links its larger neighbours, then its smaller ones, to the smallest
    it knows, until no edge changes. Every round is one written table, whose digest is observed as it is written; a
    hub's edges are never gathered in one row.
    """
    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialize(e.distinct().observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), label)
        return out, (seen.get["n"], seen.get["x"])

    now, seen = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, (now, new) = now, written(moved.union(smallest.select("a", F.col("m").alias("b"))))
        drop_tables(before)
        if new == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = new
    if seen[0]:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
