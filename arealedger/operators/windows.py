"""Trailing windows, shifts, ranks, quantiles and as-of joins over (key, quarter) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def trailing_windows(df: DataFrame, width: int, q: str = "q", to: str = "as_of") -> DataFrame:
    """Each row once for every quarter whose trailing window of `width` holds it: for medians and distinct counts."""
    return df.withColumn(to, F.explode(F.sequence(F.col(q), F.col(q) + width - 1)))


def rolling_sum(col: str, by: Sequence[str], order: str, width: int, partial: bool = False) -> Column:
    """Sum of the last `width` quarters by value of `order`; null while fewer rows stand there, unless partial."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(-(width - 1), 0)
    total = F.sum(col).over(w)
    return total if partial else F.when(F.count(F.lit(1)).over(w) >= width, total)


def lag_diff(col: str, by: Sequence[str], order: str, k: int = 1) -> Column:
    return F.col(col) - F.lag(col, k).over(Window.partitionBy(*by).orderBy(order))


def cumulative(col: str, by: Sequence[str], order: str) -> Column:
    return F.sum(col).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def relative_to_group(col: str, by: Sequence[str]) -> Column:
    return F.col(col) - F.avg(col).over(Window.partitionBy(*by))


def pct_rank_avg(col: str, by: Sequence[str]) -> Column:
    """Rank as a share of the non-null rows, ties sharing their mean; null rows get a half."""
    seen = Window.partitionBy(*by, F.col(col).isNotNull())
    rank = F.rank().over(seen.orderBy(col)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, col)) - 1) / 2
    return F.when(F.col(col).isNull(), 0.5).otherwise(rank / F.count(col).over(Window.partitionBy(*by)))


def center_median(df: DataFrame, col: str, by: Sequence[str], to: str) -> DataFrame:
    """col less its group's median; null becomes 0."""
    mid = df.groupBy(*by).agg(F.median(col).alias("_mid"))
    return df.join(mid, list(by), "left").withColumn(to, F.coalesce(F.col(col) - F.col("_mid"), F.lit(0.0))).drop("_mid")


def grid(keys: DataFrame, first: int, last: int, to: str = "q") -> DataFrame:
    """Every key in every quarter."""
    return keys.withColumn(to, F.explode(F.sequence(F.lit(first), F.lit(last))))


def shifted(df: DataFrame, cols: Sequence[str], by: Sequence[str], q: str, k: int, suffix: str) -> DataFrame:
    """df with cols of k quarters earlier (later for a negative k), by join: quarters may be missing."""
    past = df.select(*by, (F.col(q) + k).alias(q), *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(past, [*by, q], "left")


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row at or before left_on within the same key.

    One union and one window; no pair of rows is formed. Among right rows at one moment the largest values count.
    Null moments on the left get nulls, on the right they are left out.
    """
    extra = [c for c in left.columns if c not in (*by, left_on)]
    a = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(F.lit(1), *extra).alias("_row"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"))
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*by, F.col("_t").alias(left_on), *[F.col("_row")[c].alias(c) for c in extra], *[F.col("_last")[v].alias(v) for v in values])


def weighted_quantile(df: DataFrame, value: str, weight: str, level: float, by: Sequence[str], to: str) -> DataFrame:
    """The first value whose cumulated weight reaches level times the whole."""
    run = F.sum(weight).over(Window.partitionBy(*by).orderBy(value))
    whole = F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn("_ok", run >= level * whole - 1e-12).where("_ok").groupBy(*by).agg(F.min(value).alias(to))


def order_statistic(df: DataFrame, value: str, level: float, by: Sequence[str], to: str, least: int = 1) -> DataFrame:
    """Split-conformal quantile: the value of rank min(ceil((n + 1) * level), n); none under `least` rows."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    return ranked.where((F.col("_n") >= least) & (F.col("_r") == F.least(F.ceil((F.col("_n") + 1) * F.lit(level) - 1e-9), F.col("_n")))).select(*by, F.col(value).alias(to), F.col("_n").alias("n"))


def origins_before(origins: DataFrame, h: int, q: str = "q", to: str = "s") -> DataFrame:
    """(q, s): for each distinct origin the earlier origins s with s + h <= q. One row for each origin comes together."""
    w = Window.orderBy(q).rangeBetween(Window.unboundedPreceding, -h)
    seen = origins.select(q).distinct().withColumn("_seen", F.collect_list(q).over(w))
    return seen.select(q, F.explode("_seen").alias(to))


def running_order_statistic(df: DataFrame, value: str, level: float, by: Sequence[str], h: int, to: str, least: int = 1, q: str = "q") -> DataFrame:
    """(q, by, to, n): order_statistic of the values >= 0 at origins s with s + h <= q, for every q; none under `least` values.

    Values are counted by narrow classes of their size, and the counts summed over origins; only those in the class that
    holds the wanted rank are looked at one by one. So no history is copied to the origins that follow it.
    """
    rows = df.where(F.col(value).isNotNull()).select(q, *by, value, F.when(F.col(value) > 0, F.floor(F.log2(value) * 32)).otherwise(F.lit(-(1 << 40))).alias("_class"))
    pairs = origins_before(df, h, q, "_s")
    counts = rows.groupBy(F.col(q).alias("_s"), *by, "_class").agg(F.count(F.lit(1)).alias("_k"))
    known = counts.join(F.broadcast(pairs), "_s").groupBy(q, *by, "_class").agg(F.sum("_k").alias("_k"))
    w = Window.partitionBy(q, *by)
    run = known.withColumn("n", F.sum("_k").over(w)).withColumn("_up", F.sum("_k").over(w.orderBy("_class")))
    rank = F.least(F.ceil((F.col("n") + 1) * F.lit(level) - 1e-9), F.col("n"))
    at = run.withColumn("_rank", rank).where((F.col("n") >= least) & (F.col("_up") >= F.col("_rank")) & (F.col("_up") - F.col("_k") < F.col("_rank")))
    at = at.select(q, *by, "_class", "n", (F.col("_rank") - F.col("_up") + F.col("_k")).alias("_rank"))
    inside = at.join(F.broadcast(pairs), q).join(rows.withColumnRenamed(q, "_s"), ["_s", *by, "_class"])
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(q, *by).orderBy(value)))
    return ranked.where("_r = _rank").select(q, *by, F.col(value).alias(to), "n")


def numbered_rows(df: DataFrame, order: str, to: str) -> DataFrame:
    """df with row numbers from 0 by `order`: numbers inside range partitions, after the counts of those before."""
    tagged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = tagged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return inside.join(F.broadcast(before), F.col("_part") == F.col("_of")).select(*df.columns, (F.col("_in") + F.col("_before") - 1).cast("long").alias(to))


def average_ranks(counts: DataFrame, value: str, by: Sequence[str], n: str, to: str) -> DataFrame:
    """counts with the mean rank (from 1) of value in its group, where each row stands for n; equal values share theirs.

    Rows are range partitioned, ranked inside a partition, and the partitions' sizes (a row for each group and partition) give
    each its start: a group of any size is spread over tasks.
    """
    tagged = stored(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranks")
    part = Window.partitionBy(*by, "_part")
    sizes = tagged.groupBy(*by, "_part").agg(F.sum(n).alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # Range by value: equal values stand in one partition and are counted together.
    inside = tagged.withColumn("_up", F.sum(n).over(part.orderBy(value))).withColumn("_tie", F.sum(n).over(Window.partitionBy(*by, "_part", value)))
    out = inside.join(before, same([*by, "_part"], [*[f"_by{i}" for i in range(len(by))], "_of"]))
    return out.select(*counts.columns, (F.col("_before") + F.col("_up") - (F.col("_tie") - 1) / 2).alias(to))


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal columns, nulls included."""
    on = F.lit(True)
    for x, y in zip(left, right, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation, ties sharing their mean; null if a side doesn't vary.

    Equal pairs are counted first. b is ranked over the pairs, a over its values, which come back by a join; what is summed are
    ranks less their mean, (n + 1) / 2.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = stored(both.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    keys = [f"_g{i}" for i in range(len(by))]
    of = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    first = average_ranks(pairs.groupBy(*by, "_a").agg(F.sum("_n").alias("_n")), "_a", by, "_n", "_ra").select(*of, F.col("_a").alias("_v"), "_ra")
    ranked = average_ranks(pairs, "_b", by, "_n", "_rb").join(first, same([*by, "_a"], [*keys, "_v"])).drop(*keys, "_v")
    sizes = pairs.groupBy(*by).agg(F.sum("_n").alias("n")).select(*of, "n")
    x, y = F.col("_ra") - (F.col("n") + 1) / 2, F.col("_rb") - (F.col("n") + 1) / 2
    sums = ranked.join(sizes, same(by, keys)).groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("_n") * x * y).alias("_xy"), F.sum(F.col("_n") * x * x).alias("_xx"), F.sum(F.col("_n") * y * y).alias("_yy"))
    return sums.select(*by, "n", F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt("_xx") / F.sqrt("_yy")).alias("spearman"))


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
