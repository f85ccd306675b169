"""Filters of the served catalog, free-text designations, feature groups, cluster descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The words that a designation of the whole city, one for some buyers only, and one of flats have.
WHOLE, BARRED, NEEDED = "市전체", "외국인", "아파트"


def is_citywide(area: Column, kind: Column, remark: Column, whole: str = WHOLE, barred: str = BARRED, needed: str = NEEDED) -> Column:
    """Whether a designation covers all flats of the city: by its area's words, not for some buyers only. Blanks don't count."""
    a, k, r = (F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") for c in (area, kind, remark))
    return F.contains(a, F.lit(whole)) & ~F.contains(k, F.lit(barred)) & (F.contains(k, F.lit(needed)) | F.contains(r, F.lit(needed)))


def basis(df: DataFrame, area: str, kind: str, remark: str, keep: Sequence[str]) -> DataFrame:
    """Text of the rows that show a city-wide designation; a null is shown as blank."""
    return df.where(is_citywide(F.col(area), F.col(kind), F.col(remark))).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keep])


def select_features(columns: Sequence[str], groups: dict[str, Sequence[str]], drop: Sequence[str] = ()) -> list[str]:
    """Columns of the groups that aren't dropped; each column must stand in exactly one group."""
    for c in columns:
        if (n := sum(c in g for g in groups.values())) != 1:
            raise ValueError(f"{c} is in {n} groups")
    return [c for c in columns if not any(c in groups[g] for g in drop)]


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def filter_dongs(df: DataFrame, query: str = "", gu: str | None = None, flagged: bool | None = None, band: tuple[float, float] | None = None, types: Sequence[int] = ()) -> DataFrame:
    """Catalog rows (gu_name, umd_name, flags, price, type) that meet every condition given; an unknown price or type meets none."""
    if q := query.strip():
        df = df.where(F.contains(F.concat_ws(" ", "gu_name", "umd_name"), F.lit(q)))
    if gu:
        df = df.where(F.col("gu_name") == gu)
    if flagged is not None:
        df = df.where((F.size("flags") > 0) == flagged)
    if band:
        df = df.where(F.col("price").between(*band))
    return df.where(F.col("type").isin(list(types))) if types else df


def structure_z(matrix: DataFrame, membership: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cluster, feature, z): the cluster's median less the whole's, in standard deviations; 0 where nothing varies."""
    long = matrix.unpivot(["dong"], list(features), "feature", "value")
    whole = long.groupBy("feature").agg(F.median("value").alias("m"), F.stddev_pop("value").alias("sd"))
    part = long.join(membership.select("dong", "cluster"), "dong").groupBy("cluster", "feature").agg(F.median("value").alias("c"))
    return part.join(F.broadcast(whole), "feature").select("cluster", "feature", F.coalesce(F.try_divide(F.col("c") - F.col("m"), F.col("sd")), F.lit(0.0)).alias("z"))


def align_labels(previous: DataFrame, current: DataFrame) -> DataFrame:
    """current with clusters renumbered like those of previous they share most dongs with, the largest overlap first.

    The overlaps are one row for a pair of clusters, a handful, and are matched on the driver.
    """
    both = previous.select("dong", F.col("cluster").alias("a")).join(current.select("dong", F.col("cluster").alias("b")), "dong")
    found: dict = {}
    for r in both.groupBy("a", "b").count().orderBy(F.desc("count"), "a", "b").collect():
        if r["b"] not in found and r["a"] not in found.values():
            found[r["b"]] = r["a"]
    labels = [r["cluster"] for r in current.select("cluster").distinct().orderBy("cluster").collect()]
    free = iter([x for x in range(2 * len(labels) + len(found)) if x not in found.values()])
    for b in labels:
        if b not in found:
            found[b] = next(free)
    if not found:
        return current
    return current.withColumn("cluster", F.create_map(*[F.lit(x) for kv in found.items() for x in kv])[F.col("cluster")])
