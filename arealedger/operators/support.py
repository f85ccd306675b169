"""The support table: sample, change, peak, structure and peers of every neighbourhood, and what must hold of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FEW_SALES, HIGH_ERROR, sample_flags, se_band, with_particle
from ..sources.store import stored
from .neighbours import nearest

# Words of a low and a high value, distances told in km, and what a variable is called in a reason.
WORDS = {"log_ppm2": ("평당가 낮음", "평당가 높음"), "jeonse_ratio": ("전세가율 낮음", "전세가율 높음"), "log_stock": ("아파트 세대수 적음", "아파트 세대수 많음"), "new_share": ("신축 비중 낮음", "신축 비중 높음")}
PLACES = {"dist_cbd": "도심", "dist_gangnam": "강남"}
CONCEPTS = {"log_ppm2": "평당가", "jeonse_ratio": "전세가율", "log_stock": "세대수", "new_share": "신축 비중", "lat": "위치", "lng": "위치", "dist_cbd": "도심 거리", "dist_gangnam": "강남 거리"}
DISTINCT, SAME, PEAK = "DISTINGUISHABLE", "INDISTINGUISHABLE", "AT_PEAK"


def state(diff: Column, se: Column, sigmas: float = 2.0) -> Column:
    """Whether a difference stands out of its error; null without one."""
    return F.when(diff.isNotNull(), F.when(F.abs(diff) > sigmas * se, DISTINCT).otherwise(SAME))


def change_states(index: DataFrame, weights: DataFrame, q: int, back: int = 4) -> DataFrame:
    """(dong, change, mu, delta, delta_se, delta_state) of index (dong, q, log_index, log_index_se): the change over `back`
    quarters, the mean weighted by w > 0 over dongs that have both, and the difference with its error."""
    at = lambda t, c: F.max(F.when(F.col("q") == t, F.col(c)))
    rows = index.where(F.col("q").isin(q, q - back)).groupBy("dong").agg((at(q, "log_index") - at(q - back, "log_index")).alias("change"), F.sqrt(F.pow(at(q, "log_index_se"), 2) + F.pow(at(q - back, "log_index_se"), 2)).alias("delta_se"), F.max(F.col("q") == q).alias("now")).where("now")
    known = rows.join(weights.where("w > 0"), "dong").where("change is not null")
    mu = known.agg((F.sum(F.col("change") * F.col("w")) / F.sum("w")).alias("mu"))
    out = rows.crossJoin(F.broadcast(mu)).withColumn("delta", F.col("change") - F.col("mu"))
    return out.select("dong", "change", "mu", "delta", "delta_se", state(F.col("delta"), F.col("delta_se")).alias("delta_state"))


def peak_states(index: DataFrame, q: int, width: int = 20) -> DataFrame:
    """(dong, peak_q, peak_gap, peak_gap_se, peak_state): now against the highest quarter of the last `width`, the latest of
    equal ones; nothing for dongs without an index in each of them."""
    rows = index.where(F.col("q").between(q - width + 1, q))
    now = lambda c: F.max(F.when(F.col("q") == q, F.col(c)))
    top = rows.groupBy("dong").agg(F.max(F.struct("log_index", "q", "log_index_se")).alias("p"), now("log_index").alias("now"), now("log_index_se").alias("se"), F.count(F.lit(1)).alias("n")).where(F.col("n") == width)
    gap, se = F.col("now") - F.col("p.log_index"), F.sqrt(F.pow("se", 2) + F.pow("p.log_index_se", 2))
    return top.select("dong", F.col("p.q").alias("peak_q"), gap.alias("peak_gap"), se.alias("peak_gap_se"), F.when(F.col("p.q") == q, PEAK).otherwise(state(gap, se)).alias("peak_state"))


def structure_matrix(features: DataFrame, cols: Sequence[str], group: str, time: Sequence[str] = ()) -> DataFrame:
    """features with nulls of cols filled by the group's median, or by that of all where the group has none; at each time by itself."""
    own = features.groupBy(*time, group).agg(*[F.median(c).alias(f"_g_{c}") for c in cols])
    every = features.groupBy(*time).agg(*[F.median(c).alias(f"_a_{c}") for c in cols])
    rows = features.join(own, [*time, group], "left")
    rows = rows.join(every, list(time)) if time else rows.crossJoin(F.broadcast(every))
    return rows.select(*[F.coalesce(c, f"_g_{c}", f"_a_{c}").alias(c) if c in cols else F.col(c) for c in features.columns])


def top_variables(long: DataFrame, by: str, value: str, order: Sequence[str], k: int = 2) -> DataFrame:
    """The k rows of each `by` with the largest absolute value; equal ones in the given order of features."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs(value)), place))).where(F.col("rank") <= k)


def phrase(feature: Column, z: Column, middle: Column) -> Column:
    """A variable in words: low or high, or a distance to whole kilometres (halves to even)."""
    out = F.lit(None).cast("string")
    for name, (low, high) in WORDS.items():
        out = F.when(feature == name, F.when(z > 0, high).otherwise(low)).otherwise(out)
    for name, place in PLACES.items():
        out = F.when(feature == name, F.concat(F.lit(f"{place} "), F.rint(middle).cast("long").cast("string"), F.lit("km대"))).otherwise(out)
    return out


def describe_clusters(matrix: DataFrame, membership: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cluster, structure_desc): the two variables whose median in the cluster is farthest from that of all, in words."""
    rows = matrix.join(membership.select("dong", "cluster"), "dong", "left")
    all_ = rows.agg(*[F.median(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    own = rows.where("cluster is not null").groupBy("cluster").agg(*[F.median(c).alias(c) for c in cols]).crossJoin(F.broadcast(all_))
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0))
    long = own.select("cluster", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(z(c), 9).alias("z"), F.col(c).alias("middle")) for c in cols])).alias("x")).select("cluster", "x.*")
    top = top_variables(long, "cluster", "z", cols).withColumn("words", phrase(F.col("feature"), F.col("z"), F.col("middle")))
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "words"))), lambda x: x["words"]), " · ").alias("structure_desc"))


def peer_list(matrix: DataFrame, membership: DataFrame, eligible: DataFrame, cols: Sequence[str], k: int = 5, least: int = 10) -> DataFrame:
    """(dong, rank, peer, reason): the k nearest eligible dongs of the same cluster by standardized distance, where it has
    `least` eligible ones, and the two concepts in which they are nearest.

    matrix has one row for each dong. Dongs are compared within a cluster only, and only where their boxes are near.
    """
    sd = matrix.agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in cols])
    z = matrix.crossJoin(F.broadcast(sd)).select("dong", F.array(*[F.coalesce(F.try_divide(F.col(c), F.col(f"sd_{c}")), F.lit(0.0)) for c in cols]).alias("z"))
    rows = membership.where("cluster is not null").select("dong", "cluster").join(eligible.where("eligible").select("dong"), "dong").join(z, "dong")
    big = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cluster")
    rows = stored(rows.join(big, "cluster").select("dong", "cluster", "z"), "peers")
    best = nearest(rows, "dong", "cluster", "z", k, 12).join(rows.select("dong", "z"), "dong").join(rows.select(F.col("dong").alias("peer"), F.col("z").alias("pz")), "peer")
    best = best.withColumn("parts", F.zip_with("z", "pz", lambda a, b: F.round(F.pow(a - b, 2), 12)))
    ranked = F.array_sort(F.zip_with("parts", F.array(*[F.struct(F.lit(i).alias("i"), F.lit(CONCEPTS[c]).alias("c")) for i, c in enumerate(cols)]), lambda p, x: F.struct(p.alias("p"), x["i"].alias("i"), x["c"].alias("c"))))
    first = F.get(ranked, F.lit(0))["c"]
    second = F.get(F.filter(ranked, lambda x: x["c"] != first), F.lit(0))["c"]
    return best.select("dong", "rank", "peer", F.concat(with_particle(first, "과", "와"), F.lit(" "), with_particle(second, "이", "가"), F.lit(" 가까워요")).alias("reason"))


def build_support(index: DataFrame, concentration: DataFrame, weights: DataFrame, matrix: DataFrame, membership: DataFrame, eligible: DataFrame, q: int, cols: Sequence[str], described: Sequence[str]) -> DataFrame:
    """One row for each dong of the index at q: sample flags, error band, change and peak with their states, structure in
    words, and peers as dong:reason pairs joined by a bar. Peaks are hidden where sales are few or the error is high."""
    now = index.where(F.col("q") == q).select("dong", F.col("log_index_se").alias("index_se")).join(concentration, "dong", "left")
    flags = sample_flags(F.coalesce("sale_n", F.lit(0)), F.col("dominant_share"), F.col("index_se"))
    hide = F.array_contains(flags, FEW_SALES) | F.array_contains(flags, HIGH_ERROR)
    peers = peer_list(matrix, membership, eligible, cols).groupBy("dong").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer", "reason"))), lambda x: F.concat_ws(":", x["peer"], x["reason"])), "|").alias("peers"))
    named = membership.select("dong", "cluster").join(describe_clusters(matrix, membership, described), "cluster", "left")
    rows = now.join(change_states(index, weights, q), "dong", "left").join(peak_states(index, q), "dong", "left").join(named, "dong", "left").join(peers, "dong", "left")
    peak = [F.when(~hide, F.col(c)).alias(c) for c in ("peak_gap", "peak_gap_se", "peak_state")]
    return rows.select("dong", F.lit(q).alias("as_of"), "sale_n", "n_complexes", "dominant_share", "index_se", se_band(F.col("index_se")).alias("se_band"), F.array_join(flags, ";").alias("flags"), "change", "mu", "delta", "delta_se", "delta_state", *peak, F.col("cluster").alias("structure_type"), "structure_desc", "peers")


def peer_pairs(support: DataFrame) -> DataFrame:
    """(dong, pos, peer, reason) of the table's joined peers."""
    each = support.where("peers is not null").select("dong", F.posexplode(F.split("peers", r"\|")).alias("pos", "x"))
    return each.select("dong", "pos", F.split("x", ":", 2)[0].alias("peer"), F.split("x", ":", 2)[1].alias("reason"))


def same_gu_report(support: DataFrame, k: int = 4) -> DataFrame:
    """(dong, same): dongs with k or more peers of their own gu."""
    gu = lambda c: F.split(c, "_")[0]
    return peer_pairs(support).groupBy("dong").agg(F.count_if(gu(F.col("dong")) == gu(F.col("peer"))).alias("same")).where(F.col("same") >= k)


def check_support(support: DataFrame, weights: DataFrame, k: int = 5) -> DataFrame:
    """(rule, dong) for every row that breaks a rule, and a row without a dong for a rule of the whole table."""
    rules = {
        "delta is change less mu": F.abs(F.col("delta") - (F.col("change") - F.col("mu"))) > 1e-9,
        "state with a change": F.col("delta_state").isNull() != F.col("change").isNull(),
        "error of a change is at least that of the index": F.col("delta_se") < F.col("index_se") - 1e-12,
        "gap is never positive": F.col("peak_gap") > 1e-12,
        "no peak where the sample is weak": F.col("peak_state").isNotNull() & F.col("flags").rlike(f"{FEW_SALES}|{HIGH_ERROR}"),
        "share without sales": F.col("dominant_share").isNotNull() & (F.coalesce("sale_n", F.lit(0)) == 0),
        "type with words": F.col("structure_type").isNull() != F.col("structure_desc").isNull(),
    }
    broken = [support.where(c).select(F.lit(name).alias("rule"), "dong") for name, c in rules.items()]
    pairs = peer_pairs(support)
    known = support.select(F.col("dong").alias("peer"))
    broken.append(pairs.join(known, "peer", "left_anti").select(F.lit("peers are known").alias("rule"), "dong"))
    broken.append(pairs.groupBy("dong").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("peer").alias("d"), F.count_if(F.col("peer") == F.col("dong")).alias("own")).where((F.col("n") > k) | (F.col("n") != F.col("d")) | (F.col("own") > 0)).select(F.lit("peers are few, others and each once").alias("rule"), "dong"))
    whole = support.join(weights.where("w > 0"), "dong").agg(F.abs(F.sum(F.col("delta") * F.col("w"))).alias("s"), F.sum("w").alias("w"))
    broken.append(whole.where(F.col("s") > 1e-9 * F.col("w")).select(F.lit("weighted deltas add up to nothing").alias("rule"), F.lit(None).cast("string").alias("dong")))
    broken.append(support.groupBy("dong").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("one row for each dong").alias("rule"), "dong"))
    return reduce(DataFrame.union, broken)


def recount(support: DataFrame, concentration: DataFrame) -> DataFrame:
    """(dong) whose sample counts or share differ from those counted anew from the ledger: every row, not a sample."""
    again = concentration.select("dong", F.col("sale_n").alias("_n"), F.col("n_complexes").alias("_c"), F.col("dominant_share").alias("_s"))
    off = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    share = F.coalesce(F.abs(F.col("dominant_share") - F.col("_s")) > 1e-12, off("dominant_share", "_s"))
    return support.join(again, "dong", "left").where(off("sale_n", "_n") | off("n_complexes", "_c") | share).select("dong")
