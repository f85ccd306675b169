"""Mean indexes, targets, baselines, intervals and scores of rolling-origin forecasts; event studies; peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import crc_fold
from .neighbours import nearest
from .windows import running_order_statistic, shifted


def mean_index(valid: DataFrame, lam: float = 5.0) -> DataFrame:
    """Gu mean of log price by quarter plus the dong's deviation, shrunk by n / (n + lam): the quick index."""
    d = valid.groupBy("sgg_cd", "dong", "q").agg(F.count(F.lit(1)).alias("n_sales"), F.sum("log_ppm2").alias("_s"), F.avg("log_ppm2").alias("mean"))
    gu = Window.partitionBy("sgg_cd", "q")  # a row for each dong of a gu
    d = d.withColumn("gu_mean", F.sum("_s").over(gu) / F.sum("n_sales").over(gu))
    dev = (F.col("mean") - F.col("gu_mean")) * F.col("n_sales") / (F.col("n_sales") + lam)
    return d.select("dong", "sgg_cd", "q", "n_sales", dev.alias("dq_effect"), (F.col("gu_mean") + dev).alias("log_index"))


def with_targets(index: DataFrame, h: int) -> DataFrame:
    """Change over the next h quarters, and over the last h."""
    ahead = shifted(index, ["log_index"], ["dong"], "q", -h, "_ahead")
    both = shifted(ahead, ["log_index"], ["dong"], "q", h, "_back")
    return both.withColumn("y", F.col("log_index_ahead") - F.col("log_index")).withColumn("b1", F.col("log_index") - F.col("log_index_back")).drop("log_index_ahead", "log_index_back")


def baselines(panel: DataFrame) -> DataFrame:
    """B1: own momentum; B2: its mean over the origin's dongs; B0: none; where both a target and a momentum stand."""
    rows = panel.where("y is not null and b1 is not null")
    return rows.withColumn("b2", F.avg("b1").over(Window.partitionBy("q"))).withColumn("b0", F.lit(0.0))


def mae_by_origin(preds: DataFrame) -> DataFrame:
    return preds.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(F.col("y") - F.col(b))).alias(f"mae_{b}") for b in ("b0", "b1", "b2")])


def conformal_intervals(preds: DataFrame, h: int, level: float = 0.8, least: int = 200) -> DataFrame:
    """preds (dong, q, y, pred) with the half-width from errors of the other fold of dongs whose targets were known: s + h <= q."""
    rows = preds.withColumn("fold", crc_fold(F.col("dong"))).withColumn("err", F.abs(F.col("y") - F.col("pred")))
    width = running_order_statistic(rows, "err", level, ["fold"], h, "half", least).withColumn("fold", 1 - F.col("fold"))
    out = rows.join(F.broadcast(width.select("q", "fold", "half", F.col("n").alias("n_cal"))), ["q", "fold"])
    return out.select("dong", "q", "fold", "n_cal", "half", (F.col("err") <= F.col("half")).alias("covered"))


def interval_coverage(intervals: DataFrame) -> DataFrame:
    """(year, n, coverage, width): share of targets inside and the median width, by year of the origin."""
    return intervals.groupBy(F.floor(F.col("q") / 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.median(2 * F.col("half")).alias("width"))


def choose_gamma(history: DataFrame, grid: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """The share of the signal x with the least mean absolute error of y - gamma * x, origins weighing alike; ties to the smaller."""
    tried = history.withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in grid])))
    each = tried.groupBy("gamma", "q").agg(F.avg(F.abs(F.col("y") - F.col("gamma") * F.col("x"))).alias("mae"))
    whole = each.groupBy("gamma").agg(F.round(F.avg("mae"), 10).alias("mae"))
    return whole.withColumn("chosen", F.row_number().over(Window.orderBy("mae", "gamma")) == 1)


def change_block(index: DataFrame, weights: DataFrame, q: int, back: int = 4) -> DataFrame:
    """Change over `back` quarters, the weighted mean's, and the difference; without weight the plain mean."""
    now = shifted(index.where(F.col("q").isin(q, q - back)), ["log_index"], ["dong"], "q", back, "_then").where(F.col("q") == q)
    rows = now.withColumn("change", F.col("log_index") - F.col("log_index_then")).where("change is not null").join(weights, "dong", "left")
    mu = rows.agg(F.coalesce(F.try_divide(F.sum(F.col("change") * F.coalesce("w", F.lit(0))), F.sum(F.coalesce("w", F.lit(0)))), F.avg("change")).alias("mu"))
    return rows.crossJoin(F.broadcast(mu)).select("dong", "change", "mu", (F.col("change") - F.col("mu")).alias("delta"))


def overlapping_events(events: DataFrame, within: int = 4) -> DataFrame:
    """Other events within so many quarters, as a comma list in input order. Events are a list kept by hand: a fixed, small side."""
    a, b = events.alias("a"), events.select("event_id", "q", "pos").alias("b")
    near = a.join(F.broadcast(b), (F.abs(F.col("a.q") - F.col("b.q")) <= within) & (F.col("a.event_id") != F.col("b.event_id")), "left")
    out = near.groupBy("a.event_id").agg(F.array_sort(F.collect_list(F.when(F.col("b.pos").isNotNull(), F.struct("b.pos", "b.event_id")))).alias("x"))
    return out.select("event_id", F.array_join(F.transform("x", lambda e: e["event_id"]), ",").alias("overlaps"))


def event_paths(index: DataFrame, events: DataFrame, reach: int = 4) -> DataFrame:
    """Index of each dong at k = -reach..reach quarters around each event, less its value at -1."""
    rows = events.select("event_id", F.col("q").alias("q_event"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")).withColumn("q", F.col("q_event") + F.col("k"))
    at = index.join(F.broadcast(rows), "q").select("event_id", "dong", "k", "log_index")
    base = at.where("k = -1").select("event_id", "dong", F.col("log_index").alias("base"))
    return at.join(base, ["event_id", "dong"]).select("event_id", "dong", "k", (F.col("log_index") - F.col("base")).alias("path"))


def event_summary(paths: DataFrame) -> DataFrame:
    m = paths.groupBy("event_id", "k").agg(F.count("path").alias("n"), F.avg("path").alias("mean"), F.median("path").alias("median"), F.percentile("path", F.lit(0.1)).alias("p10"), F.percentile("path", F.lit(0.9)).alias("p90"), F.avg((F.col("path") > 0).cast("double")).alias("share_up"))
    down = paths.groupBy("event_id", "k").agg(F.avg((F.col("path") < 0).cast("double")).alias("share_down"))
    return m.join(down, ["event_id", "k"]).withColumn("same_direction", F.when(F.round("mean", 12) != 0, F.when(F.col("mean") > 0, F.col("share_up")).otherwise(F.col("share_down")))).drop("share_down")


# What is said of events that the index doesn't reach.
OUTSIDE_EVENT, OUTSIDE_BASE = "이벤트 분기가 지수 범위 밖", "기준 분기가 지수 범위 밖"


def event_outcomes(index: DataFrame, events: DataFrame, back: int = 4, ahead: int = 3) -> DataFrame:
    """One row for each event (event_id, q, pos): changes of eligible dongs before and after it, whether the index (dong, q,
    log_index, eligible) reaches far enough for either, overlapping events, and why there is nothing.

    The base is the quarter before the event; dongs that are eligible there count. An event or base outside of the index has
    no dongs and null changes. Dongs without an index at the other end are left out of a mean.
    """
    ends = index.agg(F.min("q").alias("first"), F.max("q").alias("last"))
    rows = events.select("event_id", "q", "pos").crossJoin(F.broadcast(ends))
    within = lambda c: F.coalesce(c.between(F.col("first"), F.col("last")), F.lit(False))
    note = F.array_join(F.array_compact(F.array(F.when(~within(F.col("q")), OUTSIDE_EVENT), F.when(~within(F.col("q") - 1), OUTSIDE_BASE))), "; ")
    rows = rows.withColumn("note", note).withColumn("pre_observable", F.coalesce(F.col("q") - 1 - back >= F.col("first"), F.lit(False))).withColumn("post_observable", F.coalesce(F.col("q") + ahead <= F.col("last"), F.lit(False)))
    seen = F.broadcast(rows.where("note = ''").select("event_id", F.col("q").alias("_q")))  # events are a list kept by hand
    at = lambda k, to, *more: index.join(seen, F.col("q") == F.col("_q") + k).select("event_id", "dong", F.col("log_index").alias(to), *more)
    base = at(-1, "base", "eligible").where("eligible").drop("eligible")
    both = base.join(at(-1 - back, "before"), ["event_id", "dong"], "left").join(at(ahead, "after"), ["event_id", "dong"], "left")
    change = both.select("event_id", (F.col("base") - F.col("before")).alias("pre"), (F.col("after") - F.col("base")).alias("post"))
    way = lambda c: F.avg(c.cast("double"))
    each = change.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_dongs"), F.count("post").alias("n_post"), F.avg("pre").alias("pre_change"), F.avg("post").alias("post_change"), F.median("post").alias("post_median"), F.percentile("post", F.lit(0.1)).alias("post_p10"), F.percentile("post", F.lit(0.9)).alias("post_p90"), way(F.col("post") > 0).alias("share_up"), way(F.col("post") < 0).alias("_down"))
    out = rows.join(each, "event_id", "left").join(overlapping_events(events), "event_id")
    if_seen = lambda flag, c: F.when(F.col(flag), F.col(c)).alias(c)
    same = F.when(F.round("post_change", 12) > 0, F.col("share_up")).when(F.round("post_change", 12) < 0, F.col("_down"))
    after = [if_seen("post_observable", c) for c in ("post_change", "post_median", "post_p10", "post_p90", "share_up")]
    return out.select("event_id", "q", F.coalesce("n_dongs", F.lit(0)).alias("n_dongs"), F.when(F.col("post_observable"), F.coalesce("n_post", F.lit(0))).otherwise(0).alias("n_post"), if_seen("pre_observable", "pre_change"), *after, F.when(F.col("post_observable"), same).alias("same_direction"), "pre_observable", "post_observable", "overlaps", "note")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings, from their contingency counts."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs("n").alias("s"), F.sum("n").alias("t"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("sa"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("sb"))
    whole = F.col("t") * (F.col("t") - 1) / 2
    expect = F.col("sa") * F.col("sb") / whole
    most = (F.col("sa") + F.col("sb")) / 2
    return both.crossJoin(left).crossJoin(right).select(F.col("t").cast("long").alias("n"), F.when(most == expect, 1.0).otherwise((F.col("s") - expect) / (most - expect)).alias("ari"))


def peers(matrix: DataFrame, features: list[str], group: str, k: int = 5) -> DataFrame:
    """The k nearest rows of the same group by standardized distance; a feature that is null on a side counts 0. Rows are
    compared within a group only, and only where their boxes are near."""
    sd = matrix.agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in features])
    z = matrix.crossJoin(F.broadcast(sd)).select("dong", group, F.array(*[F.try_divide(c, f"sd_{c}") for c in features]).alias("z"))
    return nearest(z, "dong", group, "z", k).select("dong", "peer", "distance", "rank")


def region_tags(rows: DataFrame, col: str, top: float = 0.3) -> DataFrame:
    """Rows with a positive value at or above that of place ceil(top * n) among positive ones."""
    plus = rows.where(F.col(col) > 0)
    n = plus.groupBy(col).agg(F.count(F.lit(1)).alias("_rows"))
    above = F.sum("_rows").over(Window.orderBy(F.desc(col)))  # distinct values, counted: not rows
    whole = F.sum("_rows").over(Window.orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = n.select(col, above.alias("above"), whole.alias("whole")).where(F.col("above") >= F.ceil(F.col("whole") * F.lit(top) - 1e-9)).agg(F.max(col).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("tagged", F.coalesce((F.col(col) > 0) & (F.col(col) >= F.col("cut")), F.lit(False)))
