"""What was known at each origin: vintage indexes, momentum, real-time targets, volumes, market and relative panels."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .windows import center_median, pct_rank_avg, relative_to_group

LAGS, HORIZONS = (1, 2, 4, 8, 12), (2, 4, 8, 12)
#: Sums by cell and quarter that are worked on at once: bounds a worker's memory where each dong has few.
SLICE = 2_500


def _dong_sums(first: int, last: int):
    """A task of mapInArrow over rows (dong, sgg_cd, cell, q, n, s) in that order: a dong's sums by origin and quarter.

    A cell's level at an origin is its mean up to then, so a dong's residuals are its sums less the product of its cells' counts
    by quarter and levels by origin. Dongs and cells may go on in the next batch; there is only a square of quarters for a dong.
    """

    def closed(names, gus, n, s, low):
        """Rows of dongs whose squares are whole; n by dong and quarter, s by dong, origin and quarter."""
        q = np.arange(low, last + 1)
        origins = np.arange(first, last + 1)
        d, o, k = np.nonzero((n[:, None, :] > 0) & (q[None, None, :] <= origins[None, :, None]))
        at = pa.array(d)
        return pa.RecordBatch.from_arrays([names.take(at), gus.take(at), pa.array(origins[o], pa.int32()), pa.array(q[k], pa.int32()), pa.array(n[d, k].astype(np.int64)), pa.array(s[d, o, k])], names=["dong", "sgg_cd", "origin", "q", "n_sales", "r"])

    def summed(t: pa.Table, low: int, part: tuple | None):
        """(dongs, gus, n, s) of whole cells; part: what the first dong already has."""
        codes = [pc.fill_null(t[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in ("dong", "sgg_cd", "cell")]
        new = np.logical_or(codes[0][1:] != codes[0][:-1], codes[1][1:] != codes[1][:-1])
        dong = np.concatenate([[0], np.cumsum(new)])
        cell = np.concatenate([[0], np.cumsum(np.logical_or(new, codes[2][1:] != codes[2][:-1]))])
        width, starts = last - low + 1, np.flatnonzero(np.concatenate([[True], new]))
        q, n, s = (t[c].to_numpy() for c in ("q", "n", "s"))
        count, total = np.zeros((2, cell[-1] + 1, width))
        count[cell, q - low], total[cell, q - low] = n, s
        mean = (total.sum(axis=1) / count.sum(axis=1))[:, None]  # taken off first, so that small differences stay exact
        total -= count * mean
        seen, level = np.cumsum(count, axis=1), np.cumsum(total, axis=1)
        level = np.divide(level, seen, out=np.zeros(level.shape), where=seen > 0)
        origins = np.arange(first, last + 1) - low
        level = np.where(origins >= 0, level[:, np.maximum(origins, 0)], 0.0)
        cells = np.append(cell[starts], cell[-1] + 1)
        own = np.add.reduceat(count, cells[:-1], axis=0)
        r = np.add.reduceat(total, cells[:-1], axis=0)[:, None, :] - np.stack([level[a:z].T @ count[a:z] for a, z in zip(cells, cells[1:], strict=False)])
        if part:
            own[0] += part[0]
            r[0] += part[1]
        return t["dong"].combine_chunks().take(pa.array(starts)), t["sgg_cd"].combine_chunks().take(pa.array(starts)), own, r

    def run(batches):
        rest, part, low = None, None, last  # rows of a cell that may go on; n and s of a dong that may; the first quarter so far
        key = lambda t, i, names: tuple(t[c][i].as_py() for c in names)
        for b in itertools.chain((b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)), [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None:
                return
            new = min(low, pc.min(t["q"]).as_py())
            if part and new < low:
                part = tuple(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(low - new, 0)]) for x in part)
            low, cut = new, t.num_rows
            if b is not None:
                end = key(t, cut - 1, ("dong", "sgg_cd", "cell"))
                while cut and key(t, cut - 1, ("dong", "sgg_cd", "cell")) == end:  # a number for each quarter
                    cut -= 1
            rest = t.slice(cut)
            if not cut:
                continue
            done = t.slice(0, cut)
            names, gus, n, s = summed(done, low, part)
            whole = len(n) if b is None or key(rest, 0, ("dong", "sgg_cd")) != key(done, cut - 1, ("dong", "sgg_cd")) else len(n) - 1
            part = (n[-1], s[-1]) if whole < len(n) else None
            for i in range(0, whole, 64):
                z = min(i + 64, whole)
                yield closed(names[i:z], gus[i:z], n[i:z], s[i:z], low)

    return run


def residual_index(valid: DataFrame, first: int, last: int, lam: float = 5.0) -> DataFrame:
    """(origin, sgg_cd, dong, q, n_sales, log_index) for origins first to last, from sales up to each origin.

    Log prices less their cell's mean as known at the origin; the gu's mean plus the dong's deviation, shrunk by
    n / (n + lam). Sums by cell and quarter are dealt to tasks by dong once and go to Python in the order of dongs and cells:
    there a dong's sums for all origins are a product of small matrices, so nothing is repeated by cell and origin.
    """
    rows = valid.where(F.col("q") <= last).select("cell", "sgg_cd", "dong", F.col("q").cast("int").alias("q"), "log_ppm2").repartition("dong")
    cells = rows.groupBy("dong", "sgg_cd", "cell", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("log_ppm2").alias("s"))
    cells = cells.select("dong", "sgg_cd", "cell", "q", "n", "s").sortWithinPartitions("dong", "sgg_cd", "cell")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("dong", "sgg_cd")}
    dong = stored(cells.mapInArrow(_dong_sums(first, last), f"dong {kind['dong']}, sgg_cd {kind['sgg_cd']}, origin int, q int, n_sales bigint, r double"), "vintage-sums")
    gu = dong.groupBy("origin", "sgg_cd", "q").agg((F.sum("r") / F.sum("n_sales")).alias("gu"))  # a row for each gu, origin and quarter
    index = F.col("gu") + (F.col("r") - F.col("n_sales") * F.col("gu")) / (F.col("n_sales") + lam)
    return dong.join(F.broadcast(gu), ["origin", "sgg_cd", "q"]).select("origin", "sgg_cd", "dong", "q", "n_sales", index.alias("log_index"))


def vintage_features(vintage: DataFrame, lags: Sequence[int] = LAGS, least: int = 20) -> DataFrame:
    """(origin, sgg_cd, dong, n_sales_4q, eligible, mom_k, mom_k_gu_rel): changes over k quarters as seen at the origin, and
    less the gu's mean; null where the earlier quarter has no index. Dongs without a sale in the origin's quarter have no row."""
    at = lambda k: F.max(F.when(F.col("q") == F.col("origin") - k, F.col("log_index")))
    wide = vintage.groupBy("origin", "sgg_cd", "dong").agg(F.sum(F.when(F.col("q") > F.col("origin") - 4, F.col("n_sales")).otherwise(0)).alias("n_sales_4q"), at(0).alias("now"), *[(at(0) - at(k)).alias(f"mom_{k}") for k in lags])
    wide = wide.where("now is not null").withColumn("eligible", F.col("n_sales_4q") >= least)
    return wide.select("origin", "sgg_cd", "dong", "n_sales_4q", "eligible", *[f"mom_{k}" for k in lags], *[relative_to_group(f"mom_{k}", ["origin", "sgg_cd"]).alias(f"mom_{k}_gu_rel") for k in lags])


def realtime_targets(features: DataFrame, full: DataFrame, last: int, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(origin, dong, horizon, y_rt, y_full, reason) for eligible rows: the change that the vintage h quarters later shows,
    and that of the full index (dong, q, log_index). Reasons: none, index_nan, no_vintage_row, beyond_data."""
    base = features.where("eligible").select("origin", "dong", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).withColumn("at", F.col("origin") + F.col("horizon"))
    later = features.select(F.col("origin").alias("at"), "dong", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"mom_{h}").alias("y_rt")) for h in horizons])).alias("y")).select("at", "dong", "y.*", F.lit(True).alias("found"))
    ends = full.select("dong", F.col("q").alias("at"), F.col("log_index").alias("end"))
    starts = full.select("dong", F.col("q").alias("origin"), F.col("log_index").alias("start"))
    rows = base.join(later, ["at", "dong", "horizon"], "left").join(ends, ["dong", "at"], "left").join(starts, ["dong", "origin"], "left")
    reason = F.when(F.col("at") > last, "beyond_data").when(F.col("found").isNull(), "no_vintage_row").when(F.col("y_rt").isNull(), "index_nan").otherwise("none")
    return rows.select("origin", "dong", "horizon", "y_rt", (F.col("end") - F.col("start")).alias("y_full"), reason.alias("reason"))


def valid_volume(valid: DataFrame, first: int, last: int, width: int = 4) -> DataFrame:
    """(origin, dong, n_now, log_change): sales of the last `width` quarters and their log change on those before; a dong has
    a row if it has sales in either."""
    counts = valid.groupBy("dong", "q").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.withColumn("origin", F.explode(F.sequence(F.col("q"), F.col("q") + 2 * width - 1))).where(F.col("origin").between(first, last))
    now = F.sum(F.when(F.col("origin") - F.col("q") < width, F.col("n")).otherwise(0))
    before = F.sum(F.when(F.col("origin") - F.col("q") >= width, F.col("n")).otherwise(0))
    return rows.groupBy("origin", "dong").agg(now.alias("n_now"), (F.log1p(now) - F.log1p(before)).alias("log_change"))


def policy_net(events: DataFrame, first: int, last: int, width: int = 4) -> DataFrame:
    """(origin, policy_net): sum of event scores (q, score) over the last `width` quarters, 0 without events."""
    hits = events.withColumn("origin", F.explode(F.sequence(F.col("q"), F.col("q") + width - 1))).groupBy("origin").agg(F.sum("score").alias("s"))
    origins = events.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("origin"))
    return origins.join(hits, "origin", "left").select("origin", F.coalesce("s", F.lit(0)).cast("long").alias("policy_net"))


def market_panel(features: DataFrame, volume: DataFrame, policy: DataFrame, targets: DataFrame, lags: Sequence[int] = LAGS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row for each origin: eligible dongs, their mean momentum, volume and its log change on a year ago, net policy
    score, and for each horizon the counts and means of both targets."""
    base = features.where("eligible").join(volume, ["origin", "dong"], "left")
    rows = base.groupBy("origin").agg(F.count(F.lit(1)).alias("n_eligible"), F.coalesce(F.sum("n_now"), F.lit(0)).alias("volume"), *[F.avg(f"mom_{k}").alias(f"m_mom_{k}") for k in lags])
    past = volume.groupBy((F.col("origin") + 4).alias("origin")).agg(F.sum("n_now").alias("past"))
    rows = rows.join(past, "origin", "left").withColumn("volume_change", F.log1p("volume") - F.log1p(F.coalesce("past", F.lit(0)))).drop("past").join(policy, "origin")
    if_ = lambda h, c: F.when(F.col("horizon") == h, F.col(c))
    each = targets.groupBy("origin").agg(*[x for h in horizons for x in (F.count(if_(h, "y_rt")).alias(f"n_rt_{h}"), F.count(if_(h, "y_full")).alias(f"n_full_{h}"), F.avg(if_(h, "y_rt")).alias(f"m_rt_{h}"), F.avg(if_(h, "y_full")).alias(f"m_full_{h}"))])
    return rows.join(each, "origin", "left")


def relative_features(features: DataFrame, volume: DataFrame, blocks: DataFrame) -> DataFrame:
    """(origin, dong and 12 features) of eligible dongs, each set against the origin's others; blocks (origin, dong,
    median_ppm2, jeonse_ratio, old30_share, median_age, jeonse_share, rent_n_log_change)."""
    base = features.where("eligible").join(volume, ["origin", "dong"], "left").join(blocks, ["origin", "dong"], "left")
    rows = base.withColumn("price_rank", pct_rank_avg("median_ppm2", ["origin"]))
    rows = center_median(rows, "jeonse_ratio", ["origin"], "jeonse_ratio_rel")
    own = [relative_to_group(f"mom_{k}", ["origin"]).alias(f"mom_{k}_rel") for k in (1, 4, 12)]
    return rows.select("origin", "dong", *own, "price_rank", "jeonse_ratio_rel", relative_to_group("log_change", ["origin"]).alias("volume_rel"), "old30_share", "median_age", "jeonse_share", "rent_n_log_change", "mom_2_gu_rel", "mom_8_gu_rel")


def adjacent_labels(membership: DataFrame) -> DataFrame:
    """(as_of, dong, before, now): labels of dongs that stand at neighbouring points of time, by their order."""
    times = membership.select("as_of").distinct().withColumn("pos", F.row_number().over(Window.orderBy("as_of")))  # one row for each time
    placed = membership.join(F.broadcast(times), "as_of")
    before = placed.select("dong", (F.col("pos") + 1).alias("pos"), F.col("cluster").alias("before"))
    return placed.join(before, ["dong", "pos"]).select("as_of", "dong", "before", F.col("cluster").alias("now"))
