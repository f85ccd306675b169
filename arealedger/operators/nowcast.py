"""Provisional indexes of unfinished quarters, their revisions, and how strongly deviations should be shrunk."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import index_se, shrink, unshrink
from ..sources.store import stored
from .forecast import known_before
from .hedonic import compressed_index

#: Days of a quarter up to which sales are seen.
VISIBLE_DAYS = (31, 46, 62, 77, 92)


def cell_residuals(valid: DataFrame, index: DataFrame) -> DataFrame:
    """valid with the log price less its cell's effect, given the index (dong, q, log_index)."""
    net = valid.join(index.select("dong", "q", "log_index"), ["dong", "q"]).withColumn("_net", F.col("log_ppm2") - F.col("log_index"))
    cell = net.groupBy("cell").agg(F.avg("_net").alias("_effect"))
    return net.join(cell, "cell").withColumn("residual", F.col("log_ppm2") - F.col("_effect")).drop("_net", "_effect", "log_index")


def provisional_index(rows: DataFrame, days: Sequence[int] = VISIBLE_DAYS, lam: float = 5.0) -> DataFrame:
    """rows (sgg_cd, dong, q, day, residual): (q, visible, dong, n, log_index, slope) as seen by each day.

    The gu's mean plus the dong's deviation, sum / (n + lam). slope is the residual's per day over all that is seen, 0 under
    30 sales. Sales are dealt to tasks by dong and summed by day first, so what is repeated for each visible day is sums that
    stay where they are; the sums by dong are written once for the gu's and the city's.
    """
    dealt = rows.select("sgg_cd", "dong", "q", "day", "residual").repartition("dong")
    by_day = dealt.groupBy("sgg_cd", "dong", "q", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("residual").alias("s"))
    seen = by_day.withColumn("visible", F.explode(F.array(*[F.lit(d) for d in days]))).where("day <= visible")
    n, day = F.col("n"), F.col("day")
    dong = seen.groupBy("sgg_cd", "dong", "q", "visible").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(n * day).alias("x"), F.sum(n * day * day).alias("xx"), F.sum(F.col("s") * day).alias("xy"))
    dong = stored(dong, "provisional")
    gu = dong.groupBy("sgg_cd", "q", "visible").agg((F.sum("s") / F.sum("n")).alias("level"))
    total = dong.groupBy("q", "visible").agg(F.sum("n").alias("t"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum("s").alias("y"), F.sum("xy").alias("xy"))
    slope = F.try_divide(F.col("t") * F.col("xy") - F.col("x") * F.col("y"), F.col("t") * F.col("xx") - F.col("x") * F.col("x"))
    total = total.select("q", "visible", F.when(F.col("t") >= 30, F.coalesce(slope, F.lit(0.0))).otherwise(0.0).alias("slope"))
    dong = dong.drop("x", "xx", "xy")
    out = dong.join(gu, ["sgg_cd", "q", "visible"]).join(F.broadcast(total), ["q", "visible"])
    return out.select("q", "visible", "dong", "n", (F.col("level") + (F.col("s") - F.col("n") * F.col("level")) / (F.col("n") + lam)).alias("log_index"), "slope")


def revision_panel(provisional: DataFrame, last: int = 92) -> DataFrame:
    """Earlier views against the one of day `last`: the revision and what is known of it at the time."""
    # The last view is read beside the earlier ones of its dong's quarter, not joined to them.
    own, end = Window.partitionBy("dong", "q"), lambda c: F.when(F.col("visible") == last, F.col(c))
    rows = provisional.repartition("dong").withColumn("n_final", F.max(end("n")).over(own)).withColumn("final", F.max(end("log_index")).over(own))
    rows = rows.where((F.col("visible") < last) & F.col("n_final").isNotNull())
    before = Window.partitionBy("dong").orderBy("q", "visible").rowsBetween(-8, -1)
    typical = F.when(F.count("n_final").over(before) >= 2, F.avg("n_final").over(before))
    rows = rows.withColumn("typical", typical).where("typical is not null")
    return rows.select("q", "visible", "dong", (F.col("final") - F.col("log_index")).alias("revision"), F.log((F.col("n") + 1) / (F.col("typical") + 1)).alias("log_n_ratio"), (F.col("visible") / last).alias("visible_share"), F.log1p("n").alias("log_n"), "slope", (F.col("slope") * (last - F.col("visible"))).alias("slope_left"))


REVISION_FEATURES = ("log_n_ratio", "visible_share", "log_n", "slope", "slope_left")


def revision_model(panel: DataFrame, xs: Sequence[str] = REVISION_FEATURES, least: int = 8) -> DataFrame:
    """panel with `correction`, least squares on the quarters before each one; none until `least` quarters stand before it."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(cols)
    each = panel.groupBy("q").agg(*[F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(cols[i] * F.col("revision")).alias(f"c{i}") for i in range(k)])
    known = known_before(each, 1).where(F.col("origins") >= least)

    def fit(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                left = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                out.append({"q": r["q"], "coef": np.linalg.lstsq(left, np.array([r[f"c{i}"] for i in range(k)], float), rcond=None)[0].tolist()})
            yield pd.DataFrame(out, columns=["q", "coef"])

    coefs = known.mapInPandas(fit, "q int, coef array<double>")
    return panel.join(F.broadcast(coefs), "q").withColumn("correction", sum((c * F.col("coef")[i] for i, c in enumerate(cols)), F.lit(0.0))).drop("coef")


def revision_score(panel: DataFrame) -> DataFrame:
    """(visible, raw, corrected): mean absolute revision before and after correction, quarters weighing alike."""
    each = panel.groupBy("visible", "q").agg(F.avg(F.abs("revision")).alias("raw"), F.avg(F.abs(F.col("revision") - F.col("correction"))).alias("corrected"))
    return each.groupBy("visible").agg(F.avg("raw").alias("raw"), F.avg("corrected").alias("corrected"))


def select_shrinkage(valid: DataFrame, lam: float = 5.0, splits: int = 3, least_gain: float = 0.02) -> DataFrame:
    """(lam, mse, adopted): how well one half, shrunk by each lam, foretells the other; over one hashed split of the sales and
    `splits` of the cells.

    The best lam is adopted if it betters the present one by `least_gain`. All halves are fitted in one grouped solve.
    """
    # Equal sales are told apart by a number, so that a half gets one as often as the other.
    each = valid.groupBy(*valid.columns).agg(F.count(F.lit(1)).alias("_times")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    half = lambda *of: F.pmod(F.xxhash64(*of), F.lit(2))
    # Sales are summed by cell, quarter and half first; what is repeated for each split are those sums.
    sale = half(*valid.columns, "_i")
    sums = each.withColumn("_half", sale).groupBy("cell", "sgg_cd", "dong", "q").agg(*[f(F.when(F.col("_half") == i, x)).alias(f"{c}{i}") for i in (0, 1) for f, x, c in ((F.count, F.lit(1), "n"), (F.sum, F.col("log_ppm2"), "s"))])
    own = lambda k, h, n, s: F.struct(F.lit(k).alias("k"), h.cast("int").alias("half"), n.alias("n"), s.alias("s"))
    whole = F.col("n0") + F.col("n1"), F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0))
    parts = [own(0, F.lit(i), F.col(f"n{i}"), F.col(f"s{i}")) for i in (0, 1)] + [own(k, half("cell", F.lit(k)), *whole) for k in range(1, splits + 1)]
    rows = sums.select("cell", "sgg_cd", "dong", "q", F.explode(F.array(*parts)).alias("p")).where("p.n > 0")
    rows = rows.select("cell", F.concat_ws("#", "sgg_cd", "p.k", "p.half").alias("sgg_cd"), "dong", "q", "p.n", "p.s")
    fitted = compressed_index(rows, lam).where("n_sales > 0")
    fitted = fitted.select("dong", "q", F.element_at(F.split("sgg_cd", "#"), -2).alias("k"), F.element_at(F.split("sgg_cd", "#"), -1).alias("half"), "n_sales", unshrink(F.col("dq_effect"), F.col("n_sales"), lam).alias("raw"))
    fitted = stored(fitted, "halves")
    b = fitted.where("half = '1'").select("dong", "q", "k", F.col("raw").alias("other"))
    pair = fitted.where("half = '0'").join(b, ["dong", "q", "k"])
    lams = [1 + x / 2 for x in range(31)]
    error = lambda x: F.avg(F.pow(F.col("raw") * F.col("n_sales") / (F.col("n_sales") + F.lit(x)) - F.col("other"), 2))
    tried = pair.groupBy("k").agg(*[error(x).alias(f"m{i}") for i, x in enumerate(lams)])
    each = tried.select("k", F.explode(F.array(*[F.struct(F.lit(x).alias("lam"), F.col(f"m{i}").alias("mse")) for i, x in enumerate(lams)])).alias("t")).select("t.lam", "k", "t.mse")
    curve = each.groupBy("lam").agg(F.avg("mse").alias("mse"))
    pick = curve.agg(F.min_by("lam", F.struct("mse", "lam")).alias("best"), F.min("mse").alias("least"), F.max(F.when(F.col("lam") == lam, F.col("mse"))).alias("now"))
    pick = pick.select(F.when(F.col("now") / F.col("least") - 1 >= least_gain, F.col("best")).otherwise(F.lit(float(lam))).alias("adopt"))
    return curve.crossJoin(F.broadcast(pick)).select("lam", "mse", (F.col("lam") == F.col("adopt")).alias("adopted"))


def stability(index: DataFrame, sigma: float, tau: float, lams: Sequence[float], fitted_lam: float = 5.0) -> DataFrame:
    """(lam, change_sd, thin_sd, se_median) of the index under each shrinkage: spread of quarterly changes and of thin dongs' deviations."""
    raw = unshrink(F.col("dq_effect"), F.col("n_sales"), fitted_lam)
    parts = []
    for lam in lams:
        d = shrink(raw, F.col("n_sales"), lam)
        rows = index.select("dong", "q", "n_sales", d.alias("d"), (F.col("log_index") - F.col("dq_effect") + d).alias("x"))
        rows = rows.withColumn("change", F.col("x") - F.lag("x").over(Window.partitionBy("dong").orderBy("q")))
        parts.append(rows.agg(F.stddev_samp("change").alias("change_sd"), F.stddev_samp(F.when(F.col("n_sales") <= 5, F.col("d"))).alias("thin_sd"), F.median(index_se(F.col("n_sales"), sigma, tau, lam)).alias("se_median")).withColumn("lam", F.lit(float(lam))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("lam", "change_sd", "thin_sd", "se_median")
