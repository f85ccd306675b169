"""Rolling-origin forecasts: ridge by moments, market and relative parts, variants, metrics, intervals, tests and the delta ladder.

What an origin may learn from is a range of earlier origins, s + h <= q. Sums over that range are running sums of
per-origin sums. Where a sum depends on the origin that looks back, sums by (origin, error) are copied to the origins
that follow, and never a history's rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .hedonic import drawn
from .windows import origins_before, shifted, spearman, weighted_quantile


#: Rows of a fit that a task takes at least, where there are as many.
TASK_ROWS = 50_000


def moments(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """Counts and sums by group of what a ridge fit needs; a null x counts in no mean and as 0 elsewhere."""
    zero = {x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in xs}
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(y).alias("sy")]
    for i, a in enumerate(xs):
        aggs += [F.count(a).alias(f"n{i}"), F.sum(zero[a]).alias(f"s{i}"), F.sum(zero[a] * F.col(y)).alias(f"c{i}")]
        aggs += [F.sum(zero[a] * zero[b]).alias(f"p{i}_{j}") for j, b in enumerate(xs) if j >= i]
    return df.where(F.col(y).isNotNull()).groupBy(*by).agg(*aggs)


def solve_ridge(sums: DataFrame, k: int, alpha: float, keys: Sequence[str], least: Column | None = None) -> DataFrame:
    """Models (mean, std, coef, intercept, rows) from rows of moments: one small solve for each row."""
    kept = sums.where(least) if least is not None else sums
    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)

    def fit(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n, s = (np.array([float(r[f"{c}{i}"]) for i in range(k)]) for c in "ns")
                square = np.array([[float(r[f"p{min(i, j)}_{max(i, j)}"]) for j in range(k)] for i in range(k)])
                rows, centre = float(r["rows"]), float(r["sy"]) / float(r["rows"])
                mean = np.divide(s, n, out=np.zeros(k), where=n > 0)
                var = np.divide(np.diag(square), n, out=np.zeros(k), where=n > 0) - mean**2
                std = np.where(var > 1e-15, np.sqrt(np.maximum(var, 1e-15)), 1.0)
                zz = (square - np.outer(mean, s) - np.outer(s, mean) + rows * np.outer(mean, mean)) / np.outer(std, std)
                zy = (np.array([float(r[f"c{i}"]) for i in range(k)]) - centre * s) / std
                out.append({**{c: r[c] for c in keys}, "mean": mean.tolist(), "std": std.tolist(), "coef": np.linalg.solve(zz + alpha * np.eye(k), zy).tolist(), "intercept": centre, "rows": int(rows)})
            yield pd.DataFrame(out, columns=[*keys, "mean", "std", "coef", "intercept", "rows"])

    return kept.mapInPandas(fit, f"{kinds}, mean array<double>, std array<double>, coef array<double>, intercept double, rows bigint")


def ridge_fit(df: DataFrame, xs: Sequence[str], y: str, alpha: float, by: Sequence[str]) -> DataFrame:
    """Standardized ridge for each group; rows without y teach nothing."""
    return solve_ridge(moments(df, xs, y, by), len(xs), alpha, by)


def ridge_predict(models: DataFrame, df: DataFrame, xs: Sequence[str], by: Sequence[str], to: str) -> DataFrame:
    """df with the group's prediction, null where the group has no model. Models are one narrow row for each group."""
    part = [(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) - F.col("_m.mean")[i]) / F.col("_m.std")[i] * F.col("_m.coef")[i] for i, x in enumerate(xs)]
    held = models.select(*by, F.struct("mean", "std", "coef", "intercept").alias("_m"))
    return df.join(held, list(by), "left").withColumn(to, sum(part, F.col("_m.intercept"))).drop("_m")


def known_before(sums: DataFrame, h: int, by: Sequence[str] = (), q: str = "q") -> DataFrame:
    """Per-origin sums turned into sums over origins s with s + h <= q, and `origins`, how many those are."""
    w = Window.partitionBy(*by).orderBy(q).rangeBetween(Window.unboundedPreceding, -h)
    cols = [c for c in sums.columns if c not in (*by, q)]
    return sums.select(*by, q, F.count(F.lit(1)).over(w).alias("origins"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in cols])


def rolling_ridge(panel: DataFrame, xs: Sequence[str], y: str, alpha: float, h: int, least_origins: int, least_rows: int = 0, to: str = "pred") -> DataFrame:
    """panel (q, xs, y) with a forecast fitted on origins whose target was known; null before there are enough."""
    all_q = panel.select("q").distinct()
    each = moments(panel, xs, y, ["q"])
    teach = known_before(all_q.join(each, "q", "left").withColumn("_has", F.col("rows").isNotNull().cast("int")).fillna(0), h)
    enough = (F.col("_has") >= least_origins) & (F.col("rows") >= max(least_rows, 1))
    return ridge_predict(solve_ridge(teach, len(xs), alpha, ["q"], enough), panel, xs, ["q"], to)


def market_models(market: DataFrame, h: int, base: str, target: str, sets: dict[str, Sequence[str]], alpha: float = 1.0, least: int = 12) -> DataFrame:
    """(q, model, m_hat, status): the momentum `base` itself (M0), and base plus a ridge of its miss for each feature set."""
    rows = market.withColumn("_miss", F.col(target) - F.col(base))
    parts = [rows.select("q", F.lit("M0").alias("model"), F.col(base).alias("m_hat"), F.lit("baseline").alias("status"))]
    for name, xs in sets.items():
        got = rolling_ridge(rows, xs, "_miss", alpha, h, least, to="_p")
        parts.append(got.select("q", F.lit(name).alias("model"), (F.col(base) + F.coalesce("_p", F.lit(0.0))).alias("m_hat"), F.when(F.col("_p").isNull(), "insufficient_train").otherwise("ok").alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def relative_models(panel: DataFrame, h: int, xs: Sequence[str], y: str = "r", alpha: float = 1.0, least_origins: int = 8, least_rows: int = 1500) -> DataFrame:
    """(q, dong, model, centered, status): nothing (R0), and a ridge centred within its origin (R1)."""
    got = rolling_ridge(panel, xs, y, alpha, h, least_origins, least_rows, "_p")
    raw = F.coalesce("_p", F.lit(0.0))
    r1 = got.select("q", "dong", F.lit("R1").alias("model"), (raw - F.avg(raw).over(Window.partitionBy("q"))).alias("centered"), F.when(F.col("_p").isNull(), "insufficient_train").otherwise("ok").alias("status"))
    return panel.select("q", "dong", F.lit("R0").alias("model"), F.lit(0.0).alias("centered"), F.lit("baseline").alias("status")).union(r1)


def boosted_relative(train: DataFrame, rows: DataFrame, xs: Sequence[str], y: str = "r", trees: int = 50, seed: int = 42) -> DataFrame:
    """rows with `centered` of gradient-boosted trees under absolute loss, fitted on train (R2); missing features count as 0."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    make = VectorAssembler(inputCols=list(xs), outputCol="_x")
    fit = GBTRegressor(featuresCol="_x", labelCol=y, lossType="absolute", maxIter=trees, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=seed, predictionCol="_p")
    model = fit.fit(make.transform(train.where(F.col(y).isNotNull()).fillna(0.0, list(xs))))
    got = model.transform(make.transform(rows.fillna(0.0, list(xs)))).drop("_x")
    return got.withColumn("centered", F.col("_p") - F.avg("_p").over(Window.partitionBy("q"))).drop("_p")


def rolling_boosted(panel: DataFrame, xs: Sequence[str], y: str = "y", least_origins: int = 1, least_rows: int = 1, loss: str = "squared", trees: int = 8, depth: int = 3, seed: int = 42, abreast: int = 8) -> DataFrame:
    """(h, q, dong, pred, n_train, label_vintage) of panel (h, q, dong, xs, y): for every horizon h and origin q gradient-boosted
    trees fitted on the rows whose target was known then, s + h <= q.

    Every fit reads its own horizon and origins of the one stored panel, `abreast` of them at a time. An origin without `least_origins` known origins or
    `least_rows` known rows has no forecast. Missing features count as 0, rows without y teach nothing but get forecasts.
    label_vintage is the last quarter that a label of the fit needed. Fits see all their rows; above
    10,000 of them Spark draws a tree's thresholds from a sample, which hangs on how rows lie in files.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    spark = panel.sparkSession
    made = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(panel.select("h", "q", "dong", F.col(y).cast("double").alias("_y"), *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in xs]))
    rows = stored(made.select("h", "q", "dong", "_y", "_x").repartitionByRange("h", "q", "dong"), "boosted-panel", ["h", "q"])
    sizes = rows.groupBy("h", "q").agg(F.count("_y").alias("n")).collect()  # one row for each horizon and origin
    learner = GBTRegressor(featuresCol="_x", labelCol="_y", lossType=loss, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, predictionCol="pred")

    def fit(h: int, q: int) -> DataFrame | None:
        known = [r for r in sizes if r["h"] == h and r["q"] + h <= q and r["n"]]
        n = sum(r["n"] for r in known)
        if len(known) < least_origins or n < least_rows:
            return None
        model = learner.fit(rows.where((F.col("h") == h) & (F.col("q") <= q - h) & F.col("_y").isNotNull()).coalesce(n // TASK_ROWS + 1))
        out = model.transform(rows.where((F.col("h") == h) & (F.col("q") == q))).select("h", "q", "dong", "pred")
        return stored(out.withColumns({"n_train": F.lit(n).cast("long"), "label_vintage": F.lit(max(r["q"] for r in known) + h)}), "boosted")

    with ThreadPoolExecutor(abreast) as pool:
        done = [x for x in pool.map(inheritable_thread_target(spark)(lambda r: fit(r["h"], r["q"])), sorted(sizes, key=lambda r: (r["h"], r["q"]))) if x is not None]
    out = rows.select("h", "q", "dong", F.lit(0.0).alias("pred"), F.lit(0).cast("long").alias("n_train"), F.lit(0).alias("label_vintage")).where("false")
    for x in done:
        out = out.union(x)
    return out


def rolling_gamma(history: DataFrame, h: int, grid: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), least_origins: int = 8, least_rows: int = 1000) -> DataFrame:
    """(q, gamma): the share of x with the least mean absolute error of y over known origins, which weigh alike; 0 before there are enough."""
    each = history.withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in grid]))).groupBy("gamma", "q").agg(F.avg(F.abs(F.col("y") - F.col("gamma") * F.col("x"))).alias("mae"), F.count("y").alias("n"))
    known = known_before(each.withColumn("_has", F.col("mae").isNotNull().cast("int")).fillna(0.0, ["mae"]), h, ["gamma"])
    score = F.struct(F.round(F.try_divide("mae", "_has"), 12).alias("m"), F.col("gamma"))
    best = known.groupBy("q").agg(F.min_by("gamma", score).alias("g"), F.max("_has").alias("o"), F.max("n").alias("n"))
    return best.select("q", F.when((F.col("o") >= least_origins) & (F.col("n") >= least_rows), F.col("g")).otherwise(0.0).alias("gamma"))


def assemble_variants(targets: DataFrame, market: DataFrame, relative: DataFrame) -> DataFrame:
    """targets (q, dong, y) with every market and relative model: y_hat = m_hat + gamma * centered.

    A target joins as many rows as there are model pairs, a number that doesn't grow with the data.
    """
    r = relative.select("q", "dong", F.col("model").alias("_r"), "centered", "gamma")
    m = market.select("q", F.col("model").alias("_m"), "m_hat")
    rows = targets.join(r, ["q", "dong"]).join(m, "q")
    return rows.select("q", "dong", "y", F.concat_ws("_", "_m", "_r").alias("variant"), "m_hat", "gamma", "centered", (F.col("m_hat") + F.col("gamma") * F.col("centered")).alias("y_hat"))


def metric_cube(preds: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, variant, metric, value, n_origins, n_rows) of six metrics; segments (segment, first, last) is a short list kept by hand."""
    seen = preds.where("y is not null")
    err, rel = F.abs(F.col("y_hat") - F.col("y")), F.col("gamma") * F.col("centered")
    each = seen.withColumn("_mean", F.avg("y").over(Window.partitionBy("variant", "q"))).groupBy("variant", "q").agg(
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"), F.sum(err).alias("abs"), F.abs(F.first("m_hat") - F.avg("y")).alias("market"), F.avg(F.abs(rel - (F.col("y") - F.col("_mean")))).alias("relative"),
        F.try_divide(F.covar_pop(F.col("y"), rel), F.stddev_pop("y") * F.stddev_pop(rel)).alias("corr"), (F.signum(F.first("m_hat")) == F.signum(F.avg("y"))).cast("double").alias("hit"))
    rows = each.join(F.broadcast(segments), F.col("q").between(F.col("first"), F.col("last")))
    wide = rows.groupBy("segment", "variant").agg(F.count(F.lit(1)).alias("n_origins"), F.sum("n").alias("n_rows"), F.avg("mae").alias("mae_origin"), (F.sum("abs") / F.sum("n")).alias("mae_row"), F.avg("market").alias("market_mae"), F.avg("relative").alias("relative_mae"), F.avg("corr").alias("relative_corr"), F.avg("hit").alias("market_sign_hit"))
    return wide.unpivot(["segment", "variant", "n_origins", "n_rows"], ["mae_origin", "mae_row", "market_mae", "relative_mae", "relative_corr", "market_sign_hit"], "metric", "value")


def select_models(metrics: DataFrame, segment: str, base: str, candidates: Sequence[str], metric: str, least_gain: float = 0.02) -> DataFrame:
    """(candidate, value, gain, selected): the best candidate that beats the base by the threshold, else the base; ties to the first named."""
    order = {c: i for i, c in enumerate([base, *candidates])}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    rows = metrics.where((F.col("segment") == segment) & (F.col("metric") == metric) & F.col("variant").isin(list(order))).select(F.col("variant").alias("candidate"), "value")
    floor = rows.where(F.col("candidate") == base).select(F.col("value").alias("_base"))
    rows = rows.crossJoin(F.broadcast(floor)).withColumn("gain", F.try_divide(F.col("_base") - F.col("value"), F.col("_base")))
    fit = F.when(F.col("candidate") == base, 0.0).when(F.col("gain") >= least_gain, F.col("gain")).otherwise(-1.0)
    best = F.row_number().over(Window.orderBy(F.desc(fit), rank[F.col("candidate")])) == 1
    return rows.select("candidate", "value", "gain", best.alias("selected"))


def score_latest(dongs: DataFrame, preds: DataFrame, half_width: Column) -> DataFrame:
    """Every dong once: its forecast as per cent with an interval, or why it has none."""
    pct = lambda c: (F.exp(c) - 1) * 100
    rows = dongs.join(preds.select("dong", "y_hat"), "dong", "left").withColumn("y_hat", F.when(F.col("eligible"), F.col("y_hat")))
    return rows.select("dong", F.when(F.col("eligible"), "PREDICTED").otherwise("INSUFFICIENT_SALES").alias("status"), "y_hat", pct(F.col("y_hat")).alias("est"), pct(F.col("y_hat") - half_width).alias("lower"), pct(F.col("y_hat") + half_width).alias("upper"))


def empirical_intervals(preds: DataFrame, h: int, n: int = 8, least_rows: int = 1000, level: float = 0.8) -> DataFrame:
    """(q, origins, rows, half): weighted quantile of absolute errors of the last n known origins, which weigh alike; none with fewer."""
    rows = preds.where("y is not null and y_hat is not null").select("q", F.abs(F.col("y") - F.col("y_hat")).alias("err"))
    size = rows.groupBy("q").agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy("q").rangeBetween(Window.unboundedPreceding, -h)  # one row for each origin
    past = preds.select("q").distinct().join(size, "q", "left").withColumn("s", F.sort_array(F.collect_list(F.when(F.col("size").isNotNull(), F.col("q"))).over(w), False))
    past = past.select("q", F.explode(F.slice("s", 1, n)).alias("s"))
    known = past.join(rows.join(size, "q").select(F.col("q").alias("s"), "err", (1 / F.col("size")).alias("w")), "s")
    count = known.groupBy("q").agg(F.count_distinct("s").alias("origins"), F.count(F.lit(1)).alias("rows"))
    ok = count.where((F.col("origins") == n) & (F.col("rows") >= least_rows))
    return ok.join(weighted_quantile(known, "err", "w", level, ["q"], "half"), "q")


def moving_block_bootstrap(series: DataFrame, block: int, draws: int = 2000, seed: int = 42) -> DataFrame:
    """series (pos from 0, value or null): mean and 95 % interval over draws of blocks without gaps, cut to the series' length; one row."""
    ahead = Window.orderBy("pos").rowsBetween(0, block - 1)  # one row for each quarter
    starts = series.withColumn("_n", F.count("value").over(ahead)).where(F.col("_n") == block)
    starts = starts.select(F.col("pos").alias("start"), (F.row_number().over(Window.orderBy("pos")) - 1).alias("slot"))
    size = series.agg(F.count(F.lit(1)).alias("n")).crossJoin(starts.agg(F.count(F.lit(1)).alias("starts"))).where("starts > 0")
    picks = series.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))
    picks = picks.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1))).withColumn("slot", drawn(F.col("starts"), seed, F.col("draw"), F.col("k")))
    at = picks.join(F.broadcast(starts), "slot").withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("k") * block + F.col("off") < F.col("n"))
    each = at.select("draw", (F.col("start") + F.col("off")).alias("pos")).join(F.broadcast(series), "pos").groupBy("draw").agg(F.avg("value").alias("m"))
    return each.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("draws")).crossJoin(series.agg(F.avg("value").alias("mean")))


def dm_statistic(series: DataFrame, a: str, b: str, lag: int) -> DataFrame:
    """(n, mean, statistic) of the mean difference of two error series (one row for each origin q), Bartlett weights up to `lag`; null at no variance."""
    d = series.select("q", (F.col(a) - F.col(b)).alias("d"))
    c = d.crossJoin(F.broadcast(d.agg(F.avg("d").alias("mean")))).withColumn("c", F.col("d") - F.col("mean"))
    w = Window.orderBy("q")
    terms = [F.sum(F.col("c") * F.col("c"))] + [F.lit(2 * (1 - k / (lag + 1))) * F.coalesce(F.sum(F.col(f"p{k}")), F.lit(0.0)) for k in range(1, lag + 1)]
    rows = c.select("c", "mean", *[(F.col("c") * F.lag("c", k).over(w)).alias(f"p{k}") for k in range(1, lag + 1)])
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), (sum(terms, F.lit(0.0)) / F.count(F.lit(1))).alias("v"))
    return out.select("n", "mean", F.when(F.col("v") > 0, F.col("mean") / F.sqrt(F.col("v") / F.col("n"))).alias("statistic"))


def dm_test(series: DataFrame, a: str, b: str, lag: int) -> DataFrame:
    """dm_statistic with its two-sided normal p-value."""
    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))

    return dm_statistic(series, a, b, lag).withColumn("p", tail("statistic"))


def _common(rows: DataFrame, change: str) -> Column:
    """The weighted mean of a change within its origin, the plain one where no weight stands."""
    w, o = F.coalesce("w", F.lit(0)), Window.partitionBy("q")
    return F.coalesce(F.try_divide(F.sum(F.col(change) * w).over(o), F.sum(w).over(o)), F.avg(change).over(o))


def delta_targets(index: DataFrame, weights: DataFrame, h: int = 4) -> DataFrame:
    """(q, dong, y, mu, delta): change over the next h quarters, the common one, and the rest."""
    rows = shifted(index.select("dong", "q", "log_index"), ["log_index"], ["dong"], "q", -h, "_ahead").withColumn("y", F.col("log_index_ahead") - F.col("log_index"))
    rows = rows.where("y is not null").join(weights, "dong", "left").withColumn("mu", _common(index, "y"))
    return rows.select("q", "dong", "y", "mu", (F.col("y") - F.col("mu")).alias("delta"))


def delta_features(index: DataFrame, weights: DataFrame, back: int = 4, feature_lag: int = 0, clusters: DataFrame | None = None) -> DataFrame:
    """(q, dong, sgg_cd, se, relative, gu_relative[, cluster_relative]) as of each origin, from index (dong, sgg_cd, q, log_index, se)."""
    rows = shifted(index, ["log_index"], ["dong"], "q", back + feature_lag, "_then")
    rows = shifted(rows, ["log_index"], ["dong"], "q", feature_lag, "_now").withColumn("change", F.col("log_index_now") - F.col("log_index_then"))
    rows = rows.where("change is not null").join(weights, "dong", "left").withColumn("relative", F.col("change") - _common(index, "change"))
    rows = rows.withColumn("gu_relative", F.avg("relative").over(Window.partitionBy("q", "sgg_cd")))
    keep = ["q", "dong", "sgg_cd", "se", "relative", "gu_relative"]
    if clusters is not None:
        rows = rows.join(clusters.select("q", "dong", "cluster"), ["q", "dong"], "left")
        rows = rows.withColumn("cluster_relative", F.when(F.col("cluster").isNotNull(), F.avg("relative").over(Window.partitionBy("q", "cluster"))))
        keep.append("cluster_relative")
    return rows.select(*keep)


def ladder_predictions(rows: DataFrame, h: int = 4, least: int = 500) -> DataFrame:
    """rows (q, delta, relative, gu_relative, se[, cluster_relative]) with c0 nothing, c1 the gu's momentum, c1f it and c1k the
    cluster's times a slope through the origin, and c2 momentum shrunk by its error times a slope. Slopes and the median
    error come from known origins; under `least` rows of them a fitted rung says nothing."""
    pairs = F.broadcast(origins_before(rows, h))
    parts = rows.groupBy(F.col("q").alias("s"), "se").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("relative") * F.col("delta")).alias("_xd"), F.sum(F.when(F.col("delta").isNotNull(), F.pow("relative", 2))).alias("_xx")).join(pairs, "s")
    mid = parts.groupBy("q").agg(F.pow(F.percentile("se", F.lit(0.5), F.col("_n")), 2).alias("_v"))
    out = rows.join(F.broadcast(mid), "q", "left").withColumn("_shrunk", F.col("relative") * F.col("_v") / (F.pow("se", 2) + F.col("_v")))
    xs = {"c1f": "gu_relative"} | ({"c1k": "cluster_relative"} if "cluster_relative" in rows.columns else {})
    each = rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(x) * F.col("delta")), F.lit(0.0)).alias(f"d_{k}") for k, x in xs.items()], *[F.coalesce(F.sum(F.col(x) * F.col(x)), F.lit(0.0)).alias(f"x_{k}") for k, x in xs.items()])
    known = known_before(each, h)
    # A history is shrunk by the error scale of the origin that looks back: equal errors shrink alike.
    part = F.col("_v") / (F.pow("se", 2) + F.col("_v"))
    c2 = parts.join(F.broadcast(mid), "q").groupBy("q").agg(F.try_divide(F.sum(F.col("_xd") * part), F.sum(F.col("_xx") * part * part)).alias("_b"))
    out = out.join(known, "q").join(c2, "q", "left")
    fitted = lambda slope, x: F.when(F.col("n") >= least, F.coalesce(slope * F.col(x), F.lit(0.0))).otherwise(0.0)
    got = [F.lit(0.0).alias("c0"), F.col("gu_relative").alias("c1"), *[fitted(F.try_divide(f"d_{k}", f"x_{k}"), x).alias(k) for k, x in xs.items()], fitted(F.col("_b"), "_shrunk").alias("c2")]
    return out.select(*rows.columns, *got)


def ladder_errors(preds: DataFrame, rungs: Sequence[str], least: int = 30) -> DataFrame:
    """Mean absolute error of each rung by origin with `least` dongs or more."""
    return preds.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(F.col("delta") - F.col(r))).alias(f"mae_{r}") for r in rungs]).where(F.col("n") >= least)


def ladder_score(preds: DataFrame, rungs: Sequence[str], least: int = 30) -> DataFrame:
    """(rung, mae, rho, positive): mean error, median rank correlation and the share of origins where it is positive."""
    long = preds.where("delta is not null").unpivot(["q", "dong", "delta"], list(rungs), "rung", "pred")
    each = long.groupBy("rung", "q").agg(F.avg(F.abs(F.col("delta") - F.col("pred"))).alias("mae"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rho = spearman(long, "pred", "delta", ["rung", "q"]).select("rung", "q", F.col("spearman").alias("rho"))
    up = F.avg(F.coalesce(F.col("rho") > 1e-12, F.lit(False)).cast("double"))
    return each.join(rho, ["rung", "q"], "left").groupBy("rung").agg(F.avg("mae").alias("mae"), F.median("rho").alias("rho"), up.alias("positive"))


def ladder_verdict(low: float | None, p: float | None, level: float = 0.05) -> bool:
    """Whether a rung betters its base: a gain whose interval lies above nothing, and a test that rejects equality."""
    return low is not None and p is not None and low > 0 and p < level


def save_model_card(models: DataFrame, path: str, params: dict, inputs: dict[str, str]) -> None:
    """One JSON line for each model row, with its parameters and digests of what it was fitted on."""
    models.select(F.to_json(F.struct(*models.columns, F.lit(json.dumps(params, sort_keys=True)).alias("params"), F.lit(json.dumps(inputs, sort_keys=True)).alias("input_sha256"))).alias("value")).write.text(path)
