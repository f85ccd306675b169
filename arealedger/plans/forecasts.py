"""Registered queries of forecasts, nowcasts and their scores. Importing this module adds them to QUERIES and ORACLE."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quarters, scalars
from ..operators import catalog, cluster, forecast, hedonic, ledger, nowcast, panel
from ..sources.adapter import complexes, span, trade_sale
from ..sources.store import stored
from .kmeans import ROUNDS, STARTS, kmeans_sql
from .queries import INDEX_SQL, LAST, SCALES_SQL, query, scales, stored_index, valid

RESIDUALS_SQL = """, ce AS (SELECT cell, avg(log_ppm2) AS e FROM valid GROUP BY 1),
rs AS (SELECT sgg_cd, dong, q, datediff('day', date_trunc('quarter', deal_date), deal_date) + 1 AS day, log_ppm2 - e AS residual FROM valid JOIN ce USING (cell)),
sn AS (SELECT rs.*, visible FROM rs JOIN (VALUES (31), (46), (62), (77), (92)) d(visible) ON day <= visible),
gl AS (SELECT sgg_cd, q, visible, avg(residual) AS level FROM sn GROUP BY 1, 2, 3),
sl AS (SELECT q, visible, CASE WHEN count(*) >= 30 THEN coalesce(regr_slope(residual, day), 0) ELSE 0 END AS slope FROM sn GROUP BY 1, 2),
pv AS (SELECT q, visible, dong, count(*) AS n, any_value(level) + sum(residual - level) / (count(*) + 5) AS log_index, any_value(slope) AS slope FROM sn JOIN gl USING (sgg_cd, q, visible) JOIN sl USING (q, visible) GROUP BY 1, 2, 3)"""
WEIGHT_SQL = ", hs AS (SELECT dong, sum(p_size) AS w FROM (SELECT DISTINCT dong, p_partkey, p_size FROM joined) GROUP BY 1)"
DELTA_SQL = f"""{SCALES_SQL}{WEIGHT_SQL}, ty AS (SELECT i.dong, i.q, a.log_index - i.log_index AS y FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 4),
tg AS (SELECT dong, q, y, sum(y * w) OVER (PARTITION BY q) / sum(w) OVER (PARTITION BY q) AS mu FROM ty JOIN hs USING (dong)),
fc AS (SELECT i.dong, i.sgg_cd, i.q, i.log_index - b.log_index AS change, w, sqrt(sigma * sigma * i.n_sales + tau * tau * 25) / (i.n_sales + 5) AS se FROM sc, idx i JOIN idx b ON b.dong = i.dong AND b.q = i.q - 4 JOIN hs ON hs.dong = i.dong),
fr AS (SELECT *, change - sum(change * w) OVER (PARTITION BY q) / sum(w) OVER (PARTITION BY q) AS relative FROM fc),
fg AS (SELECT *, avg(relative) OVER (PARTITION BY q, sgg_cd) AS gu_relative FROM fr),
dl AS (SELECT fg.*, y - mu AS delta FROM fg JOIN tg USING (dong, q)),
md AS (SELECT a.q, pow(median(b.se), 2) AS v FROM (SELECT DISTINCT q FROM dl) a JOIN dl b ON b.q + 4 <= a.q GROUP BY 1),
c1 AS (SELECT a.q, count(*) AS n, sum(b.gu_relative * b.delta) / sum(b.gu_relative * b.gu_relative) AS k1, sum(b.relative * v / (b.se * b.se + v) * b.delta) / sum(pow(b.relative * v / (b.se * b.se + v), 2)) AS k2
  FROM (SELECT DISTINCT q FROM dl) a JOIN md USING (q) JOIN dl b ON b.q + 4 <= a.q GROUP BY 1),
pr AS (SELECT dl.*, 0.0 AS c0, gu_relative AS c1, CASE WHEN n >= 100 THEN k1 * gu_relative ELSE 0 END AS c1f, CASE WHEN n >= 100 THEN k2 * relative * v / (se * se + v) ELSE 0 END AS c2 FROM dl LEFT JOIN md USING (q) LEFT JOIN c1 USING (q)),
er AS (SELECT q, count(*) AS n, avg(abs(delta)) AS mae_c0, avg(abs(delta - c1)) AS mae_c1, avg(abs(delta - c1f)) AS mae_c1f, avg(abs(delta - c2)) AS mae_c2 FROM pr GROUP BY 1 HAVING count(*) >= 5)"""
RUNGS = ("c0", "c1", "c1f", "c2")


def _residuals(spark, d):
    # A cell lies in one dong, so rows are dealt by dong once and a cell's mean is taken where they are.
    mean = F.avg("log_ppm2").over(Window.partitionBy("dong", "cell"))
    rows = valid(spark, d).select("sgg_cd", "dong", "cell", "q", "deal_date", "log_ppm2").repartition("dong")
    return rows.select("sgg_cd", "dong", "q", quarters.day_in_quarter(F.col("deal_date")).alias("day"), (F.col("log_ppm2") - mean).alias("residual"))


def _weights(spark, d):
    return ledger.map_complexes(complexes(spark, d), trade_sale(spark, d)).groupBy("dong").agg(F.sum("households").alias("w"))


def _ladder(spark, d):
    w = _weights(spark, d)
    index = stored(hedonic.attach_se(*scales(spark, d)).withColumnRenamed("log_index_se", "se"), "ladder-index")
    rows = forecast.delta_features(index, w).join(forecast.delta_targets(index, w).select("q", "dong", "delta"), ["q", "dong"])
    return stored(forecast.ladder_predictions(stored(rows, "ladder-rows"), least=100), "ladder")


def _relative(spark, d):
    """Own changes of a dong less their mean, the next year's as target."""
    rows = panel.baselines(panel.with_targets(stored_index(spark, d), 4))
    rows = rows.select("q", "dong", "y", "b2", (F.col("b1") - F.col("b2")).alias("x"), F.log("n_sales").alias("x2"), (F.col("y") - F.avg("y").over(panel.Window.partitionBy("q"))).alias("r"))
    return stored(rows, "relative")


@query(f"{RESIDUALS_SQL} SELECT q, visible, dong, n, round(log_index, 6) AS log_index, round(slope, 6) AS slope FROM pv")
def provisional_index(spark, d):
    return nowcast.provisional_index(_residuals(spark, d)).select("q", "visible", "dong", "n", F.round("log_index", 6).alias("log_index"), F.round("slope", 6).alias("slope"))


@query(f"""{RESIDUALS_SQL}, fn AS (SELECT q, dong, n AS n_final, log_index AS final FROM pv WHERE visible = 92),
tp AS (SELECT pv.*, n_final, final, CASE WHEN count(*) OVER w >= 2 THEN avg(n_final) OVER w END AS typical FROM pv JOIN fn USING (q, dong) WHERE visible < 92 WINDOW w AS (PARTITION BY dong ORDER BY q, visible ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT q, visible, dong, round(final - log_index, 6) AS revision, round(ln((n + 1) / (typical + 1)), 6) AS log_n_ratio, round(ln(1 + n), 6) AS log_n, round(slope * (92 - visible), 6) AS slope_left FROM tp WHERE typical IS NOT NULL""")
def revision_panel(spark, d):
    out = nowcast.revision_panel(nowcast.provisional_index(_residuals(spark, d)))
    return out.select("q", "visible", "dong", *[F.round(c, 6).alias(c) for c in ("revision", "log_n_ratio", "log_n", "slope_left")])


@query()
def revision_score(spark, d):
    """Provisional indexes before and after a correction learnt on earlier quarters."""
    return nowcast.revision_score(nowcast.revision_model(nowcast.revision_panel(nowcast.provisional_index(_residuals(spark, d)))))


@query()
def shrinkage_choice(spark, d):
    return nowcast.select_shrinkage(valid(spark, d))


@query(f"""{SCALES_SQL}, la AS (SELECT unnest([2.0, 5.0, 10.0])::DOUBLE AS lam), ls AS (SELECT lam, dong, q, n_sales, dq_effect * (n_sales + 5) / n_sales * n_sales / (n_sales + lam) AS d, log_index - dq_effect + dq_effect * (n_sales + 5) / n_sales * n_sales / (n_sales + lam) AS x, sqrt(sigma * sigma * n_sales + tau * tau * lam * lam) / (n_sales + lam) AS se FROM idx, la, sc),
lc AS (SELECT *, x - lag(x) OVER (PARTITION BY lam, dong ORDER BY q) AS change FROM ls) SELECT lam, round(stddev_samp(change), 6) AS change_sd, round(stddev_samp(CASE WHEN n_sales <= 5 THEN d END), 6) AS thin_sd, round(median(se), 6) AS se_median FROM lc GROUP BY 1""")
def shrinkage_stability(spark, d):
    """Spread of quarterly changes, of thin dongs' deviations, and the usual error under three shrinkages."""
    index, s = scales(spark, d)
    sigma, tau = s.select("sigma", "tau").first()  # one row
    out = nowcast.stability(index, sigma or 0.0, tau or 0.0, [2.0, 5.0, 10.0])
    return out.select("lam", *[F.round(c, 6).alias(c) for c in ("change_sd", "thin_sd", "se_median")])


@query(f"{DELTA_SQL} SELECT q, n, round(mae_c0, 6) AS mae_c0, round(mae_c1, 6) AS mae_c1, round(mae_c1f, 6) AS mae_c1f, round(mae_c2, 6) AS mae_c2 FROM er")
def delta_ladder(spark, d):
    out = forecast.ladder_errors(_ladder(spark, d), RUNGS, 5)
    return out.select("q", "n", *[F.round(f"mae_{r}", 6).alias(f"mae_{r}") for r in RUNGS])


@query(f"""{DELTA_SQL}, df AS (SELECT q, mae_c0 - mae_c1f AS d FROM er), ct AS (SELECT q, d - avg(d) OVER () AS c, avg(d) OVER () AS m FROM df),
lg AS (SELECT m, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM ct WINDOW w AS (ORDER BY q)),
vr AS (SELECT count(*) AS n, any_value(m) AS m, (sum(c * c) + 1.5 * coalesce(sum(c * c1), 0) + 1.0 * coalesce(sum(c * c2), 0) + 0.5 * coalesce(sum(c * c3), 0)) / count(*) AS v FROM lg)
SELECT n, round(m, 6) AS mean, CASE WHEN v > 0 THEN round(m / sqrt(v / n), 4) END AS statistic FROM vr""")
def ladder_test(spark, d):
    """The fitted gu momentum against no forecast."""
    out = forecast.dm_statistic(forecast.ladder_errors(_ladder(spark, d), RUNGS, 5), "mae_c0", "mae_c1f", 3)
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("statistic", 4).alias("statistic"))


@query(f"""{DELTA_SQL}, lo AS (UNPIVOT (SELECT q, dong, delta, c0::DOUBLE AS c0, c1::DOUBLE AS c1, c1f::DOUBLE AS c1f, c2::DOUBLE AS c2 FROM pr) ON c0, c1, c1f, c2 INTO NAME rung VALUE pred),
rk AS (SELECT rung, q, rank() OVER (PARTITION BY rung, q ORDER BY pred) + (count(*) OVER (PARTITION BY rung, q, pred) - 1) / 2 AS ra, rank() OVER (PARTITION BY rung, q ORDER BY delta) + (count(*) OVER (PARTITION BY rung, q, delta) - 1) / 2 AS rb, abs(delta - pred) AS e FROM lo),
rq AS (SELECT rung, q, avg(e) AS mae, count(*) AS n, CASE WHEN stddev_pop(ra) <> 0 AND stddev_pop(rb) <> 0 THEN corr(ra, rb) END AS rho FROM rk GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT rung, round(avg(mae), 6) AS mae, round(median(rho), 5) AS rho, round(avg(coalesce(rho > 1e-12, false)::INT), 6) AS positive FROM rq GROUP BY 1""")
def ladder_score(spark, d):
    out = forecast.ladder_score(_ladder(spark, d), RUNGS, 5)
    return out.select("rung", F.round("mae", 6).alias("mae"), F.round("rho", 5).alias("rho"), F.round("positive", 6).alias("positive"))


def _ridge_sql(rows, x0, x1=None):
    """The closed form of a standardized ridge of one or two features from running sums: prediction at (x0, x1)."""
    m = lambda i: f"(s{i} / {rows})"
    sd = lambda i: f"(CASE WHEN p{i}{i} / {rows} - {m(i)} * {m(i)} > 1e-15 THEN sqrt(greatest(p{i}{i} / {rows} - {m(i)} * {m(i)}, 1e-15)) ELSE 1 END)"
    zz = lambda i, j: f"((p{i}{j} - {m(i)} * s{j} - s{i} * {m(j)} + {rows} * {m(i)} * {m(j)}) / ({sd(i)} * {sd(j)}))"
    zy = lambda i: f"((c{i} - sy / {rows} * s{i}) / {sd(i)})"
    z = lambda i, x: f"(({x} - {m(i)}) / {sd(i)})"
    if x1 is None:
        return f"(sy / {rows} + {z(0, x0)} * {zy(0)} / ({zz(0, 0)} + 1))"
    a, b, d = f"({zz(0, 0)} + 1)", zz(0, 1), f"({zz(1, 1)} + 1)"
    det = f"({a} * {d} - {b} * {b})"
    return f"(sy / {rows} + {z(0, x0)} * ({d} * {zy(0)} - {b} * {zy(1)}) / {det} + {z(1, x1)} * ({a} * {zy(1)} - {b} * {zy(0)}) / {det})"


_SUMS = ("sy", "s0", "p00", "c0", "s1", "p11", "p01", "c1")
TWO_STAGE_SQL = f"""{INDEX_SQL}, u0 AS (SELECT i.dong, i.q, i.n_sales, a.log_index - i.log_index AS y, i.log_index - b.log_index AS b1 FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 4 JOIN idx b ON b.dong = i.dong AND b.q = i.q - 4),
rl AS MATERIALIZED (SELECT q, dong, y, b2, b1 - b2 AS x, ln(n_sales) AS x2, y - avg(y) OVER (PARTITION BY q) AS r FROM (SELECT *, avg(b1) OVER (PARTITION BY q) AS b2 FROM u0)),
mk AS (SELECT q, any_value(b2) AS base, avg(y) AS target, avg(x2) AS depth FROM rl GROUP BY 1), mi AS (SELECT *, target - base AS miss FROM mk),
mp AS (SELECT q, base, depth, miss AS sy, base AS s0, base * base AS p00, base * miss AS c0, depth AS s1, depth * depth AS p11, base * depth AS p01, depth * miss AS c1 FROM mi),
mw AS (SELECT q, base, depth, count(*) OVER w AS k, {", ".join(f"sum({c}) OVER w AS {c}" for c in _SUMS)} FROM mp WINDOW w AS (ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)),
mh AS (SELECT q, 'M0' AS m, base AS m_hat FROM mw UNION ALL SELECT q, 'M1', base + CASE WHEN k >= 4 THEN {_ridge_sql("k", "base")} ELSE 0 END FROM mw UNION ALL SELECT q, 'M2', base + CASE WHEN k >= 4 THEN {_ridge_sql("k", "base", "depth")} ELSE 0 END FROM mw),
rp AS (SELECT q, count(*) AS n, sum(r) AS sy, sum(x) AS s0, sum(x * x) AS p00, sum(x * r) AS c0, sum(x2) AS s1, sum(x2 * x2) AS p11, sum(x * x2) AS p01, sum(x2 * r) AS c1 FROM rl GROUP BY 1),
rw AS (SELECT q AS o, count(*) OVER w AS k, sum(n) OVER w AS n, {", ".join(f"sum({c}) OVER w AS {c}" for c in _SUMS)} FROM rp WINDOW w AS (ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)),
rr AS (SELECT q, dong, y, r, CASE WHEN k >= 4 AND n >= 100 THEN {_ridge_sql("n", "x", "x2")} ELSE 0 END AS raw FROM rl JOIN rw ON o = q), rc AS MATERIALIZED (SELECT *, raw - avg(raw) OVER (PARTITION BY q) AS centered FROM rr),
ge AS (SELECT gamma, q, avg(abs(r - gamma * centered)) AS mae, count(*) AS n FROM rc, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(gamma) GROUP BY 1, 2),
gw AS (SELECT gamma, q, sum(mae) OVER w AS mae, count(*) OVER w AS k, sum(n) OVER w AS n FROM ge WINDOW w AS (PARTITION BY gamma ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)),
gc AS (SELECT q, CASE WHEN k >= 4 AND n >= 100 THEN gamma ELSE 0 END::DOUBLE AS gamma FROM gw QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(mae / k, 12), gamma) = 1),
pv_ AS (SELECT q, dong, y, m || '_R0' AS variant, m_hat, 0.0::DOUBLE AS rel FROM rc JOIN mh USING (q) UNION ALL SELECT q, dong, y, m || '_R1', m_hat, gamma * centered FROM rc JOIN mh USING (q) JOIN gc USING (q)),
po_ AS (SELECT *, avg(y) OVER (PARTITION BY variant, q) AS mean FROM pv_),
pe_ AS (SELECT variant, q, count(*) AS n, avg(abs(m_hat + rel - y)) AS mae, sum(abs(m_hat + rel - y)) AS total, abs(any_value(m_hat) - avg(y)) AS market, avg(abs(rel - (y - mean))) AS relative, covar_pop(y, rel) / nullif(stddev_pop(y) * stddev_pop(rel), 0) AS corr, (sign(any_value(m_hat)) = sign(avg(y)))::INT AS hit FROM po_ GROUP BY 1, 2),
sg AS (SELECT 'early' AS segment, 0 AS f1, l - 12 AS l1 FROM span UNION ALL SELECT 'recent', l - 11, l FROM span),
wd AS (SELECT segment, variant, count(*) AS n_origins, sum(n)::BIGINT AS n_rows, avg(mae) AS mae_origin, sum(total) / sum(n) AS mae_row, avg(market) AS market_mae, avg(relative) AS relative_mae, avg(corr) AS relative_corr, avg(hit) AS market_sign_hit FROM pe_ JOIN sg ON q BETWEEN f1 AND l1 GROUP BY 1, 2)
SELECT segment, variant, n_origins, n_rows, unnest(['mae_origin', 'mae_row', 'market_mae', 'relative_mae', 'relative_corr', 'market_sign_hit']) AS metric, round(unnest([mae_origin, mae_row, market_mae, relative_mae, relative_corr, market_sign_hit]), 6) AS value FROM wd"""


@query(TWO_STAGE_SQL)
def two_stage_metrics(spark, d):
    """Market and relative parts, their variants and six metrics over two segments."""
    last = span(spark, d)[1]
    rel = _relative(spark, d)
    market = rel.groupBy("q").agg(F.first("b2").alias("base"), F.avg("y").alias("target"), F.avg("x2").alias("depth"))
    m = forecast.market_models(market, 4, "base", "target", {"M1": ["base"], "M2": ["base", "depth"]}, least=4)
    r = forecast.relative_models(rel, 4, ["x", "x2"], least_origins=4, least_rows=100)
    gamma = r.join(rel.select("q", "dong", F.col("r").alias("y")), ["q", "dong"]).select("q", "model", "y", F.col("centered").alias("x"))
    g = forecast.rolling_gamma(gamma.where("model = 'R1'"), 4, least_origins=4, least_rows=100)
    r = r.join(g, "q").withColumn("gamma", F.when(F.col("model") == "R0", 0.0).otherwise(F.col("gamma")))
    preds = forecast.assemble_variants(rel.select("q", "dong", "y"), m, r)
    segments = spark.createDataFrame([("early", 0, last - 12), ("recent", last - 11, last)], "segment string, first int, last int")
    return forecast.metric_cube(preds, segments).withColumn("value", F.round("value", 6))


@query(f"""{INDEX_SQL}, t AS (SELECT i.q, a.log_index - i.log_index AS y, i.log_index - b.log_index AS b1 FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 4 JOIN idx b ON b.dong = i.dong AND b.q = i.q - 4),
u AS (SELECT q, abs(y - avg(b1) OVER (PARTITION BY q)) AS err, 1 / count(*) OVER (PARTITION BY q) AS w FROM t), o AS (SELECT DISTINCT q FROM u),
p AS (SELECT a.q, b.q AS s FROM o a JOIN o b ON b.q + 4 <= a.q QUALIFY row_number() OVER (PARTITION BY a.q ORDER BY b.q DESC) <= 4),
k AS (SELECT p.q, s, err, w, sum(w) OVER (PARTITION BY p.q ORDER BY err) AS run, sum(w) OVER (PARTITION BY p.q) AS whole FROM p JOIN u ON u.q = s),
c AS (SELECT q, count(DISTINCT s) AS origins, count(*) AS rows FROM k GROUP BY 1 HAVING count(DISTINCT s) = 4 AND count(*) >= 20)
SELECT q, origins, rows, round(half, 6) AS half FROM c JOIN (SELECT q, min(err) AS half FROM k WHERE run >= 0.8 * whole - 1e-12 GROUP BY 1) USING (q)""")
def empirical_intervals(spark, d):
    rows = _relative(spark, d).select("q", "y", F.col("b2").alias("y_hat"))
    return forecast.empirical_intervals(rows, 4, n=4, least_rows=20).withColumn("half", F.round("half", 6))


def drawn_sql(n, *parts):
    """The SQL of hedonic.drawn."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 8))::BIGINT % {n})"


BASE_ERRORS_SQL = f"""{INDEX_SQL}, t_ AS (SELECT i.dong, i.q, a.log_index - i.log_index AS y, i.log_index - b.log_index AS b1 FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 4 JOIN idx b ON b.dong = i.dong AND b.q = i.q - 4),
eb AS (SELECT dong, q, q // 4 AS year, abs(y - b1) AS a, abs(y - avg(b1) OVER (PARTITION BY q)) AS b FROM t_)"""


def bootstrap_sql(unit):
    return f"""{BASE_ERRORS_SQL}, un AS MATERIALIZED (SELECT {unit} AS unit, sum(a - b) AS s, count(*) AS n, row_number() OVER (ORDER BY {unit}) - 1 AS slot FROM eb GROUP BY 1), sz AS (SELECT count(*) AS units FROM un),
dr AS (SELECT draw, {drawn_sql("units", 1, "draw", "k")} AS slot FROM sz, (SELECT unnest(range(1000)) AS draw) x, (SELECT slot AS k FROM un) y), ds_ AS (SELECT draw, sum(s) / sum(n) AS diff FROM dr JOIN un USING (slot) GROUP BY 1)
SELECT round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, (SELECT round(sum(s) / sum(n), 6) FROM un) AS mean FROM ds_"""


def _unit_bootstrap(spark, d, unit):
    rows = panel.baselines(panel.with_targets(stored_index(spark, d), 4)).withColumn("year", F.floor(F.col("q") / 4))
    out = hedonic.block_bootstrap(stored(rows.select(unit, F.abs(F.col("y") - F.col("b1")).alias("a"), F.abs(F.col("y") - F.col("b2")).alias("b")), "errors"), unit, "a", "b")
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "mean")])


@query(bootstrap_sql("dong"))
def mae_bootstrap(spark, d):
    """Own momentum against the city's mean, by dong blocks."""
    return _unit_bootstrap(spark, d, "dong")


@query(bootstrap_sql("q"))
def quarter_bootstrap(spark, d):
    """The same by quarters."""
    return _unit_bootstrap(spark, d, "q")


@query(bootstrap_sql("year"))
def year_bootstrap(spark, d):
    """The same by years: a year's origins are drawn together."""
    return _unit_bootstrap(spark, d, "year")


@query(f"""{BASE_ERRORS_SQL}, se_ AS MATERIALIZED (SELECT q - min(q) OVER () AS pos, avg(a) - avg(b) AS value FROM eb GROUP BY q), st AS MATERIALIZED (SELECT pos AS start, row_number() OVER (ORDER BY pos) - 1 AS slot FROM (SELECT pos, count(value) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM se_) WHERE n = 4),
sz AS (SELECT (SELECT count(*) FROM se_) AS n, (SELECT count(*) FROM st) AS starts), dr AS (SELECT draw, k, {drawn_sql("starts", 42, "draw", "k")} AS slot FROM (SELECT * FROM sz WHERE starts > 0) z, (SELECT unnest(range(2000)) AS draw) x, (SELECT unnest(range(1000)) AS k) y WHERE k < ceil(n / 4)),
pk_ AS (SELECT draw, start + o AS pos FROM dr JOIN st USING (slot), (SELECT unnest(range(4)) AS o) o_, sz WHERE k * 4 + o < n), ds_ AS (SELECT draw, avg(value) AS m FROM pk_ JOIN se_ USING (pos) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws, (SELECT round(avg(value), 6) FROM se_) AS mean FROM ds_""")
def error_gap_bootstrap(spark, d):
    """Mean gap of two baselines' errors by origin, over moving blocks of quarters."""
    e = panel.mae_by_origin(panel.baselines(panel.with_targets(stored_index(spark, d), 4)))
    first = e.agg(F.min("q").alias("f"))
    series = e.crossJoin(F.broadcast(first)).select((F.col("q") - F.col("f")).alias("pos"), (F.col("mae_b1") - F.col("mae_b2")).alias("value"))
    out = forecast.moving_block_bootstrap(stored(series, "gaps"), 4)
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "high")], "draws", F.round("mean", 6).alias("mean"))


@query(f"""{INDEX_SQL}, fz AS (SELECT dong, log_index AS level, n_sales::DOUBLE AS n FROM idx WHERE q = {LAST}), zx AS MATERIALIZED (SELECT l AS as_of, dong, [coalesce((level - avg(level) OVER ()) / nullif(stddev_pop(level) OVER (), 0), 0), coalesce((n - avg(n) OVER ()) / nullif(stddev_pop(n) OVER (), 0), 0)] AS x, 1.0::DOUBLE AS w FROM fz, span),
{kmeans_sql("zx", "(VALUES (4)) t(k)", 2, "zk")}, f AS (SELECT fz.*, cluster FROM fz JOIN zk USING (dong)),
l AS (SELECT dong, cluster, unnest(['level', 'n']) AS feature, unnest([level, n]) AS value FROM f), w AS (SELECT feature, median(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY 1), c AS (SELECT cluster, feature, median(value) AS c FROM l GROUP BY 1, 2)
SELECT cluster, feature, coalesce(round((c - m) / nullif(sd, 0), 6), 0) AS z FROM c JOIN w USING (feature)""")
def structure_z(spark, d):
    """How far each of four clusters by index level and sales stands from all dongs."""
    last = span(spark, d)[1]
    f = stored(panel.mean_index(valid(spark, d)).where(F.col("q") == last).select("dong", F.lit(last).alias("as_of"), F.col("log_index").alias("level"), F.col("n_sales").cast("double").alias("n")), "levels")
    found = cluster.keyed_kmeans(cluster.standardized(f, ["level", "n"], ["as_of"], least=1), [4], 2, starts=STARTS, rounds=ROUNDS)
    return catalog.structure_z(f.select("dong", "level", "n"), found.select("dong", "cluster"), ["level", "n"]).withColumn("z", F.round("z", 6))


@query(f""", c AS (SELECT dong, sgg_cd AS gu_name, umd_nm AS umd_name, count(*) AS n, round(median(price / area), 4) AS price FROM valid WHERE q > {LAST} - 4 GROUP BY 1, 2, 3) SELECT dong, price FROM c WHERE contains(gu_name || ' ' || umd_name, 'S1') AND n >= 20 AND price BETWEEN 1000 AND 2000""")
def catalog_filter(spark, d):
    last = span(spark, d)[1]
    c = valid(spark, d).where(F.col("q") > last - 4).groupBy("dong", F.col("sgg_cd").alias("gu_name"), F.col("umd_nm").alias("umd_name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("price") / F.col("area")), 4).alias("price"))
    c = c.withColumn("flags", scalars.sample_flags(F.col("n"), F.lit(0.0)))
    return catalog.filter_dongs(c, "S1", flagged=False, band=(1000, 2000)).select("dong", "price")


@query(f"""{BASE_ERRORS_SQL}, e0 AS (SELECT q, avg(abs(y)) AS b0, avg(abs(y - b1)) AS b1, avg(abs(y - m)) AS b2 FROM (SELECT *, avg(b1) OVER (PARTITION BY q) AS m FROM t_) GROUP BY 1), mv AS (SELECT avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2 FROM e0),
mc AS (SELECT unnest(['b0', 'b1', 'b2']) AS candidate, unnest([b0, b1, b2]) AS value, unnest([0, 1, 2]) AS o, b0 AS base FROM mv WHERE b0 IS NOT NULL), mg AS (SELECT *, (base - value) / base AS gain FROM mc)
SELECT candidate, round(value, 6) AS value, round(gain, 6) AS gain, row_number() OVER (ORDER BY CASE WHEN candidate = 'b0' THEN 0 WHEN gain >= 0.02 THEN gain ELSE -1 END DESC, o) = 1 AS selected FROM mg""")
def model_choice(spark, d):
    """Which baseline betters no change by two per cent, if any."""
    e = panel.mae_by_origin(panel.baselines(panel.with_targets(stored_index(spark, d), 4)))
    wide = e.agg(*[F.avg(f"mae_{c}").alias(c) for c in ("b0", "b1", "b2")]).where("b0 is not null")
    metrics = wide.unpivot([], ["b0", "b1", "b2"], "variant", "value").select(F.lit("all").alias("segment"), "variant", F.lit("mae_origin").alias("metric"), "value")
    out = forecast.select_models(metrics, "all", "b0", ["b1", "b2"], "mae_origin")
    return out.select("candidate", F.round("value", 6).alias("value"), F.round("gain", 6).alias("gain"), "selected")


@query(f"""{BASE_ERRORS_SQL}, hf AS (SELECT quantile_cont(b, 0.8) AS half FROM eb), eg AS (SELECT dong, coalesce(count_if(q BETWEEN l - 3 AND l) >= 20, false) AS eligible FROM valid, span GROUP BY dong, l),
mo AS (SELECT avg(a.log_index - b.log_index) AS y FROM idx a JOIN idx b ON b.dong = a.dong AND b.q = a.q - 4 JOIN eg ON eg.dong = a.dong AND eligible, span WHERE a.q = l)
SELECT dong, CASE WHEN eligible THEN 'PREDICTED' ELSE 'INSUFFICIENT_SALES' END AS status, CASE WHEN eligible THEN round(y, 6) END AS y_hat, CASE WHEN eligible THEN round((exp(y) - 1) * 100, 4) END AS est, CASE WHEN eligible THEN round((exp(y - half) - 1) * 100, 4) END AS lower, CASE WHEN eligible THEN round((exp(y + half) - 1) * 100, 4) END AS upper FROM eg, mo, hf""")
def latest_scores(spark, d):
    """Every dong's change over the coming year by the city's momentum, with the range that four in five past errors kept to."""
    first, last = span(spark, d)
    index = stored_index(spark, d)
    rows = panel.baselines(panel.with_targets(index, 4))
    half = rows.agg(F.percentile(F.abs(F.col("y") - F.col("b2")), F.lit(0.8)).alias("half"))
    dongs = ledger.eligible(valid(spark, d), first, last).where(F.col("q") == last).select("dong", "eligible")
    now = panel.with_targets(index, 4).where((F.col("q") == last) & F.col("b1").isNotNull()).join(dongs.where("eligible"), "dong").agg(F.avg("b1").alias("y_hat"))
    preds = dongs.select("dong").crossJoin(F.broadcast(now))  # one row
    out = forecast.score_latest(dongs.crossJoin(F.broadcast(half)), preds, F.col("half"))
    return out.select("dong", "status", F.round("y_hat", 6).alias("y_hat"), *[F.round(c, 4).alias(c) for c in ("est", "lower", "upper")])
