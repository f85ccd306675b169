"""Registered queries of neighbourhood clusters over time. Importing this module adds them to QUERIES and ORACLE."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cluster, hedonic, ledger, serving, support
from ..sources.adapter import completions, complexes, span, trade_rent, trade_sale
from ..sources.store import stored
from .forecasts import WEIGHT_SQL, _weights
from .kmeans import ROUNDS, STARTS, kmeans_sql
from .queries import SCALES_SQL, query, scales, valid
from .serving import CBD, COLS, GANGNAM, VINTAGE_SQL, _km, _rounded, _vintage

KS = (4, 5, 6)

STRUCTURE_SQL = f""", kp AS (SELECT dong, as_of, median(p) AS ppm2 FROM (SELECT dong, price / area AS p, unnest(range(q, q + 4)) AS as_of FROM valid) GROUP BY 1, 2),
kj AS (SELECT dong, as_of, median(CASE WHEN area > 0 AND deposit > 0 AND monthly = 0 THEN deposit / area END) AS jp FROM (SELECT *, unnest(range(q, q + 4)) AS as_of FROM rent) GROUP BY 1, 2),
kb AS (SELECT dong, q, sum(l_linenumber) AS h FROM joined, span WHERE l_returnflag = 'A' AND q <= l GROUP BY 1, 2),
kg AS (SELECT dong, as_of FROM (SELECT DISTINCT dong FROM kb), (SELECT unnest(range(f, l + 1)) AS as_of FROM span)),
ku AS (SELECT kg.dong, as_of, sum(CASE WHEN q <= as_of THEN h ELSE 0 END) AS stock, sum(CASE WHEN q BETWEEN as_of - 7 AND as_of THEN h ELSE 0 END) AS recent FROM kg JOIN kb USING (dong) GROUP BY 1, 2),
kx AS (SELECT DISTINCT apt_seq, 37.4 + l_suppkey % 350 / 1000 AS lat, 126.7 + l_suppkey % 600 / 1000 AS lng FROM joined),
kc AS (SELECT dong, avg(lat) AS lat, avg(lng) AS lng FROM (SELECT DISTINCT dong, apt_seq FROM valid) JOIN kx USING (apt_seq) GROUP BY 1),
kf AS (SELECT kp.dong, split_part(kp.dong, '_', 1) AS sgg_cd, as_of, ln(ppm2) AS log_ppm2, jp / ppm2 AS jeonse_ratio, ln(1 + stock) AS log_stock, recent / nullif(stock, 0) AS new_share, lat, lng, {_km(CBD)} AS dist_cbd, {_km(GANGNAM)} AS dist_gangnam
  FROM kp JOIN span ON as_of BETWEEN f + 3 AND l LEFT JOIN kj USING (dong, as_of) LEFT JOIN ku USING (dong, as_of) LEFT JOIN kc USING (dong)),
km AS (SELECT dong, sgg_cd, as_of, {", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY as_of, sgg_cd), median({c}) OVER (PARTITION BY as_of)) AS {c}" for c in COLS)} FROM kf),
kn AS (SELECT *, count(*) OVER (PARTITION BY as_of) AS rows FROM km WHERE {" AND ".join(f"{c} IS NOT NULL" for c in COLS)}),
kz AS MATERIALIZED (SELECT as_of, dong, [{", ".join(f"coalesce(({c} - avg({c}) OVER (PARTITION BY as_of)) / nullif(stddev_pop({c}) OVER (PARTITION BY as_of), 0), 0)" for c in COLS)}] AS x, 1.0::DOUBLE AS w FROM kn WHERE rows >= 50),
{kmeans_sql("kz", "(VALUES (4), (5), (6)) t(k)", len(COLS), "ks")}"""
AGREE_SQL = """, {p}t AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY as_of) AS pos FROM {m}), {p}l AS (SELECT b.k, b.as_of, a.cluster AS before, b.cluster AS now FROM {p}t a JOIN {p}t b ON a.k = b.k AND a.dong = b.dong AND b.pos = a.pos + 1),
{p}c AS (SELECT k, as_of, before, now, count(*) AS m FROM {p}l GROUP BY 1, 2, 3, 4), {p}s AS (SELECT k, as_of, sum(m) AS n, sum(m * (m - 1) / 2) AS s FROM {p}c GROUP BY 1, 2),
{p}a AS (SELECT k, as_of, sum(m * (m - 1) / 2) AS sa FROM (SELECT k, as_of, before, sum(m) AS m FROM {p}c GROUP BY 1, 2, 3) GROUP BY 1, 2), {p}b AS (SELECT k, as_of, sum(m * (m - 1) / 2) AS sb FROM (SELECT k, as_of, now, sum(m) AS m FROM {p}c GROUP BY 1, 2, 3) GROUP BY 1, 2),
{p}r AS (SELECT k, as_of, n::BIGINT AS n, coalesce((s - sa * sb / (n * (n - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2), 0), 1) AS ari FROM {p}s JOIN {p}a USING (k, as_of) JOIN {p}b USING (k, as_of)),
{p}k AS (SELECT k, median(ari) AS md, quantile_cont(ari, 0.1) AS low, min(ari) AS least FROM {p}r GROUP BY 1), {p}o AS (SELECT *, row_number() OVER (ORDER BY round(md, 9) DESC, round(low, 9) DESC, k) = 1 AS chosen FROM {p}k)"""
KS_SQL = STRUCTURE_SQL + AGREE_SQL.format(p="ka_", m="ks")
CHOSEN_SQL = f"{KS_SQL}, kk AS (SELECT as_of, dong, cluster, k FROM ks JOIN ka_o USING (k) WHERE chosen)"


def structure_panel(spark, d):
    """(as_of, dong, sgg_cd and the structure features) of every quarter from the fourth on, gaps filled by medians of the time."""
    first, last = span(spark, d)
    v = valid(spark, d)
    price = ledger.sale_features(trade_sale(spark, d), v).where(F.col("median_ppm2_4q").isNotNull() & F.col("as_of").between(first + 3, last)).select("dong", "as_of", "median_ppm2_4q")
    rent = ledger.rent_features(trade_rent(spark, d)).select("dong", "as_of", "jeonse_ppm2_4q")
    built = ledger.supply_features(completions(spark, d).where(F.col("q") <= last), first, last).select("dong", F.col("q").alias("as_of"), "households_8q", "stock")
    place = serving.dong_centers(v, complexes(spark, d), first)
    rows = ledger.assemble_features(price, [rent, built], ["dong", "as_of"]).join(place, "dong", "left")
    km = lambda p: scalars.km_distance(F.col("lat"), F.col("lng"), p)
    rows = rows.select("dong", F.split("dong", "_")[0].alias("sgg_cd"), "as_of", F.log("median_ppm2_4q").alias("log_ppm2"), F.try_divide("jeonse_ppm2_4q", "median_ppm2_4q").alias("jeonse_ratio"), F.log1p("stock").alias("log_stock"), F.try_divide("households_8q", "stock").alias("new_share"), "lat", "lng", km(CBD).alias("dist_cbd"), km(GANGNAM).alias("dist_gangnam"))
    return support.structure_matrix(stored(rows, "structure"), COLS, "sgg_cd", ["as_of"])


def membership(spark, d):
    """(as_of, k, dong, cluster) for every candidate k, stored."""
    points = cluster.standardized(structure_panel(spark, d), COLS, ["as_of"])
    return stored(cluster.keyed_kmeans(points, KS, len(COLS), starts=STARTS, rounds=ROUNDS), "membership")


def chosen_membership(spark, d):
    """membership of the k that is most stable over time; empty where there are too few dongs."""
    every = membership(spark, d)
    return stored(every.join(F.broadcast(cluster.stability(every).where("chosen").select("k")), "k").select("as_of", "dong", "cluster", "k"), "chosen")


@query(f"{STRUCTURE_SQL} SELECT as_of, k, dong, cluster FROM ks")
def structure_membership(spark, d):
    """Structure clusters at every quarter from the fourth on, for 4, 5 and 6 clusters; from 50 dongs on."""
    return membership(spark, d)


@query(f"{KS_SQL} SELECT k, as_of, n, round(ari, 9) AS ari FROM ka_r")
def cluster_agreement(spark, d):
    """Adjusted Rand index of neighbouring quarters."""
    return _rounded(cluster.agreement(cluster.adjacent(membership(spark, d)), ["k", "as_of"]), ["ari"], 9)


@query(f"{KS_SQL} SELECT k, round(md, 6) AS median, round(low, 6) AS low, round(least, 6) AS least, chosen FROM ka_o")
def cluster_stability(spark, d):
    return _rounded(cluster.stability(membership(spark, d)), ["median", "low", "least"])


def _greedy_sql(k: int) -> str:
    """g{k}: the first k pairs (a earlier, b later) by falling overlap of which each shares no label with one before."""
    steps = ["g0 AS (SELECT as_of, k, a, b, coalesce(m, 0) AS m, false AS taken, true AS open FROM gb)"]
    for i in range(k):
        steps.append(f"""h{i} AS (SELECT *, CASE WHEN open THEN row_number() OVER (PARTITION BY as_of, open ORDER BY m DESC, a, b) END = 1 AS pick FROM g{i}),
g{i + 1} AS MATERIALIZED (SELECT as_of, k, a, b, m, taken OR coalesce(pick, false) AS taken, open AND a <> max(CASE WHEN pick THEN a END) OVER (PARTITION BY as_of) AND b <> max(CASE WHEN pick THEN b END) OVER (PARTITION BY as_of) AS open FROM h{i})""")
    return ", ".join(steps)


@query(f"""{CHOSEN_SQL}, gt AS (SELECT DISTINCT as_of, k FROM kk), gp AS (SELECT as_of, k, dense_rank() OVER (ORDER BY as_of) AS pos FROM gt), gn AS (SELECT as_of, before AS a, now AS b, count(*) AS m FROM ka_l JOIN (SELECT DISTINCT k FROM kk) USING (k) GROUP BY 1, 2, 3),
gf AS (SELECT as_of, k, a, b FROM gp, (SELECT unnest(range(6))::INT AS a) x, (SELECT unnest(range(6))::INT AS b) y WHERE pos > 1 AND a < k AND b < k), gb AS (SELECT as_of, k, a, b, m FROM gf LEFT JOIN gn USING (as_of, a, b)), {_greedy_sql(6)},
gm AS (SELECT pos, a, b FROM g6 JOIN gp USING (as_of) WHERE taken),
gr AS (WITH RECURSIVE r AS (SELECT 1::BIGINT AS pos, c::INT AS b, c::INT AS label FROM (SELECT unnest(range(6)) AS c) x UNION ALL SELECT gm.pos, gm.b, r.label FROM r JOIN gm ON gm.pos = r.pos + 1 AND gm.a = r.b) SELECT * FROM r)
SELECT as_of, dong, cluster, label FROM kk JOIN gp USING (as_of) JOIN gr ON gr.pos = gp.pos AND gr.b = cluster""")
def aligned_clusters(spark, d):
    """The chosen clusters with numbers that carry on from quarter to quarter."""
    return cluster.aligned(chosen_membership(spark, d), by=()).select("as_of", "dong", "cluster", "label")


@query(f"""{CHOSEN_SQL} SELECT cluster, count(*) AS n, round(exp(median(log_ppm2)), 4) AS price, {", ".join(f"round(median({c}), 6) AS {c}" for c in ("jeonse_ratio", "log_stock", "dist_cbd"))} FROM kk JOIN km USING (as_of, dong), span WHERE as_of = l GROUP BY 1""")
def cluster_profiles(spark, d):
    """Size, price and usual features of each cluster in the last complete quarter."""
    last = span(spark, d)[1]
    rows = structure_panel(spark, d).where(F.col("as_of") == last)
    out = hedonic.cluster_profile(rows, chosen_membership(spark, d).where(F.col("as_of") == last), "log_ppm2", ["jeonse_ratio", "log_stock", "dist_cbd"])
    return _rounded(out.withColumn("price", F.round("price", 4)), ["jeonse_ratio", "log_stock", "dist_cbd"])


DELTA_PATH_SQL = f"""{SCALES_SQL}{WEIGHT_SQL}{VINTAGE_SQL}"""


def _delta(spark, d):
    _, _, _, index, features = _vintage(spark, d)
    paths = stored(cluster.delta_paths(index, _weights(spark, d)), "paths")
    s = scales(spark, d)[1]
    se = hedonic.attach_se(index.where("q = origin").select("origin", "dong", "n_sales"), s).select("origin", "dong", F.col("log_index_se").alias("se"))
    now = features.join(se, ["origin", "dong"], "left").select(F.col("origin").alias("as_of"), "dong", "eligible", "se")
    return paths, now


PATH_SQL = f"""{DELTA_PATH_SQL}, dw AS (SELECT origin AS as_of, dong, {", ".join(f"max(CASE WHEN origin - q = {k} THEN log_index END) AS p{k}" for k in range(4, 9))} FROM vi WHERE origin - q BETWEEN 4 AND 8 GROUP BY 1, 2),
dc AS (SELECT as_of, dong, coalesce(w, 0) AS w, {", ".join(f"p{k - 1} - p{k} AS c{k}" for k in range(8, 4, -1))} FROM dw LEFT JOIN hs USING (dong)),
dx AS (SELECT as_of, dong, CASE WHEN {" AND ".join(f"c{k} IS NOT NULL" for k in range(8, 4, -1))} THEN [{", ".join(f"c{k} - coalesce(sum(c{k} * w) OVER (PARTITION BY as_of) / nullif(sum(CASE WHEN c{k} IS NOT NULL THEN w END) OVER (PARTITION BY as_of), 0), avg(c{k}) OVER (PARTITION BY as_of))" for k in range(8, 4, -1))}] END AS x FROM dc),
de AS (SELECT vf.origin AS as_of, dong, eligible, sqrt(sigma * sigma * n_sales + tau * tau * 25) / (n_sales + 5) AS se FROM vf JOIN (SELECT origin, dong, n_sales FROM vi WHERE q = origin) USING (origin, dong), sc),
dq AS (SELECT dx.as_of, dong, x, pow(se, -2) AS w, count(*) OVER (PARTITION BY dx.as_of) AS n FROM dx JOIN de USING (as_of, dong) WHERE eligible AND x IS NOT NULL AND se > 0), dp AS MATERIALIZED (SELECT as_of, dong, x, w FROM dq WHERE n >= 50)"""


@query(f"""{PATH_SQL} SELECT dx.as_of, dong, eligible, round(se, 6) AS se, {", ".join(f"round(x[{i}], 6) AS step_{i}" for i in range(1, 5))} FROM dx LEFT JOIN de USING (as_of, dong)""")
def delta_paths(spark, d):
    """Four quarterly changes less the common one that end a year before each quarter, with the weight's error."""
    paths, now = _delta(spark, d)
    out = paths.join(now, ["as_of", "dong"], "left").select("as_of", "dong", "eligible", F.round("se", 6).alias("se"), *[F.round(F.col("x")[i], 6).alias(f"step_{i + 1}") for i in range(4)])
    return out


@query(f"""{PATH_SQL}{CHOSEN_SQL}, {kmeans_sql("dp", "(SELECT DISTINCT k FROM kk)", 4, "dk")},
du AS (SELECT as_of, s, cluster FROM (SELECT dk.as_of, kk.cluster AS s, dk.cluster, count(*) AS n FROM dk JOIN kk USING (as_of, dong) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY as_of, s ORDER BY n DESC, cluster) = 1)
SELECT as_of, dong, cluster, true AS core FROM dk UNION ALL SELECT dx.as_of, dong, du.cluster, false FROM dx JOIN kk USING (as_of, dong) JOIN du ON du.as_of = dx.as_of AND du.s = kk.cluster WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.as_of = dx.as_of AND dk.dong = dx.dong)""")
def delta_clusters(spark, d):
    """Clusters of those paths, as many as the chosen structure clusters; dongs without one follow their structure mates.

    The two scales in the errors are those of the whole ledger.
    """
    chosen = chosen_membership(spark, d)
    k = chosen.agg(F.max("k").alias("k")).first()["k"]
    paths, now = _delta(spark, d)
    if k is None:
        return paths.select("as_of", "dong", F.lit(0).alias("cluster"), F.lit(False).alias("core")).where("false")
    return cluster.delta_clusters(paths, now, chosen, k, starts=STARTS, rounds=ROUNDS)
