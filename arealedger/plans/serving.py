"""Registered queries of the support table, served views and what was known at each origin. Importing adds them to QUERIES."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quarters, scalars
from ..operators import catalog, cluster, forecast, hedonic, ledger, quality, serving, support, vintage
from ..sources.adapter import completions, complexes, span, trade_rent, trade_sale
from ..sources.store import stored
from .forecasts import WEIGHT_SQL, _weights
from .kmeans import ROUNDS, STARTS, kmeans_sql
from .queries import EVENT_SQL, LAST, SCALES_SQL, ZONES_SQL, events_table, query, scales, valid, zones_of

COLS = ("log_ppm2", "jeonse_ratio", "log_stock", "new_share", "lat", "lng", "dist_cbd", "dist_gangnam")
DESCRIBED = ("log_ppm2", "jeonse_ratio", "log_stock", "new_share", "dist_cbd", "dist_gangnam")
#: Structure clusters: their number is settled once, by stability over time (cluster_stability), and not by what they are good for.
K = 4
# The two centres that distances are measured from.
CBD, GANGNAM = (37.5663, 126.9779), (37.4979, 127.0276)


def _km(p):
    return f"sqrt(pow((lat - {p[0]}) * 111.0, 2) + pow((lng - {p[1]}) * 88.0, 2))"


def _words(feature, z, middle):
    pairs = " ".join(f"WHEN {feature} = '{k}' THEN CASE WHEN {z} > 0 THEN '{high}' ELSE '{low}' END" for k, (low, high) in support.WORDS.items())
    places = " ".join(f"WHEN {feature} = '{k}' THEN '{v} ' || round_even({middle}, 0)::BIGINT || 'km대'" for k, v in support.PLACES.items())
    return f"CASE {pairs} {places} END"


def _particle(word, closed, open_):
    return f"{word} || CASE WHEN ord(right({word}, 1)) BETWEEN 44032 AND 55203 AND (ord(right({word}, 1)) - 44032) % 28 <> 0 THEN '{closed}' ELSE '{open_}' END"


def _pct(x):
    return f"floor((exp({x}) - 1) * 100 * 10 + 0.5) / 10"


def _se_pct(x, se):
    return f"floor(exp({x}) * (exp({se}) - exp(-{se})) / 2 * 100 * 10 + 0.5) / 10"


FEATURES_SQL = f"""{SCALES_SQL}{WEIGHT_SQL}, nx AS (SELECT dong, sgg_cd, log_index, log_index_se AS index_se FROM se, span WHERE q = l),
cy AS (SELECT dong, count(*) AS n_complexes, sum(n)::BIGINT AS sale_n, max(n) / sum(n) AS dominant_share FROM (SELECT dong, apt_seq, count(*) AS n FROM valid, span WHERE q BETWEEN l - 3 AND l GROUP BY 1, 2) GROUP BY 1),
sf AS (SELECT dong, avg((year(deal_date) - build_year >= 30)::INT) AS old30_share, median(year(deal_date) - build_year) AS median_age FROM sale, span WHERE q BETWEEN l - 3 AND l GROUP BY 1),
pp AS (SELECT dong, median(price / area) AS median_ppm2 FROM valid, span WHERE q BETWEEN l - 3 AND l GROUP BY 1),
rf AS (SELECT dong, median(CASE WHEN area > 0 AND deposit > 0 AND monthly = 0 THEN deposit / area END) AS jeonse_ppm2 FROM rent, span WHERE q BETWEEN l - 3 AND l GROUP BY 1),
bl AS (SELECT dong, sum(CASE WHEN q <= l THEN l_linenumber ELSE 0 END) AS stock, sum(CASE WHEN q BETWEEN l - 7 AND l THEN l_linenumber ELSE 0 END) AS recent FROM joined, span WHERE l_returnflag = 'A' GROUP BY 1),
cp AS (SELECT DISTINCT apt_seq, 37.4 + l_suppkey % 350 / 1000 AS lat, 126.7 + l_suppkey % 600 / 1000 AS lng FROM joined),
ct AS (SELECT dong, avg(lat) AS lat, avg(lng) AS lng FROM (SELECT DISTINCT dong, apt_seq FROM valid, span WHERE q >= l - 7) JOIN cp USING (apt_seq) GROUP BY 1),
el AS (SELECT dong, sum(CASE WHEN q BETWEEN l - 3 AND l THEN 1 ELSE 0 END)::BIGINT AS n_sales_4q FROM valid, span GROUP BY 1),
ft AS (SELECT nx.dong, nx.sgg_cd, ln(median_ppm2) AS log_ppm2, jeonse_ppm2 / median_ppm2 AS jeonse_ratio, ln(1 + stock) AS log_stock, recent / nullif(stock, 0) AS new_share, lat, lng, {_km(CBD)} AS dist_cbd, {_km(GANGNAM)} AS dist_gangnam FROM nx LEFT JOIN pp USING (dong) LEFT JOIN rf USING (dong) LEFT JOIN bl USING (dong) LEFT JOIN ct USING (dong)),
my AS (SELECT dong, sgg_cd, {", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY sgg_cd), median({c}) OVER ()) AS {c}" for c in COLS)} FROM ft),
mn AS (SELECT *, count(*) OVER () AS rows FROM my WHERE {" AND ".join(f"{c} IS NOT NULL" for c in COLS)}), mz AS MATERIALIZED (SELECT l AS as_of, dong, [{", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)" for c in COLS)}] AS x, 1.0::DOUBLE AS w FROM mn, span WHERE rows >= 50),
{kmeans_sql("mz", f"(VALUES ({K})) t(k)", len(COLS), "mq")}, mx AS MATERIALIZED (SELECT my.*, cluster FROM my LEFT JOIN mq USING (dong))"""

SUPPORT_SQL = f"""{FEATURES_SQL}, ch AS (SELECT a.dong, a.log_index - b.log_index AS change, sqrt(pow(a.index_se, 2) + pow(b.log_index_se, 2)) AS delta_se FROM nx a LEFT JOIN (SELECT dong, log_index, log_index_se FROM se, span WHERE q = l - 4) b USING (dong)),
mu AS (SELECT sum(change * w) / sum(w) AS mu FROM ch JOIN hs USING (dong) WHERE w > 0 AND change IS NOT NULL),
dl_ AS (SELECT dong, change, mu, change - mu AS delta, delta_se, CASE WHEN change IS NOT NULL THEN CASE WHEN abs(change - mu) > 2 * delta_se THEN 'DISTINGUISHABLE' ELSE 'INDISTINGUISHABLE' END END AS delta_state FROM ch, mu),
pw AS (SELECT dong, q, log_index, log_index_se, count(*) OVER (PARTITION BY dong) AS n, row_number() OVER (PARTITION BY dong ORDER BY log_index DESC, q DESC) AS r FROM se, span WHERE q BETWEEN l - 19 AND l),
pk AS (SELECT dong, p.q AS peak_q, nx.log_index - p.log_index AS gap, sqrt(pow(index_se, 2) + pow(p.log_index_se, 2)) AS gap_se FROM pw p JOIN nx USING (dong) WHERE r = 1 AND n = 20),
pt AS (SELECT dong, gap, gap_se, CASE WHEN peak_q = l THEN 'AT_PEAK' WHEN abs(gap) > 2 * gap_se THEN 'DISTINGUISHABLE' ELSE 'INDISTINGUISHABLE' END AS state FROM pk, span),
lo_ AS (UNPIVOT (SELECT dong, cluster, {", ".join(DESCRIBED)} FROM mx) ON {", ".join(DESCRIBED)} INTO NAME feature VALUE value),
wl AS (SELECT feature, median(value) AS m, stddev_pop(value) AS sd FROM lo_ GROUP BY 1), cl AS (SELECT cluster, feature, median(value) AS middle FROM lo_ GROUP BY 1, 2),
zz_ AS (SELECT cluster, feature, middle, coalesce(round((middle - m) / nullif(sd, 0), 9), 0) AS z FROM cl JOIN wl USING (feature)),
tp_ AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, list_position([{", ".join(f"'{c}'" for c in DESCRIBED)}], feature)) AS r FROM zz_ QUALIFY r <= 2),
ds AS (SELECT cluster, string_agg({_words("feature", "z", "middle")}, ' · ' ORDER BY r) AS structure_desc FROM tp_ GROUP BY 1),
sd_ AS (SELECT {", ".join(f"stddev_pop({c}) AS s_{c}" for c in COLS)} FROM mx),
zv AS (SELECT dong, cluster, [{", ".join(f"coalesce({c} / nullif(s_{c}, 0), 0)" for c in COLS)}] AS z FROM mx JOIN el USING (dong), sd_ WHERE n_sales_4q >= 20),
zb AS (SELECT * FROM zv WHERE cluster IN (SELECT cluster FROM zv GROUP BY 1 HAVING count(*) >= 10)),
pr_ AS (SELECT a.dong, b.dong AS peer, [{", ".join(f"round(pow(a.z[{i}] - b.z[{i}], 2), 12)" for i in range(1, 9))}] AS parts FROM zb a JOIN zb b ON a.cluster = b.cluster AND a.dong <> b.dong),
pn AS (SELECT dong, peer, parts, row_number() OVER (PARTITION BY dong ORDER BY round(sqrt(list_sum(parts)), 9), peer) AS r FROM pr_ QUALIFY r <= 5),
pc AS (SELECT dong, peer, r, unnest(parts) AS p, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i, unnest([{", ".join(f"'{support.CONCEPTS[c]}'" for c in COLS)}]) AS c FROM pn),
pf AS (SELECT dong, peer, r, c, min((p, i)) AS k FROM pc GROUP BY 1, 2, 3, 4), po AS (SELECT *, row_number() OVER (PARTITION BY dong, peer ORDER BY k) AS j FROM pf),
ps AS (SELECT dong, peer, r, max(CASE WHEN j = 1 THEN c END) AS a, max(CASE WHEN j = 2 THEN c END) AS b FROM po GROUP BY 1, 2, 3),
pj AS (SELECT dong, string_agg(peer || ':' || {_particle("a", "과", "와")} || ' ' || {_particle("b", "이", "가")} || ' 가까워요', '|' ORDER BY r) AS peers FROM ps GROUP BY 1),
fg_ AS (SELECT nx.dong, sale_n, n_complexes, dominant_share, index_se, array_to_string([x FOR x IN [CASE WHEN coalesce(sale_n, 0) < 20 THEN 'FEW_SALES' END, CASE WHEN dominant_share > 0.5 THEN 'ONE_COMPLEX_DOMINATES' END, CASE WHEN index_se >= 0.032 THEN 'HIGH_INDEX_ERROR' END] IF x IS NOT NULL], ';') AS flags FROM nx LEFT JOIN cy USING (dong)),
su AS (SELECT fg_.*, CASE WHEN index_se < 0.016 THEN 'LOW' WHEN index_se < 0.032 THEN 'MID' ELSE 'HIGH' END AS se_band, change, mu, delta, delta_se, delta_state, CASE WHEN NOT weak THEN gap END AS peak_gap, CASE WHEN NOT weak THEN gap_se END AS peak_gap_se, CASE WHEN NOT weak THEN state END AS peak_state,
  cluster AS structure_type, structure_desc, peers FROM (SELECT *, contains(flags, 'FEW_SALES') OR contains(flags, 'HIGH_INDEX_ERROR') AS weak FROM fg_) fg_ LEFT JOIN dl_ USING (dong) LEFT JOIN pt USING (dong) LEFT JOIN mx USING (dong) LEFT JOIN ds USING (cluster) LEFT JOIN pj USING (dong))"""
BASE_SQL = f"""{SUPPORT_SQL}, fq AS (SELECT dong, jeonse_ratio, recent / nullif(stock, 0) AS completed_share, recent AS completed_8q, old30_share, median_ppm2 FROM ft LEFT JOIN bl USING (dong) LEFT JOIN sf USING (dong) LEFT JOIN pp USING (dong)),
dg AS (SELECT DISTINCT dong, sgg_cd AS gu_name, umd_nm AS umd_name FROM valid)"""


def _features(spark, d, last):
    v = valid(spark, d)
    index = stored(hedonic.attach_se(*scales(spark, d)), "index")
    now = index.where(F.col("q") == last).select("dong", "sgg_cd")
    sale = ledger.sale_features(trade_sale(spark, d), v).where(F.col("as_of") == last)
    rent = ledger.rent_features(trade_rent(spark, d)).where(F.col("as_of") == last)
    built = ledger.supply_features(completions(spark, d).where(F.col("q") <= last), span(spark, d)[0], last).where(F.col("q") == last)
    place = serving.dong_centers(v, complexes(spark, d), last - 7)
    rows = ledger.assemble_features(now, [sale, rent.drop("as_of"), built.drop("q"), place], ["dong"])
    km = lambda p: scalars.km_distance(F.col("lat"), F.col("lng"), p)
    share = F.try_divide("households_8q", "stock")
    return index, stored(rows.select("dong", "sgg_cd", F.col("median_ppm2_4q").alias("median_ppm2"), F.col("old30_share_4q").alias("old30_share"), share.alias("completed_share"), F.col("households_8q").alias("completed_8q"), F.log("median_ppm2_4q").alias("log_ppm2"), F.try_divide("jeonse_ppm2_4q", "median_ppm2_4q").alias("jeonse_ratio"), F.log1p("stock").alias("log_stock"), share.alias("new_share"), "lat", "lng", km(CBD).alias("dist_cbd"), km(GANGNAM).alias("dist_gangnam")), "features")


def _concentration(spark, d, last):
    rows = ledger.complex_concentration(valid(spark, d)).where(F.col("as_of") == last)
    return rows.select("dong", F.col("n_complexes_4q").alias("n_complexes"), F.col("sale_n_valid_4q").alias("sale_n"), F.col("dominant_share_4q").alias("dominant_share"))


def _eligible(spark, d, last):
    return ledger.eligible(valid(spark, d), span(spark, d)[0], last)


def _clusters(matrix, cols, last):
    """(dong, cluster) of every dong of the matrix; null where there are too few dongs."""
    points = cluster.standardized(matrix.withColumn("as_of", F.lit(last)), cols, ["as_of"])
    found = cluster.keyed_kmeans(points, [K], len(cols), starts=STARTS, rounds=ROUNDS)
    return stored(matrix.select("dong").join(found.select("dong", "cluster"), "dong", "left"), "clusters")


def _support(spark, d):
    last = span(spark, d)[1]
    index, features = _features(spark, d, last)
    matrix = support.structure_matrix(features.select("dong", "sgg_cd", *COLS), COLS, "sgg_cd")
    clusters = _clusters(matrix, COLS, last)
    eligible = _eligible(spark, d, last).where(F.col("q") == last).select("dong", "eligible")
    table = support.build_support(index, _concentration(spark, d, last), _weights(spark, d), matrix, clusters, eligible, last, COLS, DESCRIBED)
    return index, features, stored(table, "support")


def _dongs(spark, d):
    return valid(spark, d).select("dong", F.col("sgg_cd").alias("gu_name"), F.col("umd_nm").alias("umd_name")).distinct()


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_NUMBERS = ("dominant_share", "index_se", "change", "mu", "delta", "delta_se", "peak_gap", "peak_gap_se")


@query(f"""{SUPPORT_SQL} SELECT dong, l::INT AS as_of, sale_n, n_complexes, se_band, flags, delta_state, peak_state, structure_type, structure_desc, peers, {", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS)} FROM su, span""")
def support_table(spark, d):
    return _rounded(_support(spark, d)[2], _NUMBERS)


@query(f"""{SUPPORT_SQL}, px AS (SELECT dong, unnest(string_split(peers, '|')) AS x FROM su) SELECT dong, count(*) FILTER (split_part(x, '_', 1) = split_part(dong, '_', 1)) AS same FROM px GROUP BY 1 HAVING same >= 1""")
def same_gu_report(spark, d):
    return support.same_gu_report(_support(spark, d)[2], 1)


@query(f"{SUPPORT_SQL} SELECT 'none' AS rule, dong FROM su WHERE false")
def support_violations(spark, d):
    last = span(spark, d)[1]
    table = _support(spark, d)[2]
    found = support.check_support(table, _weights(spark, d))
    again = quality.recount_concentration(valid(spark, d), last)
    return found.union(support.recount(table, again).select(F.lit("counts are those of the ledger").alias("rule"), "dong"))


def _tag(c, name):
    return f"CASE WHEN {c} > 0 AND {c} >= (SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c} DESC) AS i, count(*) OVER () AS t FROM bs WHERE {c} > 0) WHERE i = ceil(t * 0.3::DOUBLE - 1e-9)) THEN '{name}' END"


@query(f"""{BASE_SQL}{ZONES_SQL}, zc AS (SELECT dong, sum((s1 <= l)::INT + (s2 <= l)::INT + (s3 <= l)::INT) AS zone_count FROM zz, span GROUP BY 1), bs AS (SELECT dg.*, el.n_sales_4q AS index_sales, su.*  EXCLUDE (dong), fq.* EXCLUDE (dong), coalesce(zc.zone_count, 0) AS zone_count FROM dg LEFT JOIN zc USING (dong) JOIN nx USING (dong) JOIN el USING (dong) LEFT JOIN fq USING (dong) LEFT JOIN su USING (dong))
SELECT dong, gu_name, umd_name, coalesce(sale_n, index_sales, 0) AS n_sales_4q, floor(median_ppm2 + 0.5)::BIGINT AS ppm2, coalesce(flags, '') AS flags, se_band, structure_type, structure_desc,
array_to_string([x FOR x IN [CASE WHEN zone_count > 0 THEN '정비사업 정보 있음' END, {_tag("index_sales", "거래 많은 동")}, {_tag("jeonse_ratio", "전세가율 높은 동")}, {_tag("completed_share", "최근 준공 많은 동")}, {_tag("old30_share", "30년 이상 단지 많은 동")}] IF x IS NOT NULL], ',') AS tags,
zone_count::DOUBLE AS sort_zone_count, index_sales::DOUBLE AS sort_index_sales, round(jeonse_ratio, 6) AS sort_jeonse_ratio, round(completed_share, 6) AS sort_completed_share, round(old30_share, 6) AS sort_old30_share FROM bs""")
def dong_list(spark, d):
    """The served list, with the stages that zones have reached."""
    last, _, _, base = _base(spark, d)
    zones = ledger.zone_features(zones_of(spark, d), base.select("dong", F.lit(last).alias("as_of")))
    zones = zones.select("dong", serving.zone_count(F.col("n_s1"), F.col("n_s2"), F.col("n_s3")).alias("zone_count"))
    out = serving.serve_dongs(base.join(zones, "dong", "left").fillna(0, ["zone_count"]))
    return _rounded(out, ("sort_jeonse_ratio", "sort_completed_share", "sort_old30_share"))


def _base(spark, d):
    last = span(spark, d)[1]
    index, features, table = _support(spark, d)
    counts = _eligible(spark, d, last)
    f = features.select("dong", "jeonse_ratio", "completed_share", "completed_8q", "old30_share", "median_ppm2")
    has_index = index.where(F.col("q") == last).select("dong")
    return last, features, table, serving.dong_list_base(_dongs(spark, d).join(has_index, "dong"), counts, f, table.drop("as_of"), last)


@query(f"""{BASE_SQL}, fw AS (SELECT dong, string_agg(q || ':' || a, ',' ORDER BY q) AS flows FROM (SELECT g.dong, g.q, count(v.q) AS a FROM (SELECT dong, unnest(range(l - 7, l + 1)) AS q FROM dg, span) g LEFT JOIN valid v ON v.dong = g.dong AND v.q = g.q GROUP BY 1, 2) GROUP BY 1),
cx AS (SELECT dong, string_agg(apt_seq, ',' ORDER BY deal_date DESC, apt_seq) AS complexes FROM (SELECT dong, apt_seq, deal_date, row_number() OVER (PARTITION BY dong ORDER BY deal_date DESC, apt_seq) AS r FROM (SELECT dong, apt_seq, max(deal_date) AS deal_date FROM valid GROUP BY 1, 2) QUALIFY r <= 50) GROUP BY 1),
ab AS (SELECT dong, CASE WHEN area < 13 THEN 'A' WHEN area < 26 THEN 'B' WHEN area < 39 THEN 'C' ELSE 'D' END AS band, count(*) AS n, floor(median(price) + 0.5)::BIGINT AS m FROM valid WHERE deal_ym >= (SELECT strftime(date_trunc('month', max(deal_date)) - INTERVAL 23 MONTH, '%Y%m') FROM sale) GROUP BY 1, 2), av AS (SELECT dong, string_agg(band || ':' || n || ':' || m, ',' ORDER BY band) AS areas FROM ab GROUP BY 1)
SELECT dong, gu_name, umd_name, coalesce(sale_n, n_sales_4q, 0) AS n_sales_4q, n_complexes, flags, {_pct("change")} AS dong_pct, {_pct("mu")} AS city_pct, CASE WHEN delta_state = 'DISTINGUISHABLE' THEN {_pct("delta")} END AS delta_pct, {_se_pct("delta", "delta_se")} AS delta_se_pct, delta_state,
CASE WHEN peak_state <> 'INDISTINGUISHABLE' THEN {_pct("peak_gap")} END AS peak_gap_pct, {_se_pct("peak_gap", "peak_gap_se")} AS peak_gap_se_pct, peak_state = 'AT_PEAK' AS at_peak, round(jeonse_ratio, 6) AS jeonse_ratio, completed_8q::BIGINT AS completed_8q, structure_desc, peers, flows, areas, complexes
FROM dg JOIN su USING (dong) LEFT JOIN el USING (dong) LEFT JOIN fq USING (dong) LEFT JOIN fw USING (dong) LEFT JOIN av USING (dong) LEFT JOIN cx USING (dong)""")
def dong_detail(spark, d):
    """Details of all dongs at once: sample, change with what doesn't stand out left blank, flows, facts, structure, peers,
    prices by area band over 24 months, complexes."""
    last, features, table, _ = _base(spark, d)
    base = serving.dong_detail_base(_dongs(spark, d), table, _eligible(spark, d, last), features.select("dong", "jeonse_ratio", "completed_8q"), last)
    flows = ledger.flows(valid(spark, d), trade_rent(spark, d), last).groupBy("dong").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "n_sales"))), lambda x: F.concat_ws(":", x["q"], x["n_sales"])), ",").alias("flows"))
    sold = serving.complexes_with_last_sale(valid(spark, d), complexes(spark, d))
    sold = sold.groupBy("dong").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date("deal_date")).alias("t"), "apt_seq"))), lambda x: x["apt_seq"]), ",").alias("complexes"))
    areas = ledger.area_bands(valid(spark, d), serving.area_window(trade_sale(spark, d)))
    areas = areas.groupBy("dong").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "n", scalars.half_up(F.col("median_price")).cast("long").alias("m")))), lambda x: F.concat_ws(":", x["band"], x["n"], x["m"])), ",").alias("areas"))
    rows = base.drop("delta_state").join(serving.suppressed(table), "dong")
    for part in (flows, areas, sold):
        rows = rows.join(part, "dong", "left")
    return rows.select("dong", "gu_name", "umd_name", F.coalesce("sale_n", "index_sales", F.lit(0)).alias("n_sales_4q"), "n_complexes", "flags", "dong_pct", "city_pct", "delta_pct", "delta_se_pct", "delta_state", "peak_gap_pct", "peak_gap_se_pct", "at_peak", F.round("jeonse_ratio", 6).alias("jeonse_ratio"), "completed_8q", "structure_desc", "peers", "flows", "areas", "complexes")


@query(f"""{SUPPORT_SQL}, px AS (SELECT dong, unnest(string_split(peers, '|')) AS x, generate_subscripts(string_split(peers, '|'), 1) AS place FROM su), nm AS (SELECT DISTINCT dong AS peer, sgg_cd AS gu_name, umd_nm AS umd_name FROM valid)
SELECT dong, place, split_part(x, ':', 1) AS peer, gu_name, umd_name, split_part(x, ':', 2) AS reason FROM px JOIN nm ON peer = split_part(x, ':', 1)""")
def named_peers(spark, d):
    return serving.peer_names(support.peer_pairs(_support(spark, d)[2]), _dongs(spark, d))


@query(f""" SELECT floor(max(q) / 4)::INT || 'Q' || (max(q) % 4 + 1) AS as_of_quarter, (SELECT strftime(min(deal_date), '%Y-%m') || ' ~ ' || strftime(max(deal_date), '%Y-%m') FROM sale) AS sale_period,
(SELECT strftime(min(deal_date), '%Y-%m') || ' ~ ' || strftime(max(deal_date), '%Y-%m') FROM rent) AS rent_period, 20.0::DOUBLE AS few_sales, 0.5::DOUBLE AS one_complex_share, 0.032::DOUBLE AS high_index_se, 2.0::DOUBLE AS delta_sigma FROM valid, span WHERE q <= l""")
def meta(spark, d):
    last = span(spark, d)[1]
    return serving.serve_meta(valid(spark, d).where(F.col("q") <= last), trade_sale(spark, d), trade_rent(spark, d))


@query(f"{FEATURES_SQL}, dg AS (SELECT DISTINCT dong, sgg_cd AS gu_name FROM valid) SELECT gu_name, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM dg LEFT JOIN ct USING (dong) GROUP BY 1")
def gu_summary(spark, d):
    last = span(spark, d)[1]
    return _rounded(serving.gu_summary(_dongs(spark, d), serving.dong_centers(valid(spark, d), complexes(spark, d), last - 7)), ("lat", "lng"))


@query(f"""{FEATURES_SQL}, v AS (SELECT floor(median_ppm2 + 0.5)::BIGINT AS p, row_number() OVER (ORDER BY median_ppm2) - 1 AS i, count(*) OVER () AS n FROM pp),
e AS (SELECT min(p) AS e0, max(CASE WHEN i = n // 4 THEN p END) AS e1, max(CASE WHEN i = 2 * n // 4 THEN p END) AS e2, max(CASE WHEN i = 3 * n // 4 THEN p END) AS e3, max(p) AS e4 FROM v WHERE n >= 4)
SELECT unnest([1, 2, 3, 4]) AS band, unnest([e0, e1 + 1, e2 + 1, e3 + 1]) AS low, unnest([e1, e2, e3, e4]) AS high FROM e WHERE e0 IS NOT NULL""")
def price_bands(spark, d):
    last = span(spark, d)[1]
    p = ledger.sale_features(trade_sale(spark, d), valid(spark, d)).where(F.col("as_of") == last).select(scalars.half_up(F.col("median_ppm2_4q")).cast("long").alias("p"))
    return serving.price_bands(p, "p")


@query(f""", g AS (SELECT dong, q FROM (SELECT DISTINCT dong FROM valid), (SELECT unnest(range(f, l + 1)) AS q FROM span)), n AS (SELECT g.dong, g.q, count(v.q) AS k FROM g LEFT JOIN valid v ON v.dong = g.dong AND v.q = g.q GROUP BY 1, 2),
e AS (SELECT q, coalesce(CASE WHEN count(*) OVER w = 4 THEN sum(k) OVER w END >= 20, false) AS ok FROM n WINDOW w AS (PARTITION BY dong ORDER BY q ROWS 3 PRECEDING)) SELECT (q // 4)::INT AS year, count(*) AS dong_quarters, count_if(ok)::BIGINT AS eligible FROM e GROUP BY 1""")
def eligible_by_year(spark, d):
    return ledger.eligible_by_year(_eligible(spark, d, span(spark, d)[1]))


@query(f""", hx AS (SELECT apt_seq, sgg_cd, lpad(cast(l_suppkey AS VARCHAR), 5, '0') AS code, sum(p_size) AS h FROM (SELECT DISTINCT l_suppkey, p_partkey, p_size, apt_seq, sgg_cd FROM joined) GROUP BY 1, 2, 3),
ed AS (SELECT make_date(((l + 1) // 4)::INT, ((l + 1) % 4 * 3 + 1)::INT, 1) AS day FROM span), hb AS (SELECT apt_seq, dong FROM (SELECT apt_seq, dong, count(*) AS n FROM sale, ed WHERE deal_date >= day - 14 AND deal_date < day GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY apt_seq ORDER BY n DESC, dong) = 1),
hv AS (SELECT sgg_cd, code, dong AS voted FROM (SELECT sgg_cd, code, dong, sum(h) AS h FROM hx JOIN hb USING (apt_seq) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY sgg_cd, code ORDER BY h DESC, dong) = 1),
hm AS (SELECT h, coalesce(dong, voted) AS dong FROM hx LEFT JOIN hb USING (apt_seq) LEFT JOIN hv USING (sgg_cd, code)), hw AS (SELECT sum(h)::BIGINT AS households, coalesce(sum(h) FILTER (dong IS NOT NULL), 0)::BIGINT AS mapped FROM hm)
SELECT households, mapped, round(mapped / households, 9) AS coverage, mapped / households >= 0.95 AS enough FROM hw""")
def household_coverage(spark, d):
    """Households of complexes whose dong the last two weeks of complete quarters tell, by trades or by their area code."""
    own, last = complexes(spark, d), span(spark, d)[1]
    end = quarters.first_day(F.lit(last + 1))
    trades = trade_sale(spark, d).where((F.col("deal_date") >= F.date_sub(end, 14)) & (F.col("deal_date") < end))
    return ledger.household_coverage(own, ledger.map_complexes(own, trades)).withColumn("coverage", F.round("coverage", 9))


VINTAGE_SQL = """, vc AS (SELECT cell, sgg_cd, dong, q, count(*) AS n, sum(log_ppm2) AS s FROM valid GROUP BY 1, 2, 3, 4), vs AS (SELECT vc.*, unnest(range(greatest(q, f + 3), l + 1)) AS origin FROM vc, span WHERE q <= l),
vl AS (SELECT cell, origin, sum(s) / sum(n) AS level FROM vs GROUP BY 1, 2), vd AS (SELECT origin, sgg_cd, dong, q, sum(n)::BIGINT AS n_sales, sum(s - n * level) AS r FROM vs JOIN vl USING (cell, origin) GROUP BY 1, 2, 3, 4),
vg AS (SELECT origin, sgg_cd, q, sum(r) / sum(n_sales) AS gu FROM vd GROUP BY 1, 2, 3), vi AS (SELECT vd.origin, sgg_cd, dong, q, n_sales, gu + (r - n_sales * gu) / (n_sales + 5) AS log_index FROM vd JOIN vg USING (origin, sgg_cd, q)),
vw AS (SELECT origin, sgg_cd, dong, sum(CASE WHEN q > origin - 4 THEN n_sales ELSE 0 END)::BIGINT AS n_sales_4q, max(CASE WHEN q = origin THEN log_index END) AS now, {past} FROM vi GROUP BY 1, 2, 3),
vf AS (SELECT origin, sgg_cd, dong, n_sales_4q, n_sales_4q >= 20 AS eligible, {mom} FROM vw WHERE now IS NOT NULL),
vt AS (SELECT b.origin, b.dong, horizon, y.y_rt, e.log_index - s.log_index AS y_full, CASE WHEN b.origin + horizon > (SELECT l FROM span) THEN 'beyond_data' WHEN y.dong IS NULL THEN 'no_vintage_row' WHEN y.y_rt IS NULL THEN 'index_nan' ELSE 'none' END AS reason
  FROM (SELECT * FROM vf, (VALUES (2), (4), (8), (12)) h(horizon) WHERE eligible) b LEFT JOIN (SELECT origin AS at, dong, unnest([2, 4, 8, 12]) AS h, unnest([mom_2, mom_4, mom_8, mom_12]) AS y_rt FROM vf) y ON y.at = b.origin + horizon AND y.dong = b.dong AND y.h = horizon
  LEFT JOIN (SELECT dong, q, log_index FROM vi, span WHERE origin = l) e ON e.dong = b.dong AND e.q = b.origin + horizon LEFT JOIN (SELECT dong, q, log_index FROM vi, span WHERE origin = l) s ON s.dong = b.dong AND s.q = b.origin),
vv AS (SELECT origin, dong, sum(CASE WHEN origin - q < 4 THEN n ELSE 0 END)::BIGINT AS n_now, ln(1 + sum(CASE WHEN origin - q < 4 THEN n ELSE 0 END)) - ln(1 + sum(CASE WHEN origin - q >= 4 THEN n ELSE 0 END)) AS log_change
  FROM (SELECT dong, q, count(*) AS n, unnest(range(q, q + 8)) AS origin FROM valid GROUP BY 1, 2), span WHERE origin BETWEEN f + 3 AND l GROUP BY 1, 2)""".format(
    past=", ".join(f"max(CASE WHEN q = origin - {k} THEN log_index END) AS p{k}" for k in vintage.LAGS), mom=", ".join(f"now - p{k} AS mom_{k}" for k in vintage.LAGS))


def _vintage(spark, d):
    first, last = span(spark, d)
    v = valid(spark, d)
    index = stored(vintage.residual_index(v, first + 3, last), "vintage")
    return first + 3, last, v, index, vintage.vintage_features(index)


@query(f"{VINTAGE_SQL} SELECT origin, dong, q, n_sales, round(log_index, 6) AS log_index FROM vi")
def vintage_residual_index(spark, d):
    return _vintage(spark, d)[3].select("origin", "dong", "q", "n_sales", F.round("log_index", 6).alias("log_index"))


@query(f"""{VINTAGE_SQL} SELECT origin, dong, n_sales_4q, eligible, {", ".join(f"round(mom_{k}, 6) AS mom_{k}, round(mom_{k} - avg(mom_{k}) OVER (PARTITION BY origin, sgg_cd), 6) AS mom_{k}_gu_rel" for k in vintage.LAGS)} FROM vf""")
def vintage_features(spark, d):
    out = _vintage(spark, d)[4].drop("sgg_cd")
    return _rounded(out, [c for c in out.columns if c.startswith("mom")])


@query(f"{VINTAGE_SQL} SELECT origin, dong, horizon, round(y_rt, 6) AS y_rt, round(y_full, 6) AS y_full, reason FROM vt")
def realtime_targets(spark, d):
    _, last, _, index, features = _vintage(spark, d)
    return _rounded(vintage.realtime_targets(features, index.where(F.col("origin") == last), last), ("y_rt", "y_full"))


@query(f"""{VINTAGE_SQL}{EVENT_SQL}, pe AS (SELECT q AS o, score, unnest(range(q, q + 4)) AS origin FROM ev), po AS (SELECT unnest(range(f + 3, l + 1)) AS origin FROM span), pn AS (SELECT po.origin, coalesce(sum(score), 0)::BIGINT AS policy_net FROM po LEFT JOIN pe USING (origin) GROUP BY 1),
mb AS (SELECT origin, count(*) AS n_eligible, coalesce(sum(n_now), 0)::BIGINT AS volume, {", ".join(f"round(avg(mom_{k}), 6) AS m_mom_{k}" for k in vintage.LAGS)} FROM vf LEFT JOIN vv USING (origin, dong) WHERE eligible GROUP BY 1),
pv AS (SELECT origin + 4 AS origin, sum(n_now) AS past FROM vv GROUP BY 1), mt AS (SELECT origin, {", ".join(f"count(y_rt) FILTER (horizon = {h}) AS n_rt_{h}, count(y_full) FILTER (horizon = {h}) AS n_full_{h}, round(avg(y_rt) FILTER (horizon = {h}), 6) AS m_rt_{h}, round(avg(y_full) FILTER (horizon = {h}), 6) AS m_full_{h}" for h in vintage.HORIZONS)} FROM vt GROUP BY 1)
SELECT mb.*, round(ln(1 + volume) - ln(1 + coalesce(past, 0)), 6) AS volume_change, policy_net, mt.* EXCLUDE (origin) FROM mb LEFT JOIN pv USING (origin) JOIN pn USING (origin) LEFT JOIN mt USING (origin)""")
def market_panel(spark, d):
    first, last, v, index, features = _vintage(spark, d)
    targets = vintage.realtime_targets(features, index.where(F.col("origin") == last), last)
    out = vintage.market_panel(features, vintage.valid_volume(v, first, last), vintage.policy_net(events_table(spark), first, last), targets)
    return _rounded(out, [c for c in out.columns if c.startswith("m_") or c == "volume_change"])


@query(f"""{VINTAGE_SQL}, bs AS (SELECT dong, as_of AS origin, avg((age >= 30)::INT) AS old30_share, median(age) AS median_age FROM (SELECT dong, year(deal_date) - build_year AS age, unnest(range(q, q + 4)) AS as_of FROM sale) GROUP BY 1, 2),
bp AS (SELECT dong, as_of AS origin, median(p) AS median_ppm2 FROM (SELECT dong, price / area AS p, unnest(range(q, q + 4)) AS as_of FROM valid) GROUP BY 1, 2),
br AS (SELECT dong, as_of AS origin, count(*) AS rent_n, avg((monthly = 0)::INT) AS jeonse_share, median(CASE WHEN area > 0 AND deposit > 0 AND monthly = 0 THEN deposit / area END) AS jp FROM (SELECT *, unnest(range(q, q + 4)) AS as_of FROM rent) GROUP BY 1, 2),
bb AS (SELECT bp.origin, bp.dong, median_ppm2, jp / median_ppm2 AS jeonse_ratio, old30_share, median_age, br.jeonse_share, ln(1 + br.rent_n) - ln(1 + pr.rent_n) AS rent_n_log_change FROM bp LEFT JOIN bs USING (origin, dong) LEFT JOIN br USING (origin, dong) LEFT JOIN (SELECT origin + 4 AS origin, dong, rent_n FROM br) pr USING (origin, dong)),
gr AS (SELECT origin, dong, mom_2 - avg(mom_2) OVER (PARTITION BY origin, sgg_cd) AS mom_2_gu_rel, mom_8 - avg(mom_8) OVER (PARTITION BY origin, sgg_cd) AS mom_8_gu_rel FROM vf),
rr AS (SELECT * FROM vf LEFT JOIN vv USING (origin, dong) LEFT JOIN bb USING (origin, dong) JOIN gr USING (origin, dong) WHERE eligible)
SELECT origin, dong, {", ".join(f"round(mom_{k} - avg(mom_{k}) OVER (PARTITION BY origin), 6) AS mom_{k}_rel" for k in (1, 4, 12))},
round(CASE WHEN median_ppm2 IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY origin, median_ppm2 IS NOT NULL ORDER BY median_ppm2) + (count(*) OVER (PARTITION BY origin, median_ppm2) - 1) / 2) / count(median_ppm2) OVER (PARTITION BY origin) END, 6) AS price_rank,
round(coalesce(jeonse_ratio - median(jeonse_ratio) OVER (PARTITION BY origin), 0), 6) AS jeonse_ratio_rel, round(log_change - avg(log_change) OVER (PARTITION BY origin), 6) AS volume_rel, round(old30_share, 6) AS old30_share, median_age, round(jeonse_share, 6) AS jeonse_share,
round(rent_n_log_change, 6) AS rent_n_log_change, round(mom_2_gu_rel, 6) AS mom_2_gu_rel, round(mom_8_gu_rel, 6) AS mom_8_gu_rel FROM rr""")
def relative_features(spark, d):
    """The twelve relative features of every origin's eligible dongs."""
    first, last, v, _, features = _vintage(spark, d)
    sale = ledger.sale_features(trade_sale(spark, d), v).where("median_ppm2_4q is not null")
    rent = ledger.rent_features(trade_rent(spark, d))
    past = rent.select("dong", (F.col("as_of") + 4).alias("as_of"), F.col("rent_n_4q").alias("past"))
    rows = sale.join(rent, ["dong", "as_of"], "left").join(past, ["dong", "as_of"], "left")
    blocks = rows.select(F.col("as_of").alias("origin"), "dong", F.col("median_ppm2_4q").alias("median_ppm2"), F.try_divide("jeonse_ppm2_4q", "median_ppm2_4q").alias("jeonse_ratio"), F.col("old30_share_4q").alias("old30_share"), F.col("median_age_4q").alias("median_age"), F.col("jeonse_share_4q").alias("jeonse_share"), (F.log1p("rent_n_4q") - F.log1p("past")).alias("rent_n_log_change"))
    out = vintage.relative_features(features, vintage.valid_volume(v, first, last), blocks)
    return _rounded(out, [c for c in out.columns if c not in ("origin", "dong", "median_age")])


OOT_SQL = f"""{VINTAGE_SQL}, ot AS (SELECT vt.origin, vt.dong, horizon, y_full AS y, CASE horizon {" ".join(f"WHEN {h} THEN mom_{h}" for h in vintage.HORIZONS)} END AS b1 FROM vt JOIN vf USING (origin, dong) WHERE eligible),
ob AS (SELECT *, avg(b1) OVER (PARTITION BY horizon, origin) AS b2 FROM ot), oc AS (SELECT *, avg(y) OVER (PARTITION BY horizon, origin) AS oracle FROM ob WHERE y IS NOT NULL),
od AS (SELECT *, min(origin) OVER (PARTITION BY horizon) AS f0 FROM oc), oe AS (SELECT * FROM od WHERE origin - horizon >= f0 AND b1 IS NOT NULL)"""


def _oot(spark, d, horizons=vintage.HORIZONS):
    """(h, q, dong, y, b1, b2, features) of eligible rows: y on the last vintage, own momentum and its mean over the origin."""
    _, last, _, index, features = _vintage(spark, d)
    targets = vintage.realtime_targets(features, index.where(F.col("origin") == last), last, horizons).select("origin", "dong", F.col("horizon").alias("h"), F.col("y_full").alias("y"))
    own = F.coalesce(*[F.when(F.col("h") == h, F.col(f"mom_{h}")) for h in horizons])
    rows = targets.join(features.where("eligible"), ["origin", "dong"]).withColumn("b1", own).withColumnRenamed("origin", "q")
    by = Window.partitionBy("h", "q")
    return stored(rows.withColumn("b2", F.avg("b1").over(by)).withColumn("oracle", F.when(F.col("y").isNotNull(), F.avg("y").over(by))), "oot")


def _scored(rows):
    """Rows with a target and own momentum at origins that have rows to learn from."""
    first = rows.where("y is not null").groupBy("h").agg(F.min("q").alias("f0"))
    return rows.where("y is not null and b1 is not null").join(F.broadcast(first), "h").where(F.col("q") - F.col("h") >= F.col("f0")).drop("f0")  # one row for each horizon


OOT_FEATURES = (*[f"mom_{k}" for k in vintage.LAGS], *[f"mom_{k}_gu_rel" for k in vintage.LAGS], "n_sales_4q")


@query(f"""{OOT_SQL} SELECT horizon AS h, origin AS q, count(*) AS n, round(avg(abs(y)), 6) AS mae_b0, round(avg(abs(y - b1)), 6) AS mae_b1, round(avg(abs(y - b2)), 6) AS mae_b2, round(avg(abs(y - oracle)), 6) AS mae_oracle FROM oe GROUP BY 1, 2""")
def oot_baselines(spark, d):
    """Errors of no change, own momentum, its mean and the mean that came, by horizon and origin."""
    err = lambda p, to: F.round(F.avg(F.abs(F.col("y") - p)), 6).alias(f"mae_{to}")
    return _scored(_oot(spark, d)).groupBy("h", "q").agg(F.count(F.lit(1)).alias("n"), err(F.lit(0.0), "b0"), err(F.col("b1"), "b1"), err(F.col("b2"), "b2"), err(F.col("oracle"), "oracle"))


@query()
def rolling_boosted(spark, d):
    """Boosted trees for every horizon and origin, on targets known then, beside the baselines: mean errors by horizon."""
    rows = _oot(spark, d)
    got = forecast.rolling_boosted(rows.where("b1 is not null"), OOT_FEATURES).join(_scored(rows), ["h", "q", "dong"])
    err = lambda c: F.avg(F.abs(F.col("y") - F.col(c))).alias(f"mae_{c}")
    return got.withColumn("b0", F.lit(0.0)).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("q").alias("origins"), *[err(c) for c in ("pred", "b0", "b1", "b2", "oracle")], F.max(F.col("label_vintage") - F.col("q")).alias("latest_label"))


@query()
def relative_boosted(spark, d):
    """R2: trees under absolute loss on a dong's change less its origin's mean, centred by origin; from 4 origins and 200 rows on
    (the survey's 8 and 1,500 are the defaults of a ledger of 20 years), and 0 before."""
    rows = _oot(spark, d, (4,))
    r = rows.withColumn("r", F.col("y") - F.col("oracle"))
    got = forecast.rolling_boosted(r, OOT_FEATURES, "r", 4, 200, "absolute")
    out = r.join(got, ["h", "q", "dong"], "left").withColumn("status", F.when(F.col("pred").isNull(), "insufficient_train").otherwise("ok"))
    raw = F.coalesce("pred", F.lit(0.0))
    return out.select("q", "dong", "r", (raw - F.avg(raw).over(Window.partitionBy("q"))).alias("centered"), "status", "label_vintage")
