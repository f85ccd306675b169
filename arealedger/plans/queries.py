"""Registered queries of the ledger operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quarters, scalars
from ..operators import geometry, hedonic, ledger, panel, quality, serving, windows
from ..sources import files
from ..sources.adapter import SALE_SQL, completions, complexes, span, table, trade_rent, trade_sale
from ..sources.store import stored

#: The last complete quarter, and quarters as a table, in the SQL.
LAST = "(SELECT l FROM span)"
ALL_Q = "(SELECT unnest(range(f, l + 1)) AS q FROM span)"
LAST_8Q = "(SELECT unnest(range(l - 7, l + 1)) AS q FROM span)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Dated events, policy rates and designation changes used with the given tables.
EVENTS = ((1, "E1", "1996-02-15", 1), (2, "E2", "1997-11-21", -1), (3, "E3", "1998-06-01", 1), (4, "E4", "1999-01-10", 1), (5, "E5", "2000-03-15", -1), (6, "E6", "2001-05-20", 1))
RATES = (("1995-01-01", 5.0), ("1996-03-05", 4.75), ("1997-12-20", 6.5), ("1998-09-30", 5.5), ("1999-05-05", 4.75), ("2000-10-05", 5.25), ("2001-02-08", 5.0), ("2001-07-05", 4.75))
DESIGNATIONS = (("1995-06-01", "1,2,3"), ("1997-01-15", "1,2,3,7,11"), ("1999-08-01", "2,11"), ("2001-01-10", "2,11,15,20"))


def query(sql: str | None = None, ledgers: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {SALE_SQL}{sql}" if ledgers else sql
        return f

    return add


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


def valid(spark: SparkSession, d: str) -> DataFrame:
    return ledger.valid_sales(trade_sale(spark, d))


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The mean index, written once for the several reads of it that shifts and joins make."""
    return stored(panel.mean_index(valid(spark, d)), "index")


def events_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(EVENTS), "pos int, event_id string, date string, score int")
    return rows.withColumn("q", quarters.quarter_ord(F.to_date("date")))


EVENT_SQL = f", ev AS (SELECT pos, event_id, score, year(cast(d AS DATE)) * 4 + quarter(cast(d AS DATE)) - 1 AS q FROM (VALUES {values(EVENTS)}) t(pos, event_id, d, score))"
INDEX_SQL = """, gm AS (SELECT sgg_cd, q, avg(log_ppm2) AS gu_mean FROM valid GROUP BY 1, 2),
dm AS (SELECT sgg_cd, dong, q, count(*) AS n_sales, avg(log_ppm2) AS mean FROM valid GROUP BY 1, 2, 3),
idx AS (SELECT dong, sgg_cd, q, n_sales, (mean - gu_mean) * n_sales / (n_sales + 5) AS dq_effect, gu_mean + (mean - gu_mean) * n_sales / (n_sales + 5) AS log_index FROM dm JOIN gm USING (sgg_cd, q))"""


@query(" SELECT dong, q, count(*) AS n_sales, round(avg(log_ppm2), 6) AS mean_log_ppm2, count(DISTINCT cell) AS cells FROM valid GROUP BY 1, 2")
def sales_by_quarter(spark, d):
    return valid(spark, d).groupBy("dong", "q").agg(F.count(F.lit(1)).alias("n_sales"), F.round(F.avg("log_ppm2"), 6).alias("mean_log_ppm2"), F.count_distinct("cell").alias("cells"))


@query(f""", g AS (SELECT dong, q FROM (SELECT DISTINCT dong FROM valid), {ALL_Q} r),
c AS (SELECT dong, q, count(*) AS n FROM valid GROUP BY 1, 2), f AS (SELECT dong, q, coalesce(n, 0) AS n_sales FROM g LEFT JOIN c USING (dong, q))
SELECT dong, q, n_sales, CASE WHEN count(*) OVER w = 4 THEN cast(sum(n_sales) OVER w AS BIGINT) END AS n_sales_4q,
coalesce(CASE WHEN count(*) OVER w = 4 THEN sum(n_sales) OVER w END >= 20, false) AS eligible
FROM f WINDOW w AS (PARTITION BY dong ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def eligibility(spark, d):
    first, last = span(spark, d)
    return ledger.eligible(valid(spark, d), first, last)


@query(""", r AS (SELECT dong, unnest(range(q, q + 4)) AS as_of, is_cancelled, year(deal_date) - build_year AS age FROM sale),
a AS (SELECT dong, as_of, count(*) AS sale_n_all_4q, round(avg(is_cancelled::INT), 6) AS cancel_share_4q, median(age) AS median_age_4q, round(avg((age >= 30)::INT), 6) AS old30_share_4q FROM r GROUP BY 1, 2),
p AS (SELECT dong, unnest(range(q, q + 4)) AS as_of, price / area AS ppm2 FROM valid),
b AS (SELECT dong, as_of, count(*) AS sale_n_valid_4q, round(median(ppm2), 3) AS median_ppm2_4q FROM p GROUP BY 1, 2) SELECT * FROM a LEFT JOIN b USING (dong, as_of)""")
def sale_features(spark, d):
    out = ledger.sale_features(trade_sale(spark, d), valid(spark, d))
    return out.select("dong", "as_of", "sale_n_all_4q", F.round("cancel_share_4q", 6).alias("cancel_share_4q"), "median_age_4q", F.round("old30_share_4q", 6).alias("old30_share_4q"), "sale_n_valid_4q", F.round("median_ppm2_4q", 3).alias("median_ppm2_4q"))


@query(""", r AS (SELECT dong, unnest(range(q, q + 4)) AS as_of, monthly = 0 AS j, CASE WHEN area > 0 AND deposit > 0 AND monthly = 0 THEN deposit / area END AS p FROM rent)
SELECT dong, as_of, count(*) AS rent_n_4q, round(avg(j::INT), 6) AS jeonse_share_4q, round(median(p), 3) AS jeonse_ppm2_4q FROM r GROUP BY 1, 2""")
def rent_features(spark, d):
    return ledger.rent_features(trade_rent(spark, d)).select("dong", "as_of", "rent_n_4q", F.round("jeonse_share_4q", 6).alias("jeonse_share_4q"), F.round("jeonse_ppm2_4q", 3).alias("jeonse_ppm2_4q"))


@query(""", c AS (SELECT dong, apt_seq, unnest(range(q, q + 4)) AS as_of FROM valid), e AS (SELECT dong, as_of, apt_seq, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT dong, as_of, count(*) AS n_complexes_4q, cast(sum(n) AS BIGINT) AS sale_n_valid_4q, round(max(n) / sum(n), 6) AS dominant_share_4q FROM e GROUP BY 1, 2""")
def complex_concentration(spark, d):
    return ledger.complex_concentration(valid(spark, d)).withColumn("dominant_share_4q", F.round("dominant_share_4q", 6))


@query(f""", c AS (SELECT dong, apt_seq, count(*) AS n FROM valid WHERE q BETWEEN {LAST} - 3 AND {LAST} GROUP BY 1, 2), s AS (SELECT dong, sum(n) AS n, max(n) / sum(n) AS share FROM c GROUP BY 1)
SELECT dong, array_to_string([x FOR x IN [CASE WHEN n < 20 THEN 'FEW_SALES' END, CASE WHEN share > 0.5 THEN 'ONE_COMPLEX_DOMINATES' END] IF x IS NOT NULL], ';') AS flags FROM s""")
def sample_flags(spark, d):
    last = span(spark, d)[1]
    rows = ledger.complex_concentration(valid(spark, d)).where(F.col("as_of") == last)
    return rows.select("dong", F.array_join(scalars.sample_flags(F.col("sale_n_valid_4q"), F.col("dominant_share_4q")), ";").alias("flags"))


@query(f""", b AS (SELECT dong, q, sum(l_linenumber) AS h FROM joined WHERE l_returnflag = 'A' GROUP BY 1, 2), g AS (SELECT dong, q FROM (SELECT DISTINCT dong FROM b), {ALL_Q} r),
f AS (SELECT dong, q, coalesce(h, 0) AS households FROM g LEFT JOIN b USING (dong, q))
SELECT dong, q, cast(households AS BIGINT) AS households, cast(sum(households) OVER (PARTITION BY dong ORDER BY q ROWS 3 PRECEDING) AS BIGINT) AS households_4q,
cast(sum(households) OVER (PARTITION BY dong ORDER BY q ROWS 7 PRECEDING) AS BIGINT) AS households_8q, cast(sum(households) OVER (PARTITION BY dong ORDER BY q ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock FROM f""")
def supply_features(spark, d):
    first, last = span(spark, d)
    return ledger.supply_features(completions(spark, d), first, last)


#: What is declared of some given tables: the ledger has no key, and one column and one table that don't exist are asked for.
CATALOGUE = {
    "nation": {"columns": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "key": ["n_nationkey"], "references": [(["n_regionkey"], "region", ["r_regionkey"])]},
    "region": {"columns": {"r_regionkey": "int", "r_name": "string", "r_code": "string"}, "key": ["r_regionkey"]},
    "supplier": {"columns": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}, "key": ["s_suppkey"], "references": [(["s_nationkey"], "nation", ["n_nationkey"])], "checks": {"no debt": "s_acctbal >= 0"}},
    "lineitem": {"columns": {}, "required": ["l_shipdate", "l_quantity"], "key": ["l_orderkey", "l_linenumber"], "references": [(["l_suppkey"], "supplier", ["s_suppkey"]), (["l_orderkey"], "orders", ["o_orderkey"])], "checks": {"small discount": "l_discount < 0.08", "some quantity": "l_quantity > 0"}},
    "permits": {"columns": {}},
}


@query("""WITH have AS (SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'supplier', 'lineitem', 'orders')),
want(t, c) AS (VALUES ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey'), ('region', 'r_regionkey'), ('region', 'r_name'), ('region', 'r_code'), ('supplier', 's_suppkey'), ('supplier', 's_name'), ('supplier', 's_nationkey'), ('supplier', 's_acctbal')),
x AS (SELECT 'permits' AS "table", 'table' AS kind, 'permits' AS name, 'missing' AS issue, 1::BIGINT AS n UNION ALL SELECT 'orders', 'table', 'orders', 'unexpected', 1
UNION ALL SELECT t, 'column', c, 'missing', 1 FROM want ANTI JOIN have USING (t, c) UNION ALL SELECT t, 'column', c, 'unexpected', 1 FROM have ANTI JOIN want USING (t, c) WHERE t <> 'orders'
UNION ALL SELECT 'nation', 'key', 'n_nationkey', 'repeated', count(*) - count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'region', 'key', 'r_regionkey', 'repeated', count(*) - count(DISTINCT r_regionkey) FROM region
UNION ALL SELECT 'supplier', 'key', 's_suppkey', 'repeated', count(*) - count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 'lineitem', 'key', 'l_orderkey,l_linenumber', 'repeated', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'nation', 'reference', 'n_regionkey -> region', 'orphaned', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'supplier', 'reference', 's_nationkey -> nation', 'orphaned', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'lineitem', 'reference', 'l_suppkey -> supplier', 'orphaned', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'lineitem', 'reference', 'l_orderkey -> orders', 'orphaned', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'supplier', 'check', 'no debt', 'violated', count_if(s_acctbal < 0) FROM supplier UNION ALL SELECT 'lineitem', 'check', 'small discount', 'violated', count_if(l_discount >= 0.08) FROM lineitem UNION ALL SELECT 'lineitem', 'check', 'some quantity', 'violated', count_if(l_quantity <= 0) FROM lineitem
UNION ALL SELECT 'lineitem', 'required', c, 'null', n FROM (SELECT count(*) - count(l_shipdate) AS l_shipdate, count(*) - count(l_quantity) AS l_quantity FROM lineitem) UNPIVOT (n FOR c IN (l_shipdate, l_quantity)))
SELECT * FROM x WHERE n > 0""", ledgers=False)
def schema_issues(spark, d):
    """What given tables lack or have beyond a declaration, keys, references and checks included."""
    return quality.schema_report({t: table(spark, d, t) for t in ("nation", "region", "supplier", "lineitem", "orders")}, CATALOGUE)


ZONES_SQL = """, zn AS (SELECT count(*) AS n FROM supplier), zo AS (SELECT o_custkey, min(cast(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1),
zd AS (SELECT s_nationkey || '_S' || s_suppkey AS dong, cast(c_custkey % 100 AS BIGINT) AS households, zo.f, zo.f + 180 AS f2, zo.f + 720 AS f3 FROM customer JOIN zo ON o_custkey = c_custkey, zn JOIN supplier ON s_suppkey = c_custkey % zn.n),
zz AS (SELECT dong, households, year(f) * 4 + quarter(f) - 1 AS s1, year(f2) * 4 + quarter(f2) - 1 AS s2, year(f3) * 4 + quarter(f3) - 1 AS s3 FROM zd)"""


def zones_of(spark, d):
    """(dong, households, s1, s2, s3): zones with the quarters in which they reach their stages."""
    s = table(spark, d, "supplier")
    n = s.agg(F.count(F.lit(1)).alias("_n"))
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("f"))
    c = table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).crossJoin(F.broadcast(n)).withColumn("k", F.col("c_custkey") % F.col("_n"))
    return c.join(s, F.col("k") == F.col("s_suppkey")).select(F.concat(F.col("s_nationkey").cast("string"), F.lit("_S"), F.col("s_suppkey").cast("string")).alias("dong"), (F.col("c_custkey") % 100).alias("households"), *[quarters.quarter_ord(F.date_add("f", 180 * k)).alias(a) for a, k in (("s1", 0), ("s2", 1), ("s3", 4))])


@query(f"""{ZONES_SQL}, k AS (SELECT dong, as_of FROM (SELECT DISTINCT dong FROM valid), (SELECT q AS as_of FROM {LAST_8Q}) r)
SELECT dong, as_of, count_if(s1 <= as_of)::BIGINT AS n_s1, count_if(s2 <= as_of)::BIGINT AS n_s2, count_if(s3 <= as_of)::BIGINT AS n_s3, cast(sum(CASE WHEN s1 <= as_of AND NOT s3 <= as_of THEN households ELSE 0 END) AS BIGINT) AS active_households,
cast(sum((s1 <= as_of AND s1 > as_of - 4)::INT + (s2 <= as_of AND s2 > as_of - 4)::INT + (s3 <= as_of AND s3 > as_of - 4)::INT) AS BIGINT) AS events_4q FROM k JOIN zz USING (dong) GROUP BY 1, 2""")
def zone_features(spark, d):
    last = span(spark, d)[1]
    origins = windows.grid(valid(spark, d).select("dong").distinct(), last - 7, last, "as_of")
    return ledger.zone_features(zones_of(spark, d), origins)


@query(f""", qs AS (SELECT DISTINCT q FROM sale), e AS (SELECT q, (make_date(((q + 1) // 4)::INT, ((q + 1) % 4 * 3 + 1)::INT, 1) - INTERVAL 1 DAY)::DATE AS day FROM qs),
rt AS (SELECT cast(a AS DATE) AS d, b AS rate FROM (VALUES {values(RATES)}) t(a, b)), j AS (SELECT q, day, rate FROM e ASOF LEFT JOIN rt ON e.day >= rt.d)
SELECT q, day, cast(rate AS DOUBLE) AS rate, round(cast(rate - lag(rate, 4) OVER (ORDER BY q) AS DOUBLE), 6) AS change_4q FROM j""")
def base_rate_asof(spark, d):
    q = trade_sale(spark, d).select("q").distinct()
    days = q.withColumn("day", F.date_sub(F.make_date(F.floor((F.col("q") + 1) / 4).cast("int"), ((F.col("q") + 1) % 4 * 3 + 1).cast("int"), F.lit(1)), 1)).withColumn("one", F.lit(1))
    rates = spark.createDataFrame(list(RATES), "d string, rate double").select(F.to_date("d").alias("d"), "rate", F.lit(1).alias("one"))
    out = windows.asof_join(days, rates, "day", "d", ["one"], ["rate"])
    return out.select("q", "day", "rate", F.round(windows.lag_diff("rate", ["one"], "q", 4), 6).alias("change_4q"))


@query(f""", qs AS (SELECT DISTINCT q FROM sale), gs AS (SELECT DISTINCT sgg_cd FROM sale), e AS (SELECT q, make_date(((q + 1) // 4)::INT, ((q + 1) % 4 * 3 + 1)::INT, 1) AS after FROM qs),
ch AS (SELECT cast(a AS DATE) AS d, b AS gus FROM (VALUES {values(DESIGNATIONS)}) t(a, b)), l AS (SELECT q, max_by(gus, d) AS gus FROM e JOIN ch ON d < after GROUP BY q)
SELECT q, sgg_cd, coalesce(list_contains(string_split(gus, ','), sgg_cd), false) AS designated FROM qs CROSS JOIN gs LEFT JOIN l USING (q)""")
def regulation_state(spark, d):
    sale = trade_sale(spark, d)
    q = sale.select("q").distinct().withColumn("after", F.make_date(F.floor((F.col("q") + 1) / 4).cast("int"), ((F.col("q") + 1) % 4 * 3 + 1).cast("int"), F.lit(1))).withColumn("one", F.lit(1))
    changes = spark.createDataFrame(list(DESIGNATIONS), "d string, gus string").select(F.date_add(F.to_date("d"), 1).alias("d"), F.split("gus", ",").alias("gus"), F.lit(1).alias("one"))
    state = windows.asof_join(q, changes, "after", "d", ["one"], ["gus"])
    return state.crossJoin(F.broadcast(sale.select("sgg_cd").distinct())).select("q", "sgg_cd", F.coalesce(F.array_contains("gus", F.col("sgg_cd")), F.lit(False)).alias("designated"))


@query(f"{INDEX_SQL} SELECT dong, q, n_sales, round(dq_effect, 6) AS dq_effect, round(log_index, 6) AS log_index FROM idx")
def mean_index(spark, d):
    return panel.mean_index(valid(spark, d)).select("dong", "q", "n_sales", F.round("dq_effect", 6).alias("dq_effect"), F.round("log_index", 6).alias("log_index"))


@query(f"""{INDEX_SQL}, t AS (SELECT i.dong, i.q, a.log_index - i.log_index AS y, i.log_index - b.log_index AS b1 FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 4 JOIN idx b ON b.dong = i.dong AND b.q = i.q - 4),
u AS (SELECT *, avg(b1) OVER (PARTITION BY q) AS b2 FROM t) SELECT q, count(*) AS n, round(avg(abs(y)), 6) AS mae_b0, round(avg(abs(y - b1)), 6) AS mae_b1, round(avg(abs(y - b2)), 6) AS mae_b2 FROM u GROUP BY q""")
def rolling_baselines(spark, d):
    out = panel.mae_by_origin(panel.baselines(panel.with_targets(stored_index(spark, d), 4)))
    return out.select("q", "n", *[F.round(c, 6).alias(c) for c in ("mae_b0", "mae_b1", "mae_b2")])


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    step = "lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {step})), 4294967295)"


CONFORMAL_SQL = f"""{INDEX_SQL}, fo AS (SELECT dong, ({crc32_sql('dong')} % 2)::INT AS fold FROM (SELECT DISTINCT dong FROM valid)),
t AS (SELECT i.dong, i.q, a.log_index - i.log_index AS y, i.log_index - b.log_index AS b1 FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 2 JOIN idx b ON b.dong = i.dong AND b.q = i.q - 2),
u AS (SELECT dong, q, fold, abs(y - avg(b1) OVER (PARTITION BY q)) AS err FROM t JOIN fo USING (dong)),
k AS (SELECT a.q, a.fold, err, row_number() OVER w AS r, count(*) OVER (PARTITION BY a.q, a.fold) AS n FROM (SELECT DISTINCT q, fold FROM u) a JOIN u ON u.q + 2 <= a.q AND u.fold <> a.fold WINDOW w AS (PARTITION BY a.q, a.fold ORDER BY err)),
h AS (SELECT q, fold, err AS half, n AS n_cal FROM k WHERE n >= 200 AND r = least(ceil((n + 1) * 0.8::DOUBLE - 1e-9), n))"""


@query(f"{CONFORMAL_SQL} SELECT dong, q, fold, n_cal, round(half, 6) AS half, err <= half AS covered FROM u JOIN h USING (q, fold)")
def conformal_intervals(spark, d):
    return _intervals(spark, d).withColumn("half", F.round("half", 6))


@query(f"{CONFORMAL_SQL} SELECT (q // 4)::INT AS year, count(*) AS n, round(avg((err <= half)::INT), 6) AS coverage, round(median(2 * half), 6) AS width FROM u JOIN h USING (q, fold) GROUP BY 1")
def interval_coverage(spark, d):
    return panel.interval_coverage(_intervals(spark, d)).withColumn("coverage", F.round("coverage", 6)).withColumn("width", F.round("width", 6))


def _intervals(spark, d):
    rows = panel.baselines(panel.with_targets(stored_index(spark, d), 2)).withColumnRenamed("b2", "pred")
    return panel.conformal_intervals(stored(rows, "baselines"), 2)


@query(f"""{INDEX_SQL}, t AS (SELECT i.q, a.log_index - i.log_index AS y, i.log_index - b.log_index AS x FROM idx i JOIN idx a ON a.dong = i.dong AND a.q = i.q + 4 JOIN idx b ON b.dong = i.dong AND b.q = i.q - 4),
e AS (SELECT gamma, q, avg(abs(y - gamma * x)) AS mae FROM t, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(gamma) GROUP BY 1, 2), w AS (SELECT cast(gamma AS DOUBLE) AS gamma, round(avg(mae), 10) AS m FROM e GROUP BY 1)
SELECT gamma, round(m, 6) AS mae, row_number() OVER (ORDER BY m, gamma) = 1 AS chosen FROM w""")
def gamma_choice(spark, d):
    rows = panel.baselines(panel.with_targets(stored_index(spark, d), 4)).withColumnRenamed("b1", "x")
    return panel.choose_gamma(rows).withColumn("mae", F.round("mae", 6))


@query(""", r AS (SELECT cell, dong, q, lag(q) OVER w AS q0, log_ppm2 - lag(log_ppm2) OVER w AS change FROM valid WINDOW w AS (PARTITION BY cell ORDER BY q, deal_date, order_no, log_ppm2))
SELECT dong, q0, q, count(*) AS pairs, round(sum(change), 5) AS change FROM r WHERE q0 IS NOT NULL AND q0 <> q GROUP BY 1, 2, 3""")
def repeat_pairs(spark, d):
    return ledger.repeat_pairs(valid(spark, d)).groupBy("dong", "q0", "q").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("change"), 5).alias("change"))


@query(f"""{INDEX_SQL}, hs AS (SELECT dong, sum(p_size) AS w FROM (SELECT DISTINCT dong, p_partkey, p_size FROM joined) GROUP BY 1), c AS (SELECT a.dong, a.log_index - b.log_index AS change, w FROM idx a JOIN idx b ON a.dong = b.dong AND b.q = a.q - 4 JOIN hs ON hs.dong = a.dong WHERE a.q = {LAST}),
m AS (SELECT sum(change * w) / sum(w) AS mu FROM c) SELECT dong, round(change, 6) AS change, round(mu, 6) AS mu, round(change - mu, 6) AS delta FROM c, m""")
def change_block(spark, d):
    last = span(spark, d)[1]
    cx = ledger.map_complexes(complexes(spark, d), trade_sale(spark, d)).groupBy("dong").agg(F.sum("households").alias("w"))
    out = panel.change_block(stored_index(spark, d), cx, last)
    return out.select("dong", *[F.round(c, 6).alias(c) for c in ("change", "mu", "delta")])


@query(f"""{EVENT_SQL} SELECT a.event_id, coalesce(string_agg(b.event_id, ',' ORDER BY b.pos), '') AS overlaps, any_value(n) AS n_sales FROM ev a LEFT JOIN ev b ON abs(a.q - b.q) <= 4 AND a.event_id <> b.event_id
LEFT JOIN (SELECT q, count(*) AS n FROM valid GROUP BY q) v ON v.q = a.q GROUP BY a.event_id""")
def overlapping_events(spark, d):
    e = events_table(spark)
    n = valid(spark, d).groupBy("q").agg(F.count(F.lit(1)).alias("n_sales"))
    return panel.overlapping_events(e).join(e.select("event_id", "q"), "event_id").join(n, "q", "left").select("event_id", "overlaps", "n_sales")


@query(f"""{INDEX_SQL}{EVENT_SQL}, r AS (SELECT event_id, q AS q0, unnest(range(-4, 5)) AS k FROM ev), p AS (SELECT r.event_id, i.dong, k, i.log_index - b.log_index AS path FROM r JOIN idx i ON i.q = q0 + k JOIN idx b ON b.dong = i.dong AND b.q = q0 - 1)
SELECT event_id, k, count(*) AS n, round(avg(path), 6) AS mean, round(median(path), 6) AS median, round(quantile_cont(path, 0.1), 6) AS p10, round(quantile_cont(path, 0.9), 6) AS p90, round(avg((path > 0)::INT), 6) AS share_up,
CASE WHEN round(avg(path), 12) <> 0 THEN round(CASE WHEN avg(path) > 0 THEN avg((path > 0)::INT) ELSE avg((path < 0)::INT) END, 6) END AS same_direction FROM p GROUP BY 1, 2""")
def event_study(spark, d):
    out = panel.event_summary(stored(panel.event_paths(stored_index(spark, d), events_table(spark)), "paths"))
    return out.select("event_id", "k", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90", "share_up", "same_direction")])


# Events that the ledger doesn't reach, or only in part.
FAR_EVENTS = ((7, "E7", "1990-01-01", 1), (8, "E8", "1995-01-15", -1), (9, "E9", "2001-08-01", 1), (10, "E10", "2030-05-01", 1))


@query(f"""{INDEX_SQL}, ev AS (SELECT pos, event_id, score, year(cast(d AS DATE)) * 4 + quarter(cast(d AS DATE)) - 1 AS q FROM (VALUES {values((*EVENTS, *FAR_EVENTS))}) t(pos, event_id, d, score)),
gr AS (SELECT dong, q FROM (SELECT DISTINCT dong FROM valid), {ALL_Q} r), cn AS (SELECT dong, q, count(*) AS n FROM valid GROUP BY 1, 2), el AS (SELECT dong, q, coalesce(CASE WHEN count(*) OVER w = 4 THEN sum(coalesce(n, 0)) OVER w END >= 20, false) AS eligible FROM gr LEFT JOIN cn USING (dong, q) WINDOW w AS (PARTITION BY dong ORDER BY q ROWS 3 PRECEDING)),
ix AS (SELECT idx.dong, idx.q, log_index, eligible FROM idx JOIN el USING (dong, q)), en AS (SELECT min(q) AS f1, max(q) AS l1 FROM ix),
eo AS (SELECT ev.*, array_to_string([x FOR x IN [CASE WHEN NOT q BETWEEN f1 AND l1 THEN '{panel.OUTSIDE_EVENT}' END, CASE WHEN NOT q - 1 BETWEEN f1 AND l1 THEN '{panel.OUTSIDE_BASE}' END] IF x IS NOT NULL], '; ') AS note, q - 5 >= f1 AS pre_observable, q + 3 <= l1 AS post_observable FROM ev, en),
ep AS (SELECT event_id, b.log_index - p.log_index AS pre, a.log_index - b.log_index AS post FROM eo JOIN ix b ON b.q = eo.q - 1 AND b.eligible LEFT JOIN ix p ON p.dong = b.dong AND p.q = eo.q - 5 LEFT JOIN ix a ON a.dong = b.dong AND a.q = eo.q + 3 WHERE note = ''),
es AS (SELECT event_id, count(*) AS n_dongs, count(post) AS n_post, avg(pre) AS pre_change, avg(post) AS post_change, median(post) AS post_median, quantile_cont(post, 0.1) AS post_p10, quantile_cont(post, 0.9) AS post_p90, avg((post > 0)::INT) AS up, avg((post < 0)::INT) AS down FROM ep GROUP BY 1),
ol AS (SELECT a.event_id, coalesce(string_agg(b.event_id, ',' ORDER BY b.pos), '') AS overlaps FROM ev a LEFT JOIN ev b ON abs(a.q - b.q) <= 4 AND a.event_id <> b.event_id GROUP BY 1)
SELECT event_id, q, coalesce(n_dongs, 0) AS n_dongs, CASE WHEN post_observable THEN coalesce(n_post, 0) ELSE 0 END AS n_post, CASE WHEN pre_observable THEN round(pre_change, 6) END AS pre_change, {", ".join(f"CASE WHEN post_observable THEN round({c}, 6) END AS {c}" for c in ("post_change", "post_median", "post_p10", "post_p90"))},
CASE WHEN post_observable THEN round(up, 6) END AS share_up, CASE WHEN post_observable THEN round(CASE WHEN round(post_change, 12) > 0 THEN up WHEN round(post_change, 12) < 0 THEN down END, 6) END AS same_direction, pre_observable, post_observable, "overlaps", note FROM eo LEFT JOIN es USING (event_id) JOIN ol USING (event_id)""")
def event_outcomes(spark, d):
    """Each event's changes before and after, and those that the index doesn't reach with the reason."""
    first, last = span(spark, d)
    v = valid(spark, d)
    index = panel.mean_index(v).join(ledger.eligible(v, first, last).select("dong", "q", "eligible"), ["dong", "q"]).select("dong", "q", "log_index", "eligible")
    rows = spark.createDataFrame([*EVENTS, *FAR_EVENTS], "pos int, event_id string, date string, score int")
    out = panel.event_outcomes(stored(index, "index"), rows.withColumn("q", quarters.quarter_ord(F.to_date("date"))))
    return out.withColumns({c: F.round(c, 6) for c in ("pre_change", "post_change", "post_median", "post_p10", "post_p90", "share_up", "same_direction")})


@query(""" SELECT dong, CASE WHEN area < 13 THEN 'A' WHEN area < 26 THEN 'B' WHEN area < 39 THEN 'C' ELSE 'D' END AS band, count(*) AS n, round(median(price), 4) AS median_price, min(price) AS min_price, max(price) AS max_price FROM valid
WHERE deal_ym >= (SELECT strftime(date_trunc('month', max(deal_date)) - INTERVAL 23 MONTH, '%Y%m') FROM sale) GROUP BY 1, 2""")
def area_bands(spark, d):
    """Prices by dong and area band over the ledger's last 24 months."""
    return ledger.area_bands(valid(spark, d), serving.area_window(trade_sale(spark, d))).withColumn("median_price", F.round("median_price", 4))


@query(f""", s AS (SELECT dong, q, count(*) AS a FROM valid GROUP BY 1, 2), r AS (SELECT dong, q, count(*) AS b, count_if(monthly <> 0) AS m FROM rent GROUP BY 1, 2),
g AS (SELECT dong, q FROM (SELECT dong FROM valid UNION SELECT dong FROM rent), {LAST_8Q} x)
SELECT dong, q, coalesce(a, 0) AS n_sales, coalesce(b, 0) AS n_rents, round(m / b, 6) AS monthly_share FROM g LEFT JOIN s USING (dong, q) LEFT JOIN r USING (dong, q)""")
def flows(spark, d):
    last = span(spark, d)[1]
    return ledger.flows(valid(spark, d), trade_rent(spark, d), last).withColumn("monthly_share", F.round("monthly_share", 6))


@query(" SELECT apt_seq, deal_date, order_no, price, area FROM valid QUALIFY row_number() OVER (PARTITION BY apt_seq ORDER BY deal_date DESC, order_no DESC, price DESC, area DESC) = 1")
def last_sale_per_complex(spark, d):
    return ledger.recent_sale_per_complex(valid(spark, d)).select("apt_seq", "deal_date", "order_no", "price", "area")


@query(f""", c AS (SELECT dong, count(*) AS n FROM valid WHERE q BETWEEN {LAST} - 3 AND {LAST} GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS t FROM c WHERE n > 0)
SELECT dong, n, n >= (SELECT n FROM r WHERE i = ceil(0.3 * t - 1e-9)) AS tagged FROM c""")
def region_tags(spark, d):
    last = span(spark, d)[1]
    c = valid(spark, d).where(F.col("q").between(last - 3, last)).groupBy("dong").agg(F.count(F.lit(1)).alias("n"))
    return panel.region_tags(c, "n").select("dong", "n", "tagged")


@query(f"""{INDEX_SQL}, l AS (SELECT dong, sgg_cd, log_index, n_sales FROM idx WHERE q = {LAST}), r AS (SELECT *, (rank() OVER (PARTITION BY sgg_cd ORDER BY n_sales) + (count(*) OVER (PARTITION BY sgg_cd, n_sales) - 1) / 2) / count(*) OVER (PARTITION BY sgg_cd) AS pr,
log_index - median(log_index) OVER (PARTITION BY sgg_cd) AS c FROM l) SELECT dong, round(pr, 6) AS pct_rank, round(c, 6) AS centered FROM r""")
def relative_panel(spark, d):
    last = span(spark, d)[1]
    l = panel.mean_index(valid(spark, d)).where(F.col("q") == last)
    out = windows.center_median(l.withColumn("pct_rank", windows.pct_rank_avg("n_sales", ["sgg_cd"])), "log_index", ["sgg_cd"], "centered")
    return out.select("dong", F.round("pct_rank", 6).alias("pct_rank"), F.round("centered", 6).alias("centered"))


@query(f"""{INDEX_SQL}, h AS (SELECT dong, max_by(q, (log_index, q)) AS peak, count(*) AS n FROM idx WHERE q BETWEEN {LAST} - 19 AND {LAST} GROUP BY 1), l AS (SELECT dong, q, log_index FROM idx)
SELECT h.dong, CASE WHEN n = 20 THEN peak END AS peak_q, CASE WHEN n = 20 THEN round(a.log_index - b.log_index, 6) END AS gap FROM h LEFT JOIN l a ON a.dong = h.dong AND a.q = {LAST} LEFT JOIN l b ON b.dong = h.dong AND b.q = peak""")
def peak_gap(spark, d):
    last = span(spark, d)[1]
    i = panel.mean_index(valid(spark, d)).where(F.col("q").between(last - 19, last))
    h = i.groupBy("dong").agg(F.max(F.struct("log_index", "q")).alias("p"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("q") == last, F.col("log_index"))).alias("now"))
    return h.select("dong", F.when(F.col("n") == 20, F.col("p.q")).alias("peak_q"), F.when(F.col("n") == 20, F.round(F.col("now") - F.col("p.log_index"), 6)).alias("gap"))


@query(f"""{INDEX_SQL}, f AS (SELECT dong, sgg_cd, log_index AS a, n_sales::DOUBLE AS b FROM idx WHERE q = {LAST}), s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM f),
p AS (SELECT x.dong, y.dong AS peer, round(sqrt(pow(x.a / sa - y.a / sa, 2) + pow(x.b / sb - y.b / sb, 2)), 9) AS distance FROM f x JOIN f y ON x.sgg_cd = y.sgg_cd AND x.dong <> y.dong, s)
SELECT dong, peer, round(distance, 6) AS distance, row_number() OVER (PARTITION BY dong ORDER BY distance, peer) AS rank FROM p QUALIFY rank <= 5""")
def nearest_peers(spark, d):
    last = span(spark, d)[1]
    m = panel.mean_index(valid(spark, d)).where(F.col("q") == last).select("dong", "sgg_cd", F.col("log_index").alias("a"), F.col("n_sales").cast("double").alias("b"))
    return panel.peers(stored(m, "levels"), ["a", "b"], "sgg_cd").withColumn("distance", F.round("distance", 6))


@query(""", c AS (SELECT cast(floor(area / 10) AS INT) AS x, floor AS y, count(*) AS n FROM valid GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT x, sum(n) AS n FROM c GROUP BY 1)),
b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT y, sum(n) AS n FROM c GROUP BY 1)) SELECT cast(t AS BIGINT) AS n, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 9) AS ari FROM s, a, b""")
def adjusted_rand(spark, d):
    return panel.adjusted_rand(valid(spark, d).select(F.floor(F.col("area") / 10).alias("x"), F.col("floor").alias("y")), "x", "y").withColumn("ari", F.round("ari", 9))


@query(""", m AS (SELECT dong, l_shipdate AS ts, cast(l_extendedprice AS DOUBLE) AS p FROM joined), x AS (SELECT sgg_cd, q, corr(ra, rb) AS r, count(*) AS n, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb FROM
(SELECT sgg_cd, q, rank() OVER (PARTITION BY sgg_cd, q ORDER BY area) + (count(*) OVER (PARTITION BY sgg_cd, q, area) - 1) / 2 AS ra, rank() OVER (PARTITION BY sgg_cd, q ORDER BY price) + (count(*) OVER (PARTITION BY sgg_cd, q, price) - 1) / 2 AS rb FROM valid) GROUP BY 1, 2)
SELECT sgg_cd, q, n, CASE WHEN sa <> 0 AND sb <> 0 THEN round(r, 6) END AS spearman FROM x""")
def spearman(spark, d):
    return windows.spearman(valid(spark, d), "area", "price", ["sgg_cd", "q"]).withColumn("spearman", F.round("spearman", 6))


# Terms that a text may not hold.
BANNED = ("idiot", "moron", "token =", "guarantee")


@query(f"""SELECT doc_id, line, term FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), (VALUES {", ".join(f"('{t}')" for t in BANNED)}) b(term) WHERE contains(body, term)""", ledgers=False)
def banned_terms(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    hits = lines.withColumn("term", F.explode(F.filter(F.array(*[F.lit(t) for t in BANNED]), lambda t: F.contains(F.col("body"), t))))
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), "term")


@query("""SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_replace(regexp_extract(a, '>([^<]*)</a>', 1), '\\s+', ' ', 'g') AS title, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS a FROM pages) GROUP BY 1, 2, 3""", ledgers=False)
def html_links(spark, d):
    a = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))).alias("a"))
    return a.groupBy("page_id", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_replace(F.regexp_extract("a", ">([^<]*)</a>", 1), r"\s+", " ").alias("title")).agg(F.count(F.lit(1)).alias("n"))


#: Links as a list of releases has them, made from the pages' numbers: years of two and four digits, a month that is none, another kind of file.
RELEASES_SQL = """WITH r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2018 + page_id % 7 ELSE 18 + page_id % 7 END AS y, page_id % 14 AS m, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'xlsx' END AS ext FROM pages),
l AS (SELECT page_id, page_id::VARCHAR AS seq, y || '년 ' || m || '월 A&B.' || ext AS title, (CASE WHEN y < 100 THEN y + 2000 ELSE y END)::INT AS year, m::INT AS month FROM r WHERE ext = 'xlsx' AND m BETWEEN 1 AND 12)"""


def _releases(spark, d):
    p = table(spark, d, "pages").withColumn("y", F.when(F.col("page_id") % 2 == 0, 2018 + F.col("page_id") % 7).otherwise(18 + F.col("page_id") % 7).cast("string"))
    title = F.concat("y", F.lit("년 "), (F.col("page_id") % 14).cast("string"), F.lit("월 A&amp;B."), F.when(F.col("page_id") % 5 == 0, "pdf").otherwise("xlsx"))
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<A title='"), title, F.lit("' href=\"javascript:downloadFile('"), F.col("page_id").cast("string"), F.lit("')\">x</A>"))).otherwise(F.concat(F.lit('<a href="#" onclick="return downloadFile( '), F.col("page_id").cast("string"), F.lit(' )" title="'), title, F.lit('">x</a>')))
    return files.release_links(p.select("page_id", F.concat("html", link).alias("html")), keys=("page_id",))


@query(f"{RELEASES_SQL} SELECT * FROM l", ledgers=False)
def release_links(spark, d):
    """Workbooks of a stated month among the links of all pages."""
    return _releases(spark, d)


@query(f"{RELEASES_SQL} SELECT * FROM l ORDER BY year DESC, month DESC, seq::BIGINT DESC LIMIT 1", ledgers=False)
def newest_release(spark, d):
    """The newest of them."""
    return files.newest_release(_releases(spark, d))


@query(""", n AS (SELECT apt_seq, 'umd_nm' AS name, umd_nm AS value FROM sale UNION ALL SELECT apt_seq, 'deal_ym', deal_ym FROM sale UNION ALL SELECT apt_seq, 'sgg_cd', sgg_cd FROM sale), c AS (SELECT apt_seq, name, value FROM n GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY apt_seq, name ORDER BY count(*) DESC, value) = 1),
y AS (SELECT apt_seq, median(build_year) AS build_year, count(*) AS n FROM sale GROUP BY 1) SELECT y.*, max(value) FILTER (name = 'umd_nm') AS umd_nm, max(value) FILTER (name = 'deal_ym') AS deal_ym, max(value) FILTER (name = 'sgg_cd') AS sgg_cd FROM y JOIN c USING (apt_seq) GROUP BY ALL""")
def complex_master(spark, d):
    """One row for each complex: its usual names, the median year it was built, and its trades."""
    return quality.master_of(trade_sale(spark, d), "apt_seq", ["umd_nm", "deal_ym", "sgg_cd"], "build_year")


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total, sum(cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1, 2""", ledgers=False)
def event_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query(f""", c AS (SELECT count(*) AS rows, count_if(price IS NULL)::BIGINT AS missing_price, count_if(NOT regexp_matches(deal_ym, '^[0-9]{{6}}$'))::BIGINT AS bad_month, count_if(dong <> sgg_cd || '_' || umd_nm)::BIGINT AS bad_key, min(deal_ym) AS first_ym, max(deal_ym) AS last_ym FROM sale),
k AS (SELECT count(*) AS repeated FROM (SELECT order_no, floor FROM sale GROUP BY 1, 2 HAVING count(*) > 1)), o AS (SELECT count(*) AS orphans FROM rent r WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.dong = r.dong AND v.q = r.q)) SELECT * FROM c, k, o""")
def ledger_profile(spark, d):
    s = trade_sale(spark, d)
    c = s.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price").isNull()).alias("missing_price"), F.count_if(~F.col("deal_ym").rlike("^[0-9]{6}$")).alias("bad_month"), F.count_if(F.col("dong") != F.concat("sgg_cd", F.lit("_"), "umd_nm")).alias("bad_key"), F.min("deal_ym").alias("first_ym"), F.max("deal_ym").alias("last_ym"))
    k = s.groupBy("order_no", "floor").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    o = trade_rent(spark, d).join(valid(spark, d).select("dong", "q").distinct(), ["dong", "q"], "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return c.crossJoin(k).crossJoin(o)


@query()
def hedonic_index(spark, d):
    return hedonic.hedonic_index(valid(spark, d))


@query()
def vintage_indexes(spark, d):
    """The index as seen at the end of every quarter from the fourth on."""
    first, last = span(spark, d)
    return hedonic.hedonic_index(valid(spark, d), origins=list(range(first + 3, last + 1))).select("origin", "dong", "q", "n_sales", "log_index")


SCALES_SQL = f"""{INDEX_SQL}, sv AS (SELECT count(*) AS n, var_pop(log_ppm2) AS v FROM valid GROUP BY dong, q), si AS (SELECT sqrt(sum(n * v) / sum(n - 1)) AS sigma FROM sv),
md_ AS (SELECT median(n_sales) AS mid FROM idx), sc AS (SELECT any_value(sigma) AS sigma, sqrt(greatest(avg(pow(dq_effect * (n_sales + 5) / n_sales, 2) - sigma * sigma / n_sales), 1e-8)) AS tau, count(*) AS used FROM idx, md_, si WHERE n_sales >= mid),
se AS (SELECT idx.*, sqrt(sigma * sigma * n_sales + tau * tau * 25) / (n_sales + 5) AS log_index_se FROM idx, sc)"""


def scales(spark, d):
    """The mean index and its two scales."""
    v = valid(spark, d)
    index = stored_index(spark, d)
    return index, hedonic.deviation_scale(index, hedonic.residual_scale(v))


@query(f"{SCALES_SQL} SELECT round(sigma, 6) AS sigma, round(tau, 6) AS tau, used, round(sigma * sigma / (tau * tau), 5) AS lam FROM sc")
def error_scales(spark, d):
    s = scales(spark, d)[1]
    return s.crossJoin(F.broadcast(hedonic.eb_lambda(s))).select(F.round("sigma", 6).alias("sigma"), F.round("tau", 6).alias("tau"), "used", F.round("lam", 5).alias("lam"))


@query(f"{SCALES_SQL} SELECT dong, q, n_sales, round(log_index, 6) AS log_index, round(log_index_se, 6) AS log_index_se FROM se")
def index_with_errors(spark, d):
    out = hedonic.attach_se(*scales(spark, d))
    return out.select("dong", "q", "n_sales", F.round("log_index", 6).alias("log_index"), F.round("log_index_se", 6).alias("log_index_se"))


@query(f"""{SCALES_SQL}, bn AS (SELECT (n_sales >= 1)::INT + (n_sales >= 5)::INT + (n_sales >= 10)::INT + (n_sales >= 20)::INT + (n_sales >= 50)::INT AS bin, count(*) AS n, median(log_index_se) AS md, avg(log_index_se) AS mn FROM se GROUP BY 1)
SELECT bin, n, round(md, 6) AS median_se, round(mn, 6) AS mean_se, mn < lag(mn) OVER (ORDER BY bin) AS falls FROM bn""")
def se_by_count_bin(spark, d):
    out = hedonic.se_by_count_bin(hedonic.attach_se(*scales(spark, d)))
    return out.select("bin", "n", F.round("median_se", 6).alias("median_se"), F.round("mean_se", 6).alias("mean_se"), "falls")


@query()
def index_check(spark, d):
    """The hedonic and the repeat-sales index on changes between the last two years' ends."""
    last = span(spark, d)[1]
    end = last - (last + 1) % 4
    h = hedonic.hedonic_index(valid(spark, d)).select("dong", "q", F.col("log_index").alias("x"))
    r = hedonic.repeat_sales_index(ledger.repeat_pairs(valid(spark, d))).select("dong", "q", F.col("repeat_index").alias("x"))
    return hedonic.index_check(h, r, end - 4, end)


@query()
def repeat_sales_index(spark, d):
    return hedonic.repeat_sales_index(ledger.repeat_pairs(valid(spark, d)))


@query()
def structure_clusters(spark, d):
    v = valid(spark, d).groupBy("dong").agg(F.avg("log_ppm2").alias("level"), F.avg("build_year").alias("built"), F.count(F.lit(1)).cast("double").alias("n"))
    return hedonic.structure_clusters(v, ["level", "built", "n"], ks=(4, 5, 6))


@query(""", p AS (SELECT DISTINCT apt_seq, 126.7 + l_suppkey % 600 / 1000 AS x, 37.4 + l_suppkey % 350 / 1000 AS y FROM joined), c AS (SELECT DISTINCT floor(x * 10) / 10 AS a, floor(y * 10) / 10 AS b FROM p)
SELECT apt_seq, round(a, 1)::VARCHAR || '_' || round(b, 1)::VARCHAR AS key FROM p JOIN c ON x >= a AND x < a + 0.1 AND y >= b AND y < b + 0.1""")
def complexes_in_squares(spark, d):
    """Complexes in the tenth-of-a-degree squares of the map that have suppliers of one gu or more."""
    p = complexes(spark, d).select("apt_seq", F.col("lng").alias("x"), F.col("lat").alias("y"))
    corner = p.select((F.floor(F.col("x") * 10) / 10).alias("a"), (F.floor(F.col("y") * 10) / 10).alias("b")).distinct()
    ring = F.array(*[F.array(F.col("a") + i, F.col("b") + j) for i, j in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1), (0.0, 0.0))])
    squares = corner.select(F.concat_ws("_", F.round("a", 1).cast("string"), F.round("b", 1).cast("string")).alias("key"), ring.alias("ring"))
    return geometry.points_in_polygons(p, squares).select("apt_seq", "key")


def _diamond(x, y, r):
    """A closed ring around (x, y)."""
    return [(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)]


#: Rings of each corner's shape: a diamond with a hole, and a small triangle apart from it.
_RINGS = (_diamond(0.0503, 0.0487, 0.0451), _diamond(0.0513, 0.0477, 0.0171), [(0.0903, 0.0011), (0.0989, 0.0017), (0.0957, 0.0983), (0.0903, 0.0011)])
_EDGES_SQL = ", ".join(f"({i}, {p[0]!r}, {p[1]!r}, {q[0]!r}, {q[1]!r})" for i, ring in enumerate(_RINGS) for p, q in zip(ring, ring[1:]))


def _shapes(points):
    """A shape of two parts, one of them with a hole, in each tenth-of-a-degree square that has points."""
    corner = points.select((F.floor(F.col("x") * 10) / 10).alias("a"), (F.floor(F.col("y") * 10) / 10).alias("b")).distinct()
    ring = lambda r: F.array(*[F.array(F.col("a") + p[0], F.col("b") + p[1]) for p in r])
    return corner.select(F.concat_ws("_", F.round("a", 1).cast("string"), F.round("b", 1).cast("string")).alias("key"), F.array(F.array(ring(_RINGS[0]), ring(_RINGS[1])), F.array(ring(_RINGS[2]))).alias("polygons"))


_PLACES_SQL = "p AS (SELECT DISTINCT apt_seq, 126.7 + l_suppkey % 600 / 1000 AS x, 37.4 + l_suppkey % 350 / 1000 AS y FROM joined), c AS (SELECT DISTINCT floor(x * 10) / 10 AS a, floor(y * 10) / 10 AS b FROM p)"


@query(f""", {_PLACES_SQL}, e AS (SELECT a, b, a + x0 AS x0, b + y0 AS y0, a + x1 AS x1, b + y1 AS y1 FROM c, (VALUES {_EDGES_SQL}) t(i, x0, y0, x1, y1)),
h AS (SELECT apt_seq, a, b, count(*) AS n FROM p JOIN e ON (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY 1, 2, 3) SELECT apt_seq, round(a, 1)::VARCHAR || '_' || round(b, 1)::VARCHAR AS key FROM h WHERE n % 2 = 1""")
def complexes_in_shapes(spark, d):
    """Complexes in shapes of several parts with holes."""
    p = complexes(spark, d).select("apt_seq", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return geometry.points_in_multipolygons(p, _shapes(p)).select("apt_seq", "key")


@query(f""", {_PLACES_SQL}, e AS (SELECT floor(a)::BIGINT AS degree, a, b, a + x0 AS x0, b + y0 AS y0 FROM c, (VALUES {_EDGES_SQL}) t(i, x0, y0, x1, y1)) SELECT degree, round(min(x0), 9) AS x0, round(min(y0), 9) AS y0, round(max(x0), 9) AS x1, round(max(y0), 9) AS y1, count(DISTINCT (a, b)) AS n FROM e GROUP BY 1""")
def shape_bounds(spark, d):
    """The box of all shapes of a degree of longitude."""
    p = complexes(spark, d).select(F.col("lng").alias("x"), F.col("lat").alias("y"))
    rows = _shapes(p).withColumn("degree", F.floor(F.split("key", "_")[0].cast("double")))
    return geometry.collective_bounds(rows, ["degree"]).select("degree", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")], "n")
