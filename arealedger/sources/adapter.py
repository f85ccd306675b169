"""The given tables as ledgers of sales and rents, complexes, completions and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quarters import quarter_ord

#: Width of an area bin in a cell.
AREA_BIN = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))


def _keys() -> list:
    gu, umd = F.col("s_nationkey").cast("string"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    date = F.to_date("l_shipdate")
    apt = F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.floor(F.col("p_size") / 10).cast("string"))
    return [gu.alias("sgg_cd"), umd.alias("umd_nm"), F.concat(gu, F.lit("_"), umd).alias("dong"), apt.alias("apt_seq"), date.alias("deal_date"), quarter_ord(date).alias("q")]


def trade_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale ledger, cancelled ones included."""
    apt = F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.floor(F.col("p_size") / 10).cast("string"))
    return _joined(spark, sf_dir).select(
        *_keys(),
        F.concat(apt, F.lit("_"), F.floor(F.col("l_quantity") / AREA_BIN).cast("string")).alias("cell"),
        F.date_format("l_shipdate", "yyyyMM").alias("deal_ym"),
        F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") == "R").alias("is_cancelled"),
        F.col("l_linenumber").alias("floor"),
        (F.lit(1950) + F.col("p_size")).alias("build_year"),
        F.col("l_orderkey").alias("order_no"),
    )


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First quarter of the ledger, and the last one that it holds to its end: one row comes to the driver."""
    date = F.to_date("l_shipdate")
    r = table(spark, sf_dir, "lineitem").agg(quarter_ord(F.min(date)).alias("f"), (quarter_ord(F.date_add(F.max(date), 1)) - 1).alias("l")).first()
    return (0, -1) if r["f"] is None else (r["f"], r["l"])


def trade_rent(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = F.when(F.col("l_discount") < 0.05, 0.0).otherwise(F.col("l_extendedprice") * F.col("l_discount"))
    return _joined(spark, sf_dir).where("l_linestatus = 'O'").select(*_keys(), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("deposit"), monthly.alias("monthly"), (monthly == 0).alias("is_jeonse"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed households by dong and quarter."""
    return _joined(spark, sf_dir).where("l_returnflag = 'A'").select(*_keys(), F.col("l_linenumber").alias("n")).groupBy("dong", "q").agg(F.sum("n").alias("households"))


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per complex: households over its distinct parts, legal-area code, place."""
    parts = _joined(spark, sf_dir).select("l_suppkey", "p_partkey", "p_size", *_keys()).select("l_suppkey", "p_partkey", "p_size", "apt_seq", "sgg_cd").distinct()
    return parts.groupBy("apt_seq", "sgg_cd", "l_suppkey").agg(F.sum("p_size").alias("households")).select(
        "apt_seq", "sgg_cd", "households", F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("bjd_code"), (37.4 + F.pmod("l_suppkey", F.lit(350)) / 1000).alias("lat"), (126.7 + F.pmod("l_suppkey", F.lit(600)) / 1000).alias("lng")
    )


#: The same tables for the oracle.
SALE_SQL = f"""
joined AS (
  SELECT l.*, s_nationkey, p_partkey, p_size, cast(s_nationkey AS VARCHAR) AS sgg_cd, 'S' || l_suppkey AS umd_nm,
    s_nationkey || '_S' || l_suppkey AS dong, l_suppkey || '-' || (p_size // 10) AS apt_seq,
    cast(l_shipdate AS DATE) AS deal_date, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
sale AS (
  SELECT sgg_cd, umd_nm, dong, apt_seq, deal_date, q, apt_seq || '_' || cast(floor(l_quantity / {AREA_BIN}) AS INT) AS cell,
    strftime(l_shipdate, '%Y%m') AS deal_ym, l_quantity AS area, l_extendedprice AS price, l_returnflag = 'R' AS is_cancelled,
    l_linenumber AS floor, 1950 + p_size AS build_year, l_orderkey AS order_no FROM joined),
span AS (SELECT min(q) AS f, year(max(deal_date) + 1) * 4 + quarter(max(deal_date) + 1) - 2 AS l FROM sale),
valid AS (
  SELECT *, ln(price / area) AS log_ppm2 FROM sale
  WHERE is_cancelled IS NOT TRUE AND sgg_cd IS NOT NULL AND umd_nm IS NOT NULL AND apt_seq IS NOT NULL AND area > 0 AND price > 0
    AND regexp_matches(deal_ym, '^[0-9]{{6}}$')),
rent AS (
  SELECT sgg_cd, umd_nm, dong, apt_seq, deal_date, q, l_quantity AS area, l_extendedprice AS deposit,
    CASE WHEN l_discount < 0.05 THEN 0 ELSE l_extendedprice * l_discount END AS monthly FROM joined WHERE l_linestatus = 'O')
"""
