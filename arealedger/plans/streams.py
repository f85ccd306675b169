"""Registered queries that run as streams over the given tables. Importing this module adds them to QUERIES and ORACLE."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import quarters
from ..sources.adapter import span, table
from ..sources.store import shared_dir
from ..streaming import vintages
from .queries import query


def _stream(spark, d, name):
    """A given table as a stream of its files, in as many batches as it has files."""
    return spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parquet*")


def _folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("""SELECT cast(date_trunc('day', ts) AS DATE)::VARCHAR AS as_of, event_type AS kind, strftime(ts, '%Y%m') AS ym, count(*) AS n FROM events GROUP BY 1, 2, 3""", ledgers=False)
def streamed_manifest(spark, d):
    """Records by day of arrival, landed once and recounted by day as their files come in."""
    at = _folder(spark, "landed")
    rows = _stream(spark, d, "events").select(F.to_date("ts").cast("string").alias("as_of"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyyMM").alias("ym"), "event_id")
    vintages.ingest_days(rows, ["as_of", "kind", "ym", "event_id"], f"{at}/rows", f"{at}/counts", f"{at}/state").awaitTermination()
    return spark.read.schema("kind string, ym string, n bigint, as_of string").parquet(f"{at}/counts").select("as_of", "kind", "ym", "n")


@query(""", g AS (SELECT dong, unnest(range(lo, l + 1))::INT AS q FROM (SELECT dong, min(q) AS lo FROM valid, span WHERE q <= l GROUP BY 1), span), c AS (SELECT g.dong, g.q, count(v.q) AS n FROM g LEFT JOIN valid v ON v.dong = g.dong AND v.q BETWEEN g.q - 3 AND g.q GROUP BY 1, 2)
SELECT dong, q, CASE WHEN q >= f + 3 THEN n END AS n_4q, q >= f + 3 AND n >= 20 AS eligible FROM c, span WHERE n > 0""")
def streamed_eligibility(spark, d):
    """Running eligibility of every dong and quarter with sales in its window, from a stream of sales."""
    first, last = span(spark, d)
    at = _folder(spark, "eligible")
    date = F.to_date("l_shipdate")
    gu = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, d, "part").select("p_partkey")
    sales = _stream(spark, d, "lineitem").where("l_returnflag <> 'R' and l_quantity > 0 and l_extendedprice > 0").join(gu, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    sales = sales.select(F.concat(F.col("s_nationkey").cast("string"), F.lit("_S"), F.col("l_suppkey").cast("string")).alias("dong"), quarters.quarter_ord(date).alias("q"))
    # All quarters of the ledger may come in one file, in any order: none is late.
    rows = vintages.stream_eligibility(sales, ahead=3, first=first, keep=last - first + 2)
    vintages.latest_rows(rows, f"{at}/rows", f"{at}/state").awaitTermination()
    return vintages.latest(spark, ["dong", "q"], f"{at}/rows").where((F.col("q") <= last) & (F.coalesce("n_4q", F.lit(1)) > 0))
