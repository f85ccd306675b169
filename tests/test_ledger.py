"""Ledger operators against their SQL, known answers and synthetic trends."""

import glob
import math
import numbers
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arealedger.functions import quarters, scalars
from arealedger.operators import geometry, hedonic, ledger, quality, windows
from arealedger.plans import forecasts, serving  # noqa: F401  (they add their queries)
from arealedger.plans.queries import ORACLE, QUERIES
from arealedger.sources import files
from arealedger.streaming import vintages

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v).replace(" 00:00:00", "")
    return sorted((tuple(map(cell, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    if name not in ORACLE:
        assert (got.count() > 0) == (name != "structure_clusters")  # these tables have too few dongs for clusters
        return
    assert plain(got.toPandas()) == plain(duck.sql(ORACLE[name]).df())


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_known_answers(spark):
    flags = lambda n, s, e: scalars.sample_flags(F.lit(n), F.lit(s).cast("double"), F.lit(e))
    assert one(spark, flags(19, 0.5, 0.031), flags(20, 0.5, 0.031), flags(20, 0.500001, 0.031), flags(20, None, 0.032)) == (["FEW_SALES"], [], ["ONE_COMPLEX_DOMINATES"], ["HIGH_INDEX_ERROR"])
    assert one(spark, *[scalars.se_band(F.lit(x)) for x in (0.015999, 0.016, 0.031999, 0.032)]) == ("LOW", "MID", "MID", "HIGH")
    assert one(spark, *[scalars.log_to_pct(F.lit(x)) for x in (0.0, 0.0315, -0.0513)]) == (0, 3.2, -5)
    shift = lambda q, k: quarters.shift_quarter(F.lit(q), k)
    assert one(spark, shift("2026Q2", -4), shift("2026Q1", -1), shift("2025Q4", 1), shift("garbage", 3)) == ("2025Q2", "2025Q4", "2026Q1", "garbage")
    se = one(spark, *[scalars.index_se(F.lit(n), 0.25, 0.08, 5.0) for n in (0, 1, 5, 20, 100)])
    assert math.isclose(se[0], 0.08) and list(se) == sorted(se, reverse=True)
    assert str(one(spark, scalars.parse_spaced_date(F.lit("2026. 8. 16.")))[0]) == "2026-08-16"


def test_weighted_quantile_and_asof(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 10.0, 0.25), ("a", 100.0, 0.25)], "k string, v double, w double")
    assert windows.weighted_quantile(df, "v", "w", 0.8, ["k"], "x").first()["x"] == 100
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("b", 1, 3.0)], "k string, t int, v double")
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 7), ("b", 9), ("c", 1)], "k string, t int")
    got = {(r["k"], r["t"]): r["v"] for r in windows.asof_join(left, right, "t", "t", ["k"], ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 1.0, ("a", 7): None, ("b", 9): 3.0, ("c", 1): None}


def trend(spark, gus=2):
    rng, slopes, out = random.Random(0), (0.02, -0.01, 0.0, 0.03), []
    for d, slope in enumerate(slopes):
        for q in range(12):
            for i in range(30):
                out.append((f"{d % gus}", f"{d % gus}_S{d}", f"{d}-{i % 10}", 8000 + q, i % 10 * 0.1 + d + slope * q + rng.gauss(0, 0.005), i, q))
    return spark.createDataFrame(out, "sgg_cd string, dong string, cell string, q int, log_ppm2 double, order_no int, day int").withColumn("deal_date", F.date_add(F.lit("2000-01-01").cast("date"), "day")), slopes


def test_indexes_recover_trends(spark):
    sales, slopes = trend(spark)
    free = hedonic.hedonic_index(sales, lam=1e-6).select("dong", "q", F.col("log_index").alias("x"))
    repeat = hedonic.repeat_sales_index(ledger.repeat_pairs(sales)).select("dong", "q", F.col("repeat_index").alias("x"))
    for index, tol in ((free, 0.01), (repeat, 0.02)):
        got = {(r["dong"], r["q"]): r["x"] for r in index.collect()}
        for d, slope in enumerate(slopes):
            k = f"{d % 2}_S{d}"
            assert abs(got[k, 8011] - got[k, 8000] - 11 * slope) < tol


def test_geometry(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    ring = F.array(*[F.array(*[F.lit(v) for v in p]) for p in square])
    area, c, inside, outside = one(spark, geometry.ring_area(ring), geometry.ring_centroid(ring), geometry.inside(F.lit(1.0), F.lit(1.0), ring), geometry.inside(F.lit(5.0), F.lit(1.0), ring))
    assert area == 16 and tuple(c) == (2, 2) and inside and not outside


def test_quality(spark):
    df = spark.createDataFrame([("1", "x"), ("1.5", "true"), (None, " "), ("1", "maybe")], "a string, b string")
    bad = {(r["column"], r["value"]) for r in quality.strict_cast_violations(df, {"a": "int", "b": "boolean"}).collect()}
    assert ("b", "maybe") in bad and ("b", "x") in bad and ("a", "1") not in bad
    assert quality.check_unique(df, ["a"]).count() == 1 and quality.check_header(df, ["a", "c"]) == ["missing c", "unexpected b"]
    assert quality.check_enum(df, "b", ["x"], nullable=False).count() == 3


def test_publish_moves_the_pointer_last(spark, tmp_path):
    df, root = spark.range(5), str(tmp_path)
    assert files.publish_snapshot({"t": df}, root, "1", {}) == {}
    assert files.publish_snapshot({"t": df}, root, "1", {}, commit=True) == {"t": 5}
    with pytest.raises(ValueError):
        files.publish_snapshot({"t": df}, root, "2", {"rows": df}, commit=True)
    assert files.active(spark, root, "t").count() == 5


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = vintages.event_windows(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["event_type"], r["start"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(vintages.event_windows(e))
    vintages.append_new(s, ["event_id"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select("event_id").distinct().count()
