"""Steps that once grew faster than their input: what they give, and that they don't."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealedger.operators import cluster, forecast, hedonic, ledger, neighbours, nowcast, vintage, windows


@pytest.mark.parametrize("box, digits, gaps", [(512, 12, False), (8, 12, False), (8, None, True)])
def test_nearest_equals_all_pairs(spark, monkeypatch, box, digits, gaps):
    """Many boxes, equal rows beyond one, groups smaller than k and gaps; against every pair."""
    monkeypatch.setattr(neighbours, "BOX", box)
    monkeypatch.setattr(neighbours, "ABREAST", 2)
    rng = random.Random(box)
    rows = [(f"d{i}", i % 3, [round(rng.gauss(0, 1), 2) for _ in range(3)]) for i in range(150)]
    rows += [(f"e{i}", 1, [0.5, 0.5, 0.5]) for i in range(40)] + [(f"f{i}", 7, [float(i), 0.0, 1.0]) for i in range(3)]
    if gaps:
        rows = [(n, g, [None if rng.random() < 0.1 else v for v in x]) for n, g, x in rows]
    got = neighbours.nearest(spark.createDataFrame(rows, "dong string, g int, z array<double>"), "dong", "g", "z", 4, digits)
    found = sorted((r["dong"], r["rank"], r["peer"], r["distance"]) for r in got.collect())
    want, z = [], np.array([[np.nan if v is None else v for v in x] for _, _, x in rows])
    d = neighbours.distances(z, z, digits)
    for i, (n, g, _) in enumerate(rows):
        near = sorted((d[i, j], m) for j, (m, h, _) in enumerate(rows) if g == h and i != j)[:4]
        want += [(n, r + 1, m, x) for r, (x, m) in enumerate(near)]
    assert found == sorted(want)


def test_nearest_calls_at_few_boxes(spark, monkeypatch):
    """On a line a row meets its own box and its neighbours', not all of them."""
    monkeypatch.setattr(neighbours, "BOX", 16)
    kept, store = {}, neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, label: kept.setdefault(label, store(df, label)))
    rows = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("dong"), F.lit(1).alias("g"), F.array(F.col("id").cast("double")).alias("z"))
    assert neighbours.nearest(rows, "dong", "g", "z", 5).count() == 10_000
    assert kept["calls"].count() < 3 * 2000


def test_a_round_of_kmeans_shuffles_sums_only(spark):
    """What goes between tasks is a row for each task and key, whatever the number of points, starts and clusters."""
    points = spark.range(4000).select((F.col("id") % 2).cast("int").alias("as_of"), F.col("id").alias("dong"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("x"), F.lit(1.0).alias("w"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = cluster.keyed_kmeans(points, (4, 5), 2, starts=5, rounds=3).collect()
    assert shuffled() - before < 4000
    assert len({(r["k"], r["dong"]) for r in got}) == len(got) == 8000


def test_draws_stay_off_the_driver(spark):
    """Draws times units rows are never the side that is broadcast."""
    errors = spark.range(300).select(F.concat(F.lit("d"), "id").alias("dong"), (F.col("id") % 5).cast("double").alias("a"), F.lit(1.0).alias("b"))
    plan = hedonic.block_bootstrap(errors, "dong", "a", "b", 20, 1)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Join [slot" in line] and all("BroadcastHashJoin" not in line for line in plan.splitlines() if "Join [slot" in line)


def test_vintage_sums_are_shuffled_once(spark):
    """Origins repeat sums after the last exchange by dong, not before it."""
    valid = spark.range(600).select(F.concat(F.lit("c"), F.col("id") % 20).alias("cell"), F.lit("g").alias("sgg_cd"), F.concat(F.lit("d"), F.col("id") % 5).alias("dong"), (8000 + F.col("id") % 12).cast("int").alias("q"), (F.col("id") % 7).cast("double").alias("log_ppm2"))
    kept = []
    real, vintage.stored = vintage.stored, lambda df, label: kept.append(df) or real(df, label)
    try:
        assert vintage.residual_index(valid, 8003, 8011).count() > 0
    finally:
        vintage.stored = real
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_structure_clusters_run_all_starts_together(spark):
    """As many jobs for one start as for ten."""
    rows = spark.range(60).select(F.concat(F.lit("d"), "id").alias("dong"), (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    jobs = []
    for tries in (1, 10):
        spark.sparkContext.setJobGroup(f"tries-{tries}", "")
        got = hedonic.structure_clusters(rows, ["a", "b"], (4, 5), tries)
        assert got.groupBy("k").count().where("count = 60").count() == 2
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tries-{tries}")))
    assert jobs[0] == jobs[1] < 60


def test_windows_repeat_rows_after_they_are_dealt(spark):
    """Medians of trailing windows are whole where their rows are repeated: nothing partial goes between tasks."""
    sale = spark.createDataFrame([("d", 8000, 9.0, 3.0, False, "2000-02-01", 1990)], "dong string, q int, price double, area double, is_cancelled boolean, deal_date string, build_year int").withColumn("deal_date", F.to_date("deal_date"))
    rent = spark.createDataFrame([("d", 8000, 9.0, 3.0, True)], "dong string, q int, deposit double, area double, is_jeonse boolean")
    for out in (ledger.sale_features(sale, sale), ledger.rent_features(rent)):
        assert out.count() == 4
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        above = [a for a, b in zip(lines, lines[1:], strict=False) if "partial_percentile" in b or "partial_median" in b]
        assert above and not any("Exchange" in a for a in above)


def test_provisional_sums_are_read_once(spark, monkeypatch):
    """Rows are read once for the dongs', the gus' and the city's sums; the last view is no join."""
    rows = spark.createDataFrame([("g", f"d{i % 3}", 8000 + i % 4, 1 + i % 90, float(i % 7)) for i in range(200)], "sgg_cd string, dong string, q int, day int, residual double")
    kept, store = [], nowcast.stored
    monkeypatch.setattr(nowcast, "stored", lambda df, label: kept.append(label) or store(df, label))
    seen = nowcast.provisional_index(rows)
    assert kept == ["provisional"] and "LogicalRDD" not in seen._jdf.queryExecution().optimizedPlan().toString()
    out = nowcast.revision_panel(seen)
    assert "SortMergeJoin [q" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0


def test_vintages_store_no_squares(spark):
    """Whatever the number of origins, what is written of a dong is its cells' sums."""
    rows = [("c%d" % (i % 20), "g%d" % (i % 2), "d%d" % (i % 4), 8000 + i * 7 % 12, (i % 7) / 10) for i in range(600)]
    valid = spark.createDataFrame(rows, "cell string, sgg_cd string, dong string, q int, log_ppm2 double")
    kept, real = {}, hedonic.stored
    try:
        hedonic.stored = lambda df, label: kept.setdefault(label, real(df, label))
        got = hedonic.hedonic_index(valid, origins=list(range(8003, 8012))).count()
    finally:
        hedonic.stored = real
    squares = [k for k, df in kept.items() if "w" in df.columns or "origin" in df.columns and "dong" in df.columns]
    assert got > 0 and not squares and kept["dongs"].count() == 4


@pytest.mark.parametrize("cells", [20_000, 2])
def test_shrinkage_equals_fits_of_all_halves(spark, monkeypatch, cells):
    """Sums by half, split after the sales are summed, against each half's own fit; also where dongs come in parts."""
    monkeypatch.setattr(hedonic, "CELLS", cells)
    rng = random.Random(3)
    rows = [(f"g{d % 2}", f"d{d}", f"d{d}_{rng.randrange(5)}", 8000 + rng.randrange(5), round(rng.gauss(0, 0.3), 1)) for d in range(6) for _ in range(90)]
    valid = spark.createDataFrame(rows + rows[:7], "sgg_cd string, dong string, cell string, q int, log_ppm2 double")
    got = {r["lam"]: r["mse"] for r in nowcast.select_shrinkage(valid, splits=1).collect()}
    each = valid.groupBy(*valid.columns).count().withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count")
    parts = each.withColumn("half", F.pmod(F.xxhash64(*valid.columns, "i"), F.lit(2))), each.withColumn("half", F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(2)))
    fits = [[{(r["dong"], r["q"]): r for r in hedonic.hedonic_index(p.where(F.col("half") == h)).where("n_sales > 0").collect()} for h in (0, 1)] for p in parts]
    for lam in (1.0, 5.0, 16.0):
        raw = lambda r: r["dq_effect"] * (r["n_sales"] + 5) / r["n_sales"]
        mse = [np.mean([(raw(a[k]) * a[k]["n_sales"] / (a[k]["n_sales"] + lam) - raw(b[k])) ** 2 for k in a.keys() & b.keys()]) for a, b in fits]
        assert got[lam] == pytest.approx(np.mean(mse), abs=1e-9)


def test_ranks_of_a_large_group_are_spread(spark):
    """Ties, a null group, a side that doesn't vary and null values, against plain Python; no task sorts a whole group."""
    rng = random.Random(9)
    rows = [(rng.choice(["x", None]), float(rng.randrange(6)), rng.choice([None, *[round(rng.gauss(0, 1), 1) for _ in range(5)]])) for _ in range(500)] + [("flat", 1.0, float(i)) for i in range(5)]
    got = windows.spearman(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"])
    found = {r["g"]: (r["n"], r["spearman"]) for r in got.collect()}
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    for g in ("x", None):
        own = [(a, b) for h, a, b in rows if h == g and b is not None]
        assert found[g] == (len(own), pytest.approx(np.corrcoef(rank([a for a, _ in own]), rank([b for _, b in own]))[0, 1], abs=1e-12))
    assert found["flat"] == (5, None) and len(found) == 3
    over = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
    assert over and all("_part" in line for line in over)


def test_vintage_sums_over_batches():
    """A cell's sums go to Python once, not once for each origin; dongs and cells that go on in the next batch are the same dongs."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted({(f"d{rng.randrange(6)}", rng.randrange(9), q): (rng.randrange(1, 4), rng.gauss(8, 1)) for q in range(8000, 8010) for _ in range(25)}.items())
    flat = [(d, "g", f"{d}-{c}", q, n, n * x) for (d, c, q), (n, x) in rows]
    want = {}
    for o in range(8003, 8010):
        for d, c in {(r[0], r[2]) for r in flat}:
            own = [r for r in flat if r[2] == c and r[3] <= o]
            for r in own:
                n, s = want.get((d, o, r[3]), (0, 0.0))
                want[d, o, r[3]] = n + r[4], s + r[5] - r[4] * sum(x[5] for x in own) / sum(x[4] for x in own)
    for size in (1, 7, 1000):
        names = ["dong", "sgg_cd", "cell", "q", "n", "s"]
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in flat[i : i + size]]) for i in range(0, len(flat), size)]
        got = [r for b in vintage._dong_sums(8003, 8009)(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["dong"], r["origin"], r["q"]): r["n_sales"] for r in got} == {k: v[0] for k, v in want.items()}
        assert all(abs(r["r"] - want[r["dong"], r["origin"], r["q"]][1]) < 1e-9 for r in got)


def test_a_fit_reads_its_own_origins(spark):
    """Every fit scanned the rows of all horizons and origins."""
    rows = spark.range(400).select((2 * (1 + F.col("id") % 2)).cast("int").alias("h"), (8000 + F.col("id") % 5).cast("int").alias("q"), F.col("id").cast("string").alias("dong"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    kept = []
    real, forecast.stored = forecast.stored, lambda df, label, by=(): kept.append(real(df, label, by)) or kept[-1]
    try:
        assert forecast.rolling_boosted(rows, ["x"], trees=1, depth=1).count() > 0
    finally:
        forecast.stored = real
    assert len(kept[0].inputFiles()) >= 10 and "PartitionFilters: [isnotnull(h" in kept[0].where("h = 2 and q <= 8001")._jdf.queryExecution().executedPlan().toString()
