"""Clusters over time, rolling boosted trees, streams, shapes and checks against plain Python on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealedger.operators import cluster, forecast, geometry, ledger, panel, quality, serving, support
from arealedger.sources import files
from arealedger.streaming import vintages


def lloyd(points, k, starts, rounds):
    """points {item: (x, w)}: the cheapest start's cluster of each item."""
    best = None
    for s in range(starts):
        order = sorted(points, key=lambda d: hashlib.md5(f"{s}:{d}".encode()).hexdigest())
        centres = [np.array(points[d][0]) for d in order[:k]]
        near = lambda x, c: [round(float(((np.array(x) - y) ** 2).sum()), 9) for y in c]
        for _ in range(rounds):
            own = {d: int(np.argmin(near(x, centres))) for d, (x, _) in points.items()}
            for c in range(k):
                mine = [points[d] for d in own if own[d] == c]
                if mine:
                    centres[c] = sum(w * np.array(x) for x, w in mine) / sum(w for _, w in mine)
        own = {d: int(np.argmin(near(x, centres))) for d, (x, _) in points.items()}
        cost = round(sum(w * min(near(x, centres)) for x, w in points.values()), 6)
        if best is None or cost < best[0]:
            best = (cost, own)
    return best[1]


def test_keyed_kmeans_equals_plain_rounds(spark):
    rng = random.Random(2)
    rows = [(t, f"d{i}", [rng.gauss(i % 3 * (1 + t), 1), rng.gauss(i % 2, 1)], rng.random() + 0.1) for t in range(3) for i in range(20 + t)]
    rows.append((9, "alone", [1.0, 2.0], 1.0))  # fewer points than clusters
    df = spark.createDataFrame(rows, "as_of int, dong string, x array<double>, w double")
    got = {(r["as_of"], r["k"], r["dong"]): r["cluster"] for r in cluster.keyed_kmeans(df, [2, 3], 2, starts=4, rounds=5).collect()}
    assert len(got) == 2 * len(rows)
    for t in range(3):
        points = {d: (x, w) for at, d, x, w in rows if at == t}
        for k in (2, 3):
            assert {d: got[t, k, d] for d in points} == lloyd(points, k, 4, 5)
    assert got[9, 2, "alone"] == 0
    assert cluster.keyed_kmeans(df.limit(0), [2], 2, starts=2, rounds=1).count() == 0


def test_standardized_leaves_out_gaps_and_small_times(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0), (1, "b", 3.0, 5.0), (1, "c", None, 5.0), (2, "a", 1.0, 1.0)], "as_of int, dong string, p double, q double")
    got = cluster.standardized(df, ["p", "q"], ["as_of"], least=2).collect()
    assert sorted((r["as_of"], r["dong"], tuple(r["x"])) for r in got) == [(1, "a", (-1.0, 0.0)), (1, "b", (1.0, 0.0))]


def test_labels_carry_on_and_agreement_is_that_of_pairs(spark):
    rng = random.Random(4)
    truth = {f"d{i}": i % 3 for i in range(30)}
    rows, turns = [], {}
    for t in range(5):
        turn = turns[t] = rng.sample(range(3), 3)
        for d, c in truth.items():
            if not (t == 2 and d == "d7"):
                rows.append((t, 3, d, turn[c] if not (t == 3 and d == "d4") else turn[(c + 1) % 3]))
    df = spark.createDataFrame(rows, "as_of int, k int, dong string, cluster int")
    got = {(r["as_of"], r["dong"]): r["label"] for r in cluster.aligned(df).collect()}
    assert all(got[t, d] == turns[0][truth[d] if (t, d) != (3, "d4") else (truth[d] + 1) % 3] for t, d in got) and len(got) == len(rows)
    without = {(r["as_of"], r["dong"]): r["label"] for r in cluster.aligned(df, by=()).collect()}
    assert without == got
    label = {(t, d): c for t, _, d, c in rows}
    for r in cluster.agreement(cluster.adjacent(df), ["k", "as_of"]).collect():
        both = [d for d in truth if (r["as_of"], d) in label and (r["as_of"] - 1, d) in label]
        same = [[(label[t, a] == label[t, b]) for i, a in enumerate(both) for b in both[:i]] for t in (r["as_of"] - 1, r["as_of"])]
        s, a, b, n = sum(p and q for p, q in zip(*same, strict=True)), sum(same[0]), sum(same[1]), len(same[0])
        assert r["n"] == len(both) and abs(r["ari"] - (s - a * b / n) / ((a + b) / 2 - a * b / n)) < 1e-9
    steady = {r["k"]: r["chosen"] for r in cluster.stability(df.union(df.select("as_of", F.lit(4).alias("k"), "dong", F.pmod(F.xxhash64("dong", "as_of"), F.lit(4)).cast("int")))).collect()}
    assert steady == {3: True, 4: False}


def test_delta_clusters_find_planted_paths_and_the_rest_follow_mates(spark):
    rng, rows, now, mates = random.Random(3), [], [], []
    for i in range(66):
        up = i % 2
        level = 0.0
        for q in range(0, 9):
            level += (0.03 if up == (q % 2) else -0.03) + rng.gauss(0, 0.001)
            if not (i == 65 and q == 2):
                rows.append((8, f"d{i}", q, level))
        now.append((8, f"d{i}", i < 60 or i == 65, 0.01 + 0.001 * (i % 5)))
        mates.append((8, f"d{i}", up if i != 64 else 9))
    vintage = spark.createDataFrame(rows, "origin int, dong string, q int, log_index double")
    weights = spark.createDataFrame([(f"d{i}", 5) for i in range(0, 66, 3)], "dong string, w int")
    paths = cluster.delta_paths(vintage, weights)
    made = {r["dong"]: r["x"] for r in paths.collect()}
    assert made["d65"] is None and all(len(made[f"d{i}"]) == 4 for i in range(65))
    step = lambda i, k: dict((q, v) for _, d, q, v in rows if d == f"d{i}")[k] - dict((q, v) for _, d, q, v in rows if d == f"d{i}")[k - 1]
    common = np.mean([step(i, 2) for i in range(0, 66, 3)])
    assert abs(made["d5"][1] - (step(5, 2) - common)) < 1e-9
    got = {r["dong"]: (r["cluster"], r["core"]) for r in cluster.delta_clusters(paths, spark.createDataFrame(now, "as_of int, dong string, eligible boolean, se double"), spark.createDataFrame(mates, "as_of int, dong string, cluster int"), 2, starts=5, rounds=4).collect()}
    assert {got[f"d{i}"][0] for i in range(0, 60, 2)} != {got[f"d{i}"][0] for i in range(1, 60, 2)} and all(got[f"d{i}"] == (got[f"d{i % 2}"][0], True) for i in range(60))
    assert all(got[f"d{i}"] == (got[f"d{i % 2}"][0], False) for i in (60, 61, 62, 63, 65)) and "d64" not in got


def test_boosted_origins_learn_only_what_was_known(spark):
    rng = random.Random(1)
    rows = [(h, q, f"d{i}", x := rng.gauss(0, 1), (2 * x + rng.gauss(0, 0.1)) if q + h < 14 else None) for h in (2, 4) for q in range(14) for i in range(12)]
    schema = "h int, q int, dong string, x double, y double"
    fit = lambda r: {(a["h"], a["q"], a["dong"]): a for a in forecast.rolling_boosted(spark.createDataFrame(r, schema), ["x"], trees=3, depth=2, least_origins=2, least_rows=20).collect()}
    few = [r for r in rows if r[1] < 9]
    got = fit(few)
    assert {k[:2] for k in got} == {(h, q) for h in (2, 4) for q in range(9) if q - h >= 1}
    assert all(a["label_vintage"] <= a["q"] and a["label_vintage"] == a["q"] for a in got.values()) and all(a["n_train"] == 12 * (a["q"] - a["h"] + 1) for a in got.values())
    later = [(h, q, d, x, y if q + h <= 6 else 1e6) for h, q, d, x, y in few]  # what isn't known at 6 may be anything
    again = fit(later)
    assert all(abs(again[k]["pred"] - a["pred"]) < 1e-9 for k, a in got.items() if k[1] == 6)
    y = {(h, q, d): y for h, q, d, _, y in rows}
    assert sum(abs(y[k] - a["pred"]) for k, a in got.items()) < 0.6 * sum(abs(y[k]) for k in got)
    assert quality.check_lineage(spark.createDataFrame([(1, 2), (3, 3)], "q int, label_vintage int")).count() == 1


def test_eligibility_stream_equals_batch_with_late_rows(spark, tmp_path):
    batches = [[("a", q) for q in (8000, 8001, 8002, 8003) for _ in range(6)] + [("a", 8006)] + [("b", 8001)] * 25, [("a", 8004)] * 15 + [("a", 8001)] * 2, [("c", 8006)] * 21]
    made = []
    for i, rows in enumerate(batches):
        made += rows
        spark.createDataFrame(rows, "dong string, q int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("dong string, q int").parquet(str(tmp_path / "in"))
        out = vintages.stream_eligibility(stream, ahead=3, first=8000)
        vintages.latest_rows(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = {(r["dong"], r["q"]): (r["n_4q"], r["eligible"]) for r in vintages.latest(spark, ["dong", "q"], str(tmp_path / "out")).where("q <= 8006").collect()}
        want = {(r["dong"], r["q"]): (r["n_sales_4q"], r["eligible"]) for r in ledger.eligible(spark.createDataFrame(made, "dong string, q int"), 8000, 8006).collect()}
        first = {d: min(q for k, q in made if k == d) for d, _ in made}
        assert got == {k: v for k, v in want.items() if k[1] >= first[k[0]] and (v[0] is None or v[0] > 0 or k[1] <= max(q for d, q in made if d == k[0]) + 3)}, i
    with_time = spark.readStream.schema("dong string, q int").parquet(str(tmp_path / "in")).withColumn("ts", F.make_date(F.lit(2000), F.lit(1), F.lit(1)).cast("timestamp")).withWatermark("ts", "1 day")
    vintages.latest_rows(vintages.stream_eligibility(with_time, ts="ts"), str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination()
    assert vintages.latest(spark, ["dong", "q"], str(tmp_path / "out2")).where("dong = 'a'").count() == 7


def test_days_are_recounted_whole(spark, tmp_path):
    def land(rows):
        spark.createDataFrame(rows, "as_of string, kind string, ym string, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("as_of string, kind string, ym string, id int").parquet(str(tmp_path / "in"))
        vintages.ingest_days(stream, ["as_of", "kind", "ym", "id"], str(tmp_path / "rows"), str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination()
        return {(r["as_of"], r["kind"], r["ym"]): r["n"] for r in spark.read.schema("kind string, ym string, n bigint, as_of string").parquet(str(tmp_path / "counts")).collect()}

    land([("2024-01-01", "sale", "202401", i) for i in range(5)])
    assert run() == {("2024-01-01", "sale", "202401"): 5}
    land([("2024-01-01", "sale", "202401", 3), ("2024-01-01", "sale", "202401", 9), ("2024-01-01", "rent", "202401", 1), ("2024-01-02", "sale", "202401", 1)])
    want = {("2024-01-01", "sale", "202401"): 6, ("2024-01-01", "rent", "202401"): 1, ("2024-01-02", "sale", "202401"): 1}
    assert run() == want
    again = spark.createDataFrame([("2024-01-01", "sale", "202401", 3), ("2024-01-01", "rent", "202401", 2), ("2024-01-03", "sale", "202401", 1)], "as_of string, kind string, ym string, id int")
    for _ in range(2):  # a batch that comes again replaces itself
        vintages.put_days(again, 2, ["as_of", "kind", "ym", "id"], str(tmp_path / "rows"), str(tmp_path / "counts"))
    assert run() == want | {("2024-01-01", "rent", "202401"): 2, ("2024-01-03", "sale", "202401"): 1}
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 10


def test_points_in_shapes_with_holes_and_parts(spark):
    rng = random.Random(8)
    ring = lambda *p: [list(map(float, q)) for q in (*p, p[0])]
    shapes = {
        "holed": [[ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (7, 3.5), (5, 8))]],
        "parts": [[ring((12, 0), (18, 1), (14, 9))], [ring((20, 0), (22, 0), (22, 2), (20, 2)), ring((20.5, 0.5), (21.5, 0.5), (21, 1.5))]],
        "tiny": [[ring((0.11, 0.11), (0.13, 0.11), (0.12, 0.14))]],
        "none": [],
    }
    points = [(i, rng.uniform(-2, 24), rng.uniform(-2, 12)) for i in range(2000)] + [(9000, 0.12, 0.12), (9001, None, 1.0), (9002, 5.0, 5.0)]

    def holds(x, y, rings):
        n = 0
        for r in rings:
            for (x0, y0), (x1, y1) in zip(r, r[1:]):
                n += (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
        return n % 2 == 1

    want = Counter((i, k) for i, x, y in points if x is not None for k, s in shapes.items() if holds(x, y, [r for part in s for r in part]))
    df = spark.createDataFrame(points, "id int, x double, y double")
    frame = spark.createDataFrame(list(shapes.items()), "key string, polygons array<array<array<array<double>>>>")
    for cell in (0.5, 3.0):
        assert Counter(map(tuple, geometry.points_in_multipolygons(df, frame, cell).select("id", "key").collect())) == want
    cover = geometry.grid_cover(frame, 0.5)
    assert cover.groupBy("key", "cx", "cy").count().where("count > 1").count() == 0 and cover.where("not border").count() > 100
    box = geometry.collective_bounds(frame.withColumn("all", F.lit(1)), ["all"]).first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"], box["n"]) == (0, 0, 22, 10, 3)


def test_events_out_of_reach_have_rows_with_reasons(spark):
    index = spark.createDataFrame([(d, q, g * (q - 8000), q != 8007) for d, g in (("a", 0.1), ("b", -0.02)) for q in range(8000, 8012)], "dong string, q int, log_index double, eligible boolean")
    events = spark.createDataFrame([(1, "in", 8006), (2, "early", 8002), (3, "late", 8010), (4, "before", 8000), (5, "far", 8040), (6, "thin", 8008)], "pos int, event_id string, q int")
    got = {r["event_id"]: r for r in panel.event_outcomes(index, events).collect()}
    assert (got["in"]["n_dongs"], got["in"]["n_post"]) == (2, 2) and abs(got["in"]["pre_change"] - 0.16) < 1e-9 and abs(got["in"]["post_change"] - 0.16) < 1e-9
    assert (got["in"]["share_up"], got["in"]["same_direction"], got["in"]["overlaps"], got["in"]["note"]) == (0.5, 0.5, "early,late,thin", "")
    assert not got["early"]["pre_observable"] and got["early"]["pre_change"] is None and got["early"]["post_change"] is not None
    assert not got["late"]["post_observable"] and got["late"]["post_change"] is None and got["late"]["n_post"] == 0 and got["late"]["n_dongs"] == 2
    assert got["before"]["note"] == panel.OUTSIDE_BASE and got["far"]["note"] == f"{panel.OUTSIDE_EVENT}; {panel.OUTSIDE_BASE}" and got["far"]["n_dongs"] == 0
    assert got["thin"]["n_dongs"] == 0 and got["thin"]["note"] == ""


def test_recount_finds_a_planted_error(spark):
    sales = spark.createDataFrame([("a", f"c{i % 3}", 8000 + i % 6) for i in range(40)] + [("b", "c9", 8005)], "dong string, apt_seq string, q int")
    again = quality.recount_concentration(sales, 8005)
    rows = ledger.complex_concentration(sales).where("as_of = 8005").select("dong", F.col("n_complexes_4q").alias("n_complexes"), F.col("sale_n_valid_4q").alias("sale_n"), F.col("dominant_share_4q").alias("dominant_share"))
    assert support.recount(rows, again).count() == 0
    for c in ("n_complexes", "sale_n", "dominant_share"):
        wrong = rows.withColumn(c, F.when(F.col("dong") == "a", F.col(c) + 1).otherwise(F.col(c)))
        assert [r["dong"] for r in support.recount(wrong, again).collect()] == ["a"]


def test_meta_says_whether_a_permit_covers_the_city(spark):
    sale = spark.createDataFrame([("2000-01-05",)], "deal_date string").select(F.to_date("deal_date").alias("deal_date"))
    index = spark.createDataFrame([(8000,)], "q int")
    flag = lambda rows: serving.serve_meta(index, sale, sale, spark.createDataFrame(rows, "area string, kind string, remark string")).first()["permit_zone"]
    assert flag([("市 전체", "아파트", None)]) and not flag([("市 전체", "외국인 아파트", None), ("강남구", "아파트", None)]) and flag([("市전체", None, "아파트")]) and not flag([])


def test_coverage_counts_complexes_that_nothing_maps(spark):
    own = spark.createDataFrame([("x", "1", "00001", 10), ("y", "1", "00001", 5), ("z", "1", "00002", 25)], "apt_seq string, sgg_cd string, bjd_code string, households int")
    mapped = ledger.map_complexes(own, spark.createDataFrame([("x", "1_A")], "apt_seq string, dong string"))
    assert tuple(ledger.household_coverage(own, mapped).first()) == (40, 15, 0.375, False)


def test_a_failed_publication_can_run_again(spark, tmp_path):
    root, good = str(tmp_path), spark.range(4)
    bad = good.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        files.publish_snapshot({"a": good, "b": bad}, root, "1", {}, commit=True)
    assert files.publish_snapshot({"a": spark.range(6), "b": good}, root, "1", {}, commit=True) == {"a": 6, "b": 4}
    assert files.active(spark, root, "a").count() == 6
    with pytest.raises(ValueError, match="published already"):
        files.publish_snapshot({"a": good}, root, "1", {}, commit=True)


def test_entities_are_decoded(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text("<r><resultCode>00</resultCode><item><aptNm>A &amp; B &lt;1&gt; &#44032;&#x1F600; &amp;lt;</aptNm></item></r>", encoding="utf-8")
    got, _ = files.read_trade_xml(spark, str(tmp_path / "x"), {"aptNm": "name"})
    assert got.first()["name"] == "A & B <1> 가😀 &lt;"


def test_schema_report_names_each_difference(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "y", None), (2, None, 7)], "id int, name string, b int")
    b = spark.createDataFrame([(5,)], "id int")
    declared = {
        "a": {"columns": {"id": "bigint", "name": "string", "gone": "int"}, "required": ["name", "gone"], "key": ["id"], "references": [(["b"], "b", ["id"])], "checks": {"small": "b < 6"}},
        "b": {"columns": {"id": "int"}, "key": ["id"]},
        "c": {"columns": {}},
    }
    got = {tuple(r) for r in quality.schema_report({"a": a, "b": b, "d": b}, declared).collect()}
    assert got == {("c", "table", "c", "missing", 1), ("d", "table", "d", "unexpected", 1), ("a", "column", "gone", "missing", 1), ("a", "column", "b", "unexpected", 1), ("a", "type", "id", "int, not bigint", 1), ("a", "required", "name", "null", 1), ("a", "key", "id", "repeated", 1), ("a", "reference", "b -> b", "orphaned", 1), ("a", "check", "small", "violated", 1)}
    assert quality.schema_report({"b": b}, {"b": declared["b"]}).count() == 0


@pytest.mark.parametrize("name", ["conformal_intervals", "interval_coverage", "rolling_baselines", "gamma_choice", "empirical_intervals", "mae_bootstrap", "error_gap_bootstrap", "event_study", "hedonic_index"])
def test_index_queries_read_the_ledger_seldom(spark, name):
    from arealedger.plans import forecasts, queries, serving  # noqa: F401

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 3 and "CartesianProduct" not in plan
