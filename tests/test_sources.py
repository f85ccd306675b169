"""Readers, sinks, streams and checks on small files, with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from arealedger.functions import quarters, scalars
from arealedger.operators import catalog, forecast, geometry, quality, serving, windows
from arealedger.sources import files
from arealedger.streaming import vintages


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_tables_and_files(spark, tmp_path):
    tsv = put(tmp_path / "a.tsv", "lot\tn\n0012\t1\n0003\t\n")
    got = files.read_tsv(spark, tsv, ["lot", "n"])
    assert rows(got) == [("0003", None), ("0012", "1")]
    files.write_tsv(got, str(tmp_path / "out"))
    assert rows(files.read_tsv(spark, str(tmp_path / "out"), ["lot", "n"])) == rows(got)
    put(tmp_path / "json/sale_11680_202401.json", '{"price": 5}\n{"price": 6}\n')
    put(tmp_path / "json/rent_11680_202402.json", "")
    assert rows(files.read_trade_json(spark, str(tmp_path / "json"), "price int")) == [(5, "sale", "11680", "202401"), (6, "sale", "11680", "202401")]
    put(tmp_path / "v/20240101/sale/gu1_202401.json", '{"price": 7}\n')
    assert rows(files.read_vintages(spark, str(tmp_path / "v"), "price int")) == [(7, "20240101", "sale", "gu1", "202401")]


def test_derivations(spark, tmp_path):
    raw = spark.createDataFrame([("11", "2024", "3", "12,345", "O"), ("12", "2024", "11", "x", None)], "sggCd string, dealYear string, dealMonth string, dealAmount string, cdealType string")
    assert rows(files.derive_ledger(raw, {"11": "g"}).select("deal_ym", "gu", "is_cancelled", "deal_amount")) == [("202403", "g", True, 12345.0), ("202411", None, False, None)]
    events = put(tmp_path / "e.tsv", "event_id\teffective_date\tcategory\tlabel\tdirection\nE1\t2001-05-20\tpolicy\tx\ttighten\nE2\tbad\tpolicy\tx\tnone\n")
    assert [(r["event_id"], r["q"], r["score"]) for r in files.read_events(spark, events).collect()] == [("E1", 8005, 1), ("E2", None, 0)]
    spark.createDataFrame([("2001Q3",), ("bad",)], "quarter string").write.parquet(str(tmp_path / "p"))
    assert rows(files.read_panel(spark, str(tmp_path / "p")).select("q")) == [(8006,), (None,)]
    profile = files.profile_source(spark, events).first()
    assert profile["bytes"] == len(open(events).read()) and len(profile["sha256"]) == 64
    keyed = spark.createDataFrame([("1_a", "1", "a"), ("1_b", "1", "c"), (None, "1", " ")], "dong string, sgg_cd string, umd_nm string")
    assert quality.check_dong_key(keyed).count() == 2 and rows(quality.check_non_blank(keyed, ["dong", "umd_nm"])) == [("dong", 1), ("umd_nm", 1)]
    assert [r["column"] for r in quality.check_null_rate(keyed, ["dong", "sgg_cd"], 0.3).collect()] == ["dong"]
    assert quality.check_lineage(spark.createDataFrame([(5, 5), (5, 6)], "q int, label_vintage int")).count() == 1
    road = scalars.road_address("서울", F.lit("강남구"), F.lit("테헤란로 12"), F.lit("0012"), F.lit("0000"))
    assert one(spark, road) == ("서울 강남구 테헤란로 12",) and forecast.ladder_verdict(0.1, 0.01) and not forecast.ladder_verdict(-0.1, 0.01) and not forecast.ladder_verdict(None, 0.01)


def test_xml_pages(spark, tmp_path):
    put(tmp_path / "x/1.xml", "<r><resultCode>000</resultCode><items><item><aptSeq>A-1</aptSeq><FLOOR> 3 </FLOOR></item><item><APTSEQ>A-2</APTSEQ><floor> </floor></item></items></r>")
    put(tmp_path / "x/2.xml", "<r><resultCode>99</resultCode></r>")
    got, bad = files.read_trade_xml(spark, str(tmp_path / "x"), {"aptSeq": "apt_seq", "floor": "floor"})
    assert rows(got) == [("A-1", "3"), ("A-2", None)] and [r["code"] for r in bad.collect()] == ["99"]


def test_registries(spark, tmp_path):
    releases = spark.createDataFrame([(2024, 5, 1, "a"), (2024, 12, 1, "b"), (2024, 12, 2, "c"), (2023, 12, 9, "d")], "year int, month int, seq int, link string")
    assert rows(files.latest_release(releases)) == [(2024, 12, 2, "c")] and files.latest_release(releases.limit(0)).count() == 0
    reg = spark.createDataFrame([("1168010100" + "1" + "0012" + "0003", "Seoul x 12-3", "flat", "P"), ("1168010100" + "1" + "0012" + "0004", "Seoul x 12-3", "flat", "Q"), ("z", "Busan y", "flat", "R")], "pnu string, address string, kind string, name string")
    assert rows(files.parse_registry(reg, "Seoul", "flat")) == [("Seoul x 12-3", "P", "11680", "10100", "0012", "0003")]
    page = json.dumps({"items": {"item": [{"bldNm": " A ", "hhldCnt": "12", "useAprDay": "19990501"}, {"bldNm": "", "hhldCnt": "x"}]}})
    got = files.flatten_ledger(spark.createDataFrame([(page,), ("{}",)], "body string"), "body", {"bldNm": "name", "hhldCnt": "households", "useAprDay": "day"}, ["households"], "day")
    assert rows(got) == [("A", 12.0, "19990501", 1999), (None, None, None, None)] and files.with_households(got).count() == 1
    head = ",".join(f"h{i}" for i in range(15))
    line = lambda gu, kind="k": ",".join(["1", kind, gu, "z", "lot 3-1", *["x"] * 5, "120", "2001-05-02", "x", "2003.01.02", ""])
    zones = files.read_zones(spark, put(tmp_path / "z.csv", f"{head}\n{line('gu1')}\n{line('gu9')}\n{line('gu1', '')}\n"), ["gu1", "gu2"])
    assert rows(zones) == [("gu1", "lot 3-1", 120, 8005, 8012, None)]
    permits = files.read_permits(spark, put(tmp_path / "p.json", '{"result": [{"sn": "1"}, {"sn": "2"}]}'))
    assert sorted(r["r"]["sn"] for r in permits.collect()) == ["1", "2"]
    html = spark.createDataFrame([("<table><tr><td>2020</td><td>5월</td><td>1.25</td></tr><tr><td>x</td><td>1</td><td>2</td></tr></table>",)], "h string")
    assert rows(files.html_table_rows(html, "h")) == [("2020", "5월", 1.25)]


def test_summary(spark, tmp_path):
    files.write_summary(spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int"), str(tmp_path / "s"), {"as_of": "2024Q1"}, ["k", "v"])
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0]) == {"as_of": "2024Q1", "evidence": [{"k": "a", "v": 1}, {"k": "b", "v": 2}]}


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]


def test_geojson(spark, tmp_path):
    far = [[[x + 10, y] for x, y in SQUARE]]
    small = [[[x / 2, y / 2] for x, y in SQUARE]]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"dong": "a"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}}, {"type": "Feature", "properties": {"dong": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [small, far]}}, {"type": "Feature", "properties": {"x": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    got = files.read_geojson(spark, put(tmp_path / "g.json", json.dumps(body)))
    assert [r["type"] for r in got.collect()] == ["Polygon", "MultiPolygon", "Point"]
    shown = got.where("polygons is not null").select(F.col("properties")["dong"].alias("dong"), geometry.multi_centroid(F.col("polygons")).alias("c"), geometry.multi_bounds(F.col("polygons")).alias("b"), "polygons")
    by = {r["dong"]: r for r in shown.collect()}
    assert tuple(by["a"]["c"]) == (2, 2) and [round(v, 9) for v in by["b"]["c"]] == [9.8, 1.8] and tuple(by["b"]["b"]) == (0, 0, 14, 4)
    assert {(r["why"]) for r in quality.check_geojson(got, ["dong"]).collect()} == {"keys", "type", "ring", "number"} and quality.check_geojson(got.where("polygons is not null"), ["dong"]).count() == 0
    assert rows(quality.check_bounds(got, (0, 0, 5, 5), 2)) == [("count",), *[("outside",)] * 5]
    files.write_geojson(shown.select("dong", "polygons"), str(tmp_path / "w"), ["dong"])
    line = json.loads(spark.read.text(str(tmp_path / "w")).orderBy("value").first()[0])
    assert line["properties"] == {"dong": "a"} and line["geometry"]["coordinates"] == [[SQUARE, HOLE]]
    ring = F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in SQUARE])
    assert one(spark, geometry.ring_area(geometry.orient_ring(ring, True)), geometry.ring_area(geometry.orient_ring(ring, False))) == (-16, 16)


def test_publication(spark, tmp_path):
    root, a, b = str(tmp_path / "snap"), spark.range(5), spark.range(3).withColumn("x", F.lit("y"))
    assert files.publish_snapshot({"a": a, "b": b}, root, "1", {}, commit=True) == {"a": 5, "b": 3}
    assert files.publish_snapshot({"a": spark.range(7)}, root, "2", {}, commit=True, carry=("b",)) == {"a": 7, "b": 3}
    assert files.active(spark, root, "a").count() == 7 and files.active(spark, root, "b").count() == 3
    (tmp_path / "snap/_active/version=9").mkdir()  # a publication that failed before its pointer was complete
    with pytest.raises(ValueError):
        files.publish_snapshot({"a": a}, root, "3", {"bad": a}, commit=True)
    assert files.active(spark, root, "a").count() == 7
    assert rows(files.snapshot_counts(spark, root, ["a", "b"], "1", "2")) == [("a", 5, 7, 2), ("b", 3, 3, 0)]
    batch = spark.createDataFrame([("202401", 1), ("202403", 2)], "deal_ym string, v int")
    dry = files.publish_batch(batch, "sale", str(tmp_path / "b"), "1").first()
    done = files.publish_batch(batch, "sale", str(tmp_path / "b"), "1", commit=True).first()
    assert dry == done and tuple(done)[:4] == ("sale", 2, "202401", "202403")


def test_streams(spark, tmp_path):
    schema = "as_of string, kind string, ym string, dong string, q int"
    make = lambda name, data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = lambda name: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    first = [("d1", "sale", "202401", "a", 8000)] * 15 + [("d1", "rent", "202401", "a", 8001)] * 6
    make("in", first)
    add = lambda: vintages.append_new(stream("in"), ["as_of", "kind", "ym"], str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    count = lambda: vintages.upsert_manifest(stream("in"), str(tmp_path / "man"), str(tmp_path / "c2")).awaitTermination()
    add(), count()
    make("in", [first[0]] * 4 + [("d2", "sale", "202402", "a", 8004)])
    add(), count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 22  # the key that came again is skipped
    assert rows(vintages.manifest(spark, str(tmp_path / "man"))) == [("d1", "rent", "202401", 6), ("d1", "sale", "202401", 19), ("d2", "sale", "202402", 1)]
    q = vintages.stream_eligibility(stream("in")).writeStream.outputMode("update").format("memory").queryName("elig").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("elig").orderBy(F.desc("q")).first()
    assert (last["q"], last["n_4q"], last["eligible"]) == (8004, 7, False)
    assert vintages.quarter_counts(spark.createDataFrame([("2024-01-05", "x"), ("2024-05-05", "x")], "ts string, event_type string")).count() == 2
    curve = {(r["q"], r["day"]): r["share"] for r in vintages.arrival_curve(spark.createDataFrame([(1, 10, 3), (1, 20, 1)], "q int, day int, n int")).collect()}
    assert curve == {(1, 10): 0.75, (1, 20): 1.0}


def test_checks(spark, tmp_path):
    assert [r["cells"] for r in quality.check_width(spark, put(tmp_path / "w.tsv", "a\tb\n1\t2\n1\n\n1\t2\t3\n"), ["a", "b"]).collect()] == [1, 3]
    flags = spark.createDataFrame([("a", "FEW_SALES; X"), ("b", ""), ("c", None), ("d", "FEW_SALES")], "dong string, flags string")
    assert [(r["dong"], r["unknown"]) for r in quality.check_flags(flags, "flags", ["FEW_SALES"]).collect()] == [("a", ["X"])]
    peers = spark.createDataFrame([("a", '[{"dong": "b", "reason": "r"}]'), ("b", "[]"), ("c", '[{"dong": "z", "reason": "r"}]'), ("d", '[{"dong": "d", "reason": "r"}]'), ("e", None)], "dong string, peers string")
    assert rows(quality.check_peers(peers, "peers", peers)) == [("b", "shape"), ("c", "unknown"), ("d", "itself")]
    shares = spark.createDataFrame([(0, None), (0, 0.5), (3, None), (3, 0.1)], "n int, s double")
    assert quality.check_zero_share(shares, "n", "s").count() == 2
    assert quality.schema_diff(shares, {"n": ("bigint", True), "s": ("double", False), "z": ("int", True)}) == ["missing z", "n is int, not bigint", "s may be null"]
    assert quality.check_echo(spark.createDataFrame([("1", "1"), ("1", None)], "a string, b string"), "a", "b").count() == 1
    preds = spark.createDataFrame([("v", 1), ("w", 1), ("v", 2)], "variant string, k int")
    assert [r["k"] for r in quality.same_row_sets(preds, "variant", ["k"]).collect()] == [2]
    known = spark.createDataFrame([(str(i), "x") for i in range(200)] + [("0", "y")], "code string, dong string")
    assert rows(quality.dictionary_conflicts(known, ["code"], "dong")) == [("0", 2)]
    with pytest.raises(ValueError):
        quality.dictionary_conflicts(known.limit(20).union(known.where("dong = 'y'")), ["code"], "dong")
    assert rows(quality.filled_rates(spark.createDataFrame([("g", 1), ("g", None), ("h", 2)], "gu string, lat int"), "lat", "gu", 1)) == [("g", 2, 0.5), (None, 3, 2 / 3)]
    trades = spark.createDataFrame([("k", "b", 2000), ("k", "a", 2010), ("k", " ", 2020), ("k", "a", 2000), ("k", "b", 2000)], "k string, name string, year int")
    assert rows(quality.master_of(trades, "k", ["name"], "year")) == [("k", "a", 2000.0, 5)]
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(1, 1.0), (3, 2.0)], "k int, v double")
    assert rows(quality.key_diff(a, b, ["k"])) == [(2, "a"), (3, "b")] and quality.check_consistent(a, b, ["k"], "v").count() == 2
    assert rows(quality.check_subset(a, b, ["k"])) == [(2, 2.0)] and rows(quality.check_coverage(a, b, ["k"])) == [(3, 2.0)]
    assert rows(quality.fill_rates(spark.createDataFrame([(1, None), (2, 3)], "x int, y int"))) == [(1.0, 0.5)] and tuple(quality.missing_counts(flags, ["flags"]).first()) == (2,)
    assert quality.check_pattern(flags, "dong", "^[ab]$").count() == 2
    assert rows(quality.boundary_match(flags, spark.createDataFrame([("a", "e")], "dong string, emd string")))[0] == ("a", "e", True)
    reg = spark.createDataFrame([("a", "P")], "dong string, place string")
    assert quality.match_registry(flags, reg, "dong").where("matched").count() == 1
    assert quality.with_gu_name(spark.createDataFrame([("1",), ("2",)], "sgg_cd string"), {"1": "one"}).where("gu_name is null").count() == 1


def test_scalars(spark):
    price = lambda x: scalars.format_price(F.lit(x))
    assert one(spark, price(0), price(9999.6), price(12345), price(30000), price(500)) == ("0", "1억", "1억 2,345", "3억", "500")
    zone = lambda a: scalars.zone_neighbourhood(F.lit(a), F.lit("강남구"))
    assert one(spark, zone("강남구 역삼동 12-3"), zone("상계1동 35"), zone("역삼동 산 12"), zone("역삼동 1, 2"), zone("대치동")) == ("역삼동", "상계1동", "역삼동", None, None)
    assert one(spark, quarters.quarter_label(F.lit(8004)), quarters.parse_quarter(F.lit("2001Q1")), quarters.ym_to_quarter(F.lit("202608")), quarters.ym_minus_months(F.lit("202401"), 23)) == ("2001Q1", 8004, "2026Q3", "202202")
    assert one(spark, *quarters.quarter_months(F.lit("2026Q3"))) == ("202607", "202609")
    assert one(spark, serving.format_ym(F.lit("202608")), serving.format_ym(F.lit("x"))) == ("2026-08", "x")
    assert one(spark, scalars.with_particle(F.lit("세대수"), "과", "와"), scalars.with_particle(F.lit("비중"), "과", "와")) == ("세대수와", "비중과")
    assert one(spark, scalars.strict_bool(F.lit(" TRUE")), scalars.strict_bool(F.lit("maybe")), scalars.number_or_null(F.lit("1,234.5")), scalars.number_or_null(F.lit("x")), scalars.blank_to_null(F.lit("  "))) == (True, None, 1234.5, None, None)
    assert one(spark, scalars.parse_flags(F.lit("FEW_SALES; X;HIGH_INDEX_ERROR")), scalars.format_share(F.lit(0.456)), scalars.format_pct(F.lit(3.21)), scalars.format_pct(F.lit(-1.0))) == (["FEW_SALES", "HIGH_INDEX_ERROR"], "46%", "+3.2%", "-1.0%")
    assert one(spark, scalars.normalize_address(F.lit("서울 강남구  역삼동 산 12"), "서울"), scalars.lot_address("서울", F.lit("강남구"), F.lit("역삼동"), F.lit("0012"), F.lit("0000"))) == ("강남구 역삼동 산12", "서울 강남구 역삼동 12")
    assert one(spark, scalars.safe_ratio(F.lit(1.0), F.lit(0.0)), scalars.unshrink(scalars.shrink(F.lit(2.0), F.lit(10), 5.0), F.lit(10), 5.0), scalars.enum_or_null(F.lit("z"), ["a"])) == (None, 2.0, None)
    interval = one(spark, scalars.pct_interval(F.lit(0.0), F.lit(0.1)))[0]
    assert round(interval["est"], 6) == 0 and interval["lower"] < 0 < interval["upper"]
    encoded = spark.range(1).select(scalars.encode_peers(F.array(F.struct(F.lit("a").alias("dong"), F.lit("r").alias("reason")))).alias("p")).select("p", scalars.peers_valid(F.col("p"))).first()
    assert tuple(encoded) == ('[{"dong":"a","reason":"r"}]', True)
    rounded = spark.createDataFrame([([[[[1.23456789, 2.0]]]],)], "p array<array<array<array<double>>>>").select(scalars.round_coords(F.col("p"))).first()[0]
    assert rounded == [[[[1.234568, 2.0]]]]


def test_catalog(spark):
    permit = spark.createDataFrame([("시전체 市전체", "아파트", None), ("市 전체", "외국인 아파트", ""), ("일부", "아파트", "")], "a string, k string, r string")
    assert rows(catalog.basis(permit, "a", "k", "r", ["a", "r"])) == [("시전체 市전체", "")]
    assert catalog.select_features(["x", "y"], {"g": ["x"], "h": ["y"]}, ["h"]) == ["x"]
    with pytest.raises(ValueError):
        catalog.select_features(["z"], {"g": ["x"]})
    assert rows(catalog.interactions(spark.createDataFrame([(2, 3)], "x int, y int"), [("x", "y")])) == [(2, 3, 6)]
    old = spark.createDataFrame([(c, i // 3) for i, c in enumerate("abcdef")], "dong string, cluster int")
    new = spark.createDataFrame([(c, 7 if i < 4 else 9) for i, c in enumerate("abcdef")], "dong string, cluster int")
    assert {r["dong"]: r["cluster"] for r in catalog.align_labels(old, new).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1, "f": 1}


def test_served_pages(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0), ("e", 2.0)], "dong string, v double")
    order = lambda x: [r["dong"] for r in x.collect()]
    assert order(serving.sort_dongs(df, "v", "dong")) == ["c", "d", "e", "a", "b"] and order(serving.sort_dongs(df, "v", "dong", False)) == ["a", "e", "c", "d", "b"]
    assert order(serving.page(df, [F.col("dong")], 2, 2)) == ["c", "d"] and order(serving.page(df, [F.col("dong")], 99, 2)) == ["e"] and order(serving.page(df, [F.col("dong")], -1, 2)) == ["a", "b"]
    assert serving.distinct_values(df, "v").count() == 3 and serving.non_zero(df, "v").count() == 4
    bands = serving.price_bands(spark.createDataFrame([(100 * i,) for i in range(1, 9)], "p int"), "p")
    assert rows(bands) == [(1, 100, 300), (2, 301, 500), (3, 501, 700), (4, 701, 800)] and serving.price_bands(bands.limit(3).withColumnRenamed("low", "p"), "p").count() == 0
    types = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", None, None)], "dong string, structure_type int, structure_desc string")
    assert rows(serving.structure_options(types)) == [(1, "x")]
    b = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "dong string, gu_name string")
    assert serving.visible_boundaries(b, "gu").count() == 2 and serving.visible_boundaries(b, "dong", "g").count() == 2 and serving.visible_boundaries(b, "ids", ids=b.limit(1)).count() == 1
    assert serving.area_window(spark.createDataFrame([("2024-02-10",)], "d string").select(F.to_date("d").alias("deal_date"))) == "202203"


def test_forecast_tools(spark, tmp_path):
    metrics = spark.createDataFrame([("s", v, "mae", x) for v, x in (("B", 1.0), ("M1", 0.9), ("M2", 0.9), ("M3", 0.995))], "segment string, variant string, metric string, value double")
    chosen = lambda names: [r["candidate"] for r in forecast.select_models(metrics, "s", "B", names, "mae").where("selected").collect()]
    assert chosen(["M2", "M1", "M3"]) == ["M2"] and chosen(["M3"]) == ["B"]
    dongs = spark.createDataFrame([("a", True), ("b", False)], "dong string, eligible boolean")
    got = {r["dong"]: r for r in forecast.score_latest(dongs, spark.createDataFrame([("a", 0.0), ("b", 0.1)], "dong string, y_hat double"), F.lit(0.1)).collect()}
    assert got["a"]["status"] == "PREDICTED" and got["b"]["est"] is None and got["a"]["lower"] < 0 < got["a"]["upper"]
    series = spark.createDataFrame([(i, 1.0 + 0.1 * (i % 3), 0.5) for i in range(20)], "q int, a double, b double")
    assert forecast.dm_test(series, "a", "b", 2).first()["p"] < 1e-6
    forecast.save_model_card(spark.createDataFrame([(1, 0.5)], "q int, coef double"), str(tmp_path / "card"), {"alpha": 1}, {"x": "ab"})
    assert json.loads(json.loads(spark.read.text(str(tmp_path / "card")).first()[0])["params"]) == {"alpha": 1}
    train = spark.createDataFrame([(q, float(x), 2.0 * x) for q in range(4) for x in range(30)], "q int, x double, r double")
    boosted = forecast.boosted_relative(train, train, ["x"], trees=5)
    assert boosted.count() == 120 and boosted.stat.corr("centered", "r") > 0.9
    hist = spark.createDataFrame([(q, k, float((q * 7 + k * 3) % 11)) for q in range(12) for k in range(9)], "q int, k int, v double")
    got = {(r["q"]): (r["half"], r["n"]) for r in windows.running_order_statistic(hist, "v", 0.8, [], 2, "half", 20).collect()}
    for q in range(12):
        seen = sorted(float((s * 7 + k * 3) % 11) for s in range(12) if s + 2 <= q for k in range(9))
        n = len(seen)
        assert got.get(q) == ((seen[min(-(-(n + 1) * 8 // 10), n) - 1], n) if n >= 20 else None)
