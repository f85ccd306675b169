"""Data-quality checks: each returns its violations as rows, none where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import peers_valid


def check_header(df: DataFrame, columns: list[str]) -> list[str]:
    """Differences from the exact, ordered header."""
    out = [f"missing {c}" for c in columns if c not in df.columns] + [f"unexpected {c}" for c in df.columns if c not in columns]
    return out or (["order differs"] if df.columns != columns else [])


def strict_cast_violations(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, value, n) of text that isn't blank and doesn't cast. Booleans take true, false, 1, 0 only."""
    parts = []
    for c, t in types.items():
        ok = F.lower(F.trim(c)).isin("true", "false", "1", "0") if t == "boolean" else F.trim(F.col(c)).try_cast(t).isNotNull()
        parts.append(F.when(F.col(c).isNotNull() & (F.trim(c) != "") & ~ok, F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))))
    return df.select(F.explode(F.array_compact(F.array(*parts))).alias("v")).groupBy("v.column", "v.value").agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns])


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def check_enum(df: DataFrame, column: str, allowed: list[str], nullable: bool = True) -> DataFrame:
    return df.where(F.when(F.col(column).isNull(), F.lit(not nullable)).otherwise(~F.col(column).isin(allowed)))


def check_subset(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def check_coverage(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Spine rows that have no row."""
    return spine.join(df.select(*keys).distinct(), keys, "left_anti")


def key_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("a")).union(y.join(x, keys, "left_anti").withColumn("side", F.lit("b")))


def fill_rates(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])


def check_consistent(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """Keys on which two derivations of a value disagree, or one has none."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return both.where((F.abs(F.col("a") - F.col("b")) > tol) | (F.col("a").isNull() != F.col("b").isNull()))


def check_width(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """(file, line, cells) of lines whose number of cells isn't that of the header; lines are looked at as text."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.col("value") != "")
    return lines.withColumn("cells", F.size(F.split("value", sep, -1))).where(F.col("cells") != len(columns)).select("file", F.col("value").alias("line"), "cells")


def check_flags(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows with a flag that isn't known, with those flags."""
    found = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn("unknown", F.array_except(found, F.array(*[F.lit(x) for x in known]))).where(F.size("unknown") > 0)


def check_peers(df: DataFrame, column: str, dongs: DataFrame) -> DataFrame:
    """Rows (dong, column) whose JSON peers are malformed, or name an unknown dong or the dong itself."""
    bad = df.where(F.col(column).isNotNull() & ~peers_valid(F.col(column))).select("dong", F.lit("shape").alias("why"))
    each = df.where(peers_valid(F.col(column))).select("dong", F.explode(F.from_json(column, "array<struct<dong: string, reason: string>>")).alias("p"))
    strange = each.join(dongs.select(F.col("dong").alias("_d")).distinct(), F.col("p.dong") == F.col("_d"), "left_anti").select("dong", F.lit("unknown").alias("why"))
    return bad.union(strange).union(each.where(F.col("p.dong") == F.col("dong")).select("dong", F.lit("itself").alias("why"))).distinct()


def check_zero_share(df: DataFrame, count: str, share: str) -> DataFrame:
    """Rows that have a share of nothing, or none of something."""
    return df.where((F.col(share).isNull()) != (F.coalesce(count, F.lit(0)) == 0))


def schema_diff(df: DataFrame, expected: dict[str, tuple[str, bool]]) -> list[str]:
    """Differences of columns, types and nullability from {column: (type, nullable)}; keys and references are data checks."""
    have = {f.name: (f.dataType.simpleString(), f.nullable) for f in df.schema.fields}
    out = [f"missing {c}" for c in expected if c not in have] + [f"unexpected {c}" for c in have if c not in expected]
    for c, (kind, nullable) in expected.items():
        if c in have:
            out += [f"{c} is {have[c][0]}, not {kind}"] * (have[c][0] != kind) + [f"{c} may be null"] * (have[c][1] and not nullable)
    return out


def schema_report(tables: dict[str, DataFrame], catalogue: dict[str, dict]) -> DataFrame:
    """(table, kind, name, issue, n) of everything in which tables differ from a catalogue; nothing where all is as declared.

    An entry has columns {name: type}, and may have required (columns without nulls), key, references [(columns, table,
    columns)] and checks {name: SQL condition that a row meets; null passes}. Tables and columns are missing or unexpected;
    keys are repeated, references orphaned (nulls refer to nothing), checks violated, with the number of rows. What a missing
    column is needed for is not looked at. A table's checks are one aggregation, a key or a reference one more.
    """
    found, parts = [], []
    missing = [t for t in catalogue if t not in tables]
    found += [(t, "table", t, "missing", 1) for t in missing] + [(t, "table", t, "unexpected", 1) for t in tables if t not in catalogue]
    for t, want in catalogue.items():
        if t in missing:
            continue
        df = tables[t]
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        found += [(t, "column", c, "missing", 1) for c in want["columns"] if c not in have] + [(t, "column", c, "unexpected", 1) for c in have if c not in want["columns"]]
        found += [(t, "type", c, f"{have[c]}, not {kind}", 1) for c, kind in want["columns"].items() if c in have and have[c] != kind]
        rows = {("required", c, "null"): F.count_if(F.col(c).isNull()) for c in want.get("required", ()) if c in have}
        rows |= {("check", name, "violated"): F.count_if(~F.coalesce(F.expr(c), F.lit(True))) for name, c in want.get("checks", {}).items()}
        if rows:
            counts = df.agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(name).alias("name"), F.lit(issue).alias("issue"), n.alias("n")) for (k, name, issue), n in rows.items()]).alias("x"))
            parts.append(counts.select(F.lit(t).alias("table"), F.explode("x").alias("x")).select("table", "x.*"))
        one = lambda n, kind, name, issue, t=t: n.select(F.lit(t).alias("table"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(issue).alias("issue"), F.col("n").cast("long").alias("n"))
        key = want.get("key", ())
        if key and set(key) <= set(have):
            again = df.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n"))
            parts.append(one(again, "key", ",".join(key), "repeated"))
        for cols, other, there in want.get("references", ()):
            if other in tables and set(cols) <= set(have) and set(there) <= set(tables[other].columns):
                known = tables[other].select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(there)]).distinct()
                on = [F.col(c) == F.col(f"_{i}") for i, c in enumerate(cols)]
                parts.append(one(df.dropna(subset=list(cols)).join(known, on, "left_anti").agg(F.count(F.lit(1)).alias("n")), "reference", f"{','.join(cols)} -> {other}", "orphaned"))
    out = next(iter(tables.values())).sparkSession.createDataFrame(found, "table string, kind string, name string, issue string, n bigint")
    for p in parts:
        out = out.union(p)
    return out.where("n > 0")


def check_geojson(features: DataFrame, keys: list[str]) -> DataFrame:
    """(properties, why) of read features whose keys differ, whose type is another, or that have an open or short ring or a
    coordinate that is no finite number."""
    flat = F.flatten("polygons")
    ring_ok = F.forall(flat, lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    numbers = F.forall(F.flatten(flat), lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    why = F.array_compact(F.array(F.when(F.array_sort(F.map_keys("properties")) != F.array(*[F.lit(k) for k in sorted(keys)]), "keys"), F.when(~F.coalesce(F.col("type").isin("Polygon", "MultiPolygon"), F.lit(False)), "type"), F.when(~F.coalesce(ring_ok & (F.size(flat) > 0), F.lit(False)), "ring"), F.when(~F.coalesce(numbers, F.lit(False)), "number")))
    return features.withColumn("why", F.explode(why)).select("properties", "why")


def check_bounds(features: DataFrame, box: tuple[float, float, float, float], count: int | None = None) -> DataFrame:
    """(why) for points outside of box (west, south, east, north) and for a count of features that isn't the expected one."""
    points = features.select(F.explode(F.flatten(F.flatten("polygons"))).alias("p"))
    out = points.where(~(F.col("p")[0].between(box[0], box[2]) & F.col("p")[1].between(box[1], box[3]))).select(F.lit("outside").alias("why"))
    if count is not None:
        out = out.union(features.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != count).select(F.lit("count").alias("why")))
    return out


def check_echo(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which an answer doesn't repeat what was asked."""
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


def same_row_sets(preds: DataFrame, variant: str, keys: list[str]) -> DataFrame:
    """Row keys that some variants have and others haven't."""
    whole = preds.agg(F.count_distinct(variant).alias("_all"))
    return preds.groupBy(*keys).agg(F.count_distinct(variant).alias("variants")).crossJoin(F.broadcast(whole)).where("variants <> _all").drop("_all")


def dictionary_conflicts(known: DataFrame, keys: list[str], value: str, most: float = 0.01) -> DataFrame:
    """(keys, n) of codes that stand for several values; raises if they are over `most` of all codes."""
    each = known.groupBy(*keys).agg(F.count_distinct(value).alias("n"))
    r = each.agg(F.count(F.lit(1)).alias("codes"), F.count_if(F.col("n") > 1).alias("bad")).first()
    if r["bad"] > most * r["codes"]:
        raise ValueError(f"{r['bad']} of {r['codes']} codes stand for several values")
    return each.where("n > 1")


def filled_rates(df: DataFrame, column: str, by: str, k: int = 5) -> DataFrame:
    """(by, n, rate): how often a column stands, for all rows (by is null) and for the k groups where it stands least."""
    rate = [F.count(F.lit(1)).alias("n"), F.avg(F.col(column).isNotNull().cast("double")).alias("rate")]
    return df.agg(*rate).select(F.lit(None).cast("string").alias(by), "n", "rate").union(df.groupBy(F.col(by).cast("string").alias(by)).agg(*rate).orderBy("rate", by).limit(k))


def master_of(trades: DataFrame, key: str, names: list[str], year: str) -> DataFrame:
    """One row for each key: the most frequent non-blank value of each name (the smallest of equal ones), the median year, the count."""
    mode = lambda c: F.mode(F.nullif(F.trim(c), F.lit("")), True).alias(c)
    return trades.groupBy(key).agg(*[mode(c) for c in names], F.median(year).alias(year), F.count(F.lit(1)).alias("n"))


def recount_concentration(valid: DataFrame, q: int, width: int = 4) -> DataFrame:
    """(dong, sale_n, n_complexes, dominant_share) counted straight from the ledger's last `width` quarters."""
    rows = valid.where(F.col("q").between(q - width + 1, q)).groupBy("dong", "apt_seq").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("dong").agg(F.sum("n").alias("sale_n"), F.count_distinct("apt_seq").alias("n_complexes"), (F.max("n") / F.sum("n")).alias("dominant_share"))


def match_registry(master: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """master with the registry's columns where the normalized key is known, and whether it is."""
    known = registry.withColumn("matched", F.lit(True))
    return master.join(known, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def boundary_match(dongs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(dong, emd, matched): whether a dong of the index has a boundary; boundaries (dong, emd)."""
    b = boundaries.groupBy("dong").agg(F.min("emd").alias("emd"), F.lit(True).alias("_has"))
    return dongs.select("dong").distinct().join(b, "dong", "left").select("dong", F.coalesce("emd", F.lit("")).alias("emd"), F.coalesce("_has", F.lit(False)).alias("matched"))


def with_gu_name(df: DataFrame, names: dict[str, str], code: str = "sgg_cd") -> DataFrame:
    """df with the name of its gu's code, null for an unknown one; names: a short fixed list."""
    return df.withColumn("gu_name", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(code)] if names else F.lit(None).cast("string"))


def check_non_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n) of columns with null or blank values."""
    one = F.explode(F.array_compact(F.array(*[F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull(), F.lit(c)) for c in columns])))
    return df.select(one.alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def check_dong_key(df: DataFrame) -> DataFrame:
    """Rows whose dong isn't its gu and neighbourhood, joined."""
    return df.where(~F.col("dong").eqNullSafe(F.concat_ws("_", "sgg_cd", "umd_nm")))


def check_null_rate(df: DataFrame, columns: list[str], most: float = 0.01) -> DataFrame:
    """(column, rate) of columns that are null in `most` of the rows or more."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot([], columns, "column", "rate").where(F.col("rate") >= most)


def check_lineage(preds: DataFrame, origin: str = "q", label: str = "label_vintage") -> DataFrame:
    """Predictions that learnt from labels later than their origin."""
    return preds.where(F.col(label) > F.col(origin))
