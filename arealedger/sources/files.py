"""Readers and writers of landed files, and publication of versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quarters import parse_quarter, quarter_ord
from ..functions.scalars import number_or_null


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text: leading zeros of lot numbers stay."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("sep", "\t").option("header", True).option("enforceSchema", False).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def read_vintages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of {as_of}/{kind}/{gu}_{month}.json[.gz] files with what the path says."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn("_file", F.input_file_name())
    part = lambda k: F.regexp_extract("_file", r"([^/]+)/([^/]+)/([^/_]+)_([0-9]{6})\.json", k)
    return df.select("*", part(1).alias("as_of"), part(2).alias("kind"), part(3).alias("gu"), part(4).alias("deal_ym")).drop("_file")


def html_table_rows(df: DataFrame, html: str) -> DataFrame:
    """Cells of three-cell rows whose first is a four-digit year."""
    rows = df.select(F.explode(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr"))
    cells = rows.select(F.transform(F.regexp_extract_all("tr", F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("c"))
    return cells.where((F.size("c") == 3) & F.get("c", F.lit(0)).rlike("^[0-9]{4}$")).select(F.get("c", F.lit(0)).alias("year"), F.get("c", F.lit(1)).alias("day"), F.get("c", F.lit(2)).try_cast("double").alias("rate"))


def read_trade_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of {kind}_{gu}_{month}.json files with what their names say; files without a row give none."""
    df = spark.read.schema(schema).json(path).withColumn("_file", F.input_file_name())
    part = lambda k: F.regexp_extract("_file", r"([^/_]+)_([^/_]+)_([0-9]{6})\.json", k)
    return df.select("*", part(1).alias("kind"), part(2).alias("gu"), part(3).alias("deal_ym")).drop("_file")


def decoded(text: Column) -> Column:
    """text with XML's entities, numbered ones too, as the characters that they stand for."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(1)))
    code = lambda c: F.when(c.startswith("x"), F.substring(c, 2, 6)).otherwise(F.conv(c, 10, 16))
    char = lambda c: F.decode(F.unhex(F.lpad(code(c), 8, "0")), "UTF-32")
    out = F.aggregate(numbers, text, lambda s, c: F.replace(s, F.concat(F.lit("&#"), c, F.lit(";")), char(c)))
    for name, one in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(one))
    return out


def release_links(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, seq, title, year, month) of links that download a workbook of a stated month.

    The number is that of downloadFile(..) in a link's href or onclick, year and month stand in its title, two digits of a
    year mean this century. Links without either, of another kind of file or with a month that is none are left out.
    """
    tag = F.explode(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0)))
    part = lambda name, k: F.regexp_extract("tag", rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", k)
    value = lambda name: F.trim(decoded(F.concat(part(name, 1), part(name, 2))))
    rows = pages.select(*keys, tag.alias("tag")).select(*keys, F.concat_ws(" ", value("href"), value("onclick")).alias("_does"), value("title").alias("title"))
    month = r"(\d{2,4})\s*년\s*(\d{1,2})\s*월"
    rows = rows.select(*keys, F.regexp_extract("_does", r"""downloadFile\(\s*['"]?(\d+)""", 1).alias("seq"), "title", F.regexp_extract("title", month, 1).alias("_y"), F.regexp_extract("title", month, 2).try_cast("int").alias("month"))
    year = F.when(F.length("_y") == 2, F.col("_y").try_cast("int") + 2000).otherwise(F.col("_y").try_cast("int"))
    return rows.where((F.col("seq") != "") & (F.col("_y") != "") & F.lower("title").endswith(".xlsx") & F.col("month").between(1, 12)).select(*keys, "seq", "title", year.alias("year"), "month")


def newest_release(links: DataFrame) -> DataFrame:
    """The one link with the latest month, of those with the highest number."""
    best = links.agg(F.max_by(F.struct(*links.columns), F.struct("year", "month", F.col("seq").cast("decimal(38,0)"))).alias("x"))
    return best.where("x is not null").select("x.*")


def read_trade_xml(spark: SparkSession, path: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): items of API pages under our names, whatever the case of their tags, and pages whose result code isn't zeros.

    fields: tag -> our name. A tag that an item lacks is null, and so is a blank one.
    """
    pages = spark.read.text(path, wholetext=True).withColumn("code", F.regexp_extract("value", r"(?i)<resultCode>\s*([^<]*?)\s*</resultCode>", 1))
    ok = F.col("code").rlike("^0+$")
    item = pages.where(ok).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1))).alias("item"))
    cell = lambda tag: F.nullif(F.trim(decoded(F.regexp_extract("item", rf"(?is)<{tag}>(.*?)</{tag}>", 1))), F.lit(""))
    return item.select(*[cell(tag).alias(name) for tag, name in fields.items()]), pages.where(~ok).select(F.substring("value", 1, 500).alias("page"), "code")


def derive_ledger(df: DataFrame, gu_names: dict[str, str]) -> DataFrame:
    """Raw sale rows (sggCd, dealYear, dealMonth, dealAmount, cdealType, all text) with deal_ym, gu, is_cancelled and the amount as a number."""
    names = F.create_map(*[F.lit(x) for kv in gu_names.items() for x in kv])
    ym = F.concat(F.lpad(F.trim("dealYear"), 4, "0"), F.lpad(F.trim("dealMonth"), 2, "0"))
    return df.withColumns({"deal_ym": ym, "gu": names[F.col("sggCd")], "is_cancelled": F.coalesce(F.trim("cdealType") == "O", F.lit(False)), "deal_amount": number_or_null(F.col("dealAmount"))})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Dated events of a typed TSV: event_id, date, category, label, direction, with the quarter and a score (tighten 1, ease -1, else 0)."""
    raw = read_tsv(spark, path, ["event_id", "effective_date", "category", "label", "direction"])
    date = F.try_to_date("effective_date", "yyyy-MM-dd")
    return raw.withColumns({"effective_date": date, "q": quarter_ord(date), "score": F.when(F.col("direction") == "tighten", 1).when(F.col("direction") == "ease", -1).otherwise(0)})


def read_panel(spark: SparkSession, path: str, label: str = "quarter") -> DataFrame:
    """A Parquet panel with its quarter labels parsed to ordinals in q; bad labels have none."""
    return spark.read.parquet(path).withColumn("q", parse_quarter(F.col(label)))


def profile_source(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file, read whole by one task each."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def latest_release(df: DataFrame) -> DataFrame:
    """The row (year, month, seq, ...) of the newest release."""
    return df.agg(F.max(F.struct("year", "month", "seq", *[c for c in df.columns if c not in ("year", "month", "seq")])).alias("r")).where("r is not null").select("r.*").select(*df.columns)


def parse_registry(df: DataFrame, city: str, kind: str) -> DataFrame:
    """Registry rows (pnu, address, kind, name) of a city and kind, the lot code split 5, 5, 4, 4 behind its land mark; the first name of each address."""
    rows = df.where(F.col("address").startswith(city) & (F.col("kind") == kind))
    first = rows.groupBy("address").agg(F.min(F.struct("pnu", "name")).alias("r")).select("address", "r.*")
    cut = lambda at, n: F.substring("pnu", at, n)
    return first.select("address", "name", cut(1, 5).alias("sigungu_cd"), cut(6, 5).alias("bjdong_cd"), cut(12, 4).alias("bun"), cut(16, 4).alias("ji"))


def flatten_ledger(df: DataFrame, column: str, fields: dict[str, str], numbers: list[str], day: str) -> DataFrame:
    """Items of a JSON text column under our names, numbers cast where they are some, and the year of a yyyymmdd day."""
    items = F.from_json(F.get_json_object(column, "$.items.item"), "array<map<string, string>>")
    rows = df.select(F.explode_outer(items).alias("i")).where("i is not null")
    out = rows.select(*[F.nullif(F.trim(F.col("i")[k]), F.lit("")).alias(n) for k, n in fields.items()])
    return out.withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumn("use_year", F.substring(day, 1, 4).try_cast("int"))


def with_households(df: DataFrame, column: str = "households") -> DataFrame:
    return df.where(F.col(column) > 0)


# Columns of a zone's stage dates.
STAGE_COLUMNS = (11, 13, 14, 16, 18, 22)


def read_zones(spark: SparkSession, path: str, gus: list[str]) -> DataFrame:
    """Redevelopment zones by column position: gu, lot, households and the quarters of their stage dates; rows whose first
    four cells stand and whose gu is known."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    full = F.lit(True)
    for i in range(4):
        full = full & (F.trim(F.coalesce(f"c{i}", F.lit(""))) != "")
    stages = [i for i in STAGE_COLUMNS if i < len(raw.columns)]
    quarter = lambda i: quarter_ord(F.try_to_date(F.regexp_replace(F.trim(f"c{i}"), "[./]", "-"), "yyyy-MM-dd"))
    kept = raw.where(full & F.trim("c2").isin(gus))
    return kept.select(F.trim("c2").alias("gu"), F.trim("c4").alias("lot") if len(raw.columns) > 4 else F.lit(None).alias("lot"), F.col("c10").try_cast("int").alias("households") if len(raw.columns) > 10 else F.lit(None).alias("households"), *[quarter(i).alias(f"s{k + 1}") for k, i in enumerate(stages)])


def read_permits(spark: SparkSession, path: str) -> DataFrame:
    """Records of {"result": [...]} files of land-permit designations, every value as text."""
    return spark.read.schema("result array<map<string, string>>").option("multiLine", True).json(path).select(F.explode("result").alias("r"))


def write_summary(df: DataFrame, path: str, head: dict[str, str], evidence: list[str]) -> None:
    """One JSON line: head, and the evidence columns of df's rows (a handful) as a list in their order."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*evidence))).alias("evidence"))
    rows.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], "evidence")).alias("value")).write.text(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, type, polygons) of features: a Polygon's rings stand as a list of one polygon."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    shape = F.get_json_object("f", "$.geometry.coordinates")
    rings = "array<array<array<double>>>"
    many = F.when(F.col("type") == "Polygon", F.array(F.from_json(shape, rings))).when(F.col("type") == "MultiPolygon", F.from_json(shape, f"array<{rings}>"))
    rows = lines.withColumn("type", F.get_json_object("f", "$.geometry.type"))
    return rows.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string, string>").alias("properties"), "type", many.alias("polygons"))


def write_geojson(df: DataFrame, path: str, properties: list[str], polygons: str = "polygons") -> None:
    """One feature a line, always as a MultiPolygon."""
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col(polygons).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value")).write.text(path)


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and snapshot of the newest pointer; each lies in a folder of its own, which is complete once it has its marker."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_active")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    done = [p.getPath().getName() for p in fs.listStatus(fs_path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    numbers = [int(n.split("=")[1]) for n in done if n.startswith("version=")]
    if not numbers:
        return None
    return max(numbers), spark.read.parquet(f"{root}/_active/version={max(numbers)}").first()["snapshot_id"]


def _published(spark: SparkSession, root: str) -> set[str]:
    """Snapshots that a complete pointer names or has named; one short row each."""
    if _newest(spark, root) is None:
        return set()
    return {r["snapshot_id"] for r in spark.read.schema("snapshot_id string").parquet(f"{root}/_active").collect()}


def publish_snapshot(frames: dict[str, DataFrame], root: str, snapshot_id: str, checks: dict[str, DataFrame], commit: bool = False, carry: tuple[str, ...] = ()) -> dict[str, int]:
    """Write frames under a new snapshot_id, compare what was written with what was to be, and only then add a pointer to it.

    Checks run first; without commit nothing is written. carry: tables of the present snapshot that the new one takes over.
    Pointers are never changed: each publication adds the next one, and readers take the newest that is complete, so a run that
    fails anywhere leaves the present snapshot in place, and can be run again under its id: what no pointer has named is
    written anew. A published id is refused. Gives the counts of rows written.
    """
    bad = {name: n for name, df in checks.items() if (n := df.limit(1).count())}
    if bad:
        raise ValueError(f"checks failed: {sorted(bad)}")
    if not commit:
        return {}
    spark, out = next(iter(frames.values())).sparkSession, {}
    present = _newest(spark, root)
    if carry and present is None:
        raise ValueError("there is no snapshot to carry tables over from")
    if snapshot_id in _published(spark, root):
        raise ValueError(f"snapshot {snapshot_id} is published already")
    every = frames | {name: active(spark, root, name).drop("snapshot_id") for name in carry if name not in frames}
    for name, df in every.items():
        path = f"{root}/{name}/snapshot_id={snapshot_id}"
        df.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*x.columns))).first())
        want, got = mark(df), mark(back.select(*df.columns))
        if want != got:
            raise ValueError(f"{name}: {got[0]} rows were written where {want[0]} were to be, or others")
        out[name] = got[0]
    number = 1 + (present[0] if present else 0)
    spark.createDataFrame([(snapshot_id,)], "snapshot_id string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_active/version={number}")
    return out


def active(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The active snapshot of a table: one partition is read."""
    found = _newest(spark, root)
    if found is None:
        raise ValueError(f"{root} has no active snapshot")
    return spark.read.parquet(f"{root}/{name}").where(F.col("snapshot_id").cast("string") == found[1])


def snapshot_counts(spark: SparkSession, root: str, names: list[str], old: str, new: str) -> DataFrame:
    """(name, old, new, change): rows of each table in two snapshots."""
    out = None
    for name in names:
        t = spark.read.parquet(f"{root}/{name}").withColumn("_s", F.col("snapshot_id").cast("string"))
        row = t.agg(F.count_if(F.col("_s") == old).alias("old"), F.count_if(F.col("_s") == new).alias("new")).select(F.lit(name).alias("name"), "old", "new", (F.col("new") - F.col("old")).alias("change"))
        out = row if out is None else out.union(row)
    return out


def publish_batch(df: DataFrame, kind: str, root: str, batch: str, commit: bool = False, limit: int = 10_000) -> DataFrame:
    """Profile of a batch (kind, rows, first and last month, checksum); with commit it is written, read back, compared and made active.

    A dry run looks at `limit` rows at most; a commit at all of them.
    """
    rows = df if commit else df.limit(limit)
    profile = lambda x: x.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.min("deal_ym").alias("first_ym"), F.max("deal_ym").alias("last_ym"), F.hex(F.bit_xor(F.xxhash64(*df.columns))).alias("checksum"))
    if commit:
        publish_snapshot({kind: rows}, f"{root}/{kind}", batch, {}, commit=True)
        return profile(active(df.sparkSession, f"{root}/{kind}", kind))
    return profile(rows)
