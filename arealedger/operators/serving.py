"""Tables that a product serves: its list, details of all neighbourhoods at once, centres, bands, pages and boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quarters import quarter_label, ym_minus_months
from ..functions.scalars import half_up, log_se_to_pct, log_to_pct
from .catalog import is_citywide
from .ledger import recent_sale_per_complex
from .panel import region_tags
from .support import PEAK, SAME
from .windows import top_by

# Tags and the columns that they rank dongs by; thresholds told in footnotes.
TAGS = {"정비사업 정보 있음": "zone_count", "거래 많은 동": "index_sales", "전세가율 높은 동": "jeonse_ratio", "최근 준공 많은 동": "completed_share", "30년 이상 단지 많은 동": "old30_share"}
THRESHOLDS = {"few_sales": 20.0, "one_complex_share": 0.5, "high_index_se": 0.032, "delta_sigma": 2.0}


def format_ym(ym: Column) -> Column:
    """YYYYMM as YYYY-MM; anything else as it is."""
    return F.regexp_replace(ym, "^([0-9]{4})([0-9]{2})$", "$1-$2")


def period(ledger: DataFrame, to: str) -> DataFrame:
    """One row: the months that a ledger (deal_date) covers, `-` for an empty one."""
    ends = ledger.agg(F.date_format(F.min("deal_date"), "yyyyMM").alias("a"), F.date_format(F.max("deal_date"), "yyyyMM").alias("z"))
    return ends.select(F.coalesce(F.concat(format_ym(F.col("a")), F.lit(" ~ "), format_ym(F.col("z"))), F.lit("-")).alias(to))


def serve_meta(index: DataFrame, sale: DataFrame, rent: DataFrame, permits: DataFrame | None = None) -> DataFrame:
    """One row: the newest quarter of the index, the ledgers' periods and the thresholds; with permits (area, kind, remark)
    also permit_zone, whether one of them covers all flats of the city."""
    as_of = index.agg(F.coalesce(quarter_label(F.max("q")), F.lit("-")).alias("as_of_quarter"))
    out = as_of.crossJoin(period(sale, "sale_period")).crossJoin(period(rent, "rent_period")).select("*", *[F.lit(v).alias(k) for k, v in THRESHOLDS.items()])
    if permits is None:
        return out
    return out.crossJoin(permits.agg(F.coalesce(F.bool_or(is_citywide(F.col("area"), F.col("kind"), F.col("remark"))), F.lit(False)).alias("permit_zone")))


def zone_count(*stages: str) -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in stages), F.lit(0))


def dong_list_base(dongs: DataFrame, index: DataFrame, features: DataFrame, support: DataFrame, q: int) -> DataFrame:
    """dongs (dong, gu_name, umd_name) that have an index at q, with their features and support where there are any."""
    return dongs.join(index.where(F.col("q") == q).select("dong", F.col("n_sales_4q").alias("index_sales")), "dong").join(features, "dong", "left").join(support, "dong", "left")


def dong_detail_base(dongs: DataFrame, support: DataFrame, index: DataFrame, features: DataFrame, q: int) -> DataFrame:
    """dongs that have a support row, with index and features at q where there are any."""
    return dongs.join(support, "dong").join(index.where(F.col("q") == q).select("dong", F.col("n_sales_4q").alias("index_sales")), "dong", "left").join(features, "dong", "left")


def with_tags(rows: DataFrame, tags: dict[str, str] = TAGS, top: float = 0.3) -> DataFrame:
    """rows (dong, ...) with tags: for each ranked column those at or above the place of the top share; any positive count of zones."""
    out, marks = rows, []
    for i, (tag, c) in enumerate(tags.items()):
        if c == "zone_count":
            marks.append(F.when(F.col(c) > 0, tag))
            continue
        out = region_tags(out, c, top).withColumnRenamed("tagged", f"_t{i}").drop("cut")
        marks.append(F.when(F.col(f"_t{i}"), tag))
    return out.withColumn("tags", F.array_compact(F.array(*marks))).drop(*[f"_t{i}" for i in range(len(tags))])


def serve_dongs(base: DataFrame) -> DataFrame:
    """The list: names, sales, price, flags, band, structure, tags and the values they sort by. base: dong_list_base with
    median_ppm2, sale_n, flags, se_band, structure_type, structure_desc and the tagged columns."""
    rows = with_tags(base.withColumn("n_sales_4q", F.coalesce("sale_n", "index_sales", F.lit(0))))
    return rows.select("dong", "gu_name", "umd_name", "n_sales_4q", half_up(F.col("median_ppm2")).cast("long").alias("ppm2"), F.coalesce("flags", F.lit("")).alias("flags"), "se_band", "structure_type", "structure_desc", F.array_join("tags", ",").alias("tags"), *[F.col(c).cast("double").alias(f"sort_{c}") for c in TAGS.values()])


def suppressed(rows: DataFrame) -> DataFrame:
    """Changes of support rows in per cent; a difference that doesn't stand out of its error is null, and so is a peak gap
    without a state or within its error."""
    gap = F.when(F.col("peak_state").isNotNull() & (F.col("peak_state") != SAME), log_to_pct(F.col("peak_gap")))
    return rows.select("dong", log_to_pct(F.col("change")).alias("dong_pct"), log_to_pct(F.col("mu")).alias("city_pct"), F.when(F.col("delta_state") == "DISTINGUISHABLE", log_to_pct(F.col("delta"))).alias("delta_pct"), log_se_to_pct(F.col("delta"), F.col("delta_se")).alias("delta_se_pct"), "delta_state", gap.alias("peak_gap_pct"), log_se_to_pct(F.col("peak_gap"), F.col("peak_gap_se")).alias("peak_gap_se_pct"), (F.col("peak_state") == PEAK).alias("at_peak"))


def peer_names(pairs: DataFrame, dongs: DataFrame) -> DataFrame:
    """pairs (dong, pos, peer, reason) with the peer's names, in order; unknown peers are left out."""
    named = dongs.select(F.col("dong").alias("peer"), "gu_name", "umd_name")
    return pairs.join(named, "peer").select("dong", F.row_number().over(Window.partitionBy("dong").orderBy("pos")).alias("place"), "peer", "gu_name", "umd_name", "reason")


def complexes_with_last_sale(valid: DataFrame, complexes: DataFrame, n: int = 50) -> DataFrame:
    """The n complexes of each dong that were sold last, with that sale; complexes (apt_seq, households)."""
    last = recent_sale_per_complex(valid).select("dong", "apt_seq", "deal_date", "price", "area")
    return top_by(last, ["dong"], [F.desc("deal_date"), F.col("apt_seq")], n).join(complexes.select("apt_seq", "households"), "apt_seq", "left")


def dong_centers(valid: DataFrame, complexes: DataFrame, since: int) -> DataFrame:
    """(dong, lat, lng): mean place of the distinct complexes sold since a quarter; complexes without a place don't count."""
    sold = valid.where(F.col("q") >= since).select("dong", "apt_seq").distinct()
    return sold.join(complexes.where("lat is not null and lng is not null").select("apt_seq", "lat", "lng"), "apt_seq").groupBy("dong").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def gu_summary(dongs: DataFrame, centers: DataFrame) -> DataFrame:
    """(gu_name, n, lat, lng): dongs of each gu, and the mean centre of those that have one."""
    return dongs.join(centers, "dong", "left").groupBy("gu_name").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def price_bands(prices: DataFrame, value: str) -> DataFrame:
    """(band, low, high): four bands between the values at places floor(n / 4), floor(n / 2), floor(3 n / 4) and the last one;
    each next band begins one above. None for fewer than four values. Equal values are counted, not gathered."""
    counts = prices.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    run = Window.orderBy("v")
    whole = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = counts.select("v", F.sum("k").over(run).alias("up"), F.sum("k").over(whole).alias("n"))
    at = lambda place: F.min(F.when(F.col("up") > place, F.col("v")))
    edges = placed.where("n >= 4").agg(F.min("v").alias("e0"), *[at(F.floor(F.col("n") * r / 4)).alias(f"e{r}") for r in (1, 2, 3)], F.max("v").alias("e4")).where("e0 is not null")
    rows = F.array(*[F.struct(F.lit(i + 1).alias("band"), (F.col(f"e{i}") + (1 if i else 0)).alias("low"), F.col(f"e{i + 1}").alias("high")) for i in range(4)])
    return edges.select(F.explode(rows).alias("b")).select("b.*")


def area_window(ledger: DataFrame, months: int = 24) -> str | None:
    """The first of the last `months` months (YYYYMM) of a ledger; one value comes to the driver."""
    return ledger.agg(ym_minus_months(F.date_format(F.max("deal_date"), "yyyyMM"), months - 1)).first()[0]


def sort_dongs(rows: DataFrame, by: str, name: str, descending: bool = True) -> DataFrame:
    """rows in order of `by`, nulls last in either direction, ties by name."""
    return rows.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), name)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1; held between the first and the last) of rows in order, with the number of pages."""
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("pages")).first()["pages"]
    at = min(max(1, number), pages)
    return rows.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("page", F.lit(at)).withColumn("pages", F.lit(pages))


def distinct_values(rows: DataFrame, col: str) -> DataFrame:
    return rows.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()


def structure_options(rows: DataFrame) -> DataFrame:
    """(structure_type, structure_desc): one text for each type, that of the first dong."""
    return rows.where("structure_type is not null").groupBy("structure_type").agg(F.min_by("structure_desc", "dong").alias("structure_desc"))


def non_zero(rows: DataFrame, col: str) -> DataFrame:
    return rows.where(F.col(col) > 0)


def visible_boundaries(boundaries: DataFrame, level: str, gu: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """boundaries (dong, gu_name, ...) to draw: one row for each gu, the dongs of a gu, or listed ids (dong)."""
    if level == "gu":
        return boundaries.select("gu_name").distinct()
    return boundaries.where(F.col("gu_name") == gu) if level == "dong" else boundaries.join(ids.select("dong").distinct(), "dong", "left_semi")
