"""Ledger predicates, keys and trailing features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import cumulative, grid, rolling_sum, top_by, trailing_windows


def valid_sales(df: DataFrame) -> DataFrame:
    """Sales that aren't marked cancelled (a null mark: not cancelled), with ids, area, price and a month, and their log price per area."""
    ids = F.col("sgg_cd").isNotNull() & F.col("umd_nm").isNotNull() & F.col("apt_seq").isNotNull()
    ok = ids & ~F.coalesce("is_cancelled", F.lit(False)) & (F.col("area") > 0) & (F.col("price") > 0) & F.col("deal_ym").rlike("^[0-9]{6}$")
    return df.where(ok).withColumn("log_ppm2", F.log(F.col("price") / F.col("area")))


def counts(sales: DataFrame) -> DataFrame:
    return sales.groupBy("dong", "q").agg(F.count(F.lit(1)).alias("n_sales"))


def eligible(valid: DataFrame, first: int, last: int, least: int = 20) -> DataFrame:
    """dong x quarter grid with counts, the trailing year's sum (null before a whole year) and whether it reaches `least`."""
    full = grid(valid.select("dong").distinct(), first, last).join(counts(valid), ["dong", "q"], "left").fillna(0, ["n_sales"])
    full = full.withColumn("n_sales_4q", rolling_sum("n_sales", ["dong"], "q", 4))
    return full.withColumn("eligible", F.coalesce(F.col("n_sales_4q") >= least, F.lit(False)))


def sale_features(ledger: DataFrame, valid: DataFrame, width: int = 4) -> DataFrame:
    """Trailing sale block by dong and as_of: count with cancelled ones, cancel share, age and 30-year share, median price.

    Rows are dealt by dong before windows repeat them, so that what goes between tasks are rows, each once.
    """
    age = F.year("deal_date") - F.col("build_year")
    each = ledger.select("dong", "q", age.alias("age"), "is_cancelled").repartition("dong").groupBy("dong", "q", "age").agg(F.count(F.lit(1)).alias("n"), F.count("is_cancelled").alias("marked"), F.count_if("is_cancelled").alias("cancelled"))
    rows, known = trailing_windows(each, width), F.when(F.col("age").isNotNull(), F.col("n"))  # counts by age are repeated, not sales
    block = rows.groupBy("dong", "as_of").agg(F.sum("n").alias("sale_n_all_4q"), F.try_divide(F.sum("cancelled"), F.sum("marked")).alias("cancel_share_4q"), F.percentile("age", F.lit(0.5), F.col("n")).alias("median_age_4q"), F.try_divide(F.sum(F.when(F.col("age") >= 30, F.col("n")).otherwise(0)), F.sum(known)).alias("old30_share_4q"))
    price = trailing_windows(valid.select("dong", "q", (F.col("price") / F.col("area")).alias("ppm2")).repartition("dong"), width).groupBy("dong", "as_of").agg(F.count(F.lit(1)).alias("sale_n_valid_4q"), F.median("ppm2").alias("median_ppm2_4q"))
    return block.join(price, ["dong", "as_of"], "left")


def rent_features(rent: DataFrame, width: int = 4) -> DataFrame:
    ppm2 = F.when((F.col("area") > 0) & (F.col("deposit") > 0) & F.col("is_jeonse"), F.col("deposit") / F.col("area"))
    rows = trailing_windows(rent.select("dong", "q", "is_jeonse", ppm2.alias("ppm2")).repartition("dong"), width)
    return rows.groupBy("dong", "as_of").agg(F.count(F.lit(1)).alias("rent_n_4q"), F.avg(F.col("is_jeonse").cast("double")).alias("jeonse_share_4q"), F.median("ppm2").alias("jeonse_ppm2_4q"))


def supply_features(completed: DataFrame, first: int, last: int) -> DataFrame:
    """Completed households of a quarter, of 4 and 8 quarters so far, and the stock."""
    full = grid(completed.select("dong").distinct(), first, last).join(completed, ["dong", "q"], "left").fillna(0, ["households"])
    return full.select("dong", "q", "households", rolling_sum("households", ["dong"], "q", 4, True).alias("households_4q"), rolling_sum("households", ["dong"], "q", 8, True).alias("households_8q"), cumulative("households", ["dong"], "q").alias("stock"))


def assemble_features(keys: DataFrame, frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """keys with the columns of each frame where it has a row; frames have one row for a key."""
    for frame in frames:
        keys = keys.join(frame, list(on), "left")
    return keys


def eligible_by_year(rows: DataFrame) -> DataFrame:
    """(year, dong_quarters, eligible) of the grid that `eligible` gives."""
    return rows.groupBy(F.floor(F.col("q") / 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("dong_quarters"), F.count_if("eligible").alias("eligible"))


def household_coverage(complexes: DataFrame, mapped: DataFrame, least: float = 0.95) -> DataFrame:
    """(households, mapped, coverage, enough): households of all complexes, of those with a dong, and whether the share will do."""
    whole = complexes.agg(F.sum("households").alias("households"))
    part = mapped.where("dong is not null").agg(F.coalesce(F.sum("households"), F.lit(0)).alias("mapped"))
    share = F.try_divide("mapped", "households")
    return whole.crossJoin(part).select("households", "mapped", share.alias("coverage"), (share >= least).alias("enough"))


def complex_concentration(valid: DataFrame, width: int = 4) -> DataFrame:
    """Distinct complexes and the largest one's share, from counts by complex and quarter made once."""
    per = valid.groupBy("dong", "apt_seq", "q").agg(F.count(F.lit(1)).alias("n"))
    each = trailing_windows(per, width).groupBy("dong", "as_of", "apt_seq").agg(F.sum("n").alias("n"))
    return each.groupBy("dong", "as_of").agg(F.count(F.lit(1)).alias("n_complexes_4q"), F.sum("n").alias("sale_n_valid_4q"), (F.max("n") / F.sum("n")).alias("dominant_share_4q"))


def zone_features(zones: DataFrame, origins: DataFrame, width: int = 4) -> DataFrame:
    """zones (dong, households, s1..s3: quarters of stages or null) at each origin (dong, as_of) of their dong."""
    rows = origins.join(zones, "dong")
    t, stages = F.col("as_of"), ("s1", "s2", "s3")
    reached = [F.sum(F.when(F.col(s) <= t, 1).otherwise(0)).alias(f"n_{s}") for s in stages]
    active = F.sum(F.when((F.col("s1") <= t) & ~F.coalesce(F.col("s3") <= t, F.lit(False)), F.col("households")).otherwise(0)).alias("active_households")
    recent = F.sum(sum((F.when((F.col(s) <= t) & (F.col(s) > t - width), 1).otherwise(0) for s in stages), F.lit(0))).alias("events_4q")
    return rows.groupBy("dong", "as_of").agg(*reached, active, recent)


def map_complexes(complexes: DataFrame, trades: DataFrame) -> DataFrame:
    """complexes with the dong of most of their trades; without trades, the dong with most households of the same (gu, code)."""
    by_trades = top_by(trades.groupBy("apt_seq", "dong").agg(F.count(F.lit(1)).alias("n")), ["apt_seq"], [F.desc("n"), F.col("dong")]).select("apt_seq", F.col("dong").alias("dong_t"))
    known = complexes.join(by_trades, "apt_seq", "left")
    votes = known.where("dong_t is not null").groupBy("sgg_cd", "bjd_code", "dong_t").agg(F.sum("households").alias("h"))
    table = top_by(votes, ["sgg_cd", "bjd_code"], [F.desc("h"), F.col("dong_t")]).select("sgg_cd", "bjd_code", F.col("dong_t").alias("dong_v"))
    return known.join(table, ["sgg_cd", "bjd_code"], "left").select(*complexes.columns, F.coalesce("dong_t", "dong_v").alias("dong"))


def repeat_pairs(valid: DataFrame) -> DataFrame:
    """Consecutive trades of a cell in different quarters."""
    w = Window.partitionBy("cell").orderBy("q", "deal_date", "order_no", "log_ppm2")
    rows = valid.select("cell", "dong", "q", F.lag("q").over(w).alias("q0"), (F.col("log_ppm2") - F.lag("log_ppm2").over(w)).alias("change"))
    return rows.where("q0 is not null and q0 <> q")


def recent_sale_per_complex(valid: DataFrame) -> DataFrame:
    return top_by(valid, ["apt_seq"], [F.desc("deal_date"), F.desc("order_no"), F.desc("price"), F.desc("area")])


def area_bands(valid: DataFrame, first_ym: str) -> DataFrame:
    """Price distribution by dong and area band; a null area falls into the last band."""
    band = F.when(F.col("area") < 13, "A").when(F.col("area") < 26, "B").when(F.col("area") < 39, "C").otherwise("D")
    return valid.where(F.col("deal_ym") >= first_ym).groupBy("dong", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.median("price").alias("median_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def flows(valid: DataFrame, rent: DataFrame, last: int, n: int = 8) -> DataFrame:
    """Sales and rents of the last n quarters, zero-filled; the monthly share is null without rents."""
    sales = counts(valid)
    rents = rent.groupBy("dong", "q").agg(F.count(F.lit(1)).alias("n_rents"), F.count_if(~F.col("is_jeonse")).alias("n_monthly"))
    spine = grid(valid.select("dong").union(rent.select("dong")).distinct(), last - n + 1, last)
    out = spine.join(sales.join(rents, ["dong", "q"], "full"), ["dong", "q"], "left").fillna(0, ["n_sales", "n_rents", "n_monthly"])
    return out.select("dong", "q", "n_sales", "n_rents", F.try_divide("n_monthly", "n_rents").alias("monthly_share"))
