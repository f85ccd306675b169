"""Quarters as ordinals (year * 4 + quarter - 1), labels (YYYYQn) and months (YYYYMM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_ord(date: Column) -> Column:
    return F.year(date) * 4 + F.quarter(date) - 1


def parse_quarter(label: Column) -> Column:
    """Ordinal of a YYYYQn label, null for anything else."""
    return F.when(label.rlike("^[0-9]{4}Q[1-4]$"), F.substring(label, 1, 4).try_cast("int") * 4 + F.substring(label, 6, 1).try_cast("int") - 1)


def quarter_label(q: Column) -> Column:
    return F.concat(F.floor(q / 4).cast("string"), F.lit("Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))


def shift_quarter(label: Column, by: int) -> Column:
    """The label `by` quarters on; bad labels pass through."""
    return F.coalesce(quarter_label(parse_quarter(label) + by), label)


def ym_to_quarter(ym: Column) -> Column:
    return F.concat(F.substring(ym, 1, 4), F.lit("Q"), F.floor((F.substring(ym, 5, 2).try_cast("int") + 2) / 3).cast("string"))


def quarter_months(label: Column) -> tuple[Column, Column]:
    """First and last month (YYYYMM) of a quarter label."""
    year, n = F.substring(label, 1, 4), F.substring(label, 6, 1).try_cast("int")
    return F.concat(year, F.lpad((n * 3 - 2).cast("string"), 2, "0")), F.concat(year, F.lpad((n * 3).cast("string"), 2, "0"))


def ym_minus_months(ym: Column, n: int) -> Column:
    return F.date_format(F.add_months(F.to_date(ym, "yyyyMM"), -n), "yyyyMM")


def day_in_quarter(date: Column) -> Column:
    return F.datediff(date, F.trunc(date, "quarter")) + 1


def first_day(q: Column) -> Column:
    """The date on which a quarter ordinal begins."""
    return F.make_date(F.floor(q / 4).cast("int"), F.pmod(q, F.lit(4)).cast("int") * 3 + 1, F.lit(1))
