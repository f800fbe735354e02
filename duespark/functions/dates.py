"""Fiscal calendar (April to March, in India's time) and dates. Instants are UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def fiscal_year(ts: Column) -> Column:
    """Like 2025-26."""
    local = _local(ts)
    start = F.year(local) - F.when(F.month(local) < 4, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def fiscal_quarter(ts: Column) -> Column:
    return F.concat(F.lit("Q"), (F.floor(((F.month(_local(ts)) + 8) % 12) / 3) + 1).cast("int").cast("string"))


def days_between(a: Column, b: Column) -> Column:
    """a - b in days, as a real number."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000.0)


def plus_days(ts: Column, days: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + days * 86_400_000_000)


def prior_period(start: Column, end: Column) -> Column:
    """The period of equal length that ends a microsecond before start."""
    span = F.unix_micros(end) - F.unix_micros(start)
    return F.struct(F.timestamp_micros(F.unix_micros(start) - 1 - span).alias("prior_start"), F.timestamp_micros(F.unix_micros(start) - 1).alias("prior_end"))


def voucher_date(first: Column, second: Column) -> Column:
    return F.date_format(F.coalesce(first, second), "yyyyMMdd")


def parse_date(text: Column) -> Column:
    """ISO prefix; d/m/y with / - or .; day, month's name, year; null if none fits."""
    t = F.trim(text)
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    numeric = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    part = lambda p, k: F.regexp_extract(t, p, k)
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    dmy = F.when(t.rlike(numeric), F.try_to_date(F.concat_ws("-", full(part(numeric, 3)), F.lpad(part(numeric, 2), 2, "0"), F.lpad(part(numeric, 1), 2, "0")), "yyyy-MM-dd"))
    named = r"^(\d{1,2})[\s\-.]*([A-Za-z]{3})[A-Za-z]*[\s\-.,]*(\d{4}|\d{2})$"
    month = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(part(named, 2)))
    by_name = F.when(t.rlike(named) & (month > 0), F.try_to_date(F.concat_ws("-", full(part(named, 3)), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(named, 1), 2, "0")), "yyyy-MM-dd"))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), iso), dmy, by_name)
