"""Predicates, joins, paging and sets with the document store's null rules stated."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(column: Column, values: list) -> Column:
    """FLT-03: rows with a null match too."""
    return column.isNull() | ~column.isin(values)


def filled(column: Column) -> Column:
    """FLT-04."""
    return column.isNotNull() & (column != "")


def any_of(column: Column, comma_list: str) -> Column:
    """FLT-02."""
    values = [v.strip() for v in comma_list.split(",") if v.strip()]
    return column == values[0] if len(values) == 1 else column.isin(values)


def optional(**wanted) -> Column:
    """FLT-15: equality on the given fields; None leaves a field free."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def through_day(column: Column, day: str) -> Column:
    """FLT-06: up to the end of the day."""
    return column < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """FLT-07."""
    return (end >= low) & (start <= high)


def rule_holds(field: Column, op: Column, value: Column) -> Column:
    """FLT-16: an unknown value or operator holds."""
    cases = F.when(op == "eq", field == value).when(op == "gt", field > value).when(op == "gte", field >= value).when(op == "lt", field < value).when(op == "lte", field <= value)
    return F.coalesce(cases, F.lit(True))


def after_cursor(cursor: dict | None, keys: list[str]) -> Column:
    """FLT-11: rows that follow a cursor in an all-descending order."""
    if cursor is None:
        return F.lit(True)
    lit = lambda v: F.lit(v).cast("timestamp") if isinstance(v, datetime) else F.lit(v)
    out = F.lit(False)
    for k in reversed(keys):
        out = (F.col(k) < lit(cursor[k])) | ((F.col(k) == lit(cursor[k])) & out)
    return out


def keyset_page(rows: DataFrame, keys: list[str], size: int, cursor: dict | None = None) -> DataFrame:
    """SRT-03: one row more than a page, so that the caller sees whether another follows."""
    return rows.filter(after_cursor(cursor, keys)).orderBy(*[F.desc(k) for k in keys]).limit(size + 1)


def encode_cursor(*columns: str) -> Column:
    """SRT-04: URL-safe base64 of the JSON of a row's keys, without padding."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(*columns)).cast("binary")), "+/", "-_"), F.lit("="))


def sorted_by(rows: DataFrame, key: str | None, ascending: bool, allowed: dict[str, str], default: str, tie: str) -> DataFrame:
    """SRT-01: an unknown key falls back to the default, newest first."""
    column = allowed.get(key or "", None)
    if column is None:
        return rows.orderBy(F.desc(default), tie)
    return rows.orderBy(F.asc(column) if ascending else F.desc(column), tie)


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """SRT-02: pages from 1; bounds are clamped."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def same_key_other_row(rows: DataFrame, keys: list[str], id_col: str, differs: str) -> DataFrame:
    """JN-13: rows of whose keys another row has a different value, from one pre-aggregation instead of a self-join."""
    facts = rows.dropna(subset=keys).groupBy(*keys).agg(F.min(differs).alias("__lo"), F.max(differs).alias("__hi"))
    return rows.join(facts.filter("__lo <> __hi").select(*keys), keys, "left_semi").select(id_col)


def resolve_org(files: DataFrame, orgs: DataFrame) -> DataFrame:
    """JN-18: files (file_id, gstin, candidates array) and orgs (org_id, org_gstin): one hit by tax id, else a single candidate, else triage."""
    each = files.select("file_id", "gstin", F.size("candidates").alias("n"), F.explode("candidates").alias("org_id"))
    hits = each.join(orgs, "org_id", "left").groupBy("file_id").agg(F.max("n").alias("n"), F.count_if(F.col("gstin") == F.col("org_gstin")).alias("hits"), F.min(F.when(F.col("gstin") == F.col("org_gstin"), F.col("org_id"))).alias("hit"), F.min("org_id").alias("only"))
    out = F.when(F.col("hits") == 1, F.col("hit")).when(F.col("n") == 1, F.col("only"))
    return files.select("file_id").join(hits.select("file_id", out.alias("org_id")), "file_id", "left")


def section_union(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """JN-20: both sides' keys with zeros where one has none."""
    r = right.select(F.col(key), F.col(value).alias("source"))
    return left.select(key, F.col(value).alias("target")).join(r, key, "full").select(key, F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("source", F.lit(0)).alias("source"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """SET-05, SET-11: rows of first, and those of second whose key first doesn't have."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def dependents(**counts: DataFrame) -> DataFrame:
    """AG-23: label and count of each table, with their total."""
    parts = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        parts = one if parts is None else parts.unionByName(one)
    total = parts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("label"), "n")
    return parts.unionByName(total)
