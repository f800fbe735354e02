"""Projections of rows for an API, and ranks that no single task has to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_nulls(*columns: Column | str) -> Column:
    """PRJ-03: the JSON of the columns; null fields are left out, in nested structs too."""
    return F.to_json(F.struct(*columns))


def compliance_summary(section: Column, gl_code: Column, signals: Column) -> Column:
    """PRJ-04: section and code (null where there is none), number and highest severity of the open signals (code, severity, ...)."""
    rank = lambda s: F.when(s["severity"] == "critical", 3).when(s["severity"] == "warning", 2).when(s["severity"] == "info", 1).otherwise(0)
    names = F.array(F.lit(None).cast("string"), F.lit("info"), F.lit("warning"), F.lit("critical"))
    highest = F.get(names, F.coalesce(F.array_max(F.transform(signals, rank)), F.lit(0)))
    return F.struct(section.alias("tds_section"), gl_code.alias("gl_code"), F.coalesce(F.size(signals), F.lit(0)).alias("signals"), highest.alias("severity"))


def nullable_text(value: Column) -> Column:
    """PRJ-05: an empty text is none."""
    return F.when(F.length(value) > 0, value)


def nullable_number(value: Column) -> Column:
    """PRJ-05: what isn't a number is none."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def ranked(rows: DataFrame, keys: list[str], coarse: Column, order: list[Column]) -> DataFrame:
    """SRT-05, SRT-09: adds `rank` from 1 within the keys, by coarse and then order.

    Rows are numbered within each value of coarse and the counts of lesser values are added, so that a
    key with very many rows isn't sorted in one task. coarse isn't null.
    """
    df = rows.withColumn("__coarse", coarse)
    lesser = Window.partitionBy(*keys).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*keys, "__coarse").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__coarse", F.coalesce(F.sum("__n").over(lesser), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__coarse").orderBy(*order)
    numbered = df.join(before, [*keys, "__coarse"]).withColumn("rank", F.col("__before") + F.row_number().over(within))
    return numbered.select(*rows.columns, "rank")


def locale_order(label: Column) -> Column:
    """SRT-07: a label that sorts as people read: by letters, then accents, then case, small letters first."""
    return F.collate(label, "UNICODE")


def same_letters(label: Column) -> Column:
    """SRT-07: a label that equals, groups and joins with those of the same letters, whatever their case and accents."""
    return F.collate(label, "UNICODE_CI_AI")


def labelled(rows: DataFrame, code: str, name: str) -> DataFrame:
    """SRT-07: each code once, with the label "name (code)", or the code where there is no name, in the order of a reader's language; ties by code. Of several names of a code the least is taken."""
    one = rows.filter(F.col(code) != "").groupBy(code).agg(F.min(F.nullif(F.col(name), F.lit(""))).alias(name))
    label = F.when(F.col(name).isNotNull(), F.concat(F.col(name), F.lit(" ("), F.col(code), F.lit(")"))).otherwise(F.col(code))
    return one.withColumn("label", label).orderBy(locale_order(F.col("label")), code)
