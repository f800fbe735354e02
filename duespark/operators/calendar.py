"""E-04: working days. A calendar counts the working days up to each day, so that a distance is the difference of two look-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days of the week that aren't worked, as dayofweek numbers them: Sunday and Saturday.
WEEKEND = (1, 7)


def calendar(spark: SparkSession, first: date, last: date, holidays: DataFrame | None = None) -> DataFrame:
    """day, working, n (working days from `first` up to this day, itself included). holidays: day; repeated days, nulls and days outside count for nothing.

    One row a day, so the count runs in one small task: a century is 36,525 rows.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    off = F.dayofweek("day").isin(*WEEKEND)
    if holidays is not None:
        free = holidays.select(F.col("day").cast("date").alias("day")).dropna().distinct().withColumn("free", F.lit(True))
        days = days.join(F.broadcast(free.filter(F.col("day").between(F.lit(first), F.lit(last)))), "day", "left")
        off = off | F.coalesce("free", F.lit(False))
    days = days.select("day", (~off).alias("working"))
    return days.withColumn("n", F.sum(F.col("working").cast("bigint")).over(Window.orderBy("day")))


def with_working_days(rows: DataFrame, known: DataFrame, **dates: str) -> DataFrame:
    """rows with a column for each name: the count of the calendar `known` at the day of the given column; null outside the calendar.

    The calendar has one row a day and is broadcast.
    """
    for name, column in dates.items():
        at = F.broadcast(known.select(F.col("day").alias("__day"), F.col("n").alias(name)))
        rows = rows.join(at, F.col(column).cast("date") == F.col("__day"), "left").drop("__day")
    return rows


def working_days_between(a: Column, b: Column) -> Column:
    """How many working days lie from one day to another, by their counts; a day off counts as the working day before it."""
    return F.abs(a - b)
