"""Incremental ingestion with Structured Streaming: markers are checkpoints, ticks are triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duespark.operators.folds import ordered_fold

#: Hours before each further try of a failed write.
BACKOFF_HOURS = (1, 2, 4, 8)


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """STM-01, STM-02: JSON documents as they arrive, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once_each(stream: DataFrame, keys: list[str], event_time: str, delay: str = "24 hours") -> DataFrame:
    """STM-04, STM-07: the first row of each key within the delay; state older than that is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """STM-01, STM-05: takes in what is there, then stops; a later run goes on after the checkpoint."""
    out = step(stream) if step else stream
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def polled(stream: DataFrame, target: str, checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """STM-06: a batch each minute."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def run_summary(batch: DataFrame) -> DataFrame:
    """STM-03: created, duplicate and failed rows of a batch (key, error)."""
    per = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    return per.agg(F.count_if(F.col("bad") == 0).alias("created"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("bad") > 0).alias("failed"))


def next_try(attempts: Column, last: Column) -> Column:
    """STM-08: when to try again; null once all tries are used up."""
    hours = F.get(F.array(*[F.lit(h) for h in BACKOFF_HOURS]), attempts)
    return F.timestamp_micros(F.unix_micros(last) + hours * 3_600_000_000)


def due_retries(rows: DataFrame, as_of: Column) -> DataFrame:
    """STM-08: rows (attempts, last_attempt) whose time has come."""
    return rows.filter(next_try(F.col("attempts"), F.col("last_attempt")) <= as_of)


def deliverable(rows: DataFrame, as_of: Column, most: int = 3, hours: int = 24) -> DataFrame:
    """STM-09: failed notifications of fewer than `most` tries, created within the last hours."""
    fresh = F.unix_micros("created_at") >= F.unix_micros(as_of) - hours * 3_600_000_000
    return rows.filter((F.col("status") == "failed") & (F.col("attempts") < most) & fresh)


def quiet_for_a_day(rows: DataFrame, key: str, at: str) -> DataFrame:
    """WIN-12: notifications that go out: the first of a key, then the first that comes over a day after the last that went out.

    Which rows go out depends on those before, so each key's times are folded in order, one state a key.
    """
    day = 86_400_000_000
    times = rows.select(F.col(key), F.unix_micros(at).alias("micros")).filter("micros IS NOT NULL")

    def step(state, row):
        if state["last"] is None or row["micros"] - state["last"] > day:
            state["last"] = row["micros"]
            yield row[key], row["micros"]

    kind = rows.schema[key].dataType.simpleString()
    sent = ordered_fold(times, [key], ["micros"], lambda: {"last": None}, step, f"`{key}` {kind}, micros bigint")
    return sent.select(key, F.timestamp_micros("micros").alias(at))
