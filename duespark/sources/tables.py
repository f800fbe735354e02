"""Readers of the driver's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(rows: DataFrame, most: int) -> int:
    """Into how many tasks rows are dealt so that one has about `most` of them: more than the session's number if the table is large.

    A task's share grows with the table otherwise, and with it what is sorted in memory or on disk. Parquet files are counted by their footers.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over all cores, for costly work on each row: a small file, or one of few row groups, is one task otherwise.

    The number of tasks is given, as adaptive execution would join small ones again.
    """
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)
