"""Written intermediate tables, in the folder that the whole cluster shares.

A written table cuts the lineage: when an executor is lost, its later tasks read
the table again, and nothing before it is computed anew. The tables of one
application lie in one folder, duespark/<application id>, which can be deleted as
a whole once its results are stored.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="duespark-")
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/duespark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; otherwise as it is, for a shuffled join. df should be a written table."""
    return F.broadcast(df) if df.count() <= most else df


def broadcast_under(df: DataFrame, most_bytes: int) -> DataFrame:
    """df with a broadcast hint if its values take at most that many bytes, 8 and more a value; otherwise as it is, for a shuffled join. df should be a written table of plain columns."""
    width = lambda f: F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.lit(0)
    row = sum((F.coalesce(width(f), F.lit(0)) + 8 for f in df.schema), F.lit(16))
    size = df.agg(F.sum(row.cast("bigint")).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= most_bytes else df


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores after it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
