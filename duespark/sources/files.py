"""Files in: bank statements, code lists, incremental listings. Files out: CSV."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duespark.functions.dates import parse_date
from duespark.functions.money import parse_amount, to_minor

#: Header names that stand for a code list's columns.
CODE_ALIASES = {"code": ("code", "glcode", "gl code", "account code"), "name": ("name", "glname", "gl name", "account name", "description"), "category": ("category", "type", "group"), "section": ("section", "tdssection", "linkedtdssection")}


def bank_statement(spark: SparkSession, path: str, columns: dict[str, int], delimiter: str = ",") -> DataFrame:
    """SRC-03: rows by position of date, description, debit, credit, reference and balance; the header is skipped.

    Rows without a date or with neither debit nor credit are left out. `""` within quotes is one quote.
    """
    width = max(columns.values()) + 1
    schema = ", ".join(f"c{k} string" for k in range(width))
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("sep", delimiter).option("escape", '"').csv(path)
    at = lambda name: F.trim(F.col(f"c{columns[name]}")) if name in columns else F.lit(None).cast("string")
    minor = lambda name: F.coalesce(to_minor(parse_amount(at(name))), F.lit(0))
    df = raw.select(parse_date(at("date")).alias("date"), at("description").alias("description"), minor("debit").alias("debit_minor"), minor("credit").alias("credit_minor"), at("reference").alias("reference"), to_minor(parse_amount(at("balance"))).alias("balance_minor"))
    return df.filter(F.col("date").isNotNull() & ((F.col("debit_minor") > 0) | (F.col("credit_minor") > 0)))


def code_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-05, SRC-06: rows by header aliases, and the rows that lack a code or a name."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    named = {c.strip().lower(): c for c in raw.columns}

    def pick(field: str) -> Column:
        found = next((named[a] for a in CODE_ALIASES[field] if a in named), None)
        return (F.nullif(F.trim(F.col(f"`{found}`")), F.lit("")) if found else F.lit(None).cast("string")).alias(field)

    rows = raw.select(*[pick(f) for f in CODE_ALIASES])
    bad = rows.filter("code IS NULL OR name IS NULL").withColumn("error", F.when(F.col("code").isNull(), "code is missing").otherwise("name is missing"))
    return rows.filter("code IS NOT NULL AND name IS NOT NULL"), bad


def new_files(listing: DataFrame, marker: tuple[datetime, str] | None, extensions: tuple[str, ...]) -> DataFrame:
    """SRC-07: files (path, modified) after the marker in the order of (modified, path), of the given extensions."""
    ok = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*extensions)
    if marker:
        at = F.lit(marker[0]).cast("timestamp")
        ok = ok & ((F.col("modified") > at) | ((F.col("modified") == at) & (F.col("path") > marker[1])))
    return listing.filter(ok)


def attachments(messages: DataFrame, after_uid: int, sender: str, types: tuple[str, ...]) -> DataFrame:
    """SRC-08: one row an attachment of messages (uid, sender, parts array<struct<name, mime, content>>) beyond a marker."""
    chosen = messages.filter((F.col("uid") > after_uid) & F.contains(F.lower("sender"), F.lit(sender.lower())))
    return chosen.select("uid", "sender", F.explode("parts").alias("p")).filter(F.col("p.mime").isin(*types)).select("uid", "sender", "p.name", "p.mime", "p.content")


def write_csv(rows: DataFrame, path: str, header: str) -> None:
    """SNK-01: one text column as CSV lines; every file starts with the header."""
    rows.withColumnRenamed(rows.columns[0], header).write.option("header", True).option("quote", "").option("sep", "\u0001").mode("overwrite").csv(path)
