"""A content-addressed archive of WARC records, and its reader.

An archive is two tables in one folder. `payloads` holds each distinct payload once, under its
SHA-256; `headers` holds one row a record: the exact header bytes, the digest of its payload and
the URL as it came (in the header its line breaks are percent-encoded). The reader joins them,
rebuilds whole records, parses these, and checks both digests against the bytes that it got; a
payload that many records share is read and checked once. Of the records with one payload the one with the largest page_id is the
response; the others are revisits that refer to it.

Only ids and digests take part in the search for responses, so a payload shared by many pages
doesn't gather their texts anywhere. Payload bytes are shuffled once to be written and once to
be read.

Defined results: a null html counts as empty, a null url as an empty one; empty payloads are
payloads too; a null page_id sorts below all others and is written as an empty id; if several
rows share the largest page_id of a payload, the one with the largest url is the response, and
of rows alike in both, one; an empty table gives empty archives. Other columns are ignored.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duespark.llm.scratch import fresh_path, write_table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight letters for every ten hexadecimal digits."""
    digest = F.sha1(data)
    letters = []
    for group in range(4):
        number = F.conv(F.substring(digest, 10 * group + 1, 10), 16, 10).cast("bigint")
        for k in range(8):
            place = F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(BASE32), place + 1, F.lit(1)))
    return F.concat(*letters)


def _header(kind: str, target: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    lines = [
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.lit(kind)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page"), F.lit(">"))),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
    ]
    if kind == "revisit":
        lines.append(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), target, F.lit(">"))))
        lines.append(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    # A revisit's block is empty: its payload stands in the record that it refers to.
    lines.append(line("Content-Length", (F.col("size") if kind == "response" else F.lit(0)).cast("string")))
    return F.concat(*lines, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> None:
    """Writes path/payloads and path/headers. Payloads of fewer bytes than min_bytes never become revisits.

    date: the records' WARC-Date, as 2024-01-31T12:00:00Z; the time of writing by default.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    )
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("bigint").alias("size"))
    # Rows alike in page, url and payload differ only in their number here.
    facts = facts.groupBy("page_id", "url", "sha256", "sha1", "size").agg(F.count(F.lit(1)).alias("times"))
    first = facts.groupBy("sha256").agg(F.max_by(F.struct("page_id", "url"), F.struct(F.coalesce("page_id", F.lit(-(2**63))), "url")).alias("first"))
    known = facts.join(first, "sha256").withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url")))
    known = known.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("nth"))
    small = F.col("size") < min_bytes
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))
    response = small | (F.col("is_first") & (F.col("nth") == 1))
    headers = known.withColumn("page", page).select("sha256", "url", F.when(response, _header("response", target, date)).otherwise(_header("revisit", target, date)).cast("binary").alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")

    # The first row of each payload brings its bytes. Grouped by all join keys, the payloads aren't shuffled again.
    keys = ["key", "url", "sha256"]
    key = lambda page_id: F.coalesce(page_id.cast("string"), F.lit("")).alias("key")
    chosen = first.select(key(F.col("first.page_id")), F.col("first.url").alias("url"), "sha256")
    carried = rows.select(key(F.col("page_id")), "url", F.sha2("payload", 256).alias("sha256"), "payload").join(chosen, keys)
    carried.groupBy(*keys).agg(F.first("payload").alias("payload")).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: sha256, page_id, record_type, refers_to, url, stated_digest, header."""
    headers = spark.read.schema("sha256 string, url string, header binary").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(text, rf"(?m)^{name}: {pattern}$", 1)
    number = lambda s: F.nullif(s, F.lit("")).cast("bigint")
    return headers.select(
        "sha256",
        number(field("WARC-Record-ID", r"<urn:page:(-?\d*)>")).alias("page_id"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        number(field("WARC-Refers-To", r"<urn:page:(-?\d*)>")).alias("refers_to"),
        "url",
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("stated_digest"),
        "header",
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, record_type, refers_to, url, stated_digest, header, payload (of the response, for revisits too), intact.

    intact tells whether the payload's SHA-256 and SHA-1 are those stated.
    """
    df = read_headers(spark, path).join(_payloads(spark, path), "sha256")
    return df.withColumn("intact", (F.sha2("payload", 256) == F.col("sha256")) & (base32_sha1(F.col("payload")) == F.col("stated_digest"))).drop("sha256")


def checked_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, record_type, refers_to, url, payload_bytes, payload_digest, intact, from the rebuilt records.

    Each response is rebuilt and its payload taken out of the record's bytes; a revisit has the facts of
    the response that it refers to, by its digest, so no payload is read for it.
    """
    headers = read_headers(spark, path)
    whole = headers.filter("record_type = 'response'").join(_payloads(spark, path), "sha256")
    whole = whole.withColumn("record", _record())
    length = F.regexp_extract(F.decode("header", "UTF-8"), r"(?m)^Content-Length: (\d+)$", 1).cast("int")
    block = F.substring(F.col("record"), F.length("header") + 1, length)
    found = whole.select("sha256", "page_id", "url", "stated_digest", block.alias("block"))
    digest = base32_sha1(F.col("block"))
    facts = found.select("sha256", "page_id", "url", F.length("block").cast("bigint").alias("payload_bytes"), digest.alias("payload_digest"), ((F.sha2("block", 256) == F.col("sha256")) & (digest == F.col("stated_digest"))).alias("intact"))
    facts = write_table(facts, "responses")
    shared = facts.select("sha256", "payload_bytes", "payload_digest", "intact")
    revisits = headers.filter("record_type = 'revisit'").join(shared, "sha256").withColumn("intact", F.col("intact") & (F.col("payload_digest") == F.col("stated_digest")))
    columns = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "intact"]
    responses = facts.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("bigint")})
    return responses.select(*columns).unionByName(revisits.select(*columns))


def _record() -> Column:
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat("header", block, F.lit(b"\r\n\r\n"))


def records(archive: DataFrame) -> DataFrame:
    """page_id, record: the bytes of each whole WARC record. A revisit has no block."""
    return archive.select("page_id", _record().alias("record"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive of pages into the shared folder and reads it back, with the payload of each record."""
    return read_archive(pages.sparkSession, _stored(pages, min_bytes))


def checked_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive of pages into the shared folder, rebuilds its records and checks them."""
    return checked_records(pages.sparkSession, _stored(pages, min_bytes))


def _stored(pages: DataFrame, min_bytes: int) -> str:
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return path
