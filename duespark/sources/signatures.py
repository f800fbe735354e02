"""STR-20: what a document's file looks like from outside: type, size bucket, pages of a PDF, sides and shape of a picture."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Bytes of a size bucket, MIME types by extension, the eight bytes that begin a PNG.
BUCKET = 32_768
EXTENSIONS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
PNG = "89504E470D0A1A0A"
OTHER = "application/octet-stream"


def mime_of(path: Column) -> Column:
    """The MIME type that a path's extension says."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*(F.when(ending == e, m) for e, m in EXTENSIONS.items()), F.lit(OTHER))


def pdf_pages(content: Column) -> Column:
    """How many page objects a PDF names; one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type[\s ]*/Page\b")))


def png_sides(content: Column) -> Column:
    """Struct of width and height from a PNG's header; null for other bytes, a header that is cut off, or a side of zero."""
    side = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    ok = (F.octet_length(content) >= 24) & (F.hex(F.substring(content, 1, 8)) == PNG) & (side(17) > 0) & (side(21) > 0)
    return F.when(ok, F.struct(side(17).alias("width"), side(21).alias("height")))


def jpeg_frame(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first start of frame; segments before it are skipped by their lengths."""
    if data is None or len(data) < 4 or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 8 < len(data):
        if data[at] != 0xFF:
            at = data.find(b"\xff", at)
            if at < 0:
                return None
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big")
            return (width, height) if width and height else None
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if not length:
            return None
        at += length + 2
    return None


def jpeg_sides(content: Column) -> Column:
    """Struct of width and height of a JPEG; of nulls for other bytes."""
    import pandas as pd

    @F.pandas_udf(StructType().add("width", LongType()).add("height", LongType()))
    def sides(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_frame(x) or (None, None) for x in contents], columns=["width", "height"], dtype="Int64")

    return sides(content)


def layout_signatures(files: DataFrame) -> DataFrame:
    """files (mime, length, content) with a column signature.

    The content is looked at for PDF, PNG and JPEG alone and may be null for others. Bytes that aren't what the type
    says have no sides (a PDF: one page). A null or empty file is in the first size bucket.
    """
    content = lambda m: F.when(F.col("mime") == m, F.col("content"))
    named = files.withColumn("__jpeg", jpeg_sides(content("image/jpeg"))).withColumn("__png", png_sides(content("image/png")))
    width, height = (F.coalesce(F.col(f"__png.{s}"), F.col(f"__jpeg.{s}")) for s in ("width", "height"))
    ratio = F.when(width / height < 0.8, "portrait").when(width / height > 1.3, "landscape").otherwise("square-ish")
    bucket = F.greatest(F.lit(1), F.ceil(F.coalesce("length", F.lit(0)) / BUCKET)).cast("string")
    pages = F.when(F.col("mime") == "application/pdf", F.concat(F.lit("pages:"), F.coalesce(pdf_pages(F.col("content")), F.lit(1)).cast("string")))
    sides = F.when(width.isNotNull() & height.isNotNull(), F.concat(F.lit("w:"), width.cast("string"), F.lit("|h:"), height.cast("string"), F.lit("|ratio:"), ratio))
    return named.withColumn("signature", F.concat_ws("|", "mime", F.concat(F.lit("size-bucket:"), bucket), pages, sides)).drop("__jpeg", "__png")


def file_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """path, mime, length, signature of the files of a folder. Files of other types than PDF, PNG and JPEG are listed, not read; empty files have no row."""
    known = ",".join(f"*.{e},*.{e.upper()}" for e in ("pdf", "png", "jpg", "jpeg"))
    read = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    wanted = read(f"{{{known}}}").select("path", mime_of(F.col("path")).alias("mime"), "length", "content")
    listed = read("*").select("path", mime_of(F.col("path")).alias("mime"), "length", F.lit(None).cast("binary").alias("content"))
    rest = listed.filter(~F.col("mime").isin(*(EXTENSIONS[e] for e in ("pdf", "png", "jpg"))))
    return layout_signatures(wanted.unionByName(rest)).select("path", "mime", "length", "signature")
