"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words weighted by their counts. For each of K samples a word draws, from a
hash of itself and the sample's number, r and c from Gamma(2, 1) and b from the uniform
distribution; with t = floor(ln w / r + b) the word of the least ln a = ln c - r (t - b + 1)
and its t are the sample. Two documents agree in a sample with a probability equal to the
generalised Jaccard similarity of their weights, so the share of equal samples estimates it.

With 32 samples of 16 bits the estimate's standard error is at most 0.09.

A sample is the minimum of one BIGINT a word, ln a above a hash of (word, t). Documents are
dealt once, by ranges of their id; counting, sampling and the comparison with the following
document then need no further shuffle.

Defined results: a null text counts as empty; texts without words share one fingerprint, of
zeros; equal texts have equal fingerprints; a null id sorts first; equal ids sort by text; the
document after the last is the first, which for a single document is itself; an empty table
gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duespark.llm.quality_rules import words_of

SAMPLES = 32
#: Ranges of ids for each shuffle partition at least, and rows in a range about; a range of more rows only spills.
RANGES_PER_PARTITION = 4
ROWS_PER_RANGE = 20_000
BITS = 21


def _uniform(bits: Column, k: int) -> Column:
    """The k-th 21 bits of a hash as a number within (0, 1)."""
    part = F.shiftrightunsigned(bits, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    return (part + F.lit(0.5)) * F.lit(2.0**-BITS)


def sample_code(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th sample of one weighted term as a BIGINT that sorts by ln a; its lower half names the term and t."""
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_uniform(first, 0) * _uniform(first, 1))
    log_c = F.log(-F.log(_uniform(second, 0) * _uniform(second, 1)))
    b = _uniform(first, 2)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + F.lit(1.0))
    return F.shiftleft(((log_a + F.lit(128.0)) * F.lit(2.0**23)).cast("bigint"), 32).bitwiseOR(F.hash(term, t).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def _runs(df: DataFrame, hashes: str, which: int) -> DataFrame:
    """Adds r<which>: array<struct<which, term, log_weight>> for a sorted array of word hashes."""
    h, at = F.col(hashes), F.col(f"{hashes}_at")
    df = df.withColumn(f"{hashes}_at", F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: (k == 0) | (F.get(h, k - 1) != F.get(h, k)))).otherwise(F.array().cast("array<int>")))
    term = lambda s, k: F.struct(F.lit(which).alias("which"), F.get(h, s).alias("term"), F.log((F.coalesce(F.get(at, k + 1), F.size(h)) - s).cast("double")).alias("log_weight"))
    return df.withColumn(f"r{which}", F.transform(at, term))


def _ranges(df: DataFrame) -> tuple[list[int], Column]:
    """Ids that start a range (the least id aside), and what tells the first document."""
    spark = df.sparkSession
    row = df.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n = max(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), row["n"] // ROWS_PER_RANGE)
    found = df.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(20_000, 10 * n))).first()[0] if row["n"] else []
    cuts = sorted(set(found or []))
    if row["nulls"]:
        return cuts, F.col("doc_id").isNull()
    return [c for c in cuts if c != row["least"]], F.col("doc_id") == F.lit(row["least"])


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place, ghost, ord, doc_id, text, following (the next document's text), dealt by place.

    Each range also gets the first documents of the next one as ghosts, so that no range waits for another.
    """
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts, is_first = _ranges(df)
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    # How many cuts aren't above the id, in two steps: first among every step-th cut, then between two of these.
    step = max(1, math.isqrt(len(cuts)))
    at_most = lambda xs: F.coalesce(F.size(F.filter(xs, lambda c: c <= F.col("doc_id"))), F.lit(0))
    heads = F.split(F.lit(",".join(map(str, cuts[::step]))), ",").cast("array<bigint>") if cuts else bounds
    df = df.withColumn("head", at_most(heads))
    df = df.withColumn("own", F.when(F.col("head") > 0, (F.col("head") - 1) * step + at_most(F.slice(bounds, (F.col("head") - 1) * step + 1, F.lit(step)))).otherwise(0))
    starts = F.when(F.get(bounds, F.col("own") - 1) == F.col("doc_id"), F.col("own") - 1)
    wraps = F.when(is_first, F.lit(len(cuts)))
    places = F.array(F.struct(F.col("own").alias("place"), F.lit(0).alias("ghost")), F.struct(starts.alias("place"), F.lit(1).alias("ghost")), F.struct(wraps.alias("place"), F.lit(1).alias("ghost")))
    df = df.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["place"].isNotNull())).alias("p")).select("p.place", "p.ghost", "doc_id", "text")
    w = Window.partitionBy("place").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return df.select("*", F.row_number().over(w).alias("ord"), F.lead("text").over(w).alias("following"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited (the edited text's SHA-256), fp, edited_fp, next_fp (arrays of samples).

    The edited text has its last quarter of code points replaced by as many from the start of the following document.
    """
    df = with_following(docs, id_col, text_col)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    df = df.select("*", n.cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("following", F.lit("")), F.lit(1), quarter)).alias("edited_text"))
    hashed = lambda text: F.sort_array(F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.select("place", "ghost", "ord", "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited"), hashed("text").alias("h0"), hashed("edited_text").alias("h1"))
    df = _runs(_runs(df, "h0", 0), "h1", 1)
    keys = ["place", "ghost", "ord", "doc_id", "n_chars", "edited"]
    df = df.select(*keys, F.explode_outer(F.concat("r0", "r1")).alias("x")).select(*keys, "x.which", "x.term", "x.log_weight")
    codes = [F.min(sample_code(F.col("term"), F.col("log_weight"), k)).alias(f"c{k}") for k in range(samples)]
    low = lambda k: F.coalesce(F.col(f"c{k}").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(0))
    df = df.groupBy(*keys, "which").agg(*codes).select(*keys, "which", F.array(*[low(k) for k in range(samples)]).alias("fp"))
    zeros = F.array_repeat(F.lit(0), samples)
    df = df.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    df = df.withColumns({"fp": F.coalesce("fp", zeros), "edited_fp": F.coalesce("edited_fp", zeros)})
    w = Window.partitionBy("place").orderBy("ord")
    return df.withColumn("next_fp", F.lead("fp").over(w)).filter("ghost = 0").select("doc_id", "n_chars", "edited", "fp", "edited_fp", "next_fp")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def as_text(fp: Column) -> Column:
    """Four hexadecimal digits a sample."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
