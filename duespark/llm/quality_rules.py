"""Document quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words are runs of `[^\\x20\\x09-\\x0D]`. The verdict uses tokens, which part letters and digits
from other signs, lower-cased. Their unigrams and bigrams fall into hashed buckets; the bucket
counts of all documents (raw corpus) and of the trusted ones give two smoothed multinomials.
A document's score is the mean log ratio of trusted to raw over its n-grams, and the document
is kept if the score reaches a fixed threshold: no document is drawn at random.

The counts cover every document. What reaches the driver is two numbers for each bucket. The
ratios are whole numbers (millionths), so a score doesn't depend on the order of its sum.

Defined results: a null text counts as empty; a text without words has zero counts and fails
the base rules; repeated rows are scored alike, each on its own; with no trusted documents all
ratios come from smoothing alone; an empty table gives no rows. Only the id and the text are
read, so other columns' names don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duespark.llm.scratch import broadcast_if, write_table

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 10_000
#: Mean log ratio (natural logarithm) that a document needs.
THRESHOLD = -0.3
MIN_WORDS = 50
#: Trusted ids up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
POSITION_BITS = 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def ngrams_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))


def bucket_of(*hashes: Column) -> Column:
    """The bucket of a token's hash, or of the hashes of a pair: each token's text is hashed once."""
    return F.pmod(F.xxhash64(*hashes), F.lit(BUCKETS)).cast("int")


def hashes_of(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _covered(positions: Column) -> Column:
    """Words in the union of three-word windows at sorted positions."""
    return F.aggregate(F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (their hashes) and the counts that the base rules need.

    Windows found twice are adjacent once sorted: each window is one BIGINT, the upper bits of its hash
    over its position. Where two different windows share those bits, or positions need more of them, the
    windows themselves are compared.
    """
    mask = (1 << POSITION_BITS) - 1
    high = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    gram = lambda words, p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))

    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("*", words_of(F.col("text")).alias("words"), hashes_of(ngrams_of(F.col("text"))).alias("tokens"))
    df = df.select("*", hashes_of(F.col("words")).alias("hashes"))
    words, hashes, n = F.col("words"), F.col("hashes"), F.size("words")
    df = df.select(
        "*",
        n.cast("bigint").alias("n_words"),
        F.when(n >= 3, F.sort_array(F.transform(F.slice(hashes, 1, n - 2), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))).alias("windows"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(SPACE.replace("[", "[^"))).alias("lines"),
    )
    windows = F.col("windows")
    # Each window against the next one; of two alike both are kept, and a window is named once.
    alike = F.zip_with(windows, F.slice(windows, 2, F.greatest(F.size(windows), F.lit(0))), lambda x, y: F.when(high(x.bitwiseXOR(y)) == 0, F.array(x, y)))
    df = df.select("*", F.array_distinct(F.flatten(F.filter(alike, lambda p: p.isNotNull()))).alias("twice"))
    twice = F.col("twice")
    at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    clash = (n > mask) | F.exists(F.transform(twice, lambda x, k: (k > 0) & (high(F.get(twice, k - 1)) == high(x)) & (gram(words, at(F.get(twice, k - 1))) != gram(words, at(x)))), lambda c: F.coalesce(c, F.lit(False)))
    df = df.select("*", F.coalesce(clash, F.lit(False)).alias("clash"), F.sort_array(F.transform(twice, at)).alias("quick"))
    grams = F.transform(F.slice(words, 1, n - 2), lambda w, i: gram(words, i))
    df = df.select("*", F.when(F.col("clash"), grams).alias("grams"))
    df = df.select("*", F.when(F.col("clash"), F.sort_array("grams")).alias("sorted"))
    df = df.select("*", F.array_distinct(F.filter("sorted", lambda g, k: (k > 0) & (F.get(F.col("sorted"), k - 1) == g))).alias("doubled"))
    slow = F.filter(F.transform("grams", lambda g, k: F.when(F.array_contains("doubled", g), k)), lambda k: k.isNotNull())
    df = df.select("*", F.when(F.col("clash"), slow).otherwise(F.col("quick")).alias("positions"))
    return df.select(
        "doc_id",
        "tokens",
        "n_words",
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("positions")), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def _of_hashes(h: Column) -> Column:
    """The buckets of all tokens and pairs of hashes."""
    return F.concat(F.transform(h, lambda x: bucket_of(x)), F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: bucket_of(x, F.get(h, i + 1))))


def _buckets(tokens: Column) -> Column:
    """The buckets of all tokens and pairs; the hashes are bound to a name, so that each token is hashed once."""
    return F.get(F.transform(F.array(hashes_of(tokens)), _of_hashes), F.lit(0))


def _with_trust(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with good. trusted: ids, one column; nulls are no ids."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted_id")).dropna().distinct()
    ids = broadcast_if(write_table(ids, "trusted"), BROADCAST_IDS)
    return rows.join(ids, rows["doc_id"] == F.col("trusted_id"), "left").withColumn("good", F.col("trusted_id").isNotNull()).drop("trusted_id")


def _ratios(rows: DataFrame) -> list[int]:
    """Millionths of log(trusted / raw) for each bucket of rows (good, buckets)."""
    counts = rows.select("good", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good")).collect()
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        good[row["bucket"]] += row["good"]
    shift = math.log(sum(raw) / sum(good))
    return [round(1e6 * (math.log(g / r) + shift)) for g, r in zip(good, raw, strict=True)]


def _verdicts(rows: DataFrame, ratios: list[int], threshold: float) -> DataFrame:
    """The verdicts of rows with the base counts and buckets."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = rows.select(*counts, (total / (F.greatest(F.size("buckets"), F.lit(1)) * F.lit(1e6))).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(*counts, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def fit_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Millionths of log(trusted / raw) for each bucket. trusted: the ids of trusted documents, one column, without nulls."""
    df = docs.select(F.col(id_col).alias("doc_id"), _buckets(ngrams_of(F.coalesce(F.col(text_col), F.lit("")))).alias("buckets"))
    return _ratios(_with_trust(df, trusted))


def judge(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    return _verdicts(_counted(docs, id_col, text_col), ratios, threshold)


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return base_counts(docs, id_col, text_col).withColumn("buckets", _of_hashes(F.col("tokens"))).drop("tokens")


def fit_and_judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdicts of docs by the ratios that docs and trusted give. Texts are read once: counts and buckets go to a written table, about 0.6 of the input."""
    rows = write_table(_counted(docs, id_col, text_col), "buckets")
    return _verdicts(rows, _ratios(_with_trust(rows.select("doc_id", "buckets"), trusted)), threshold)
