"""Text operators over documents: totals, currencies, languages, chunks, evaluation."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from duespark.functions.money import amount_token, bound, round_half_up

# What lines with a total say, what others say, and what amounts look like.
_W = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
STRONG = r"(?i)(grand\s*total|amount\s*payable|amount\s*due|total\s*due|invoice\s*total|invoice\s*value|total\s*amount|net\s*payable|net\s*amount\s*payable|total\s*payable|amt\s*due|betrag)"
WEAK = r"(?i)\b(total|payable|balance|amount\s*due|amt\s*due|amount)\b"
NEGATIVE = r"(?i)(sub\s*total|subtotal|balance\s*due|tax(?:able)?|vat|gst|cgst|sgst|igst|mwst|u\s*st|ust|discount|round(?:ing)?\s*off|shipping|freight|delivery|paid|payment\s*received|advance|credit\s*note)"
CURRENCY_MARK = r"(?i)[€£$₹]|(?:\bUSD\b|\bEUR\b|\bGBP\b|\bINR\b)"
MONEY_MARK = r"(?i)[€£$₹]|(?:\bUSD\b|\bEUR\b|\bGBP\b|\bINR\b|\bAUD\b|\bCAD\b|\bJPY\b|\bAED\b|\bSGD\b|\bCHF\b|\bCNY\b)"
FRACTION = r"[.,]\d{1,2}\b"
AMOUNT = r"[-+]?(?:\d{1,3}(?:[,\s.]\d{2,3})+|\d+)(?:[.,]\d{1,2})?"
LOOKAHEAD = 3
#: Frequent short words of the languages told apart.
LEXICON = {"en": "the and of to in is that for it with", "de": "der die und das ist nicht ein den mit von", "fr": "le la les des est et une dans que pour", "es": "el los del las una por con para que se"}
SCRIPTS = {"hi": r"[ऀ-ॿ]", "ar": r"[؀-ۿ]", "zh": r"[一-鿿]", "ru": r"[Ѐ-ӿ]"}


def _says(line: Column, pattern: str) -> Column:
    """Whether a line matches; word borders are those of ASCII letters, whatever stands beside."""
    return line.rlike(pattern.replace(r"\b", _W))


def is_whole(amount: Column) -> Column:
    """Whether a positive amount has no fraction. A double from 2 ** 53 on has none, and may be too large for the bigint that floor gives."""
    return (amount >= float(2**53)) | (F.floor(amount) == amount)


def magnitude_score(amount: Column) -> Column:
    """TXT-03: fractions and large amounts count for a total, years, millions and less than one against it."""
    whole = is_whole(amount)
    size = F.when(amount >= 10_000, 6).when(amount >= 100, 4).when(amount >= 1, 1).otherwise(-5)
    return F.when(whole, 0).otherwise(6) - F.when(whole & amount.between(1900, 2100), 18).otherwise(0) - F.when(amount >= 1_000_000, 8).otherwise(0) + size


def line_score(line: Column, position: Column, lines: Column) -> Column:
    """TXT-03: what a line's label, currency, place in the text and percent sign say."""
    label = F.when(_says(line, STRONG), 120).when(_says(line, WEAK), 55).otherwise(0) - F.when(_says(line, NEGATIVE), 85).otherwise(0)
    return label + F.when(_says(line, CURRENCY_MARK), 6).otherwise(0) + place_score(position, lines) - F.when(line.contains("%"), 12).otherwise(0)


def place_score(position: Column, lines: Column) -> Column:
    return F.when(position >= F.floor(lines * F.lit(0.6)), 8).otherwise(0)


def amounts_in(line: Column) -> Column:
    """The positive amounts of a line, in order; amounts written together with two decimals each are parted."""
    even = F.regexp_replace(F.replace(line, F.lit("\u00a0"), F.lit(" ")), r"\s+", " ")

    def parted(token: Column) -> Column:
        compact = F.regexp_replace(token, r"\s+", "")
        each = lambda mark: F.when(compact.rlike(rf"^\d+{mark}\d{{2}}(?:\d+{mark}\d{{2}})+$"), F.regexp_extract_all(compact, F.lit(rf"\d+{mark}\d{{2}}"), F.lit(0)))
        return F.coalesce(each(r"\."), each(","), F.array(token))

    tokens = F.flatten(F.transform(F.regexp_extract_all(even, F.lit(AMOUNT), F.lit(0)), parted))
    return F.filter(F.transform(tokens, amount_token), lambda a: a.isNotNull() & (a > 0))


def totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TXT-02: each document's total: score, amount, line (of the lines that aren't empty); null if it has none.

    Candidates are the amounts of lines labelled as a total, or else of up to three lines after such a one, until a
    line of words without an amount; labels that score nothing give none. Without candidates, amounts of other lines
    that look like money are. The best score wins, then the larger amount, then the later line. All within the row.
    """
    lines = F.filter(F.transform(F.split(F.translate(F.col(text_col), "\r", "\n"), r"\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    df = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    df = df.withColumns({"n": F.size("lines"), "amounts": F.transform("lines", amounts_in)})
    of = lambda k: F.coalesce(F.get("amounts", k), F.array().cast("array<double>"))
    ends = lambda k: F.coalesce(F.get("lines", k).rlike("[A-Za-z]"), F.lit(True)) & (F.size(of(k)) == 0)

    def after(k: Column) -> Column:
        found = of(k + LOOKAHEAD)
        for step in range(LOOKAHEAD - 1, 0, -1):
            found = F.concat(of(k + step), F.when(ends(k + step + 1), F.array().cast("array<double>")).otherwise(found))
        return found

    def labelled(line: Column, k: Column) -> Column:
        score = line_score(line, k, F.col("n"))
        near = F.when(F.size(of(k)) > 0, of(k)).otherwise(after(k))
        scored = bound(score, lambda s: F.when(s > 0, F.transform(near, lambda a: F.struct((s + magnitude_score(a)).alias("score"), a.alias("amount"), k.alias("line")))))
        return F.when(_says(line, STRONG) | _says(line, WEAK), scored)

    def like_money(line: Column, k: Column) -> Column:
        fits = ~_says(line, NEGATIVE) & (_says(line, WEAK) | _says(line, MONEY_MARK) | _says(line, FRACTION) | F.exists(of(k), lambda a: ~is_whole(a)))
        return F.when(fits, F.transform(of(k), lambda a: F.struct((place_score(k, F.col("n")) + magnitude_score(a)).alias("score"), a.alias("amount"), k.alias("line"))))

    best = lambda of_line: F.array_max(F.flatten(F.array_compact(F.transform("lines", of_line))))
    df = df.withColumn("labelled", best(labelled))
    df = df.withColumn("best", F.when(F.col("labelled").isNotNull(), F.col("labelled")).otherwise(best(like_money)))
    return df.select("doc_id", F.col("best.score").cast("bigint").alias("score"), F.col("best.amount").alias("amount"), F.col("best.line").cast("bigint").alias("line"))


def currency(text: Column) -> Column:
    """TXT-04: an ISO code, then words of Indian taxes, then Rs, then a symbol."""
    code = F.nullif(F.regexp_extract(text, r"\b(INR|USD|EUR|GBP|AED|SGD|JPY)\b", 1), F.lit(""))
    return F.coalesce(code, F.when(text.rlike(r"\b(GSTIN|CGST|SGST|IGST)\b"), "INR"), F.when(text.rlike(r"(?i)\brs\.?\s*\d"), "INR"), F.when(text.contains("₹"), "INR"), F.when(text.contains("$"), "USD"), F.when(text.contains("€"), "EUR"), F.when(text.contains("£"), "GBP"))


def language(text: Column) -> Column:
    """TXT-06: a script with six hits that leads by a fifth, else the lexicon with the most hits, ties to the first by name; null without hits."""
    script_hits = F.array_sort(F.array(*[F.struct((-F.regexp_count(text, F.lit(p))).alias("n"), F.lit(k).alias("k")) for k, p in SCRIPTS.items()]))
    first, second = F.get(script_hits, F.lit(0)), F.get(script_hits, F.lit(1))
    script = F.when((-first["n"] >= 6) & (first["n"] * F.lit(1.0) <= second["n"] * F.lit(1.2)), first["k"])
    tokens = F.split(F.lower(text), r"[^\p{L}]+")
    hits_of = lambda words: F.size(F.filter(tokens, lambda t: t.isin(words)))
    hits = F.array_sort(F.array(*[F.struct((-hits_of(words.split())).alias("n"), F.lit(k).alias("k")) for k, words in LEXICON.items()]))
    top = F.get(hits, F.lit(0))
    return F.coalesce(script, F.when(top["n"] < 0, top["k"]))


def without_repeated_lines(text: Column) -> Column:
    """WIN-06: a line equal to the one before goes."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, k: (k == 0) | ~F.coalesce(F.get(lines, k - 1) == x, F.lit(False))), "\n")


def chunks_of(text: str, most: int) -> list[str]:
    """Pages, or lines where there is one page only, put together while they stay within three quarters of `most`."""
    target = most * 3 // 4
    pages = [p for p in re.split(r"\n(?=\f)|(?<=\f)\n|\f", text) if p.strip()]
    parts, sign = (pages, 0) if len(pages) > 1 else (text.split("\n"), 1)
    out, open_parts, size = [], [], 0
    for part in parts:
        if size and size + len(part) + sign > target:
            out.append("\n".join(open_parts))
            open_parts, size = [part], len(part)
        elif size:
            open_parts.append(part)
            size += 1 + len(part)
        else:
            open_parts, size = [part], len(part)
    last = "\n".join(open_parts)
    return [*out, last] if last.strip() else out or [text]


def chunks(text: Column, most: int = 8000) -> Column:
    """TXT-08: a text's chunks for a model that takes `most` characters. A longer page or line is a chunk of its own; a blank text is one chunk, a null one null."""
    # pandas is loaded where it is used, as each driver that only imports this would hold it.
    import pandas as pd

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunks_of(t, most) for t in texts], dtype=object)

    return cut(text)


def strategy(text: Column, single_pass: int = 6000) -> Column:
    """TXT-09."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "none").when(n <= single_pass, "single").otherwise("chunked")


def quality_metrics(text: Column) -> Column:
    """CNF-03: shares of low-quality tokens and of printable characters, in thousandths."""
    from duespark.functions.text import low_quality_token

    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    low = F.size(F.filter(tokens, lambda t: low_quality_token(t)))
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7E]", ""))
    return F.struct(round_half_up(low * 1000 / F.greatest(F.size(tokens), F.lit(1))).alias("low_permille"), round_half_up(printable * 1000 / F.greatest(F.length(text), F.lit(1))).alias("printable_permille"))


def fill(base: Column, override: Column) -> Column:
    """TXT-17: the override wins where it is set."""
    return F.coalesce(override, base)


def scale_correction(amount: Column, candidates: Column) -> Column:
    """TXT-10: the first candidate, by size, that is the amount times a power of ten within two percent."""
    factors = F.array(*[F.lit(x) for x in (1.0, 0.1, 0.01, 10.0, 100.0)])
    near = lambda c: F.exists(factors, lambda f: F.abs(c - amount * f) <= F.abs(amount * f) * 0.02)
    return F.get(F.array_sort(F.filter(candidates, near)), F.lit(0))


def accuracy(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """TXT-19: checks passed by document and whether 90 percent pass; a document not found passes none."""
    f = found.select(F.col(key).alias("__k"), *[F.col(x).alias(f"__{x}") for x in fields])
    joined = expected.join(f, F.col(key) == F.col("__k"), "left")
    passed = sum((F.coalesce(F.col(x).eqNullSafe(F.col(f"__{x}")) & F.col("__k").isNotNull(), F.lit(False)).cast("int") for x in fields), F.lit(0))
    return joined.select(key, passed.cast("bigint").alias("passed"), F.lit(len(fields)).cast("bigint").alias("checks"), (passed * 10 >= 9 * len(fields)).alias("ok"))


def dedup_by_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TXT-07, last part: the least id of each normalised text."""
    norm = F.md5(F.lower(F.regexp_replace(F.col(text_col), r"\s+", " ")))
    return docs.groupBy(norm.alias("text_md5")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))


def line_clusters(blocks: DataFrame, gap: float) -> DataFrame:
    """WIN-11, TXT-14: numbers lines of a page: a block whose middle is over `gap` below the last starts a new one. blocks: page_id, block_id, mid_y."""
    w = Window.partitionBy("page_id").orderBy("mid_y", "block_id")
    df = blocks.withColumn("__new", F.when(F.col("mid_y") - F.lag("mid_y").over(w) > gap, 1).otherwise(0))
    return df.withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def estimated_confidence(text: Column, blocks: Column) -> Column:
    """CNF-04: ten-thousandths, from the share of low-quality tokens and the number of blocks; 0 for a text without tokens."""
    tokens = F.array_remove(F.split(text, r"\s+"), "")
    low = lambda t: ((F.length(t) == 1) & ~t.isin("I", "a", "A", "x", "X", "&")) | t.rlike(r"[^\p{L}\p{N}_@#&%$,.:/+\-]") | (t.rlike(r"\p{Nd}") & t.rlike("[A-Za-z]") & t.rlike(r"[^\p{L}\p{N}_]"))
    share = F.size(F.filter(tokens, low)) / F.size(tokens)
    raw = F.lit(0.92) - share * 0.55 + F.least(F.lit(0.15), blocks * 0.002)
    return F.when(F.size(tokens) > 0, F.greatest(F.lit(0), F.least(F.lit(9900), F.floor(raw * 10000 + 0.5)))).otherwise(0).cast("bigint")
