"""String functions over names, tax identifiers and free text."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from duespark.functions.money import bound

# Formats of Indian tax and bank identifiers.
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
UDYAM = r"^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$"
IRN = r"^[0-9a-fA-F]{64}$"
IFSC = r"^[A-Z]{4}0[A-Z0-9]{6}$"
TAN = r"^[A-Z]{4}[0-9]{5}[A-Z]$"


def collapsed_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    """False for an empty or null part."""
    return F.coalesce((F.length(F.trim(part)) > 0) & F.contains(F.lower(text), F.lower(F.trim(part))), F.lit(False))


def regex_escape(value: Column) -> Column:
    """STR-02: a pattern that matches the text as it is."""
    return F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def long_words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def word_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(long_words(a), long_words(b)))


def squeezed(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def squeezed_prefix(x: Column, y: Column) -> Column:
    return (F.length(x) >= 3) & (F.length(y) >= 3) & (F.startswith(x, y) | F.startswith(y, x))


def squeezed_sequence(x: Column, y: Column, share: float = 0.8) -> Column:
    def found(short: Column, long: Column) -> Column:
        # Only the beginning has to be found, and not all of it can be if the longer text lacks one of its characters.
        needed = F.substring(short, F.lit(1), F.ceil(F.length(short) * F.lit(share)).cast("int"))
        absent = F.call_function("translate", needed, long, F.lit(""))
        locate = lambda s, c: F.call_function("locate", c, long, s["at"] + 1)
        step = lambda s, c: F.struct(F.when((s["at"] >= 0) & (locate(s, c) > 0), locate(s, c)).otherwise(-1).alias("at"), (s["hits"] + F.when((s["at"] >= 0) & (locate(s, c) > 0), 1).otherwise(0)).alias("hits"))
        hits = F.aggregate(F.filter(F.split(short, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits")), step, lambda s: s["hits"])
        return F.when(absent != "", F.lit(False)).otherwise((F.length(short) > 0) & (hits >= F.length(short) * F.lit(share)))

    return F.coalesce(F.when(F.length(x) <= F.length(y), found(x, y)).otherwise(found(y, x)), F.lit(False))


def prefix_match(a: Column, b: Column) -> Column:
    """Either starts with the other, both of three characters at least, white space and case aside."""
    return squeezed_prefix(squeezed(a), squeezed(b))


def sequence_match(a: Column, b: Column, share: float = 0.8) -> Column:
    """Whether enough of the shorter text's characters occur in order in the longer one. A character that isn't found uses up the rest."""
    return bound(F.struct(squeezed(a).alias("x"), squeezed(b).alias("y")), lambda s: squeezed_sequence(s["x"], s["y"], share))


def pan_of_gstin(gstin: Column) -> Column:
    return F.when(gstin.rlike(GSTIN), F.substring(gstin, 3, 10))


def holder_category(pan: Column) -> Column:
    return F.when(pan.rlike(PAN), F.substring(pan, 4, 1))


def email_domain(address: Column) -> Column:
    return F.nullif(F.lower(F.get(F.split(F.trim(address), "@"), F.lit(1))), F.lit(""))


def xml_escape(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def unique_texts(values: Column) -> Column:
    """Trimmed, not empty, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def first_not_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def length_prefixed(*parts: Column) -> Column:
    """SHA-256 of the parts, each led by its length and a colon."""
    text = F.concat(*[F.concat(F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts])
    return F.sha2(text, 256)


def low_quality_token(token: Column) -> Column:
    """Too short, mostly signs, or one letter three times in a row."""
    signs = F.length(F.regexp_replace(token, r"[A-Za-z0-9]", ""))
    return (F.length(token) < 2) | (signs * 2 > F.length(token)) | token.rlike(r"([A-Za-z])\1\1")


def normalize_markup(text: Column) -> Column:
    """Tags become spaces, cell marks become blanks, blank runs shrink."""
    t = F.regexp_replace(text, r"<[^>]*>", " ")
    t = F.regexp_replace(t, r"[ \t|]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n ?", "\n"))
