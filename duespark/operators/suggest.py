"""Suggestions of codes and cost centres, name mapping, feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duespark.functions.money import percent_bucket, round_half_up


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def history_scores(usage: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """GLS-02: vendor_id, code, score, confidence, rank from usage (vendor_id, code, n, recent array<timestamp>).

    A use within the last days counts twice more; the confidence is the code's share of its vendor's score.
    """
    fresh = F.size(F.filter("recent", lambda t: F.unix_micros(t) >= F.unix_micros(as_of) - days * 86_400_000_000))
    df = usage.select("vendor_id", "code", (F.col("n") + 2 * fresh).cast("bigint").alias("score"))
    whole = Window.partitionBy("vendor_id")
    share = F.least(F.lit(100), round_half_up(100 * F.col("score") / F.greatest(F.sum("score").over(whole), F.lit(1))))
    return df.select("*", share.cast("bigint").alias("confidence"), F.row_number().over(whole.orderBy(F.desc("score"), "code")).cast("bigint").alias("rank"))


def alternatives(scores: DataFrame) -> DataFrame:
    """WIN-09: ranks 2 to 4 where the first is below 60."""
    pick = lambda low, high: F.array_sort(F.array_agg(F.when(F.col("rank").between(low, high), F.struct("rank", "code"))))
    df = scores.filter("rank <= 4").groupBy("vendor_id").agg(F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("first"), pick(2, 4).alias("a"))
    rest = F.array_join(F.transform(F.filter("a", lambda x: x.isNotNull()), lambda x: x["code"]), ",")
    return df.select("vendor_id", F.when(F.col("first") < 60, rest).otherwise(F.lit("")).alias("alternatives"))


def catalog_matches(items: DataFrame, catalog: DataFrame, points: int = 20, most: int = 70) -> DataFrame:
    """GLS-03: the catalog code whose name shares most words with an item's text; ties to the least code.

    items: item_id, text; catalog: code, name. Joined word by word: only pairs that share a word are ever made.
    """
    left = items.select("item_id", F.explode(tokens(F.col("text"))).alias("w"))
    right = catalog.select("code", F.explode(tokens(F.col("name"))).alias("w"))
    hits = left.join(right, "w").groupBy("item_id", "code").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("item_id").agg(F.max_by(F.struct("code", "n"), F.struct("n", -F.col("code"))).alias("b"))
    return best.select("item_id", "b.code", F.least(F.lit(most), points * F.col("b.n")).cast("bigint").alias("confidence"))


def cascade(*sources: Column) -> Column:
    """GLS-01, GLS-04: the first struct whose code isn't null."""
    return F.coalesce(*[F.when(s["code"].isNotNull(), s) for s in sources])


def canonical_names(rows: DataFrame, by_gstin: DataFrame, by_name: DataFrame) -> DataFrame:
    """JN-17: a name by tax id, else by the normalised name, else as it is."""
    from duespark.functions.text import collapsed_key

    a = by_gstin.select(F.col("gstin").alias("__g"), F.col("canonical").alias("__a"))
    b = by_name.select(F.col("key").alias("__k"), F.col("canonical").alias("__b"))
    joined = rows.join(a, F.col("gstin") == F.col("__g"), "left").join(b, collapsed_key(F.col("name")) == F.col("__k"), "left")
    return joined.withColumn("name", F.coalesce("__a", "__b", "name")).drop("__g", "__a", "__k", "__b")


def flag_value(tenant: Column, flag: str, tenant_override: Column, global_override: Column, percent: int, allowed: list[str], default: bool) -> Column:
    """FLG-01: override of the tenant, of all, a listed tenant, the tenant's bucket, the default."""
    rule = F.when(tenant.isin(allowed), F.lit(True)) if allowed else F.lit(None).cast("boolean")
    rolled = F.when(percent_bucket(tenant, F.lit(flag)) < percent, F.lit(True))
    return F.coalesce(tenant_override, global_override, rule, rolled, F.lit(default))


def corrections(current: DataFrame, incoming: DataFrame, newest: int) -> DataFrame:
    """SET-06: corrections (group, field, value, n, seen) by field: the newer value, counts added, the newest fields kept."""
    both = current.unionByName(incoming).groupBy("group", "field").agg(F.max_by("value", "seen").alias("value"), F.sum("n").cast("bigint").alias("n"), F.max("seen").alias("seen"))
    w = Window.partitionBy("group").orderBy(F.desc("seen"), "field")
    return both.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= newest).drop("__k")
