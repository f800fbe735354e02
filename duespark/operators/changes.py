"""Next-state functions: each takes the current rows and the changes, and returns the rows that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str, set_fields: list[str], insert_fields: list[str], add_fields: list[str], union_fields: list[str]) -> DataFrame:
    """DML-01: one row a key in `changes`. set: the change wins; insert: only new rows; add: sums; union: array union."""
    c, n = current.alias("c"), changes.alias("n")
    joined = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full")
    old, new = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"n.{x}"))
    cols = [F.coalesce(new(key), old(key)).alias(key)]
    cols += [F.coalesce(new(x), old(x)).alias(x) for x in set_fields]
    cols += [F.when(old(key).isNull(), new(x)).otherwise(old(x)).alias(x) for x in insert_fields]
    cols += [(F.coalesce(old(x), F.lit(0)) + F.coalesce(new(x), F.lit(0))).alias(x) for x in add_fields]
    cols += [F.array_union(F.coalesce(old(x), F.array()), F.coalesce(new(x), F.array())).alias(x) for x in union_fields]
    return joined.select(*cols)


def guarded_update(rows: DataFrame, guard: Column, **fields: Column) -> DataFrame:
    """DML-03: sets fields where the guard holds, and `modified` tells where."""
    ok = F.coalesce(guard, F.lit(False))
    return rows.withColumns({k: F.when(ok, v).otherwise(F.col(k)) for k, v in fields.items()} | {"modified": ok})


def bulk_update(rows: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """SRC-12: many single updates as one join. updates: at most one row a key; a null field leaves the old value."""
    u = updates.select(F.col(key).alias("__k"), *[F.col(x).alias(f"__{x}") for x in fields])
    new = {x: F.coalesce(f"__{x}", x) for x in fields}
    return rows.join(u, F.col(key) == F.col("__k"), "left").withColumns(new).drop("__k", *[f"__{x}" for x in fields])


def guarded_delete(rows: DataFrame, chosen: Column, allowed: Column) -> DataFrame:
    """DML-04: chosen rows go if allowed."""
    return rows.filter(~(F.coalesce(chosen, F.lit(False)) & F.coalesce(allowed, F.lit(False))))


def compare_and_set(rows: DataFrame, version: str, expected: Column, new: Column) -> DataFrame:
    """DML-05: the version moves on where it is the expected one (null-safe)."""
    return guarded_update(rows, F.col(version).eqNullSafe(expected), **{version: new})


def upsert_unless_protected(current: DataFrame, incoming: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """DML-06: incoming rows replace rows of the same key unless their status is protected; columns alike."""
    kept = current.filter(F.col("status").isin(protected)).select(key)
    new = incoming.join(kept, key, "left_anti")
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def merge_vendors(ledgers: DataFrame, merges: DataFrame) -> DataFrame:
    """DML-07: ledgers of the sources are added to their targets: sums, first crossing. merges: source, target."""
    to = F.coalesce("target", "vendor_id").alias("vendor_id")
    moved = ledgers.join(merges, ledgers.vendor_id == merges.source, "left").select(to, *[c for c in ledgers.columns if c != "vendor_id"])
    return moved.groupBy("vendor_id", "section", "fy").agg(F.sum("base_minor").cast("bigint").alias("base_minor"), F.sum("tax_minor").cast("bigint").alias("tax_minor"), F.min("crossed_at").alias("crossed_at"))


def split_overflow(ledgers: DataFrame, entries: str, most: int) -> DataFrame:
    """DML-08, ARR-02, FLT-13: the first entries stay, the others become `overflow`."""
    n = F.coalesce(F.size(entries), F.lit(0))
    return ledgers.withColumn("overflow", F.when(n > most, F.slice(entries, F.lit(most + 1), n)).otherwise(F.slice(entries, 1, 0))).withColumn(entries, F.slice(entries, 1, most))


def usage_counters(current: DataFrame, uses: DataFrame, keys: list[str], keep: int = 5) -> DataFrame:
    """DML-13, WIN-08, SRT-11: adds uses (keys, used_at) to counters (keys, n, recent) and keeps the newest times."""
    got = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("more"), F.array_agg("used_at").alias("times"))
    joined = current.join(got, keys, "full")
    times = F.array_sort(F.concat(F.coalesce("recent", F.array().cast("array<timestamp>")), F.coalesce("times", F.array().cast("array<timestamp>"))))
    return joined.select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint").alias("n"), F.slice(times, F.greatest(F.lit(1), F.size(times) - keep + 1), keep).alias("recent"))


def prepend_bounded(history: Column, entry: Column, most: int = 1000) -> Column:
    """ARR-07, DML-16."""
    return F.slice(F.concat(F.array(entry), F.coalesce(history, F.array())), 1, most)


def overlay(items: DataFrame, results: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN-19, DML-14: fields of results replace those of items; attempts are counted."""
    r = results.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *[F.col(x).alias(f"__{x}") for x in fields])
    joined = items.join(r, F.col(key) == F.col("__k"), "left")
    out = joined.withColumns({x: F.when(F.col("__hit"), F.col(f"__{x}")).otherwise(F.col(x)) for x in fields} | {"attempts": F.col("attempts") + F.when(F.col("__hit"), 1).otherwise(0)})
    return out.drop("__k", "__hit", *[f"__{x}" for x in fields])


def new_rate_version(rates: DataFrame, changes: DataFrame) -> DataFrame:
    """TAX-10: closes current rows of changed sections and opens new ones. rates: section, bps, valid_from, valid_to; changes: section, bps, valid_from."""
    ch = changes.select("section", F.col("bps").alias("new_bps"), F.col("valid_from").alias("new_from"))
    closed = rates.join(ch, "section", "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("new_from").isNotNull(), F.col("new_from")).otherwise(F.col("valid_to"))).select("section", "bps", "valid_from", "valid_to")
    return closed.unionByName(changes.select("section", "bps", "valid_from", F.lit(None).cast("timestamp").alias("valid_to")))


def first_occurrences(rows: DataFrame, fingerprint: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """SET-03, WIN-05, STM-04: rows whose fingerprint is new, the first of each within the batch; nulls are equal."""
    w = Window.partitionBy(*fingerprint).orderBy(*order)
    fresh = rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    if existing is None:
        return fresh
    old = existing.select(*[F.col(c).alias(f"__{c}") for c in fingerprint])
    same = None
    for c in fingerprint:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    return fresh.join(old, same, "left_anti")
