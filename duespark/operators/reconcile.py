"""Reconciliation of bank debits with invoices: a band join on amounts, scores, the best candidate, the decision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duespark.functions.dates import days_between
from duespark.functions.money import bound
from duespark.functions.text import contains_ignoring_case, squeezed, squeezed_prefix, squeezed_sequence, word_overlap
from duespark.operators.calendar import with_working_days, working_days_between

WEIGHTS = {"exact": 50, "close": 10, "number": 30, "vendor": 20, "date": 10}
TOLERANCE = 100
MATCH_ABOVE, SUGGEST_FROM = 50, 30
#: Fixed value: invoices that one payment is split over, at most.
MOST_INVOICES = 10
#: Characters of an invoice's number by which descriptions are looked through.
HEAD = 3
#: Fixed value: working days within which a date is as good as met.
WORKING_DAYS = 2


def amount_score(debit: Column, net: Column, tolerance: int = TOLERANCE, weights: dict = WEIGHTS) -> Column:
    """REC-01; -1 rejects."""
    off = F.abs(debit - net)
    return F.when(off > tolerance, -1).when(off <= 1, weights["exact"]).otherwise(weights["close"])


def number_score(description: Column, number: Column, weight: int = WEIGHTS["number"]) -> Column:
    return F.when(contains_ignoring_case(description, number), weight).otherwise(0)


def vendor_score(description: Column, vendor: Column, weight: int = WEIGHTS["vendor"]) -> Column:
    """REC-02."""
    some = F.length(F.trim(F.coalesce(vendor, F.lit("")))) > 0
    # Both texts are squeezed once, and only without a common word.
    plain = F.struct(squeezed(description).alias("x"), squeezed(vendor).alias("y"))
    alike = bound(plain, lambda s: F.when(squeezed_prefix(s["x"], s["y"]), weight).when(squeezed_sequence(s["x"], s["y"]), (3 * weight + 2) // 4).otherwise(0))
    return F.when(some & (word_overlap(description, vendor) >= 1), weight).when(some, alike).otherwise(0)


def date_score(paid: Column, *dates: Column, weight: int = WEIGHTS["date"]) -> Column:
    """REC-03: the best over the reference dates."""
    half, fifth = (weight * 5 + 5) // 10, (weight * 2 + 5) // 10

    def one(d: Column) -> Column:
        off = F.abs(days_between(paid, d))
        return F.coalesce(F.when(off <= 3, weight).when(off <= 7, half).when(off <= 30, fifth).otherwise(0), F.lit(0))

    scores = [F.when(d.isNull(), 0).otherwise(one(d)) for d in dates]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def decision(score: Column) -> Column:
    """REC-04: above 50 is a match, from 30 a suggestion."""
    return F.when(score > MATCH_ABOVE, "matched").when(score >= SUGGEST_FROM, "suggested").otherwise("unmatched")


def band_join(left: DataFrame, right: DataFrame, left_amount: str, right_amount: str, tolerance: int, keys: list[str]) -> DataFrame:
    """JN-11: pairs of equal keys with |a - b| <= tolerance, as an equi-join on buckets of tolerance + 1.

    The smaller side goes to its own bucket and both neighbours, so each pair meets once. Round amounts
    crowd single buckets; those are shuffled joins, which adaptive execution splits.
    """
    width = tolerance + 1
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    near = left.withColumn("__bucket", F.explode(F.array(*[bucket(left_amount) + k for k in (-1, 0, 1)])))
    other = right.withColumn("__bucket", bucket(right_amount))
    return near.join(other, [*keys, "__bucket"]).filter(F.abs(F.col(left_amount) - F.col(right_amount)) <= tolerance).drop("__bucket")


def scored(pairs: DataFrame, tolerance: int = TOLERANCE, calendar: DataFrame | None = None) -> DataFrame:
    """tenant_id, txn_id, invoice_id, score of pairs with the columns of both sides of `candidates`."""
    dates = ["created_at", "approved_at", "due_at"]
    dated = date_score(F.col("paid_at"), *(F.col(c) for c in dates))
    if calendar is not None:
        pairs = with_working_days(pairs, calendar, n_paid="paid_at", **{f"n_{c}": c for c in dates})
        near = [F.coalesce(working_days_between(F.col("n_paid"), F.col(f"n_{c}")) <= WORKING_DAYS, F.lit(False)) for c in dates]
        dated = F.when(near[0] | near[1] | near[2], WEIGHTS["date"]).otherwise(dated)
    score = amount_score(F.col("debit_minor"), F.col("net_minor"), tolerance) + number_score(F.col("description"), F.col("number")) + vendor_score(F.col("description"), F.col("vendor_name")) + dated
    return pairs.select("tenant_id", "txn_id", "invoice_id", score.cast("bigint").alias("score"))


def candidates(txns: DataFrame, invoices: DataFrame, tolerance: int = TOLERANCE, calendar: DataFrame | None = None) -> DataFrame:
    """Scored pairs. txns: txn_id, tenant_id, debit_minor, paid_at, description; invoices: invoice_id, tenant_id, net_minor, number, vendor_name, created_at, approved_at, due_at.

    E-04: with a calendar (operators.calendar), a payment within two working days of a reference date has the full date score.
    """
    return scored(band_join(txns, invoices, "debit_minor", "net_minor", tolerance, ["tenant_id"]), tolerance, calendar)


def _number(number: Column) -> Column:
    return F.lower(F.trim(number))


def named_pairs(txns: DataFrame, invoices: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs of `candidates` whose description has the invoice's number, of HEAD characters at least, found by equality instead of in all pairs.

    A description is looked through for the numbers' first HEAD characters, of which there are few and which are broadcast;
    from there on it is cut at each length that such numbers have, and the cuts are joined with the numbers.
    """
    term = _number(F.col("number"))
    numbered = invoices.withColumn("__term", term).filter(F.length("__term") >= HEAD)
    heads = numbered.groupBy(F.substring("__term", 1, HEAD).alias("__head")).agg(F.collect_set(F.length("__term")).alias("__lengths"))
    text = F.col("__text")
    spots = txns.withColumn("__text", F.lower("description")).filter(F.length(text) >= HEAD).withColumn("__at", F.explode(F.sequence(F.lit(1), F.length(text) - HEAD + 1)))
    spots = spots.withColumn("__head", F.substring(text, F.col("__at"), F.lit(HEAD))).join(F.broadcast(heads), "__head").withColumn("__length", F.explode("__lengths"))
    cuts = spots.filter(F.col("__at") + F.col("__length") - 1 <= F.length(text)).withColumn("__term", F.substring(text, F.col("__at"), F.col("__length")))
    cuts = cuts.drop("__text", "__at", "__head", "__lengths", "__length")
    return band_join(numbered, cuts, "net_minor", "debit_minor", tolerance, ["tenant_id", "__term"]).drop("__term")


def alike(invoices: DataFrame) -> DataFrame:
    """The invoice of least id of those that score alike but for their number, which is null unless shorter than HEAD."""
    number = F.when(F.length(_number(F.col("number"))) < HEAD, F.col("number"))
    keys = ["tenant_id", "net_minor", "number", "vendor_name", "created_at", "approved_at", "due_at"]
    return invoices.withColumn("number", number).groupBy(*keys).agg(F.min("invoice_id").alias("invoice_id"))


def best(pairs: DataFrame) -> DataFrame:
    """WIN-01: the highest score of each transaction, ties to the least invoice, by pre-aggregation."""
    return pairs.groupBy("tenant_id", "txn_id").agg(F.max_by(F.struct("invoice_id", "score"), F.struct("score", -F.col("invoice_id"))).alias("b")).select("tenant_id", "txn_id", "b.invoice_id", "b.score")


def reconcile(txns: DataFrame, invoices: DataFrame, tolerance: int = TOLERANCE, calendar: DataFrame | None = None) -> DataFrame:
    """REC-05: txn_id, invoice_id, score, state; an invoice may serve several transactions. E-04 with a calendar.

    Invoices that only their number tells apart are one candidate, and payments that name a number are paired with its invoice:
    a payment's best is one of both, as a pair without its number's share scores less than itself.
    """
    pairs = candidates(txns, alike(invoices), tolerance, calendar).unionByName(scored(named_pairs(txns, invoices, tolerance), tolerance, calendar))
    found = best(pairs)
    out = txns.select("tenant_id", "txn_id").join(found, ["tenant_id", "txn_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("bigint")).withColumn("state", decision(F.col("score")))
    return out.select("tenant_id", "txn_id", F.when(F.col("state") != "unmatched", F.col("invoice_id")).alias("invoice_id"), "score", "state")


def summary(result: DataFrame) -> DataFrame:
    """AG-24, E-05: counts by tenant and the match rate in thousandths."""
    n = lambda s: F.count_if(F.col("state") == s).cast("bigint")
    df = result.groupBy("tenant_id").agg(n("matched").alias("matched"), n("suggested").alias("suggested"), n("unmatched").alias("unmatched"))
    return df.withColumn("match_permille", F.floor(F.col("matched") * 1000 / (F.col("matched") + F.col("suggested") + F.col("unmatched"))).cast("bigint"))


def split_candidates(pairs: DataFrame, tolerance: int = TOLERANCE, most: int = MOST_INVOICES) -> DataFrame:
    """E-01, the limit that the rule itself has: of the candidates from the largest down, those before whose amounts the debit is reached; of these the `most` that are nearest to the debit. Ties go to the least invoice."""
    largest = Window.partitionBy("txn_id").orderBy(F.desc("net_minor"), "invoice_id")
    before = F.coalesce(F.sum("net_minor").over(largest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nearest = Window.partitionBy("txn_id").orderBy(F.abs(F.col("debit_minor") - F.col("net_minor")), "invoice_id")
    fits = pairs.filter(F.col("net_minor") <= F.col("debit_minor") + tolerance).withColumn("before", before).filter("before <= debit_minor")
    return fits.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= most).drop("before", "place")


def split_matches(pairs: DataFrame, tolerance: int = TOLERANCE, most: int = MOST_INVOICES) -> DataFrame:
    """E-01: for each transaction the smallest set of its candidate invoices that adds up to the debit: txn_id, ids, sum.

    pairs: txn_id, debit_minor, invoice_id, net_minor. Of sets of one size the nearest sum wins, then the least ids. All
    sums of a transaction's at most ten candidates are made at once, for many transactions in one array.
    """
    item = F.array_sort(F.collect_list(F.struct("invoice_id", "net_minor")))
    rows = split_candidates(pairs, tolerance, most).groupBy("txn_id", "debit_minor").agg(item.alias("i"))
    masks = np.arange(1, 1 << most)
    chosen = (masks[:, None] >> np.arange(most)) & 1
    size = chosen.sum(axis=1)

    def run(batches):
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            txn, debit, ids, nets = (batch.column(k) for k in range(4))
            lists = nets.to_pylist()
            amounts = np.array([[*x, *[0] * (most - len(x))] for x in lists], np.int64).reshape(-1, most)
            off = np.abs(amounts @ chosen.T - debit.to_numpy()[:, None])
            out = []
            for k, own in enumerate(ids.to_pylist()):
                ok = np.flatnonzero((off[k] <= tolerance) & (masks < 1 << len(own)))
                if len(ok):
                    best = min((int(size[m]), int(off[k, m]), [x for x, c in zip(own, chosen[m], strict=False) if c], int(amounts[k] @ chosen[m])) for m in ok)
                    out.append((txn[k].as_py(), best[2], best[3]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["txn_id", "ids", "sum"])

    flat = rows.select("txn_id", F.col("debit_minor").cast("bigint"), F.transform("i", lambda x: x["invoice_id"].cast("bigint")).alias("ids"), F.transform("i", lambda x: x["net_minor"].cast("bigint")).alias("nets"))
    return flat.mapInArrow(run, "txn_id bigint, ids array<bigint>, sum bigint")


def apply_links(txns: DataFrame, invoices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-10: matches, manual matches and unmatches, with their effects on transactions and invoices.

    txns: txn_id, invoice_id, confidence, status; invoices: invoice_id, verified_by (a transaction), n_verified (its
    signals of a verified payment); links: txn_id, action (match, manual, unmatch), invoice_id, confidence, one row a transaction.
    An unmatch clears the invoice that its transaction had, and comes before the matches; of several
    transactions matched with one invoice the largest id verifies it, and each leaves a signal.
    """
    k = links.select(F.col("txn_id").alias("__txn"), "action", F.col("invoice_id").alias("__invoice"), F.col("confidence").alias("__confidence"))
    joined = txns.join(k, F.col("txn_id") == F.col("__txn"), "left")
    linked, off = F.col("action").isin("match", "manual"), F.col("action") == "unmatch"
    after = joined.select(
        "txn_id",
        F.when(linked, F.col("__invoice")).when(off, None).otherwise(F.col("invoice_id")).alias("invoice_id"),
        F.when(F.col("action") == "manual", 100).when(linked, F.col("__confidence")).when(off, None).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("action") == "manual", "manual").when(linked, "matched").when(off, "unmatched").otherwise(F.col("status")).alias("status"),
    )
    cleared = joined.filter(off & F.col("invoice_id").isNotNull()).select("invoice_id").distinct().withColumn("__cleared", F.lit(True))
    added = joined.filter(linked).groupBy(F.col("__invoice").alias("invoice_id")).agg(F.max("txn_id").alias("__by"), F.count(F.lit(1)).alias("__more"))
    both = invoices.join(cleared, "invoice_id", "left").join(added, "invoice_id", "left")
    keep = F.col("__cleared").isNull()
    return after, both.select("invoice_id", F.coalesce("__by", F.when(keep, F.col("verified_by"))).alias("verified_by"), (F.when(keep, F.col("n_verified")).otherwise(0) + F.coalesce("__more", F.lit(0))).cast("bigint").alias("n_verified"))


def aggregate_matches(payments: DataFrame, invoices: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """E-02: several payments (invoice_ref, debit_minor) of one invoice (number, invoice_id, net_minor) against its amount, by the number that they name."""
    paid = payments.groupBy("invoice_ref").agg(F.sum("debit_minor").cast("bigint").alias("paid_minor"), F.count(F.lit(1)).alias("payments"))
    joined = invoices.join(paid, F.col("number") == F.col("invoice_ref"))
    off = F.col("paid_minor") - F.col("net_minor")
    state = F.when(F.abs(off) <= tolerance, "matched").when(off < 0, "part paid").otherwise("overpaid")
    return joined.select("invoice_id", "payments", "paid_minor", state.alias("state"))


def over_allocated(allocations: DataFrame, txns: DataFrame, invoices: DataFrame) -> DataFrame:
    """E-06: allocations (txn_id, invoice_id, minor) whose transaction or invoice has more allocated than its own amount."""
    by = lambda key, name: allocations.groupBy(key).agg(F.sum("minor").alias(name))
    full_txn = by("txn_id", "s").join(txns.select("txn_id", "debit_minor"), "txn_id").select("txn_id", (F.col("s") > F.col("debit_minor")).alias("over_txn"))
    full_inv = by("invoice_id", "s").join(invoices.select("invoice_id", "net_minor"), "invoice_id").select("invoice_id", (F.col("s") > F.col("net_minor")).alias("over_invoice"))
    joined = allocations.join(full_txn, "txn_id", "left").join(full_inv, "invoice_id", "left")
    return joined.select("txn_id", "invoice_id", "minor", F.coalesce("over_txn", F.lit(False)).alias("over_txn"), F.coalesce("over_invoice", F.lit(False)).alias("over_invoice"))
