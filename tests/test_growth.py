"""Work that has to grow with the rows, not with their pairs, and keep all results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from duespark.functions import fields as shared
from duespark.operators import matching, reconcile, tax
from duespark.plans import fields, records


def test_copies_of_invoices_are_one_candidate_and_named_ones_are_found(spark):
    day = dt.datetime(2024, 1, 10)
    texts = ["NEFT inv-1 to Acme Works", "paid INV-12x7", "UPI transfer", "9 for a1 ab", None, "", "acmeworks", "inv-1inv-12 ACME"]
    txns = [(k, k % 2, 1000 + k % 7, day + dt.timedelta(days=k % 45), texts[k % 8]) for k in range(64)]
    numbers = ["INV-1", " inv-12 ", "9", "ab", None, "", "INV-1234", "İx-1"]
    names = ["Acme Works", None, "", "UPI trans"]
    invoices = [(k, k % 2, 1000 + k % 5 * 40, numbers[k % 8], names[k // 3 % 4], day, day + dt.timedelta(days=k % 3 * 20) if k % 3 else None, day) for k in range(100)]
    txns = spark.createDataFrame(txns, "txn_id long, tenant_id long, debit_minor long, paid_at timestamp, description string")
    invoices = spark.createDataFrame(invoices, "invoice_id long, tenant_id long, net_minor long, number string, vendor_name string, created_at timestamp, approved_at timestamp, due_at timestamp")
    found = {(r.txn_id, r.score, r.invoice_id) for r in reconcile.reconcile(txns, invoices).collect()}
    best = {(r.txn_id, r.score, r.invoice_id if r.score >= reconcile.SUGGEST_FROM else None) for r in reconcile.best(reconcile.candidates(txns, invoices)).collect()}
    assert found == best and len(best) == 64
    named = reconcile.candidates(txns, invoices).count()
    copies = invoices.filter("invoice_id = 0").withColumn("invoice_id", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("number", F.concat(F.lit("INV-"), F.col("invoice_id").cast("string")))
    assert named and reconcile.alike(copies).count() == 1
    pairs = reconcile.named_pairs(txns.filter("txn_id = 0"), copies)
    assert [r.invoice_id for r in pairs.collect()] == [1]


def test_a_ledger_is_summed_by_windows_of_one_shuffle(spark):
    draw = random.Random(5)
    rows = [(k, 1, draw.choice([1, 2, None]), "194C", dt.datetime(2024, 5, 1 + draw.randrange(20)), draw.randrange(-50, 10_000) * 997, draw.choice([10, 100, 1505]), draw.choice([0, 2_000_000]), draw.choice([0, 9_000_000, 40_000_000]), draw.choice([0, 3_000_000]), draw.choice([0, 20_000])) for k in range(300)]
    names = ["invoice_id", "line", "vendor_id", "section", "invoice_date", "base_minor", "bps", "single", "annual", "opening_base", "opening_tax"]
    df = spark.createDataFrame(rows, "invoice_id long, line long, vendor_id long, section string, invoice_date timestamp, base_minor long, bps int, single long, annual long, opening_base long, opening_tax long")
    want = set()
    for vendor in (1, 2, None):
        own = sorted((dict(zip(names, r, strict=True)) for r in rows if r[2] == vendor), key=lambda x: (x["invoice_date"], x["invoice_id"]))
        base, tax_so_far = max(x["opening_base"] for x in own), max(x["opening_tax"] for x in own)
        for x in own:
            before, base = base, base + x["base_minor"]
            share = lambda b: (b * x["bps"] + 5000) // 10000  # noqa: E731,B023
            if x["annual"] > 0 and base <= x["annual"]:
                now, state = 0, "BELOW_ANNUAL"
            elif x["annual"] > 0 and before <= x["annual"]:
                now, state = max(0, share(base) - tax_so_far), "CROSSED"
            elif x["single"] > 0 and x["base_minor"] < x["single"]:
                now, state = 0, "BELOW_SINGLE"
            else:
                now, state = share(x["base_minor"]), "ABOVE"
            tax_so_far += now
            want.add((x["invoice_id"], x["base_minor"], now, state == "CROSSED", state))
    out = tax.ledger_fold(df)
    assert {(r.invoice_id, r.base_minor, r.tax_minor, r.crossed, r.state) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and len([x for x in plan.split("Initial Plan")[-1].splitlines() if "Exchange" in x]) == 1


def test_costly_rows_of_a_small_file_are_dealt_over_the_cores(spark, small):
    assert fields.field_maps(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert records.normalised_provenance(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_candidates_are_sought_once(spark):
    found = matching.field_candidates(F.col("text"), {f: F.lit(None).cast("string") for f in ("invoiceNumber", "vendorName", "currency", "totalAmountMinor")})
    plan = spark.createDataFrame([("Vendor: Acme",)], "text string").select(found.alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("bill\\s*from") == 1


def test_a_confidence_is_rounded_as_its_sql_does(spark):
    text = F.lit(None).cast("double")
    row = spark.range(1).select(*(shared.field_confidence(text, F.lit(x) / 1000, F.lit(0.5)) for x in (480.15, 250.25, 638.55, 459.45, -3.0))).first()
    assert list(row) == [0.4802, 0.2502, 0.6385, 0.4595, 0.0]
