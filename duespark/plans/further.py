"""Queries of the remaining lookups, array aggregates, sorts and updates over the adapted tables."""

from pyspark.sql import functions as F

from duespark.functions.money import to_major_text
from duespark.operators.reconcile import amount_score, decision
from duespark.plans.adapt import ctes, entries, invoices, transactions, vendors
from duespark.sources.tables import table


def tenant_names(spark, d):
    """JN-01, JN-10: a chain of lookups with a default name."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").filter("n_nationkey % 4 <> 0")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").groupBy(F.coalesce("n_name", F.lit("Unknown")).alias("tenant")).agg(F.count(F.lit(1)).alias("n"))


def amount_range(spark, d):
    """JN-12: invoices within the range of all transactions' amounts; the range is a scalar subquery, within the one job."""
    t = transactions(spark, d)
    edge = lambda of: F.coalesce(t.agg(of("debit_minor")).scalar(), F.lit(0))
    return invoices(spark, d).filter(F.col("total_minor").between(edge(F.min) - 100, edge(F.max) + 100)).agg(F.count(F.lit(1)).alias("n"), F.min("invoice_id").alias("first"))


def mailboxes(spark, d):
    """JN-23: nations with their customers' segments; one BUILDING collapses the list to `all`."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    segs = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"), F.bool_or(F.col("c_acctbal") > 9000).alias("all"))
    return n.join(segs, n.n_nationkey == segs.c_nationkey, "left").select("n_name", F.when(F.coalesce("all", F.lit(False)), "all").otherwise(F.array_join(F.coalesce("s", F.array().cast("array<string>")), ",")).alias("assigned"))


def recipients(spark, d):
    """JN-24: the vendor's own name, else its state's first vendor."""
    v = vendors(spark, d)
    admin = v.groupBy("state").agg(F.min_by("name", "vendor_id").alias("admin"))
    return v.join(admin, "state").select("vendor_id", F.coalesce(F.when(F.col("vendor_id") % 2 == 0, F.col("name")), F.col("admin")).alias("recipient"))


def line_checks(spark, d):
    """AG-25, AG-28, FLT-12: arrays of an order's lines against its total."""
    e = entries(spark, d).groupBy("invoice_id").agg(F.array_agg("base_minor").alias("a"), F.array_agg("section").alias("s"))
    j = e.join(invoices(spark, d).select("invoice_id", "total_minor"), "invoice_id")
    total = F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y)
    return j.select("invoice_id", (F.abs(total - F.col("total_minor")) <= 1).alias("adds_up"), F.size(F.filter("a", lambda x: x > 1_000_000)).alias("large"), F.array_contains("s", "194R").alias("has_r"))


def code_import(spark, d):
    """SET-04: parts as an import: known keys and repeats are skipped."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 150).alias("code"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"))
    return p.join(known, "code", "left_anti").groupBy("code").agg(F.min_by("name", "ordinal").alias("name"))


def ledger_records(spark, d):
    """DML-02: ledgers from grouped changes: sums, counts, entries in order."""
    e = entries(spark, d)
    return e.groupBy("vendor_id", "section").agg(F.sum("base_minor").cast("bigint").alias("base_minor"), F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("invoice_id", "line", "base_minor"))), lambda x: F.concat_ws(":", x["invoice_id"], x["line"], x["base_minor"])), ",")).alias("entries_md5"))


def manual_matches(spark, d):
    """DML-10: manual matches and unmatches of transactions."""
    t = transactions(spark, d)
    state = F.when(F.col("txn_id") % 4 == 0, "manual").when(F.col("txn_id") % 5 == 0, "unmatched").otherwise("suggested")
    return t.select("txn_id", state.alias("state"), F.when(state == "manual", F.col("txn_id")).alias("invoice_id"))


def expected_debits(spark, d):
    """E-02, E-03, TAX-06: debits of several transactions against one invoice with tax added."""
    t = transactions(spark, d).groupBy("tenant_id", F.floor(F.col("txn_id") / 6).cast("bigint").alias("g")).agg(F.sum("debit_minor").cast("bigint").alias("paid"), F.max("txn_id").alias("last"))
    i = invoices(spark, d).select("invoice_id", "total_minor")
    j = t.join(i, t.last == i.invoice_id)
    expected = F.col("total_minor") + F.floor(F.col("total_minor") / 1000 + F.lit(0.5)).cast("bigint")
    score = amount_score(F.col("paid"), expected, 5000)
    return j.select("tenant_id", "g", "paid", expected.alias("expected"), score.cast("bigint").alias("score"), decision(score).alias("state"))


def voucher_preview(spark, d):
    """VCH-04, VCH-05: label and value rows of every voucher; the place of supply only if it differs."""
    i = invoices(spark, d).join(vendors(spark, d).select("vendor_id", "state", "name"), "vendor_id", "left")
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    amount, key = to_major_text(F.col("total_minor")), F.col("invoice_id").cast("string")
    rows = F.array(
        row("Invoice Number", F.col("number")),
        row("Vendor Name", F.coalesce("name", F.lit("Unknown Vendor"))),
        row("Invoice Date", F.date_format("created_at", "yyyyMMdd")),
        row("Total Amount", F.concat(F.lit("-"), amount, F.lit(" / "), amount)),
        row("Purchase Ledger", F.lit("PURCHASE_LEDGER")),
        row("Company", F.lit("COMPANY")),
        row("Narration", F.concat(F.lit("Source=orders:"), key, F.lit(" | Attachment="), F.col("number"), F.lit(" | InternalId="), key)),
        row("Place of Supply", F.when(F.col("state") != "NATION_1", F.col("state"))),
    )
    return i.select("invoice_id", F.explode(rows).alias("r")).select("invoice_id", "r.label", "r.value").filter("value IS NOT NULL")


def priorities(spark, d):
    """SRT-05, SRT-09: a derived order, as ranks that don't need one task: counts of the tiers before."""
    i = invoices(spark, d)
    tier = F.when(F.col("status") == "FAILED_PARSE", 0).when(F.col("status") == "NEEDS_REVIEW", 1).otherwise(2)
    return i.groupBy(tier.alias("tier"), "tenant_id").agg(F.count(F.lit(1)).alias("n"))


def banker_rounding(spark, d):
    """MTH-09."""
    return table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_orderkey") / F.lit(2.0)).cast("bigint").alias("half_even"))


QUERIES = {
    "jn01_jn10_tenant_names": tenant_names,
    "jn12_amount_range": amount_range,
    "jn23_mailboxes": mailboxes,
    "jn24_recipients": recipients,
    "ag25_ag28_line_checks": line_checks,
    "set04_code_import": code_import,
    "dml02_ledger_records": ledger_records,
    "dml10_manual_matches": manual_matches,
    "e02_e03_expected_debits": expected_debits,
    "vch04_vch05_preview": voucher_preview,
    "srt05_srt09_priorities": priorities,
    "mth09_banker_rounding": banker_rounding,
}
ORACLES = {
    "jn01_jn10_tenant_names": "SELECT coalesce(n_name, 'Unknown') AS tenant, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0 GROUP BY 1",
    "jn12_amount_range": f"{ctes('invoices', 'transactions')}, r AS (SELECT min(debit_minor) - 100 AS lo, max(debit_minor) + 100 AS hi FROM transactions) SELECT count(*) AS n, min(invoice_id) AS first FROM invoices, r WHERE total_minor BETWEEN lo AND hi",
    "jn23_mailboxes": """WITH s AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS s, bool_or(c_acctbal > 9000) AS a FROM customer GROUP BY 1)
SELECT n_name, CASE WHEN a THEN 'all' ELSE coalesce(array_to_string(s, ','), '') END AS assigned FROM nation LEFT JOIN s ON n_nationkey = c_nationkey""",
    "jn24_recipients": f"{ctes('vendors')}, a AS (SELECT state, arg_min(name, vendor_id) AS admin FROM vendors GROUP BY 1) SELECT vendor_id, CASE WHEN vendor_id % 2 = 0 THEN name ELSE admin END AS recipient FROM vendors JOIN a USING (state)",
    "ag25_ag28_line_checks": f"""{ctes('entries', 'invoices')}, e AS (SELECT invoice_id, sum(base_minor) AS t, CAST(count(*) FILTER (base_minor > 1000000) AS INTEGER) AS large, bool_or(section = '194R') AS has_r FROM entries GROUP BY 1)
SELECT invoice_id, abs(t - total_minor) <= 1 AS adds_up, large, has_r FROM e JOIN invoices USING (invoice_id)""",
    "set04_code_import": "SELECT p_partkey % 150 AS code, arg_min(p_name, p_partkey) AS name FROM part WHERE p_partkey % 150 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "dml02_ledger_records": f"""{ctes('entries')} SELECT vendor_id, section, CAST(sum(base_minor) AS BIGINT) AS base_minor, count(*) AS n,
  md5(string_agg(invoice_id || ':' || line || ':' || base_minor, ',' ORDER BY invoice_id, line, base_minor)) AS entries_md5 FROM entries GROUP BY 1, 2""",
    "dml10_manual_matches": f"{ctes('transactions')} SELECT txn_id, CASE WHEN txn_id % 4 = 0 THEN 'manual' WHEN txn_id % 5 = 0 THEN 'unmatched' ELSE 'suggested' END AS state, CASE WHEN txn_id % 4 = 0 THEN txn_id END AS invoice_id FROM transactions",
    "e02_e03_expected_debits": f"""{ctes('invoices', 'transactions')}, t AS (SELECT tenant_id, txn_id // 6 AS g, CAST(sum(debit_minor) AS BIGINT) AS paid, max(txn_id) AS last FROM transactions GROUP BY 1, 2),
j AS (SELECT t.tenant_id, g, paid, total_minor + CAST(floor(total_minor / 1000 + 0.5) AS BIGINT) AS expected FROM t JOIN invoices i ON last = invoice_id),
s AS (SELECT *, CAST(CASE WHEN abs(paid - expected) > 5000 THEN -1 WHEN abs(paid - expected) <= 1 THEN 50 ELSE 10 END AS BIGINT) AS score FROM j)
SELECT *, CASE WHEN score > 50 THEN 'matched' WHEN score >= 30 THEN 'suggested' ELSE 'unmatched' END AS state FROM s""",
    "vch04_vch05_preview": f"""{ctes('invoices', 'vendors')}, j AS (SELECT invoice_id, number, created_at, total_minor // 100 || '.' || lpad(CAST(total_minor % 100 AS VARCHAR), 2, '0') AS amount, state, name FROM invoices i LEFT JOIN vendors v ON i.vendor_id = v.vendor_id)
SELECT invoice_id, 'Invoice Number' AS label, number AS value FROM j UNION ALL SELECT invoice_id, 'Vendor Name', coalesce(name, 'Unknown Vendor') FROM j UNION ALL SELECT invoice_id, 'Invoice Date', strftime(created_at, '%Y%m%d') FROM j
UNION ALL SELECT invoice_id, 'Total Amount', '-' || amount || ' / ' || amount FROM j UNION ALL SELECT invoice_id, 'Purchase Ledger', 'PURCHASE_LEDGER' FROM j UNION ALL SELECT invoice_id, 'Company', 'COMPANY' FROM j
UNION ALL SELECT invoice_id, 'Narration', 'Source=orders:' || invoice_id || ' | Attachment=' || number || ' | InternalId=' || invoice_id FROM j UNION ALL SELECT invoice_id, 'Place of Supply', state FROM j WHERE state <> 'NATION_1'""",
    "srt05_srt09_priorities": f"{ctes('invoices')} SELECT CASE status WHEN 'FAILED_PARSE' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END AS tier, tenant_id, count(*) AS n FROM invoices GROUP BY 1, 2",
    "mth09_banker_rounding": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey // 2 WHEN o_orderkey % 4 = 3 THEN o_orderkey // 2 + 1 ELSE o_orderkey // 2 END AS BIGINT) AS half_even FROM orders",
}
