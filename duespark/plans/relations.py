"""Queries of predicates, joins, paging, sets, vouchers and next-state functions over the adapted tables."""

from pyspark.sql import functions as F

from duespark.operators import changes, relational as rel, vouchers
from duespark.plans.adapt import ctes, entries, invoices, vendors
from duespark.sources.tables import table


def filters(spark, d):
    """FLT-01..06, 14, 15 as flags."""
    i = invoices(spark, d)
    return i.select(
        "invoice_id",
        rel.any_of(F.col("status"), "APPROVED,EXPORTED").alias("listed"),
        rel.not_in(F.col("vendor_id"), [1, 2, 3]).alias("not_in"),
        rel.filled(F.col("number")).alias("filled"),
        rel.through_day(F.col("created_at"), "1997-06-30").alias("through_day"),
        rel.overlaps(F.col("created_at"), F.col("due_at"), F.lit("1997-01-01").cast("timestamp"), F.lit("1997-02-01").cast("timestamp")).alias("overlaps"),
        F.coalesce(rel.optional(status="EXPORTED", tenant_id=None), F.lit(False)).alias("optional"),
        rel.rule_holds(F.col("total_minor"), F.lit("gte"), F.when(F.col("invoice_id") % 2 == 0, F.lit(15_000_000))).alias("rule"),
    )


def cursor_page(spark, d):
    """FLT-11, SRT-03."""
    return rel.keyset_page(invoices(spark, d).select("priority", "total_minor", "invoice_id"), ["priority", "total_minor", "invoice_id"], 20, {"priority": "3-MEDIUM", "total_minor": 20_000_000, "invoice_id": 7})


def vendor_page(spark, d):
    """FLT-08, SRT-01, SRT-02: the second page of a search."""
    v = vendors(spark, d).filter(F.contains(F.lower("name"), F.lower(F.lit("CUSTOMER#"))))
    return rel.page(v.select("vendor_id", "name"), [F.asc("name"), F.asc("vendor_id")], 2, 25)


def linked(spark, d):
    """JN-03, NUL-01: invoices with their vendors where there are any."""
    return invoices(spark, d).join(vendors(spark, d).select("vendor_id", "name"), "vendor_id", "left").select("invoice_id", F.coalesce("name", F.lit("(Unknown)")).alias("vendor"))


def unused_vendors(spark, d):
    """JN-06, JN-09."""
    return vendors(spark, d).join(invoices(spark, d).filter("tenant_id = 1").select("vendor_id"), "vendor_id", "left_anti").select("vendor_id", "name")


def active_vendors(spark, d):
    """JN-08."""
    return vendors(spark, d).join(invoices(spark, d).filter("status = 'APPROVED'"), "vendor_id", "left_semi").select("vendor_id")


def duplicates_by_key(spark, d):
    """JN-13, JN-14."""
    return rel.same_key_other_row(invoices(spark, d), ["vendor_id", "priority"], "invoice_id", "content_hash")


def merge_preview(spark, d):
    """JN-20: full outer of two vendors' totals by section."""
    e = entries(spark, d)
    side = lambda v: e.filter(F.col("vendor_id") == v).groupBy("section").agg(F.sum("base_minor").cast("bigint").alias("minor"))
    return rel.section_union(side(1), side(2).filter("section <> '194A'"), "section", "minor")


def distinct_labels(spark, d):
    """SET-01, SET-02, STR-13."""
    v = vendors(spark, d)
    return v.groupBy(F.concat_ws(" / ", F.nullif("region", F.lit("")), "state").alias("label")).agg(F.min_by("name", "vendor_id").alias("first_name"))


def fresh_rows(spark, d):
    """SET-03, WIN-05: first of each fingerprint that isn't known yet."""
    i = invoices(spark, d)
    return changes.first_occurrences(i.filter("invoice_id % 2 = 1").select("invoice_id", "vendor_id", "priority"), ["vendor_id", "priority"], ["invoice_id"], i.filter("invoice_id % 8 = 0").select("vendor_id", "priority"))


def approvals(spark, d):
    """DML-03: approve what may be approved."""
    i = invoices(spark, d).select("invoice_id", "status")
    return changes.guarded_update(i, (F.col("invoice_id") % 3 == 0) & F.col("status").isin("PARSED", "NEEDS_REVIEW"), status=F.lit("APPROVED"))


def deletions(spark, d):
    """DML-04."""
    i = invoices(spark, d).select("invoice_id", "status")
    return changes.guarded_delete(i, F.col("invoice_id") % 10 == 0, F.col("status") != "EXPORTED")


def vendor_upsert(spark, d):
    """DML-01, SET-08: vendor master from two batches of orders."""
    o = table(spark, d, "orders")
    batch = lambda c: o.filter(c).groupBy(F.col("o_custkey").alias("vendor_id")).agg(F.max("o_orderpriority").alias("last_priority"), F.min("o_orderkey").alias("first_invoice"), F.count(F.lit(1)).alias("invoices"), F.array_sort(F.collect_set("o_orderstatus")).alias("seen"))
    out = changes.upsert(batch("o_orderkey % 2 = 0"), batch("o_orderkey % 3 = 0"), "vendor_id", ["last_priority"], ["first_invoice"], ["invoices"], ["seen"])
    return out.withColumn("seen", F.concat_ws(",", F.array_sort("seen")))


def merged_ledgers(spark, d):
    """DML-07: every odd vendor merges into the even one before it."""
    e = entries(spark, d)
    led = e.groupBy("vendor_id", "section", F.lit("all").alias("fy")).agg(F.sum("base_minor").cast("bigint").alias("base_minor"), F.sum("tax_minor").cast("bigint").alias("tax_minor"), F.min("invoice_date").cast("timestamp_ntz").alias("crossed_at"))
    ids = led.select("vendor_id").distinct().filter("vendor_id % 2 = 1")
    return changes.merge_vendors(led, ids.select(F.col("vendor_id").alias("source"), (F.col("vendor_id") - 1).alias("target")))


def protected_upsert(spark, d):
    """DML-06."""
    i = invoices(spark, d).select("invoice_id", "status", "total_minor")
    new = i.filter("invoice_id % 4 = 0").select("invoice_id", F.lit("PARSED").alias("status"), (F.col("total_minor") + 1).alias("total_minor"))
    return changes.upsert_unless_protected(i, new, "invoice_id", ["EXPORTED", "APPROVED"])


def voucher_lines(spark, d):
    """VCH-01, VCH-02."""
    e = entries(spark, d).groupBy("invoice_id").agg(F.sum("base_minor").cast("bigint").alias("base_minor"), F.sum("tax_minor").cast("bigint").alias("tax_minor"))
    total, igst = F.col("base_minor"), F.when(F.col("invoice_id") % 2 == 0, F.floor(F.col("base_minor") * 18 / 118)).otherwise(0)
    rows = e.select("invoice_id", total.alias("total_minor"), vouchers.subtotal(total, F.when(F.col("invoice_id") % 5 == 0, total - igst), igst).cast("bigint").alias("sub_minor"), F.lit(0).alias("cgst"), F.lit(0).alias("sgst"), igst.cast("bigint").alias("igst"), F.lit(0).alias("cess"), F.when(F.col("invoice_id") % 3 == 0, F.col("tax_minor")).alias("tds"))
    return vouchers.ledger_lines(rows)


def voucher_batches(spark, d):
    """SNK-04."""
    return vouchers.batches(invoices(spark, d).filter("status = 'APPROVED'").select("tenant_id", "invoice_id"), ["tenant_id"], "invoice_id", width=500)


def csv_export(spark, d):
    """SNK-01, SNK-02, MTH-03."""
    i = invoices(spark, d).filter("status IN ('APPROVED', 'EXPORTED')")
    rows = i.withColumn("note", F.concat(F.lit('say "'), F.col("priority"), F.lit('", ok')))
    return vouchers.csv_rows(rows, {"number": "Invoice", "total_minor": "Amount", "note": "Note"}, {"total_minor"})


def validations(spark, d):
    """FLT-19, FLT-20."""
    rules = ((F.col("vendor_id").isNotNull(), "vendor missing"), (F.col("total_minor") < 30_000_000, "total too large"), (F.col("status") == "APPROVED", "not approved"))
    return invoices(spark, d).select("invoice_id", vouchers.first_failure(*rules).alias("first"), F.concat_ws("; ", vouchers.all_failures(*rules)).alias("failures"))


def dependents(spark, d):
    """AG-23."""
    return rel.dependents(orders=table(spark, d, "orders"), customers=table(spark, d, "customer"), parts=table(spark, d, "part"))


QUERIES = {
    "flt_filters": filters,
    "flt11_srt03_cursor_page": cursor_page,
    "flt08_srt02_vendor_page": vendor_page,
    "jn03_linked": linked,
    "jn06_unused_vendors": unused_vendors,
    "jn08_active_vendors": active_vendors,
    "jn13_jn14_duplicates": duplicates_by_key,
    "jn20_merge_preview": merge_preview,
    "set01_set02_labels": distinct_labels,
    "set03_win05_fresh_rows": fresh_rows,
    "dml01_vendor_upsert": vendor_upsert,
    "dml03_approvals": approvals,
    "dml04_deletions": deletions,
    "dml06_protected_upsert": protected_upsert,
    "dml07_merged_ledgers": merged_ledgers,
    "vch01_vch02_voucher_lines": voucher_lines,
    "snk01_csv_export": csv_export,
    "snk04_voucher_batches": voucher_batches,
    "flt19_flt20_validations": validations,
    "ag23_dependents": dependents,
}

_I = ctes("invoices")
ORACLES = {
    "flt_filters": f"""{_I} SELECT invoice_id, status IN ('APPROVED', 'EXPORTED') AS listed, vendor_id IS NULL OR vendor_id NOT IN (1, 2, 3) AS not_in, number IS NOT NULL AND number <> '' AS filled,
  created_at < TIMESTAMP '1997-07-01' AS through_day, due_at >= TIMESTAMP '1997-01-01' AND created_at <= TIMESTAMP '1997-02-01' AS overlaps, status = 'EXPORTED' AS optional,
  CASE WHEN invoice_id % 2 = 0 THEN total_minor >= 15000000 ELSE true END AS rule FROM invoices""",
    "flt11_srt03_cursor_page": f"{_I} SELECT priority, total_minor, invoice_id FROM invoices WHERE (priority, total_minor, invoice_id) < ('3-MEDIUM', 20000000, 7) ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 21",
    "flt08_srt02_vendor_page": f"{ctes('vendors')} SELECT vendor_id, name FROM vendors WHERE contains(lower(name), 'customer#') ORDER BY name, vendor_id LIMIT 25 OFFSET 25",
    "jn03_linked": f"{ctes('invoices', 'vendors')} SELECT invoice_id, coalesce(name, '(Unknown)') AS vendor FROM invoices i LEFT JOIN vendors v ON i.vendor_id = v.vendor_id",
    "jn06_unused_vendors": f"{ctes('invoices', 'vendors')} SELECT vendor_id, name FROM vendors v WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.vendor_id = v.vendor_id AND tenant_id = 1)",
    "jn08_active_vendors": f"{ctes('invoices', 'vendors')} SELECT vendor_id FROM vendors v WHERE EXISTS (SELECT 1 FROM invoices i WHERE i.vendor_id = v.vendor_id AND status = 'APPROVED')",
    "jn13_jn14_duplicates": f"{_I} SELECT invoice_id FROM invoices a WHERE EXISTS (SELECT 1 FROM invoices b WHERE a.vendor_id = b.vendor_id AND a.priority = b.priority AND a.content_hash <> b.content_hash)",
    "jn20_merge_preview": f"""{ctes('entries')}, a AS (SELECT section, CAST(sum(base_minor) AS BIGINT) AS minor FROM entries WHERE vendor_id = 1 GROUP BY 1), b AS (SELECT section, CAST(sum(base_minor) AS BIGINT) AS minor FROM entries WHERE vendor_id = 2 AND section <> '194A' GROUP BY 1)
SELECT coalesce(a.section, b.section) AS section, coalesce(a.minor, 0) AS target, coalesce(b.minor, 0) AS source FROM a FULL JOIN b ON a.section = b.section""",
    "set01_set02_labels": f"{ctes('vendors')} SELECT region || ' / ' || state AS label, arg_min(name, vendor_id) AS first_name FROM vendors GROUP BY 1",
    "set03_win05_fresh_rows": f"""{_I}, f AS (SELECT min(invoice_id) AS invoice_id, vendor_id, priority FROM invoices WHERE invoice_id % 2 = 1 GROUP BY vendor_id, priority)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM invoices o WHERE invoice_id % 8 = 0 AND o.vendor_id IS NOT DISTINCT FROM f.vendor_id AND o.priority = f.priority)""",
    "dml01_vendor_upsert": """WITH a AS (SELECT o_custkey AS k, max(o_orderpriority) AS p, min(o_orderkey) AS f, count(*) AS n, list(DISTINCT o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey AS k, max(o_orderpriority) AS p, min(o_orderkey) AS f, count(*) AS n, list(DISTINCT o_orderstatus) AS s FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(b.k, a.k) AS vendor_id, coalesce(b.p, a.p) AS last_priority, CASE WHEN a.k IS NULL THEN b.f ELSE a.f END AS first_invoice, coalesce(a.n, 0) + coalesce(b.n, 0) AS invoices,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))), ',') AS seen FROM a FULL JOIN b ON a.k = b.k""",
    "dml03_approvals": f"{_I}, g AS (SELECT *, invoice_id % 3 = 0 AND status IN ('PARSED', 'NEEDS_REVIEW') AS modified FROM invoices) SELECT invoice_id, CASE WHEN modified THEN 'APPROVED' ELSE status END AS status, modified FROM g",
    "dml04_deletions": f"{_I} SELECT invoice_id, status FROM invoices WHERE NOT (invoice_id % 10 = 0 AND status <> 'EXPORTED')",
    "dml06_protected_upsert": f"{_I} SELECT invoice_id, CASE WHEN invoice_id % 4 = 0 AND status NOT IN ('EXPORTED', 'APPROVED') THEN 'PARSED' ELSE status END AS status, CASE WHEN invoice_id % 4 = 0 AND status NOT IN ('EXPORTED', 'APPROVED') THEN total_minor + 1 ELSE total_minor END AS total_minor FROM invoices",
    "dml07_merged_ledgers": f"{ctes('entries')} SELECT vendor_id - vendor_id % 2 AS vendor_id, section, 'all' AS fy, CAST(sum(base_minor) AS BIGINT) AS base_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor, min(invoice_date) AS crossed_at FROM entries GROUP BY 1, 2",
    "vch01_vch02_voucher_lines": f"""{ctes('entries')}, e AS (SELECT *, CASE WHEN invoice_id % 2 = 0 THEN base_minor * 18 // 118 ELSE 0 END AS igst, CASE WHEN invoice_id % 3 = 0 THEN tax_minor ELSE 0 END AS tds FROM (SELECT invoice_id, CAST(sum(base_minor) AS BIGINT) AS base_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor FROM entries GROUP BY 1)),
l AS (SELECT invoice_id, 1 AS o, 'party' AS ledger, tds - base_minor AS minor FROM e UNION ALL SELECT invoice_id, 2, 'purchase', base_minor - igst FROM e UNION ALL SELECT invoice_id, 3, 'igst', igst FROM e UNION ALL SELECT invoice_id, 4, 'tds', -tds FROM e)
SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY o) - 1 AS position, ledger, CAST(minor AS BIGINT) AS minor FROM l WHERE minor <> 0""",
    "snk01_csv_export": f"""{_I} SELECT number || ',' || total_minor // 100 || '.' || lpad(CAST(total_minor % 100 AS VARCHAR), 2, '0') || ',"say ""' || priority || '"", ok"' AS line FROM invoices WHERE status IN ('APPROVED', 'EXPORTED')""",
    "snk04_voucher_batches": f"{_I} SELECT tenant_id, invoice_id, (row_number() OVER (PARTITION BY tenant_id ORDER BY invoice_id) - 1) // 25 AS batch FROM invoices WHERE status = 'APPROVED'",
    "flt19_flt20_validations": f"""{_I}, f AS (SELECT invoice_id, CASE WHEN vendor_id IS NULL THEN 'vendor missing' END AS a, CASE WHEN total_minor >= 30000000 THEN 'total too large' END AS b, CASE WHEN status <> 'APPROVED' THEN 'not approved' END AS c FROM invoices)
SELECT invoice_id, coalesce(a, b, c) AS first, concat_ws('; ', a, b, c) AS failures FROM f""",
    "ag23_dependents": "WITH c AS (SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'parts', count(*) FROM part) SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c",
}
