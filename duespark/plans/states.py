"""Queries of rules, next states and projections over the adapted tables."""

from pyspark.sql import functions as F

from duespark.functions.text import GSTIN, IRN, PAN
from duespark.operators import changes, documents, projections, reconcile, relational, risk, suggest, tax, workflow
from duespark.plans.accounting import tax_kernels
from duespark.plans.adapt import ctes, entries, invoices, transactions, vendors
from duespark.sources.tables import table


def one_of(number, *values):
    """The value that a number picks, by its remainder."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def rules(spark, d):
    """FLT-07, FLT-16."""
    i = invoices(spark, d)
    op = one_of(F.col("invoice_id"), "eq", "gt", "gte", "lt", "lte", "other")
    day = lambda x: F.lit(x).cast("timestamp")
    return i.select("invoice_id", relational.rule_holds(F.col("total_minor"), op, F.lit(15_000_000)).alias("holds"), relational.overlaps(F.col("created_at"), F.col("due_at"), day("1997-01-01"), day("1997-06-30")).alias("overlaps"))


def eligible(spark, d):
    """FLT-17: approvers by role, by list or any, within a limit."""
    i, key = invoices(spark, d), F.col("invoice_id")
    limit = F.when(key % 7 != 0, F.lit(20_000_000))
    ok = workflow.may_approve(one_of(key, "any", "role", "users", "none"), one_of(key, "admin", "clerk", "lead"), F.lit("clerk"), key % 5, F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), limit, F.col("total_minor"))
    return i.select("invoice_id", ok.alias("may_approve"))


def versions(spark, d):
    """DML-05, DML-16: versions that move on, with the old one in a bounded history."""
    i = invoices(spark, d).select("invoice_id", (F.col("invoice_id") % 3).alias("version"), F.array(F.col("invoice_id") % 3 - 1, F.col("invoice_id") % 3 - 2).alias("history"))
    i = i.withColumn("history", changes.prepend_bounded(F.col("history"), F.col("version"), 2))
    out = changes.compare_and_set(i, "version", F.lit(1), F.lit(2).cast("bigint"))
    return out.select("invoice_id", "version", "modified", F.concat_ws(",", F.transform("history", lambda x: x.cast("string"))).alias("history"))


def overflow(spark, d):
    """DML-08: of each invoice's lines two stay, the others overflow."""
    e = entries(spark, d).groupBy("invoice_id").agg(F.array_sort(F.array_agg("line")).alias("lines"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return changes.split_overflow(e, "lines", 2).select("invoice_id", text("lines"), text("overflow"))


def counters(spark, d):
    """DML-13, WIN-08: uses of priorities added to the counters of finished orders; the newest five days."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("timestamp").alias("used_at"), F.col("o_orderstatus").alias("s"))
    current = o.filter("s = 'F'").groupBy("vendor_id", "code").agg(F.count(F.lit(1)).alias("n"), F.array_agg("used_at").alias("recent"))
    out = changes.usage_counters(current, o.filter("s <> 'F'"), ["vendor_id", "code"])
    return out.select("vendor_id", "code", "n", F.concat_ws(",", F.transform("recent", lambda x: F.date_format(x, "yyyy-MM-dd"))).alias("recent"))


def overlaid(spark, d):
    """DML-14, JN-19: results of retried items, by invoice."""
    items = invoices(spark, d).select("invoice_id", "status", F.lit(0).cast("bigint").alias("attempts"))
    results = transactions(spark, d).select(F.col("txn_id").alias("invoice_id"), F.when(F.col("description") == "UPI transfer", "FAILED").otherwise("DONE").alias("status"))
    return changes.overlay(items, results, "invoice_id", ["status"])


def triaged(spark, d):
    """DML-15: assignments and rejections, of which some lack an organisation, a reason or the state."""
    i, key = invoices(spark, d), F.col("invoice_id")
    rows = i.select("invoice_id", F.when(F.col("status").isin("PARSED", "NEEDS_REVIEW"), "PENDING_TRIAGE").otherwise(F.col("status")).alias("status"), F.lit(None).cast("bigint").alias("org_id"))
    decisions = i.select("invoice_id", one_of(key, "assign", "reject", "wait").alias("action"), F.col("vendor_id").alias("org_id"), one_of(F.floor(key / 3), "other", "spam").alias("reason"), F.when(key % 4 == 0, "seen").alias("notes"))
    return workflow.triage(rows, decisions)


def section_rules(spark, d):
    """JN-15, WIN-10: the most specific rule of a vendor's segment."""
    items = vendors(spark, d).select(F.col("vendor_id").alias("item_id"), "tenant_id", F.col("category").alias("gl_category"), one_of(F.col("vendor_id"), "C", "P").alias("pan_category"))
    segments = vendors(spark, d).groupBy("category").agg(F.lit(1))
    n, key = table(spark, d, "nation"), F.col("n_nationkey")
    drawn = n.select(F.when(key % 2 == 0, key % 5).alias("tenant_id"), one_of(F.floor(key / 2), "AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY").alias("gl_category"), one_of(F.floor(key / 3), "*", "C").alias("pan_category"), F.concat(F.lit("194-"), key.cast("string")).alias("section"), (key % 3).alias("priority"))
    return tax.section_rule(items, drawn.join(segments, drawn.gl_category == segments.category, "left_semi"))


def rates_resolved(spark, d):
    """JN-16: rates of vendors and sections; own rates of tenants from the nations, common ones from the regions."""
    e = entries(spark, d).groupBy("vendor_id", "section").agg(F.lit(1)).select(F.concat_ws(":", "vendor_id", "section").alias("item_id"), (F.col("vendor_id") % 5).alias("tenant_id"), "section", F.when(F.col("vendor_id") % 4 < 2, one_of(F.col("vendor_id"), "C", "P")).alias("pan_category"))
    key = F.col("k")
    own = table(spark, d, "nation").groupBy((F.col("n_nationkey") % 5).alias("tenant_id"), one_of(F.floor(F.col("n_nationkey") / 10), "194A", "194N", "194R").alias("section")).agg(F.max("n_nationkey").alias("k"))
    own = own.select("tenant_id", "section", (key % 4 != 0).alias("active"), (key + 100).alias("company"), (key + 50).alias("individual"), (key * 1000).alias("threshold"))
    r, key = table(spark, d, "region"), F.col("r_regionkey")
    common = r.select(one_of(key, "194A", "194N", "194R", "194C", "194J").alias("section"), (key != 3).alias("active"), F.when(key == 2, F.lit("1996-01-01")).alias("valid_to"), (key + 1000).alias("company"), (key + 500).alias("individual"), (key * 7).alias("single"), (key * 9).alias("annual"))
    return tax.resolved_rates(e, own, common)


def names(spark, d):
    """JN-17: names by tax id, else by the normalised name, else as they are."""
    v = vendors(spark, d).select("vendor_id", F.concat(F.lit("G"), F.col("vendor_id").cast("string")).alias("gstin"), F.concat(F.lit("  "), F.upper("name"), F.lit("  x ")).alias("name"), "category")
    return suggest.canonical_names(v.select("vendor_id", "gstin", "name"), v.filter("category = 'BUILDING'").select("gstin", F.concat(F.lit("tax "), F.col("gstin")).alias("canonical")), v.filter("category IN ('BUILDING', 'MACHINERY')").select(F.concat(F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))).alias("key"), F.concat(F.lit("name "), F.col("gstin")).alias("canonical")))


def routed(spark, d):
    """JN-18: orders as files whose parts' suppliers are the candidates; the order's customer gives the tax id."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    files = li.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.array_agg("l_suppkey", ).alias("candidates")).join(o.select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 100).alias("gstin")), "file_id")
    files = files.withColumn("candidates", F.array_distinct("candidates"))
    return relational.resolve_org(files, table(spark, d, "supplier").select(F.col("s_suppkey").alias("org_id"), (F.col("s_suppkey") % 100).alias("org_gstin")))


def preferred(spark, d):
    """SET-05, SET-11: vendors' own settings before those of their type."""
    v = vendors(spark, d)
    own = v.filter("category = 'BUILDING'").select("vendor_id", F.lit("own").alias("setting"))
    return relational.prefer(own, v.select("vendor_id", F.col("category").alias("setting")), ["vendor_id"])


def identity_signals(spark, d):
    """RSK-05, RSK-06, RSK-08, RSK-09, TAX-08, MAP-01, CLS-02."""
    v, key = vendors(spark, d), F.col("vendor_id")
    pan = one_of(key, None, "bad", "ABCPD1234E", "ABCCD1234E", "AAACA1111A")
    gstin = one_of(key, None, "29ABCPD1234E1Z5", "27ABCCD1234E1Z5")
    irn = one_of(key, None, "", "zz", "ab" * 32)
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    history = F.when(key % 3 == 0, texts()).when(key % 3 == 1, texts("h0", "h1")).otherwise(texts("h2"))
    known = F.when(key % 2 == 0, texts()).otherwise(texts("a.com"))
    found = F.array_compact(F.array(risk.above_expected(key * 1000, F.lit(100_000)), risk.below_minimum(key, F.lit(50))))
    found = risk.filtered_signals(found, ["TOTAL_AMOUNT_BELOW_MINIMUM"], {"TOTAL_AMOUNT_ABOVE_EXPECTED": "critical"}, {"TOTAL_AMOUNT_ABOVE_EXPECTED": 7})
    return v.select(
        "vendor_id",
        risk.pan_level(pan, gstin).alias("pan_level"),
        risk.irn_signal(irn, gstin, key * 1000, 50_000).alias("irn"),
        risk.bank_changed(F.concat(F.lit("h"), (key % 4).cast("string")), history).alias("bank_changed"),
        risk.sender_signal(one_of(key, None, "gmail.com", "a.com", "b.com"), known).alias("sender"),
        F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["code"], s["severity"], s["penalty"].cast("string")))).alias("signals"),
        risk.status_after_extraction(key % 2, F.size(found), key % 5 != 0).alias("status"),
    )


def linked(spark, d):
    """Transactions matched with their own orders at first, then manual matches and unmatches by tenant."""
    t = transactions(spark, d)
    now = t.select("txn_id", F.when(F.col("description") != "UPI transfer", F.col("txn_id")).alias("invoice_id"), F.when(F.col("description") != "UPI transfer", 80).alias("confidence"), F.when(F.col("description") != "UPI transfer", "matched").otherwise("unmatched").alias("status"))
    i = invoices(spark, d).join(now.select("invoice_id").dropna().withColumn("hit", F.lit(True)), "invoice_id", "left").select("invoice_id", F.when(F.col("hit"), F.col("invoice_id")).alias("verified_by"), F.when(F.col("hit"), 1).otherwise(0).alias("n_verified"))
    action = F.when(F.col("tenant_id") == 0, "unmatch").when(F.col("tenant_id") == 1, "manual").when(F.col("tenant_id") == 2, "match")
    links = t.select("txn_id", action.alias("action"), F.floor(F.col("txn_id") / 4).cast("bigint").alias("invoice_id"), F.lit(60).alias("confidence")).dropna(subset=["action"])
    return reconcile.apply_links(now, i, links)


def named_payments(spark, d):
    """E-02: order lines as payments that name their order."""
    e = entries(spark, d)
    return reconcile.aggregate_matches(e.select(F.concat(F.lit("INV-"), F.col("invoice_id").cast("string")).alias("invoice_ref"), F.col("base_minor").alias("debit_minor")), invoices(spark, d).select("invoice_id", "number", F.col("total_minor").alias("net_minor")))


def allocations(spark, d):
    """E-06: order lines as allocations of a third order's payment."""
    e = entries(spark, d).select((F.col("invoice_id") - F.col("invoice_id") % 3).alias("txn_id"), "invoice_id", F.col("base_minor").alias("minor"))
    return reconcile.over_allocated(e, transactions(spark, d), invoices(spark, d).select("invoice_id", F.col("total_minor").alias("net_minor")))


def api_rows(spark, d):
    """PRJ-03."""
    i = invoices(spark, d)
    return i.select("invoice_id", projections.without_nulls(F.col("vendor_id"), "status", F.date_format("approved_at", "yyyy-MM-dd").alias("approved")).alias("body"))


def summaries(spark, d):
    """PRJ-04, PRJ-05, NUL-02."""
    i = invoices(spark, d)
    signals = F.array_compact(F.array(risk.above_expected(F.col("total_minor"), F.lit(20_000_000)), risk.below_minimum(F.col("total_minor"), F.lit(1_000_000))))
    code = projections.nullable_number(one_of(F.col("invoice_id"), "12.5", "", "x1", "NaN", None))
    s = projections.compliance_summary(projections.nullable_text(one_of(F.col("invoice_id"), "194C", "", None)), code, signals)
    return i.select("invoice_id", s.alias("s")).select("invoice_id", "s.*")


def triage_page(spark, d):
    """AG-12, SRT-10: the oldest of the invoices to review, with the number of all."""
    i = invoices(spark, d).filter("status = 'NEEDS_REVIEW'")
    first = relational.page(i, [F.asc("created_at"), F.asc("invoice_id")], 1, 25)
    return first.select("invoice_id", i.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total"))


def in_order(spark, d):
    """SRT-05, SRT-09: every invoice's place in its tenant's list, by tier, newest first, then by number."""
    i = invoices(spark, d)
    tier = F.when(F.col("status") == "FAILED_PARSE", 0).when(F.col("status") == "NEEDS_REVIEW", 1).otherwise(2)
    coarse = tier * 1_000_000 - F.floor(F.unix_micros("created_at") / (7 * 86_400_000_000))
    return projections.ranked(i, ["tenant_id"], coarse, [F.desc("created_at"), F.asc("invoice_id")]).select("tenant_id", "invoice_id", "rank")


def confidences(spark, d):
    """CNF-04: whole texts, their lines as blocks."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", documents.estimated_confidence(text, F.size(F.split(text, "\n"))).alias("confidence"))


QUERIES = {
    "flt07_flt16_rules": rules,
    "flt17_eligible": eligible,
    "dml05_dml16_versions": versions,
    "dml08_overflow": overflow,
    "dml13_win08_counters": counters,
    "dml14_jn19_overlay": overlaid,
    "dml15_triage": triaged,
    "jn15_win10_section_rules": section_rules,
    "jn16_resolved_rates": rates_resolved,
    "jn17_canonical_names": names,
    "jn18_routed_files": routed,
    "set05_set11_preferred": preferred,
    "rsk05_rsk09_tax08_cls02_signals": identity_signals,
    "tax02_effective_rates": lambda spark, d: tax_kernels(spark, d).select("invoice_id", "line", "bps", "rate_source"),
    "dml10_linked_transactions": lambda spark, d: linked(spark, d)[0],
    "dml10_linked_invoices": lambda spark, d: linked(spark, d)[1],
    "e02_named_payments": named_payments,
    "e06_over_allocated": allocations,
    "prj03_api_rows": api_rows,
    "prj04_prj05_summaries": summaries,
    "ag12_srt10_triage_page": triage_page,
    "srt05_srt09_in_order": in_order,
    "cnf04_confidences": confidences,
}
_pick = lambda key, *values: "CASE (" + key + f") % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"
_links = f"""{ctes('transactions', 'invoices')}, now AS (SELECT txn_id, tenant_id, CASE WHEN description <> 'UPI transfer' THEN txn_id END AS old, CASE tenant_id WHEN 0 THEN 'unmatch' WHEN 1 THEN 'manual' WHEN 2 THEN 'match' END AS action, txn_id // 4 AS new FROM transactions)"""
_low = r"(length(t) = 1 AND t NOT IN ('I', 'a', 'A', 'x', 'X', '&')) OR regexp_matches(t, '[^\p{L}\p{N}_@#&%$,.:/+\-]') OR (regexp_matches(t, '\p{Nd}') AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[^\p{L}\p{N}_]'))"
ORACLES = {
    "flt07_flt16_rules": f"{ctes('invoices')} SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN total_minor = 15000000 WHEN 1 THEN total_minor > 15000000 WHEN 2 THEN total_minor >= 15000000 WHEN 3 THEN total_minor < 15000000 WHEN 4 THEN total_minor <= 15000000 ELSE true END AS holds, due_at >= TIMESTAMP '1997-01-01' AND created_at <= TIMESTAMP '1997-06-30' AS overlaps FROM invoices",
    "flt17_eligible": f"{ctes('invoices')} SELECT invoice_id, CASE invoice_id % 4 WHEN 0 THEN true WHEN 1 THEN invoice_id % 3 = 1 WHEN 2 THEN invoice_id % 5 IN (1, 2) ELSE false END AND (invoice_id % 7 = 0 OR total_minor <= 20000000) AS may_approve FROM invoices",
    "dml05_dml16_versions": f"{ctes('invoices')} SELECT invoice_id, CASE WHEN invoice_id % 3 = 1 THEN 2 ELSE invoice_id % 3 END AS version, invoice_id % 3 = 1 AS modified, (invoice_id % 3) || ',' || (invoice_id % 3 - 1) AS history FROM invoices",
    "dml08_overflow": f"{ctes('entries')}, g AS (SELECT invoice_id, list_sort(list(line)) AS a FROM entries GROUP BY 1) SELECT invoice_id, array_to_string(a[:2], ',') AS lines, array_to_string(a[3:], ',') AS overflow FROM g",
    "dml13_win08_counters": "SELECT o_custkey AS vendor_id, o_orderpriority AS code, count(*) AS n, array_to_string(list_transform(list_sort(list(o_orderdate))[-5:], lambda x: strftime(x, '%Y-%m-%d')), ',') AS recent FROM orders GROUP BY 1, 2",
    "dml14_jn19_overlay": f"{ctes('invoices', 'transactions')} SELECT invoice_id, CASE WHEN txn_id IS NULL THEN status WHEN description = 'UPI transfer' THEN 'FAILED' ELSE 'DONE' END AS status, CAST(txn_id IS NOT NULL AS BIGINT) AS attempts FROM invoices LEFT JOIN transactions ON invoice_id = txn_id",
    "dml15_triage": f"""{ctes('invoices')}, r AS (SELECT invoice_id, vendor_id, CASE WHEN status IN ('PARSED', 'NEEDS_REVIEW') THEN 'PENDING_TRIAGE' ELSE status END AS status FROM invoices),
a AS (SELECT *, status = 'PENDING_TRIAGE' AND invoice_id % 3 = 0 AND vendor_id IS NOT NULL AS assigned, status = 'PENDING_TRIAGE' AND invoice_id % 3 = 1 AND ((invoice_id // 3) % 2 = 1 OR invoice_id % 4 = 0) AS rejected FROM r)
SELECT invoice_id, CASE WHEN assigned THEN 'PENDING' WHEN rejected THEN 'REJECTED' ELSE status END AS status, CASE WHEN assigned THEN vendor_id END AS org_id, assigned OR rejected AS applied FROM a""",
    "jn15_win10_section_rules": f"""{ctes('vendors')}, u AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 5 END AS t, {_pick('n_nationkey // 2', 'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')} AS g, {_pick('n_nationkey // 3', '*', 'C')} AS p, '194-' || n_nationkey AS section, n_nationkey % 3 AS priority FROM nation),
j AS (SELECT vendor_id AS item_id, section, priority, CASE WHEN t IS NOT NULL THEN 0 ELSE 2 END + CASE WHEN p <> '*' THEN 0 ELSE 1 END AS r FROM vendors v LEFT JOIN u ON category = g AND (t IS NULL OR t = v.tenant_id) AND (p = '*' OR p = CASE vendor_id % 2 WHEN 0 THEN 'C' ELSE 'P' END)),
k AS (SELECT *, row_number() OVER w AS k, lead(priority) OVER w = priority AND lead(r) OVER w = r AS tied FROM j WINDOW w AS (PARTITION BY item_id ORDER BY r, priority DESC, section))
SELECT item_id, section, CASE WHEN section IS NULL THEN 'none' WHEN tied THEN 'medium' ELSE 'high' END AS confidence FROM k WHERE k = 1""",
    "jn16_resolved_rates": f"""{ctes('entries')}, e AS (SELECT DISTINCT vendor_id, section FROM entries), o AS (SELECT n_nationkey % 5 AS tenant_id, {_pick('n_nationkey // 10', '194A', '194N', '194R')} AS s, max(n_nationkey) AS k FROM nation GROUP BY 1, 2),
c AS (SELECT {_pick('r_regionkey', '194A', '194N', '194R', '194C', '194J')} AS s, r_regionkey AS k FROM region WHERE r_regionkey NOT IN (2, 3)),
j AS (SELECT e.*, o.k AS ok, c.k AS ck, vendor_id % 4 = 0 AS company FROM e LEFT JOIN o ON o.tenant_id = vendor_id % 5 AND o.s = section LEFT JOIN c ON c.s = section)
SELECT vendor_id || ':' || section AS item_id, CAST(CASE WHEN ok % 4 <> 0 THEN ok + CASE WHEN company THEN 100 ELSE 50 END WHEN ok IS NULL THEN ck + CASE WHEN company THEN 1000 ELSE 500 END END AS BIGINT) AS bps,
  CAST(CASE WHEN ok % 4 <> 0 THEN ok * 1000 WHEN ok IS NULL THEN ck * 7 END AS BIGINT) AS single_minor, CAST(CASE WHEN ok % 4 <> 0 THEN 0 WHEN ok IS NULL THEN ck * 9 END AS BIGINT) AS annual_minor,
  CASE WHEN ok % 4 <> 0 THEN 'tenant' WHEN ok IS NULL AND ck IS NOT NULL THEN 'rateTable' END AS source FROM j""",
    "jn17_canonical_names": f"{ctes('vendors')} SELECT vendor_id, 'G' || vendor_id AS gstin, CASE category WHEN 'BUILDING' THEN 'tax G' || vendor_id WHEN 'MACHINERY' THEN 'name G' || vendor_id ELSE '  ' || upper(name) || '  x ' END AS name FROM vendors",
    "jn18_routed_files": """WITH f AS (SELECT l_orderkey AS file_id, l_suppkey AS s, o_custkey % 100 AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
h AS (SELECT file_id, count(*) AS n, count(*) FILTER (s % 100 = g) AS hits, min(s) FILTER (s % 100 = g) AS hit, min(s) AS sole FROM f GROUP BY 1) SELECT file_id, CASE WHEN hits = 1 THEN hit WHEN n = 1 THEN sole END AS org_id FROM h""",
    "set05_set11_preferred": f"{ctes('vendors')} SELECT vendor_id, CASE WHEN category = 'BUILDING' THEN 'own' ELSE category END AS setting FROM vendors",
    "rsk05_rsk09_tax08_cls02_signals": f"""{ctes('vendors')}, a AS (SELECT vendor_id, {_pick('vendor_id', None, 'bad', 'ABCPD1234E', 'ABCCD1234E', 'AAACA1111A')} AS pan, {_pick('vendor_id', None, '29ABCPD1234E1Z5', '27ABCCD1234E1Z5')} AS gstin, {_pick('vendor_id', None, '', 'zz', 'ab' * 32)} AS irn, {_pick('vendor_id', None, 'gmail.com', 'a.com', 'b.com')} AS domain FROM vendors),
b AS (SELECT *, CASE WHEN regexp_matches(gstin, '{GSTIN}') THEN substr(gstin, 3, 10) END AS own, vendor_id * 1000 > 100000 AS above FROM a)
SELECT vendor_id, CASE WHEN coalesce(pan, '') = '' THEN 'missing' WHEN NOT regexp_matches(pan, '{PAN}') THEN 'invalid' WHEN own <> pan THEN 'mismatch' WHEN own = pan THEN 'L2' ELSE 'L1' END AS pan_level,
  CASE WHEN coalesce(irn, '') = '' THEN CASE WHEN gstin <> '' AND vendor_id * 1000 > 50000 THEN 'IRN_MISSING' END WHEN NOT regexp_matches(irn, '{IRN}') THEN 'IRN_FORMAT_INVALID' END AS irn,
  CASE vendor_id % 3 WHEN 0 THEN false WHEN 1 THEN vendor_id % 4 > 1 ELSE vendor_id % 4 <> 2 END AS bank_changed,
  CASE WHEN domain IS NULL THEN NULL WHEN vendor_id % 2 = 0 THEN 'SENDER_FIRST_TIME' WHEN domain = 'gmail.com' THEN 'SENDER_FREEMAIL' WHEN domain <> 'a.com' THEN 'SENDER_DOMAIN_MISMATCH' END AS sender,
  CASE WHEN above THEN 'TOTAL_AMOUNT_ABOVE_EXPECTED:critical:7' ELSE '' END AS signals, CASE WHEN vendor_id % 5 = 0 THEN 'PENDING_TRIAGE' WHEN vendor_id % 2 > 0 OR above THEN 'NEEDS_REVIEW' ELSE 'PARSED' END AS status FROM b""",
    "tax02_effective_rates": f"""{ctes('entries')} SELECT invoice_id, line, CAST(CASE WHEN invoice_id % 10 = 0 THEN 75 WHEN vendor_id % 4 > 1 THEN 2000 WHEN vendor_id % 4 = 0 THEN 200 ELSE 100 END AS BIGINT) AS bps, CASE WHEN invoice_id % 10 = 0 THEN 'section-197' WHEN vendor_id % 4 > 1 THEN '206aa-no-pan' ELSE 'standard' END AS rate_source FROM entries""",
    "dml10_linked_transactions": f"""{_links} SELECT txn_id, CASE WHEN action IN ('manual', 'match') THEN new WHEN action = 'unmatch' THEN NULL ELSE old END AS invoice_id, CAST(CASE action WHEN 'manual' THEN 100 WHEN 'match' THEN 60 WHEN 'unmatch' THEN NULL ELSE CASE WHEN old IS NOT NULL THEN 80 END END AS INTEGER) AS confidence,
  CASE action WHEN 'manual' THEN 'manual' WHEN 'match' THEN 'matched' WHEN 'unmatch' THEN 'unmatched' ELSE CASE WHEN old IS NOT NULL THEN 'matched' ELSE 'unmatched' END END AS status FROM now""",
    "dml10_linked_invoices": f"""{_links}, n AS (SELECT new AS invoice_id, max(txn_id) AS t, count(*) AS k FROM now WHERE action IN ('manual', 'match') GROUP BY 1), w AS (SELECT i.invoice_id, old IS NOT NULL AND coalesce(action, '') <> 'unmatch' AS kept FROM invoices i LEFT JOIN now ON old = i.invoice_id)
SELECT w.invoice_id, coalesce(t, CASE WHEN kept THEN w.invoice_id END) AS verified_by, CAST(CASE WHEN kept THEN 1 ELSE 0 END + coalesce(k, 0) AS BIGINT) AS n_verified FROM w LEFT JOIN n ON w.invoice_id = n.invoice_id""",
    "e02_named_payments": f"""{ctes('entries', 'invoices')}, p AS (SELECT invoice_id, CAST(sum(base_minor) AS BIGINT) AS paid_minor, count(*) AS payments FROM entries GROUP BY 1)
SELECT invoice_id, payments, paid_minor, CASE WHEN abs(paid_minor - total_minor) <= 100 THEN 'matched' WHEN paid_minor < total_minor THEN 'part paid' ELSE 'overpaid' END AS state FROM p JOIN invoices USING (invoice_id)""",
    "e06_over_allocated": f"""{ctes('entries', 'invoices', 'transactions')}, a AS (SELECT invoice_id - invoice_id % 3 AS txn_id, invoice_id, base_minor AS minor FROM entries), s AS (SELECT *, sum(minor) OVER (PARTITION BY txn_id) AS st, sum(minor) OVER (PARTITION BY invoice_id) AS si FROM a)
SELECT s.txn_id, s.invoice_id, minor, coalesce(st > debit_minor, false) AS over_txn, coalesce(si > total_minor, false) AS over_invoice FROM s LEFT JOIN transactions t ON s.txn_id = t.txn_id LEFT JOIN invoices i ON s.invoice_id = i.invoice_id""",
    "prj03_api_rows": f"""{ctes('invoices')} SELECT invoice_id, '{{' || coalesce('"vendor_id":' || vendor_id || ',', '') || '"status":"' || status || '"' || coalesce(',"approved":"' || strftime(approved_at, '%Y-%m-%d') || '"', '') || '}}' AS body FROM invoices""",
    "prj04_prj05_summaries": f"""{ctes('invoices')} SELECT invoice_id, CASE WHEN invoice_id % 3 = 0 THEN '194C' END AS tds_section, CASE WHEN invoice_id % 5 = 0 THEN CAST(12.5 AS DOUBLE) END AS gl_code, CAST(total_minor > 20000000 OR (total_minor > 0 AND total_minor < 1000000) AS INTEGER) AS signals,
  CASE WHEN total_minor > 20000000 THEN 'warning' WHEN total_minor > 0 AND total_minor < 1000000 THEN 'info' END AS severity FROM invoices""",
    "ag12_srt10_triage_page": f"{ctes('invoices')}, r AS (SELECT * FROM invoices WHERE status = 'NEEDS_REVIEW') SELECT invoice_id, (SELECT count(*) FROM r) AS total FROM r ORDER BY created_at, invoice_id LIMIT 25",
    "srt05_srt09_in_order": f"{ctes('invoices')} SELECT tenant_id, invoice_id, row_number() OVER (PARTITION BY tenant_id ORDER BY CASE status WHEN 'FAILED_PARSE' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, created_at DESC, invoice_id) AS rank FROM invoices",
    "cnf04_confidences": f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '') AS a, len(string_split(coalesce(text, ''), chr(10))) AS blocks FROM documents),
n AS (SELECT doc_id, blocks, len(a) AS n, len(list_filter(a, lambda t: {_low})) AS low FROM d)
SELECT doc_id, CAST(CASE WHEN n > 0 THEN greatest(0, least(9900, floor((CAST(0.92 AS DOUBLE) - CAST(low AS DOUBLE) / n * CAST(0.55 AS DOUBLE) + least(CAST(0.15 AS DOUBLE), blocks * CAST(0.002 AS DOUBLE))) * 10000 + 0.5))) ELSE 0 END AS BIGINT) AS confidence FROM n""",
}
