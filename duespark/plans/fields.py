"""Queries of extracted fields, date presets, searches, pages of arrays, exports and one quarter's liability."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duespark.functions import fields
from duespark.functions.dates import fiscal_quarter, fiscal_year
from duespark.operators.changes import bulk_update
from duespark.operators.risk import action_reason, severity_of
from duespark.plans.adapt import ctes, entries, invoices, transactions, vendors
from duespark.plans.overview import _fy, _quarter, big
from duespark.sources.tables import spread, table

PLACES = ["12 MG Road, Goa", "uttar  pradesh & Bihar", "Dadra & Nagar Haveli and Daman & Diu", "goal street", None, "Andhra Pradesh", "3 Assam-Street, West Bengal", "Keralam"]
CODES = ["HDFC0000001", "sbin0123456", "ZZZZ0AAAAAA", None]
FROM, TO = "1995-03-01", "1996-06-30"


def _of(values: list, key) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def states_banks(spark, d):
    """STR-10, STR-11."""
    key = F.col("vendor_id")
    gstin = F.when(key % 3 == 0, F.concat(F.lit(" "), F.lpad((key % 41).cast("string"), 2, "0"), F.lit("abcpe1234f1z5"))).when(key % 3 == 1, "bad")
    return vendors(spark, d).select("vendor_id", fields.state_of(gstin, _of(PLACES, key)).alias("state"), fields.bank_of(_of(CODES, key)).alias("bank"))


def plain_texts(spark, d):
    """STR-16."""
    return table(spark, d, "documents").select("doc_id", F.md5(fields.plain_text("text")).alias("plain_md5"))


def repaired_digits(spark, d):
    """STR-18."""
    return table(spark, d, "documents").select("doc_id", F.md5(fields.ocr_digits(F.col("text"))).alias("repaired_md5"))


def field_maps(spark, d):
    """STR-21, MAP-03..06, CNF-02, maps as text."""
    c, key = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey"), F.col("c_custkey")
    name = F.when(key % 3 == 0, F.lit("12 Mill Road")).when(key % 6 == 1, F.concat("c_mktsegment", F.lit(" Ltd"))).when(key % 3 == 1, F.col("c_name")).otherwise("")
    present = fields.present_fields({"vendorName": F.nullif(name, F.lit("")), "total": F.when(key % 2 == 0, key), "gst.cgst": F.when(key % 5 == 0, key * 9)})
    candidates = fields.candidate_map(F.create_map(F.lit("totalAmountMinor"), F.array(key.cast("string"), F.lit(" 12.50 "), F.lit("x"), key.cast("string")), F.lit("no"), F.when(key % 2 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a "), F.lit("a"), F.lit("b")))))
    confidences = fields.confidence_map(F.create_map(F.lit("a"), (key % 150).cast("string"), F.lit("b"), F.lit("bad"), F.lit(" a"), F.when(key % 2 == 0, "0.25")))
    current = F.create_map(F.lit("vendorName"), name, F.lit("totalAmountMinor"), (key % 4 - 1).cast("string"), F.lit("keep"), F.lit("1"))
    selected = F.create_map(F.lit("vendorName"), F.lit("Acme"), F.lit("totalAmountMinor"), (key % 7).cast("string"), F.lit("new"), F.lit("2"))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    joined = F.array_join(F.array_sort(F.transform(F.map_entries(candidates), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";")
    return c.select(
        "c_custkey",
        fields.correction_hint(name, F.col("c_mktsegment")).alias("hint"),
        F.array_join(F.array_sort(F.map_keys(present)), ";").alias("present"),
        joined.alias("candidates"),
        F.try_element_at(confidences, F.lit("a")).alias("confidence"),
        F.size(confidences).cast("bigint").alias("confidences"),
        shown(fields.merged_fields(current, selected, relaxed=True)).alias("relaxed"),
        shown(fields.merged_fields(current, selected, relaxed=False)).alias("strict"),
        fields.field_confidence(F.when(key % 3 == 0, (key % 120).cast("double")), F.when(key % 3 == 1, F.col("c_acctbal") / 1000), F.lit(0.5)).alias("field_confidence"),
    )


def date_presets(spark, d):
    """DT-09."""
    days = invoices(spark, d).select(F.to_date("created_at").alias("day")).distinct()
    shown = days.select("day", F.explode(fields.presets(F.col("day"))).alias("p"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return shown.select(text("day").alias("day"), "p.preset", text("p.first").alias("first"), text("p.last").alias("last"))


def compact_days(spark, d):
    """DT-11."""
    key, created = F.col("invoice_id"), F.col("created_at")
    given = F.when(key % 4 == 0, F.date_format(created, "yyyyMMdd")).when(key % 4 == 1, F.date_format(created, " yyyy-MM-dd")).when(key % 4 == 2, "soon")
    return invoices(spark, d).select("invoice_id", fields.compact_day(given, F.col("due_at")).alias("day"))


def voucher_totals(spark, d):
    """VCH-03."""
    key = F.col("invoice_id")
    parsed = F.when(key % 3 == 0, F.lit(0)).when(key % 3 == 1, F.col("total_minor"))
    amount = F.when(key % 4 != 0, key * 2.5 - 20)
    return invoices(spark, d).select("invoice_id", fields.total_minor(parsed, amount, F.when(key % 5 == 0, "JPY").otherwise("INR")).alias("minor"))


def already_exported(inv: DataFrame) -> DataFrame:
    """JN-07: of each tenant's requested invoices (here those of the first half year of 1995) those that can't be exported, and those of them that have been."""
    asked = inv.filter("created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1995-07-01'").select("invoice_id")
    missing = asked.join(inv.filter("status = 'APPROVED'"), "invoice_id", "left_anti")
    return inv.join(missing, "invoice_id", "left_semi").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("missing"), F.count_if(F.col("status") == "EXPORTED").alias("already"))


def search(parts: DataFrame, pattern: str) -> DataFrame:
    """FLT-09, FLT-10: rows with a size whose name or brand has a match of the pattern, case aside; the pattern isn't escaped."""
    return parts.filter(F.col("p_size").isNotNull() & (F.col("p_name").rlike(f"(?i){pattern}") | F.col("p_brand").rlike(f"(?i){pattern}"))).select("p_partkey")


def export_window(inv: DataFrame) -> DataFrame:
    """FLT-21: days of export within a window, its last day included, and their order in each tenant: most invoices first, then the later day."""
    days = inv.filter(F.col("exported_at") >= F.lit(FROM).cast("timestamp")).filter(F.col("exported_at") < F.date_add(F.lit(TO).cast("date"), 1))
    days = days.groupBy("tenant_id", F.date_format("exported_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # A tenant has at most one row a day here, so no window grows with the invoices.
    return days.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("n"), F.desc("day"))))


def array_page(history, page: int, limit: int):
    """SRT-12: a page of an array that has its newest entry first; pages begin at 1."""
    return F.slice(history, (max(1, page) - 1) * limit + 1, limit)


def history_pages(spark, d):
    """SRT-12: second pages of three of each invoice's lines, the last line first, with the total. An invoice has few lines."""
    per = entries(spark, d).groupBy("invoice_id").agg(F.sort_array(F.collect_list("line"), asc=False).alias("history"))
    return per.select("invoice_id", F.array_join(array_page(F.col("history"), 2, 3), ",").alias("items"), F.size("history").cast("bigint").alias("total"))


def quarter_liability(ent: DataFrame, quarter: str = "Q2") -> DataFrame:
    """AG-20: one quarter's liability by year and section: sums and number of its entries; the first date is that of the ledgers concerned, of any quarter."""
    chosen = fiscal_quarter(F.col("invoice_date")) == quarter
    only = lambda c: F.sum(F.when(chosen, F.col(c)))
    ledgers = ent.groupBy(fiscal_year(F.col("invoice_date")).alias("fy"), "section", "vendor_id").agg(only("base_minor").alias("base"), only("tax_minor").alias("tax"), F.count_if(chosen).alias("n"), F.min("invoice_date").alias("first"))
    return ledgers.filter("n > 0").groupBy("fy", "section").agg(big(F.sum("base")).alias("base_minor"), big(F.sum("tax")).alias("tax_minor"), F.sum("n").alias("n"), F.min("first").cast("timestamp_ntz").alias("first_date"))


def projected(inv: DataFrame) -> DataFrame:
    """PRJ-01, PRJ-02: nested paths that are asked for, and all but some columns."""
    nested = inv.select("invoice_id", "status", F.struct("total_minor", "number").alias("parsed"), F.col("content_hash").alias("ocr_text"))
    return nested.drop("ocr_text").select("invoice_id", "status", "parsed.total_minor")


def lookup(inv: DataFrame, invoice_id: int) -> DataFrame:
    """SRC-02: one row by its id."""
    return inv.filter(F.col("invoice_id") == invoice_id).limit(1).select("invoice_id", "tenant_id", "status")


def exported_reasons(spark, d):
    """SRC-12, DML-09: results of an export set statuses and errors; reason and severity are derived from the new values."""
    t = transactions(spark, d)
    failed = F.col("description") == "UPI transfer"
    results = t.select(F.col("txn_id").alias("invoice_id"), F.when(~failed, "EXPORTED").alias("status"), F.when(failed, "timeout").alias("export_error"))
    rows = invoices(spark, d).select("invoice_id", "vendor_id", "total_minor", "status", F.lit(None).cast("string").alias("export_error"))
    rows = bulk_update(rows, results, "invoice_id", ["status", "export_error"])
    reason = action_reason(F.col("status"), F.col("export_error"), F.col("total_minor") > 30_000_000, F.col("vendor_id").isNotNull(), F.lit("INR"))
    rows = rows.withColumn("reason", reason)
    return rows.select("invoice_id", "status", "export_error", "reason", F.when(F.col("reason").isNotNull(), severity_of(F.col("reason"))).cast("bigint").alias("severity"))


_inv = lambda f: lambda spark, d: f(invoices(spark, d))
QUERIES = {
    "str10_str11_states_banks": states_banks,
    "str16_plain_texts": plain_texts,
    "str18_repaired_digits": repaired_digits,
    "str21_map03_map06_cnf02_fields": field_maps,
    "dt09_presets": date_presets,
    "dt11_compact_days": compact_days,
    "vch03_totals": voucher_totals,
    "jn07_already_exported": _inv(already_exported),
    "flt09_flt10_search": lambda spark, d: search(table(spark, d, "part"), "br.*2"),
    "flt21_export_window": _inv(export_window),
    "srt12_history_pages": history_pages,
    "ag20_quarter_liability": lambda spark, d: quarter_liability(entries(spark, d)),
    "prj01_prj02_projected": _inv(projected),
    "src12_dml09_exported_reasons": exported_reasons,
    "src02_lookup": _inv(lambda inv: lookup(inv, 1)),
}
_texts = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
_pairs = lambda table: ", ".join(f"('{k}', '{v}')" for k, v in table.items())
_shown = lambda name, total: f"'keep=1;new=2;totalAmountMinor=' || {total} || ';vendorName=' || {name}"
ORACLES = {
    "str10_str11_states_banks": f"""WITH s(code, state) AS (VALUES {_pairs(fields.STATES)}), b(prefix, bank) AS (VALUES {_pairs(fields.BANKS)}),
v AS (SELECT c_custkey AS vendor_id, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 41 AS VARCHAR), 2, '0') END AS code, replace(regexp_replace(lower({_texts(PLACES)}[c_custkey % {len(PLACES)} + 1]), '\\s+', ' ', 'g'), '&', 'and') AS place, upper(substr({_texts(CODES)}[c_custkey % {len(CODES)} + 1], 1, 4)) AS prefix FROM customer),
m AS (SELECT vendor_id, state FROM v JOIN s ON regexp_matches(place, '(^|[^a-z0-9])' || lower(state) || '($|[^a-z0-9])') QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY length(state) DESC, state) = 1)
SELECT v.vendor_id, coalesce(s.state, m.state) AS state, coalesce(bank, v.prefix) AS bank FROM v LEFT JOIN s ON v.code = s.code LEFT JOIN m ON v.vendor_id = m.vendor_id LEFT JOIN b ON v.prefix = b.prefix""",
    "str16_plain_texts": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS plain_md5 FROM documents",
    "str18_repaired_digits": r"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '(?s)\b[0-9OlIoiL,.\s]+\b|[^0-9OlIoiL,.\s]+|.'), lambda p: CASE WHEN regexp_matches(p, '[0-9]') AND regexp_full_match(p, '[0-9OlIoiL,.\s]+') THEN translate(p, 'Ol', '01') ELSE p END), '')) AS repaired_md5 FROM documents",
    "str21_map03_map06_cnf02_fields": f"""WITH c AS (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '12 Mill Road' WHEN c_custkey % 6 = 1 THEN c_mktsegment || ' Ltd' WHEN c_custkey % 3 = 1 THEN c_name ELSE '' END AS name FROM customer)
SELECT c_custkey, c_mktsegment || CASE WHEN name <> '' THEN ' not ' || name ELSE '' END AS hint,
  array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'gst.cgst' END, CASE WHEN k % 2 = 0 THEN 'total' END, CASE WHEN name <> '' THEN 'vendorName' END], lambda x: x IS NOT NULL), ';') AS present,
  CASE WHEN k % 2 = 0 THEN '' ELSE 'no=a,b;' END || 'totalAmountMinor=' || k || CASE WHEN k <> 1250 THEN ',1250' ELSE '' END AS candidates,
  CASE WHEN k % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CASE WHEN k % 150 > 1 THEN least(CAST(1 AS DOUBLE), round(CAST(k % 150 AS DOUBLE) / 100, 4)) ELSE CAST(k % 150 AS DOUBLE) END END AS confidence, CAST(1 AS BIGINT) AS confidences,
  {_shown("'Acme'", "k % 7")} AS relaxed, {_shown("CASE WHEN k % 6 = 1 THEN name ELSE 'Acme' END", "CASE WHEN k % 4 <= 1 AND k % 7 > 0 THEN k % 7 ELSE k % 4 - 1 END")} AS strict,
  CASE k % 3 WHEN 0 THEN CASE WHEN k % 120 > 1 THEN least(1.0, (k % 120) / 100.0) ELSE CAST(k % 120 AS DOUBLE) END WHEN 1 THEN round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), c_acctbal / 1000)), 4) ELSE CAST(0.5 AS DOUBLE) END AS field_confidence FROM c""",
    "dt09_presets": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT d, CAST(date_trunc('month', d) AS DATE) AS m FROM d),
p AS (SELECT d, 'this-month' AS preset, m AS a, d AS b FROM m UNION ALL SELECT d, 'last-month', CAST(m - INTERVAL 1 MONTH AS DATE), m - 1 FROM m UNION ALL SELECT d, '7d', d - 6, d FROM m UNION ALL SELECT d, '30d', d - 29, d FROM m UNION ALL SELECT d, 'quarter', CAST(date_trunc('quarter', d) AS DATE), d FROM m)
SELECT strftime(d, '%Y-%m-%d') AS day, preset, strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last FROM p""",
    "dt11_compact_days": f"{ctes('invoices')} SELECT invoice_id, strftime(CASE WHEN invoice_id % 4 < 2 THEN created_at ELSE due_at END, '%Y%m%d') AS day FROM invoices",
    "vch03_totals": f"""{ctes('invoices')} SELECT invoice_id, CAST(CASE WHEN invoice_id % 3 = 1 AND total_minor > 0 THEN total_minor WHEN invoice_id % 4 <> 0 AND invoice_id * 2.5 > 20 THEN floor((invoice_id * 2.5 - 20) * CASE WHEN invoice_id % 5 = 0 THEN 1 ELSE 100 END + 0.5) END AS BIGINT) AS minor FROM invoices""",
    "jn07_already_exported": f"{ctes('invoices')} SELECT tenant_id, count(*) AS missing, count(*) FILTER (status = 'EXPORTED') AS already FROM invoices WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1995-07-01' AND status <> 'APPROVED' GROUP BY 1",
    "flt09_flt10_search": "SELECT p_partkey FROM part WHERE p_size IS NOT NULL AND (regexp_matches(p_name, 'br.*2', 'i') OR regexp_matches(p_brand, 'br.*2', 'i'))",
    "flt21_export_window": f"""{ctes('invoices')}, n AS (SELECT tenant_id, strftime(exported_at, '%Y-%m-%d') AS day, count(*) AS n FROM invoices WHERE exported_at >= TIMESTAMP '{FROM}' AND exported_at < TIMESTAMP '{TO}' + INTERVAL 1 DAY GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, day DESC) AS INTEGER) AS rank FROM n""",
    "srt12_history_pages": f"{ctes('entries')}, h AS (SELECT invoice_id, list_reverse_sort(list(line)) AS history FROM entries GROUP BY 1) SELECT invoice_id, array_to_string(history[4:6], ',') AS items, len(history) AS total FROM h",
    "ag20_quarter_liability": f"""{ctes('entries')}, e AS (SELECT {_fy} AS fy, {_quarter} AS quarter, * FROM entries), f AS (SELECT *, min(invoice_date) OVER (PARTITION BY fy, section, vendor_id) AS first FROM e)
SELECT fy, section, CAST(sum(base_minor) AS BIGINT) AS base_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor, count(*) AS n, min(first) AS first_date FROM f WHERE quarter = 'Q2' GROUP BY 1, 2""",
    "prj01_prj02_projected": f"{ctes('invoices')} SELECT invoice_id, status, total_minor FROM invoices",
    "src12_dml09_exported_reasons": f"""{ctes('invoices', 'transactions')}, j AS (SELECT invoice_id, vendor_id, total_minor, CASE WHEN description <> 'UPI transfer' THEN 'EXPORTED' ELSE status END AS status, CASE WHEN description = 'UPI transfer' THEN 'timeout' END AS export_error FROM invoices LEFT JOIN transactions ON invoice_id = txn_id),
r AS (SELECT *, CASE WHEN status = 'FAILED_PARSE' THEN 'FAILED' WHEN export_error IS NOT NULL THEN 'EXPORT_FAILED' WHEN total_minor > 30000000 THEN 'CRITICAL_RISK' WHEN vendor_id IS NULL THEN 'MISSING_GSTIN' WHEN status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' END AS reason FROM j)
SELECT invoice_id, status, export_error, reason, CAST(CASE reason WHEN 'FAILED' THEN 100 WHEN 'EXPORT_FAILED' THEN 90 WHEN 'CRITICAL_RISK' THEN 80 WHEN 'MISSING_GSTIN' THEN 70 WHEN 'NEEDS_REVIEW' THEN 50 END AS BIGINT) AS severity FROM r""",
    "src02_lookup": f"{ctes('invoices')} SELECT invoice_id, tenant_id, status FROM invoices WHERE invoice_id = 1",
}
