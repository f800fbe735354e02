"""Queries of tax, reconciliation, risk and vouchers over the adapted tables."""

from pyspark.sql import functions as F

from duespark.operators import reconcile as rec
from duespark.operators import risk, tax
from duespark.plans.adapt import ctes, entries, invoices, transactions, vendors
from duespark.plans.overview import _fy

BPS, SINGLE, ANNUAL = 1000, 3_000_000, 500_000_000


def _matchable(spark, d):
    inv = invoices(spark, d).filter("status <> 'EXPORTED'")
    ven = vendors(spark, d).select("vendor_id", F.col("name").alias("vendor_name"))
    return inv.join(ven, "vendor_id", "left").select("invoice_id", "tenant_id", F.col("total_minor").alias("net_minor"), "number", "vendor_name", "created_at", "approved_at", "due_at")


def rec05(spark, d):
    return rec.reconcile(transactions(spark, d), _matchable(spark, d))


def ledger_general(spark, d):
    e = entries(spark, d).withColumns({"bps": F.lit(BPS), "single": F.lit(SINGLE), "annual": F.lit(ANNUAL), "opening_base": F.lit(0), "opening_tax": F.lit(0)})
    return tax.ledger_fold(e)


def tax_kernels(spark, d):
    e = entries(spark, d)
    igst = F.when(F.col("line") % 3 == 0, F.floor(F.col("base_minor") / 10)).otherwise(0)
    sub = F.when(F.col("line") % 4 == 0, F.col("base_minor") - 500)
    pan = F.when(F.col("vendor_id") % 4 == 0, "ABCCD1234E").when(F.col("vendor_id") % 4 == 1, "ABCPD1234E").when(F.col("vendor_id") % 4 == 2, "bad")
    rate = tax.effective_rate(tax.rate_for_holder(F.substring(pan, 4, 1), F.lit(200), F.lit(100)), pan, F.lit(75), F.col("invoice_id") % 10 == 0)
    df = e.select("invoice_id", "line", tax.taxable_base(F.col("base_minor"), sub, F.lit(0), F.lit(0), igst, F.lit(0)).cast("bigint").alias("taxable"), rate.alias("r"), tax.collected_at_source(F.col("base_minor"), F.lit(0.1)).alias("collected"))
    return df.select("invoice_id", "line", "taxable", F.col("r.bps").alias("bps"), F.col("r.source").alias("rate_source"), "collected")


def risk_signals(spark, d):
    i, as_of = invoices(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp")
    signals = F.array_compact(F.array(risk.above_expected(F.col("total_minor"), F.lit(20_000_000)), risk.below_minimum(F.col("total_minor"), F.lit(1_000_000)), risk.due_too_far(F.col("due_at"), as_of, 60)))
    df = i.select("invoice_id", "status", signals.alias("s"), risk.msme_state(F.col("created_at"), as_of).alias("msme"), risk.missing_fields(vendor=F.col("vendor_id"), number=F.col("number")).alias("missing"), risk.action_reason(F.col("status"), F.lit(None).cast("string"), F.col("total_minor") > 40_000_000, F.col("invoice_id") % 3 == 0, F.lit("INR")).alias("reason"))
    score = risk.document_confidence(F.lit(0.9), F.lit(80), F.size("s"), risk.penalty_sum(F.col("s"), 30))
    return df.select("invoice_id", F.concat_ws(",", F.transform("s", lambda x: x["code"])).alias("codes"), risk.penalty_sum(F.col("s"), 30).alias("penalty"), risk.max_severity(F.col("s")).alias("severity"), "msme", "missing", "reason", risk.severity_of(F.col("reason")).cast("bigint").alias("reason_severity"), score.alias("confidence"), risk.tone(score).alias("tone"))


QUERIES = {
    "tax01_tax03_tax06_kernels": tax_kernels,
    "tax04_tax05_win04_ledger": lambda spark, d: tax.ledger(entries(spark, d), BPS, SINGLE, ANNUAL),
    "tax05_ledger_fold": ledger_general,
    "jn11_win01_rec05_reconcile": rec05,
    "ag24_e05_match_summary": lambda spark, d: rec.summary(rec05(spark, d)),
    "rsk_cls_cnf_signals": risk_signals,
}

_ledger = f"""{ctes('entries')}, e AS (SELECT {_fy} AS fy, * FROM entries),
b AS (SELECT *, CAST(coalesce(sum(base_minor) OVER (PARTITION BY vendor_id, section, fy ORDER BY invoice_date, invoice_id, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM e),
r AS (SELECT *, before + base_minor AS after FROM b),
t AS (SELECT invoice_id, line, vendor_id, section, fy, base_minor, before,
  CAST(CASE WHEN after <= {ANNUAL} THEN 0 WHEN before <= {ANNUAL} THEN (after * {BPS} + 5000) // 10000 WHEN base_minor < {SINGLE} THEN 0 ELSE (base_minor * {BPS} + 5000) // 10000 END AS BIGINT) AS tax_minor,
  before <= {ANNUAL} AND after > {ANNUAL} AS crossed,
  CASE WHEN after <= {ANNUAL} THEN 'BELOW_ANNUAL' WHEN before <= {ANNUAL} THEN 'CROSSED' WHEN base_minor < {SINGLE} THEN 'BELOW_SINGLE' ELSE 'ABOVE' END AS state FROM r)"""
_day = "abs(epoch_us(paid_at) - epoch_us({0})) / 86400000000.0"
_date = lambda c: f"CASE WHEN {c} IS NULL THEN 0 WHEN {_day.format(c)} <= 3 THEN 10 WHEN {_day.format(c)} <= 7 THEN 5 WHEN {_day.format(c)} <= 30 THEN 2 ELSE 0 END"
_reconcile = f"""{ctes('invoices', 'vendors', 'transactions')},
m AS (SELECT i.*, v.name AS vendor_name FROM invoices i LEFT JOIN vendors v ON i.vendor_id = v.vendor_id WHERE status <> 'EXPORTED'),
p AS (SELECT t.tenant_id, t.txn_id, m.invoice_id, CASE WHEN abs(debit_minor - total_minor) <= 1 THEN 50 ELSE 10 END
  + CASE WHEN contains(lower(description), lower(number)) THEN 30 ELSE 0 END
  + CASE WHEN vendor_name IS NULL THEN 0 WHEN len(list_intersect(list_filter(string_split_regex(lower(description), '\\s+'), lambda w: length(w) > 2), list_filter(string_split_regex(lower(vendor_name), '\\s+'), lambda w: length(w) > 2))) >= 1 THEN 20 ELSE 0 END
  + greatest({_date('created_at')}, {_date('approved_at')}, {_date('due_at')}) AS score
  FROM transactions t JOIN m ON t.tenant_id = m.tenant_id AND abs(debit_minor - total_minor) <= 100),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, txn_id ORDER BY score DESC, invoice_id) AS k FROM p) WHERE k = 1),
o AS (SELECT t.tenant_id, t.txn_id, b.invoice_id, CAST(coalesce(score, 0) AS BIGINT) AS score FROM transactions t LEFT JOIN b USING (tenant_id, txn_id)),
f AS (SELECT tenant_id, txn_id, CASE WHEN score >= 30 THEN invoice_id END AS invoice_id, score, CASE WHEN score > 50 THEN 'matched' WHEN score >= 30 THEN 'suggested' ELSE 'unmatched' END AS state FROM o)"""
_n = lambda s: f"CAST(count(*) FILTER (state = '{s}') AS BIGINT)"
ORACLES = {
    "tax01_tax03_tax06_kernels": f"""{ctes('entries')}, e AS (SELECT *, CASE WHEN line % 3 = 0 THEN base_minor // 10 ELSE 0 END AS igst, CASE WHEN line % 4 = 0 THEN base_minor - 500 END AS sub,
  CASE vendor_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'P' END AS cat FROM entries)
SELECT invoice_id, line, CAST(CASE WHEN coalesce(sub, 0) > 0 THEN sub WHEN igst > 0 THEN greatest(0, base_minor - igst) ELSE base_minor END AS BIGINT) AS taxable,
  CAST(CASE WHEN invoice_id % 10 = 0 THEN 75 WHEN cat IS NULL THEN 2000 WHEN cat = 'C' THEN 200 ELSE 100 END AS BIGINT) AS bps,
  CASE WHEN invoice_id % 10 = 0 THEN 'section-197' WHEN cat IS NULL THEN '206aa-no-pan' ELSE 'standard' END AS rate_source, CAST(floor(base_minor * CAST(0.1 AS DOUBLE) / 100) AS BIGINT) AS collected FROM e""",
    "tax04_tax05_win04_ledger": f"{_ledger} SELECT * FROM t",
    "tax05_ledger_fold": f"{_ledger} SELECT vendor_id, section, fy, invoice_id, line, base_minor, tax_minor, crossed, state FROM t",
    "jn11_win01_rec05_reconcile": f"{_reconcile} SELECT * FROM f",
    "ag24_e05_match_summary": f"{_reconcile} SELECT tenant_id, {_n('matched')} AS matched, {_n('suggested')} AS suggested, {_n('unmatched')} AS unmatched, {_n('matched')} * 1000 // count(*) AS match_permille FROM f GROUP BY 1",
    "rsk_cls_cnf_signals": f"""{ctes('invoices')}, a AS (SELECT *, total_minor > 20000000 AS s1, total_minor > 0 AND total_minor < 1000000 AS s2, datediff('day', TIMESTAMP '1998-01-01', due_at) AS ahead, floor((epoch_us(TIMESTAMP '1998-01-01') - epoch_us(created_at)) / 86400000000.0) AS age FROM invoices),
b AS (SELECT *, ahead > 60 AS s3, CASE WHEN s1 THEN least(30, floor(15 + 25 * ((total_minor - 20000000) / 20000000) + 0.5)) ELSE 0 END + CASE WHEN ahead > 60 THEN least(20, floor(8 + (ahead - 60) / 4.0 + 0.5)) ELSE 0 END AS pen,
  CASE WHEN status = 'FAILED_PARSE' THEN 'FAILED' WHEN total_minor > 40000000 THEN 'CRITICAL_RISK' WHEN invoice_id % 3 <> 0 THEN 'MISSING_GSTIN' WHEN status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' END AS reason FROM a),
c AS (SELECT *, CAST(least(30, pen) AS BIGINT) AS penalty, CAST(s1 AS INTEGER) + CAST(s2 AS INTEGER) + CAST(s3 AS INTEGER) AS n FROM b),
g AS (SELECT *, CAST(least(100, greatest(0, floor(CAST(0.9 AS DOUBLE) * 100 * CAST(0.65 AS DOUBLE) + 80 * CAST(0.35 AS DOUBLE) - least(25, 4 * n) - penalty + 0.5))) AS BIGINT) AS confidence FROM c)
SELECT invoice_id, concat_ws(',', CASE WHEN s1 THEN 'TOTAL_AMOUNT_ABOVE_EXPECTED' END, CASE WHEN s2 THEN 'TOTAL_AMOUNT_BELOW_MINIMUM' END, CASE WHEN s3 THEN 'DUE_DATE_TOO_FAR' END) AS codes, penalty,
  CASE WHEN s1 OR s3 THEN 'warning' WHEN s2 THEN 'info' END AS severity, CASE WHEN age > 45 THEN 'MSME_PAYMENT_OVERDUE' WHEN age > 30 THEN 'MSME_PAYMENT_DUE_SOON' END AS msme,
  CASE WHEN vendor_id IS NULL THEN 'vendor' END AS missing, reason, CAST(CASE reason WHEN 'FAILED' THEN 100 WHEN 'CRITICAL_RISK' THEN 80 WHEN 'MISSING_GSTIN' THEN 70 WHEN 'NEEDS_REVIEW' THEN 50 END AS BIGINT) AS reason_severity,
  confidence, CASE WHEN confidence >= 91 THEN 'green' WHEN confidence >= 80 THEN 'yellow' ELSE 'red' END AS tone FROM g""",
}
