"""Dashboards: KPI facet, daily series, breakdowns, top lists, tenant usage, liability report."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duespark.functions.dates import fiscal_quarter, fiscal_year, utc_day
from duespark.plans.adapt import ctes, entries, invoices, vendors

PAID, PENDING = ("APPROVED", "EXPORTED"), ("PARSED", "NEEDS_REVIEW")
STATUSES = ("PENDING", "PARSED", "NEEDS_REVIEW", "AWAITING_APPROVAL", "APPROVED", "EXPORTED", "FAILED_OCR", "FAILED_PARSE", "PENDING_TRIAGE", "REJECTED")
FROM, TO = "1996-01-01 00:00:00", "1996-12-31 23:59:59"


def big(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("bigint")


def amount(*states: str) -> Column:
    return big(F.sum(F.when(F.col("status").isin(*states), F.col("total_minor"))))


def count_of(*states: str) -> Column:
    return F.count_if(F.col("status").isin(*states)).cast("bigint")


def within(column: str, start: str = FROM, end: str = TO) -> Column:
    return F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def kpi_facet(inv: DataFrame) -> DataFrame:
    """AG-01: all branches in one pass."""
    return inv.agg(F.count(F.lit(1)).alias("total"), count_of(*PAID).alias("approved"), amount(*PAID).alias("approved_minor"), amount(*PENDING).alias("pending_minor"), count_of("EXPORTED").alias("exported"), count_of("NEEDS_REVIEW").alias("needs_review"))


def daily(inv: DataFrame, column: str) -> DataFrame:
    """AG-02..04: count and sum by UTC day of a timestamp."""
    return inv.filter(F.col(column).isNotNull()).groupBy(utc_day(F.col(column)).alias("day")).agg(F.count(F.lit(1)).alias("n"), big(F.sum("total_minor")).alias("minor"))


def status_breakdown(inv: DataFrame) -> DataFrame:
    """AG-05."""
    return inv.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def top_vendors(inv: DataFrame, states: tuple, n: int = 10) -> DataFrame:
    """AG-06, AG-07: largest amounts, ties by name."""
    name = F.coalesce(F.col("vendor_id").cast("string"), F.lit("(Unknown)")).alias("vendor")
    found = inv.filter(F.col("status").isin(*states)).groupBy(name).agg(big(F.sum("total_minor")).alias("minor"), F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("minor"), "vendor").limit(n)


def status_facet(inv: DataFrame) -> DataFrame:
    """AG-08: one row of counts for all statuses."""
    return inv.agg(*[count_of(s).alias(s.lower()) for s in STATUSES], count_of(*PENDING).alias("pending_total"))


def duplicate_hashes(inv: DataFrame) -> DataFrame:
    """AG-09."""
    return inv.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def possible_duplicates(inv: DataFrame) -> DataFrame:
    """AG-10: rows that share their content hash, from pre-aggregated counts."""
    return inv.join(duplicate_hashes(inv).select("content_hash", F.lit(True).alias("hit")), "content_hash", "left").select("invoice_id", F.coalesce("hit", F.lit(False)).alias("possible_duplicate"))


def reason_counts(inv: DataFrame) -> DataFrame:
    """AG-11: counts by reason for action, with zeros for reasons that don't occur."""
    from duespark.operators.risk import action_reason, action_severity

    kinds = inv.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in action_severity])).alias("reason"))
    found = inv.select(action_reason(F.col("status"), F.lit(None).cast("string"), F.lit(False), F.lit(True), F.lit("INR")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(found, "reason", "left").select("reason", big(F.col("n")).alias("n"))


def tenant_usage(inv: DataFrame) -> DataFrame:
    """AG-13."""
    failed = F.col("status").isin("FAILED_OCR", "FAILED_PARSE")
    return inv.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total"), count_of(*PAID).alias("approved"), F.count_if(failed).cast("bigint").alias("failed"), amount(*PAID).alias("approved_minor"), F.max("created_at").cast("timestamp_ntz").alias("last_created"))


def tenant_overview(inv: DataFrame, ven: DataFrame) -> DataFrame:
    """JN-02, AG-14, AG-15: tenants with usage, vendors and first vendor, zeros where none."""
    people = ven.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("vendors"), F.min_by("name", "vendor_id").alias("first_vendor"))
    return people.join(tenant_usage(inv), "tenant_id", "left").select("tenant_id", "vendors", "first_vendor", big(F.col("total")).alias("total"), big(F.col("approved_minor")).alias("approved_minor"))


def liability(ent: DataFrame) -> DataFrame:
    """AG-17..19, AG-21: by section, vendor and section, quarter and section, in one pass over grouping sets."""
    df = ent.select(fiscal_year(F.col("invoice_date")).alias("fy"), fiscal_quarter(F.col("invoice_date")).alias("quarter"), "section", "vendor_id", "base_minor", "tax_minor", "invoice_date")
    sets = [["fy", "section"], ["fy", "vendor_id", "section"], ["fy", "quarter", "section"]]
    grouped = df.groupingSets([[F.col(c) for c in x] for x in sets], "fy", "section", "vendor_id", "quarter")
    return grouped.agg(big(F.sum("base_minor")).alias("base_minor"), big(F.sum("tax_minor")).alias("tax_minor"), F.count(F.lit(1)).alias("n"), F.min("invoice_date").cast("timestamp_ntz").alias("first_date"))


def liability_kpis(ent: DataFrame, threshold: int) -> DataFrame:
    """AG-22: totals and distinct vendors over a threshold."""
    by_vendor = ent.groupBy("vendor_id", "section").agg(F.sum("base_minor").alias("base"), F.sum("tax_minor").alias("tax"))
    return by_vendor.agg(big(F.sum("tax")).alias("tax_minor"), F.count_if(F.col("base") > threshold).cast("bigint").alias("crossings"), F.count_distinct(F.when(F.col("base") > threshold, F.col("vendor_id"))).alias("vendors"))


def period_trend(inv: DataFrame) -> DataFrame:
    """JN-22, AG-30: this period against the one before, with the trend in percent."""
    now = F.coalesce(F.sum(F.when(within("created_at"), F.col("total_minor"))), F.lit(0)).cast("bigint")
    before = F.coalesce(F.sum(F.when(within("created_at", "1995-01-01 00:00:00", "1995-12-31 23:59:59"), F.col("total_minor"))), F.lit(0)).cast("bigint")
    df = inv.groupBy("tenant_id").agg(now.alias("current_minor"), before.alias("prior_minor"))
    c, p = F.col("current_minor"), F.col("prior_minor")
    trend = F.when((p == 0) & (c == 0), 0).when(p == 0, 100).otherwise(F.floor((c - p) * 100 / p + F.lit(0.5)))
    return df.withColumn("trend", trend.cast("bigint"))


def cumulative_tax(ent: DataFrame) -> DataFrame:
    """WIN-02: running tax over a dense grid of quarters for each section and year."""
    df = ent.groupBy(fiscal_year(F.col("invoice_date")).alias("fy"), "section", fiscal_quarter(F.col("invoice_date")).alias("quarter")).agg(F.sum("tax_minor").alias("tax"))
    grid = df.select("fy", "section").distinct().select("*", F.explode(F.array(*[F.lit(f"Q{k}") for k in range(1, 5)])).alias("quarter"))
    w = Window.partitionBy("fy", "section").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df, ["fy", "section", "quarter"], "left").select("fy", "section", "quarter", F.sum(F.coalesce("tax", F.lit(0))).over(w).cast("bigint").alias("cumulative_minor"))


def burndown(inv: DataFrame) -> DataFrame:
    """WIN-03: what is left of each tenant's approved total after each month, never below 0."""
    months = inv.filter("approved_at IS NOT NULL").groupBy("tenant_id", F.date_format("approved_at", "yyyy-MM").alias("month")).agg(F.sum("total_minor").alias("minor"))
    w = Window.partitionBy("tenant_id")
    run = w.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.select("tenant_id", "month", F.greatest(F.lit(0), F.sum("minor").over(w) - F.sum("minor").over(run)).cast("bigint").alias("left_minor"))


def top_and_others(inv: DataFrame, n: int = 5) -> DataFrame:
    """WIN-07: the largest vendors and one row for the rest. Ranks come from the top n alone, so no vendor is moved to one task."""
    per = inv.filter("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.sum("total_minor").alias("minor"))
    top = per.orderBy(F.desc("minor"), "vendor_id").limit(n).select("vendor_id", F.col("vendor_id").cast("string").alias("label"))
    # The top n rows are a fixed bound for this broadcast.
    tagged = per.join(F.broadcast(top), "vendor_id", "left")
    return tagged.groupBy(F.coalesce("label", F.lit("Others")).alias("vendor")).agg(big(F.sum("minor")).alias("minor"), F.count(F.lit(1)).alias("n"))


def percentiles(inv: DataFrame) -> DataFrame:
    """AG-31, AG-32: median, interpolated p95 and nearest-rank p99."""
    return inv.groupBy("status").agg(F.median("total_minor").alias("median"), F.percentile("total_minor", 0.95).alias("p95"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY total_minor)").cast("bigint").alias("p99"))


_range = f"created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"
_in = lambda states: "(" + ", ".join(f"'{s}'" for s in states) + ")"
_sum = lambda states: f"CAST(coalesce(sum(total_minor) FILTER (status IN {_in(states)}), 0) AS BIGINT)"
_count = lambda states: f"CAST(count(*) FILTER (status IN {_in(states)}) AS BIGINT)"
_ist = "(invoice_date + INTERVAL 330 MINUTE)"
_fy_start = f"(year({_ist}) - CASE WHEN month({_ist}) < 4 THEN 1 ELSE 0 END)"
_fy = f"({_fy_start} || '-' || lpad(CAST(({_fy_start} + 1) % 100 AS VARCHAR), 2, '0'))"
_quarter = f"('Q' || CAST((month({_ist}) + 8) % 12 // 3 + 1 AS VARCHAR))"


def _inv(f):
    return lambda spark, d: f(invoices(spark, d))


def _ent(f):
    return lambda spark, d: f(entries(spark, d))


def _daily_sql(column):
    return f"{ctes('invoices')} SELECT strftime({column}, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(total_minor) AS BIGINT) AS minor FROM invoices WHERE {column} IS NOT NULL GROUP BY 1"


def _top_sql(states):
    return f"{ctes('invoices')} SELECT coalesce(CAST(vendor_id AS VARCHAR), '(Unknown)') AS vendor, CAST(sum(total_minor) AS BIGINT) AS minor, count(*) AS n FROM invoices WHERE status IN {_in(states)} GROUP BY 1 ORDER BY minor DESC, vendor LIMIT 10"


QUERIES = {
    "ag01_kpi_facet": lambda spark, d: kpi_facet(invoices(spark, d).filter(within("created_at"))),
    "ag02_daily_approvals": _inv(lambda i: daily(i, "approved_at")),
    "ag03_daily_ingestion": _inv(lambda i: daily(i, "created_at")),
    "ag04_daily_exports": _inv(lambda i: daily(i, "exported_at")),
    "ag05_status_breakdown": _inv(status_breakdown),
    "ag06_top_vendors_approved": _inv(lambda i: top_vendors(i, PAID)),
    "ag07_top_vendors_pending": _inv(lambda i: top_vendors(i, PENDING)),
    "ag08_status_facet": _inv(status_facet),
    "ag09_duplicate_hashes": _inv(duplicate_hashes),
    "ag10_possible_duplicates": _inv(possible_duplicates),
    "ag11_reason_counts": _inv(reason_counts),
    "ag13_tenant_usage": _inv(tenant_usage),
    "ag14_ag15_jn02_tenant_overview": lambda spark, d: tenant_overview(invoices(spark, d), vendors(spark, d)),
    "ag17_ag21_liability_report": _ent(liability),
    "ag22_liability_kpis": _ent(lambda e: liability_kpis(e, 500_000_000)),
    "ag30_jn22_period_trend": _inv(period_trend),
    "ag31_ag32_percentiles": _inv(percentiles),
    "win02_cumulative_tax": _ent(cumulative_tax),
    "win03_burndown": _inv(burndown),
    "win07_top_and_others": _inv(top_and_others),
}
_base = f"{ctes('invoices')} SELECT count(*) AS total, {_count(PAID)} AS approved, {_sum(PAID)} AS approved_minor, {_sum(PENDING)} AS pending_minor, {_count(['EXPORTED'])} AS exported, {_count(['NEEDS_REVIEW'])} AS needs_review FROM invoices"
ORACLES = {
    "ag01_kpi_facet": f"{_base} WHERE {_range}",
    "ag02_daily_approvals": _daily_sql("approved_at"),
    "ag03_daily_ingestion": _daily_sql("created_at"),
    "ag04_daily_exports": _daily_sql("exported_at"),
    "ag05_status_breakdown": f"{ctes('invoices')} SELECT status, count(*) AS n FROM invoices GROUP BY 1",
    "ag06_top_vendors_approved": _top_sql(PAID),
    "ag07_top_vendors_pending": _top_sql(PENDING),
    "ag08_status_facet": f"{ctes('invoices')} SELECT {', '.join(f'{_count([s])} AS {s.lower()}' for s in STATUSES)}, {_count(PENDING)} AS pending_total FROM invoices",
    "ag09_duplicate_hashes": f"{ctes('invoices')} SELECT content_hash, count(*) AS n FROM invoices GROUP BY 1 HAVING count(*) > 1",
    "ag10_possible_duplicates": f"{ctes('invoices')} SELECT invoice_id, count(*) OVER (PARTITION BY content_hash) > 1 AS possible_duplicate FROM invoices",
    "ag11_reason_counts": f"""{ctes('invoices')}, r AS (SELECT CASE WHEN status IN ('FAILED_OCR','FAILED_PARSE') THEN 'FAILED' WHEN status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' WHEN status = 'AWAITING_APPROVAL' THEN 'AWAITING_APPROVAL' END AS reason FROM invoices)
SELECT k.reason, count(r.reason) AS n FROM (VALUES ('FAILED'), ('EXPORT_FAILED'), ('CRITICAL_RISK'), ('MISSING_GSTIN'), ('NEEDS_REVIEW'), ('AWAITING_APPROVAL')) k(reason) LEFT JOIN r USING (reason) GROUP BY 1""",
    "ag13_tenant_usage": f"{ctes('invoices')} SELECT tenant_id, count(*) AS total, {_count(PAID)} AS approved, {_count(['FAILED_OCR', 'FAILED_PARSE'])} AS failed, {_sum(PAID)} AS approved_minor, max(created_at) AS last_created FROM invoices GROUP BY 1",
    "ag14_ag15_jn02_tenant_overview": f"""{ctes('invoices', 'vendors')}, u AS (SELECT tenant_id, count(*) AS total, {_sum(PAID)} AS approved_minor FROM invoices GROUP BY 1), p AS (SELECT tenant_id, count(*) AS vendors, arg_min(name, vendor_id) AS first_vendor FROM vendors GROUP BY 1)
SELECT tenant_id, vendors, first_vendor, coalesce(total, 0) AS total, coalesce(approved_minor, 0) AS approved_minor FROM p LEFT JOIN u USING (tenant_id)""",
    "ag17_ag21_liability_report": f"""{ctes('entries')}, e AS (SELECT {_fy} AS fy, {_quarter} AS quarter, * FROM entries)
SELECT fy, section, vendor_id, quarter, CAST(sum(base_minor) AS BIGINT) AS base_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor, count(*) AS n, min(invoice_date) AS first_date FROM e GROUP BY GROUPING SETS ((fy, section), (fy, vendor_id, section), (fy, quarter, section))""",
    "ag22_liability_kpis": f"""{ctes('entries')}, v AS (SELECT vendor_id, section, sum(base_minor) AS base, sum(tax_minor) AS tax FROM entries GROUP BY 1, 2)
SELECT CAST(coalesce(sum(tax), 0) AS BIGINT) AS tax_minor, CAST(count(*) FILTER (base > 500000000) AS BIGINT) AS crossings, count(DISTINCT CASE WHEN base > 500000000 THEN vendor_id END) AS vendors FROM v""",
    "ag30_jn22_period_trend": f"""{ctes('invoices')}, t AS (SELECT tenant_id, CAST(coalesce(sum(total_minor) FILTER ({_range}), 0) AS BIGINT) AS current_minor, CAST(coalesce(sum(total_minor) FILTER (created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31 23:59:59'), 0) AS BIGINT) AS prior_minor FROM invoices GROUP BY 1)
SELECT *, CAST(CASE WHEN prior_minor = 0 AND current_minor = 0 THEN 0 WHEN prior_minor = 0 THEN 100 ELSE floor((current_minor - prior_minor) * 100 / prior_minor + 0.5) END AS BIGINT) AS trend FROM t""",
    "ag31_ag32_percentiles": f"{ctes('invoices')} SELECT status, median(total_minor) AS median, quantile_cont(total_minor, 0.95) AS p95, CAST(quantile_disc(total_minor, 0.99) AS BIGINT) AS p99 FROM invoices GROUP BY 1",
    "win02_cumulative_tax": f"""{ctes('entries')}, e AS (SELECT {_fy} AS fy, section, {_quarter} AS quarter, sum(tax_minor) AS tax FROM entries GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT fy, section, quarter FROM (SELECT DISTINCT fy, section FROM e), (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) q(quarter))
SELECT fy, section, quarter, CAST(sum(coalesce(tax, 0)) OVER (PARTITION BY fy, section ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_minor FROM g LEFT JOIN e USING (fy, section, quarter)""",
    "win03_burndown": f"""{ctes('invoices')}, m AS (SELECT tenant_id, strftime(approved_at, '%Y-%m') AS month, sum(total_minor) AS minor FROM invoices WHERE approved_at IS NOT NULL GROUP BY 1, 2)
SELECT tenant_id, month, CAST(greatest(0, sum(minor) OVER (PARTITION BY tenant_id) - sum(minor) OVER (PARTITION BY tenant_id ORDER BY month ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS left_minor FROM m""",
    "win07_top_and_others": f"""{ctes('invoices')}, p AS (SELECT vendor_id, sum(total_minor) AS minor FROM invoices WHERE vendor_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY minor DESC, vendor_id) AS k FROM p)
SELECT CASE WHEN k <= 5 THEN CAST(vendor_id AS VARCHAR) ELSE 'Others' END AS vendor, CAST(sum(minor) AS BIGINT) AS minor, count(*) AS n FROM r GROUP BY 1""",
}
