"""Queries of suggestions, workflows, batches and grouped lists over the adapted tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from duespark.operators import suggest, workflow
from duespark.plans.adapt import ctes, invoices, vendors
from duespark.sources.tables import table


def history(spark, d):
    """GLS-02: order priorities as codes, with dates of their uses."""
    o = table(spark, d, "orders")
    usage = o.groupBy(F.col("o_custkey").alias("vendor_id"), F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.array_agg(F.col("o_orderdate").cast("timestamp")).alias("recent"))
    return suggest.history_scores(usage, F.lit("2001-08-01").cast("timestamp"), 365)


def catalog(spark, d):
    """GLS-03: parts' texts matched with all types as a catalog; a type's code is its least part."""
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return suggest.catalog_matches(items, p.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("code")))


def flags(spark, d):
    """FLG-01, MTH-08."""
    c = table(spark, d, "customer")
    own = F.when(F.col("c_custkey") % 10 == 0, False)
    return c.select("c_custkey", suggest.flag_value(F.col("c_name"), "beta", own, F.lit(None).cast("boolean"), 25, ["Customer#000000001"], False).alias("on"))


def status_actions(spark, d):
    """FLT-18, FLT-23."""
    i = invoices(spark, d)
    f = workflow.action_flags(F.col("status"), F.col("tenant_id") == 1, F.col("tenant_id") != 2)
    return i.select("invoice_id", F.concat_ws(",", workflow.row_actions(F.col("status"))).alias("actions"), f["approve"].alias("approve"), f["edit"].alias("edit"), f["export"].alias("export"))


def approval_states(spark, d):
    """DML-11: three steps an order, its line items' suppliers as approvers."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    steps = o.select(F.col("o_orderkey").alias("invoice_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step_no"), F.col("o_totalprice"))
    steps = steps.select("invoice_id", "step_no", F.when(F.col("step_no") == 2, "all").otherwise("any").alias("rule"), F.lit(2).alias("approvers"), ((F.col("step_no") < 3) | (F.col("o_totalprice") > 200000)).alias("applies"))
    return workflow.advance(steps, li.select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("step_no"), F.col("l_suppkey").alias("user_id")))


def org_archive(spark, d):
    """DML-12, JN-09."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return workflow.archive_or_delete(c.select(F.col("c_custkey").alias("org_id")), o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("org_id")))


def action_queue(spark, d):
    """AG-29: per status the number and the three newest invoices."""
    i = invoices(spark, d)
    # The rank limit is pushed below the shuffle, so three rows of each status leave a task, not whole groups.
    w = Window.partitionBy("status").orderBy(F.desc("created_at"), "invoice_id")
    top = i.select("status", "invoice_id", F.row_number().over(w).alias("k")).filter("k <= 3").groupBy("status").agg(F.array_sort(F.array_agg(F.struct("k", "invoice_id"))).alias("t"))
    n = i.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.join(top, "status").select("status", "n", F.array_join(F.transform("t", lambda x: x["invoice_id"]), ",").alias("newest"))


def action_items(spark, d):
    """AG-29: every invoice to act on, with its reason, severity and rank by recency within the reason.

    The adapted tables tell failed and to-be-reviewed invoices only. Invoices are ranked within weeks, and
    the weeks' counts are summed up, so that no reason is sorted in one task.
    """
    i = invoices(spark, d)
    reason = F.when(F.col("status") == "FAILED_PARSE", "FailedOcr").when(F.col("status") == "NEEDS_REVIEW", "NeedsReview")
    i = i.select("invoice_id", reason.alias("reason"), "created_at", F.floor(F.unix_micros("created_at") / (7 * 86_400_000_000)).alias("week")).filter("reason IS NOT NULL")
    newer = Window.partitionBy("reason").orderBy(F.desc("week")).rowsBetween(Window.unboundedPreceding, -1)
    before = i.groupBy("reason", "week").agg(F.count(F.lit(1)).alias("n")).select("reason", "week", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))
    within = Window.partitionBy("reason", "week").orderBy(F.desc("created_at"), "invoice_id")
    severity = F.when(F.col("reason") == "FailedOcr", 100).otherwise(50)
    return i.join(before, ["reason", "week"]).select("invoice_id", "reason", severity.alias("severity"), (F.col("before") + F.row_number().over(within)).alias("rank"))


def grand_totals(spark, d):
    """AG-16, AG-34."""
    i = invoices(spark, d)
    return i.agg(F.count(F.lit(1)).alias("n"), F.sum("total_minor").cast("bigint").alias("minor"), F.count_distinct("vendor_id").alias("vendors"), F.min("total_minor").alias("least"), F.max("total_minor").alias("most"))


def recent(spark, d):
    """SRT-08, SRT-10: newest within a window of days."""
    i = invoices(spark, d).filter((F.col("created_at") >= F.lit("2001-05-01").cast("timestamp")) & (F.col("created_at") < F.lit("2001-07-01").cast("timestamp")))
    return i.orderBy(F.desc("created_at"), "invoice_id").select("invoice_id", "status").limit(20)


def allocation_caps(spark, d):
    """E-06: customers whose orders add up to more than a cap, with what is over."""
    i = invoices(spark, d).filter("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.sum("total_minor").cast("bigint").alias("minor"))
    return i.filter("minor > 200000000").select("vendor_id", (F.col("minor") - 200_000_000).alias("over_minor"))


def labelled_vendors(spark, d):
    """JN-04, JN-05, SRT-06: inner joins with a sort flag."""
    v = vendors(spark, d)
    return v.filter("category = 'BUILDING'").join(table(spark, d, "customer").select(F.col("c_custkey").alias("vendor_id"), "c_acctbal"), "vendor_id").select("vendor_id", "name", (F.col("c_acctbal") > 0).alias("in_credit"))


QUERIES = {
    "gls02_win09_history": history,
    "gls03_catalog": catalog,
    "flg01_flags": flags,
    "flt18_flt23_actions": status_actions,
    "dml11_approval_states": approval_states,
    "dml12_org_archive": org_archive,
    "ag29_action_queue": action_queue,
    "ag29_action_items": action_items,
    "ag16_grand_totals": grand_totals,
    "srt08_recent": recent,
    "e06_allocation_caps": allocation_caps,
    "jn04_labelled_vendors": labelled_vendors,
}
_tok = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3))"
ORACLES = {
    "gls02_win09_history": """WITH u AS (SELECT o_custkey AS vendor_id, o_orderpriority AS code, count(*) + 2 * count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY) AS score FROM orders GROUP BY 1, 2)
SELECT vendor_id, code, score, CAST(least(100, floor(100 * score / greatest(sum(score) OVER (PARTITION BY vendor_id), 1) + 0.5)) AS BIGINT) AS confidence, row_number() OVER (PARTITION BY vendor_id ORDER BY score DESC, code) AS rank FROM u""",
    "gls03_catalog": f"""WITH a AS (SELECT p_partkey AS item_id, unnest({_tok("concat_ws(' ', p_type, p_name)")}) AS w FROM part), c AS (SELECT min(p_partkey) AS code, p_type FROM part GROUP BY p_type), b AS (SELECT code, unnest({_tok('p_type')}) AS w FROM c),
h AS (SELECT item_id, code, count(*) AS n FROM a JOIN b USING (w) GROUP BY 1, 2)
SELECT item_id, code, CAST(least(70, 20 * n) AS BIGINT) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, code) AS r FROM h) WHERE r = 1""",
    "flg01_flags": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN false WHEN c_name = 'Customer#000000001' THEN true ELSE CAST('0x' || left(sha256(c_name || ':beta'), 8) AS BIGINT) % 100 < 25 END AS "on" FROM customer""",
    "flt18_flt23_actions": f"""{ctes('invoices')} SELECT invoice_id, CASE status WHEN 'EXPORTED' THEN '' WHEN 'APPROVED' THEN 'select,export' WHEN 'PARSED' THEN 'select,approve' WHEN 'NEEDS_REVIEW' THEN 'select,approve,retry' ELSE 'select,retry' END AS actions,
  tenant_id = 1 AND status IN ('PARSED', 'NEEDS_REVIEW') AS approve, tenant_id <> 2 AND status <> 'EXPORTED' AS edit, tenant_id = 1 AND status = 'APPROVED' AS export FROM invoices""",
    "dml11_approval_states": """WITH s AS (SELECT o_orderkey AS invoice_id, step_no, step_no < 3 OR o_totalprice > 200000 AS applies FROM orders, (VALUES (1), (2), (3)) v(step_no)),
g AS (SELECT l_orderkey AS invoice_id, l_linenumber AS step_no, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2),
x AS (SELECT s.invoice_id, s.step_no, NOT applies OR coalesce(n, 0) >= CASE WHEN s.step_no = 2 THEN 2 ELSE 1 END AS done FROM s LEFT JOIN g ON s.invoice_id = g.invoice_id AND s.step_no = g.step_no),
m AS (SELECT invoice_id, min(step_no) FILTER (NOT done) AS current_step FROM x GROUP BY 1) SELECT invoice_id, current_step, CASE WHEN current_step IS NULL THEN 'approved' ELSE 'in_progress' END AS state FROM m""",
    "dml12_org_archive": "WITH n AS (SELECT o_custkey AS org_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS org_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'archive' ELSE 'delete' END AS action FROM customer LEFT JOIN n ON c_custkey = org_id",
    "ag29_action_queue": f"""{ctes('invoices')}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, invoice_id) AS k FROM invoices)
SELECT status, count(*) AS n, string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS newest FROM r GROUP BY 1""",
    "ag29_action_items": f"""{ctes('invoices')}, q AS (SELECT *, CASE status WHEN 'FAILED_PARSE' THEN 'FailedOcr' WHEN 'NEEDS_REVIEW' THEN 'NeedsReview' END AS reason FROM invoices)
SELECT invoice_id, reason, CASE reason WHEN 'FailedOcr' THEN 100 ELSE 50 END AS severity, row_number() OVER (PARTITION BY reason ORDER BY created_at DESC, invoice_id) AS rank FROM q WHERE reason IS NOT NULL""",
    "ag16_grand_totals": f"{ctes('invoices')} SELECT count(*) AS n, CAST(sum(total_minor) AS BIGINT) AS minor, count(DISTINCT vendor_id) AS vendors, min(total_minor) AS least, max(total_minor) AS most FROM invoices",
    "srt08_recent": f"{ctes('invoices')} SELECT invoice_id, status FROM invoices WHERE created_at >= TIMESTAMP '2001-05-01' AND created_at < TIMESTAMP '2001-07-01' ORDER BY created_at DESC, invoice_id LIMIT 20",
    "e06_allocation_caps": f"{ctes('invoices')} SELECT vendor_id, CAST(sum(total_minor) - 200000000 AS BIGINT) AS over_minor FROM invoices WHERE vendor_id IS NOT NULL GROUP BY 1 HAVING sum(total_minor) > 200000000",
    "jn04_labelled_vendors": f"{ctes('vendors')} SELECT vendor_id, name, c_acctbal > 0 AS in_credit FROM vendors JOIN customer ON vendor_id = c_custkey WHERE category = 'BUILDING'",
}
