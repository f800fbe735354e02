"""Maps the driver's tables onto the accounts-payable domain, in Spark and in DuckDB's SQL.

Money is BIGINT minor units from the first projection on, so later sums are exact. Each frame
has a twin CTE in SQL; `ctes("invoices", ...)` gives those that an oracle needs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duespark.functions.money import round_half_up
from duespark.sources.tables import table


def minor(major):
    return round_half_up(major * 100)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: dates of approval and export follow the status; every 97th order has no vendor."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "EXPORTED").when(F.col("o_orderstatus") == "P", "NEEDS_REVIEW").when(key % 5 == 0, "PARSED").when(key % 7 == 0, "FAILED_PARSE").otherwise("APPROVED")
    df = o.select(
        key.alias("invoice_id"),
        (F.col("o_custkey") % 5).alias("tenant_id"),
        F.when(key % 97 != 0, F.col("o_custkey")).alias("vendor_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        minor(F.col("o_totalprice")).alias("total_minor"),
        status.alias("status"),
        F.concat(F.lit("INV-"), key.cast("string")).alias("number"),
        F.md5((key % 1009).cast("string")).alias("content_hash"),
        F.col("o_orderpriority").alias("priority"),
    )
    day = 86_400_000_000
    later = lambda days: F.timestamp_micros(F.unix_micros("created_at") + (F.col("invoice_id") % days) * day)
    return df.withColumns({"approved_at": F.when(F.col("status").isin("APPROVED", "EXPORTED"), later(20)), "exported_at": F.when(F.col("status") == "EXPORTED", later(45)), "due_at": later(90)})


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("c_custkey").alias("vendor_id"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 5).alias("tenant_id"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries: one row a line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_suppkey").alias("vendor_id"),
        F.concat(F.lit("194"), F.col("l_returnflag")).alias("section"),
        F.col("l_shipdate").cast("timestamp").alias("invoice_date"),
        minor(F.col("l_extendedprice")).alias("base_minor"),
        F.floor((minor(F.col("l_extendedprice")) * 100 + 5000) / 10000).cast("bigint").alias("tax_minor"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank debits: every third order paid some days later, some a few minor units off."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    df = o.filter(key % 3 == 0).select(
        key.alias("txn_id"),
        (F.col("o_custkey") % 5).alias("tenant_id"),
        (minor(F.col("o_totalprice")) + (key % 11 - 5) * 13).alias("debit_minor"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (key % 35) * 86_400_000_000).alias("paid_at"),
        F.when(key % 2 == 0, F.concat(F.lit("NEFT payment inv-"), key.cast("string"), F.lit(" to Customer"))).otherwise(F.lit("UPI transfer")).alias("description"),
    )
    return df


SQL = {
    "invoices": """invoices0 AS (SELECT o_orderkey AS invoice_id, o_custkey % 5 AS tenant_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS vendor_id, o_orderdate AS created_at,
    CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS total_minor,
    CASE WHEN o_orderstatus = 'F' THEN 'EXPORTED' WHEN o_orderstatus = 'P' THEN 'NEEDS_REVIEW' WHEN o_orderkey % 5 = 0 THEN 'PARSED'
         WHEN o_orderkey % 7 = 0 THEN 'FAILED_PARSE' ELSE 'APPROVED' END AS status,
    'INV-' || o_orderkey AS number, md5(CAST(o_orderkey % 1009 AS VARCHAR)) AS content_hash, o_orderpriority AS priority FROM orders),
  invoices AS (SELECT *, CASE WHEN status IN ('APPROVED','EXPORTED') THEN created_at + to_days(CAST(invoice_id % 20 AS INTEGER)) END AS approved_at,
    CASE WHEN status = 'EXPORTED' THEN created_at + to_days(CAST(invoice_id % 45 AS INTEGER)) END AS exported_at,
    created_at + to_days(CAST(invoice_id % 90 AS INTEGER)) AS due_at FROM invoices0)""",
    "vendors": """vendors AS (SELECT c_custkey AS vendor_id, c_name AS name, n_name AS state, r_name AS region, c_mktsegment AS category, c_custkey % 5 AS tenant_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "entries": """entries AS (SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS vendor_id, '194' || l_returnflag AS section, l_shipdate AS invoice_date,
    CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS base_minor,
    (CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 100 + 5000) // 10000 AS tax_minor FROM lineitem)""",
    "transactions": """transactions AS (SELECT o_orderkey AS txn_id, o_custkey % 5 AS tenant_id,
    CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) + (o_orderkey % 11 - 5) * 13 AS debit_minor,
    o_orderdate + to_days(CAST(o_orderkey % 35 AS INTEGER)) AS paid_at,
    CASE WHEN o_orderkey % 2 = 0 THEN 'NEFT payment inv-' || o_orderkey || ' to Customer' ELSE 'UPI transfer' END AS description FROM orders WHERE o_orderkey % 3 = 0)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n  ".join(SQL[n] for n in names)
