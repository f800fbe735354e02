"""Tax withholding: taxable base, rates, thresholds and the ledger fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duespark.functions.dates import fiscal_year
from duespark.functions.money import floor_share, round_half_up, share_bps
from duespark.functions.text import PAN

NO_PAN_BPS = 2000

#: Seed rates as (section, company bps, individual bps, single threshold, annual threshold), in minor units.
RATES = [
    ("194C", 200, 100, 3_000_000, 10_000_000),
    ("194J", 1000, 1000, 3_000_000, 3_000_000),
    ("194H", 500, 500, 0, 1_500_000),
    ("194I(a)", 200, 200, 0, 24_000_000),
    ("194I(b)", 1000, 1000, 0, 24_000_000),
    ("194A", 1000, 1000, 0, 500_000),
    ("194Q", 10, 10, 0, 500_000_000),
]


def taxable_base(total: Column, subtotal: Column, cgst: Column, sgst: Column, igst: Column, cess: Column) -> Column:
    """TAX-01: null tax parts count as 0; all null means that there is no tax split."""
    parts = [F.coalesce(x, F.lit(0)) for x in (cgst, sgst, igst)]
    none = F.coalesce(subtotal, cgst, sgst, igst, cess).isNull()
    separate = (parts[0] > 0) | (parts[1] > 0) | (parts[2] > 0)
    has_sub = F.coalesce(subtotal, F.lit(0)) > 0
    rest = F.greatest(F.lit(0), total - parts[0] - parts[1] - parts[2] - F.coalesce(cess, F.lit(0)))
    return F.when(none, total).when(has_sub, subtotal).when(separate, rest).otherwise(total)


def rate_for_holder(category: Column, company: Column, individual: Column) -> Column:
    """TAX-03."""
    return F.when(category == "C", company).otherwise(individual)


def effective_rate(bps: Column, pan: Column, cert_bps: Column, cert_ok: Column) -> Column:
    """TAX-02: struct of the rate and where it comes from."""
    no_pan = ~F.coalesce(pan.rlike(PAN), F.lit(False))
    ok = F.coalesce(cert_ok, F.lit(False)) & cert_bps.isNotNull()
    rate = F.when(ok, cert_bps).when(no_pan, F.greatest(F.lit(NO_PAN_BPS), 2 * bps)).otherwise(bps)
    source = F.when(ok, "section-197").when(no_pan, "206aa-no-pan").otherwise("standard")
    return F.struct(rate.cast("bigint").alias("bps"), source.alias("source"))


def certificate_ok(on: Column, valid_from: Column, valid_to: Column, cert_fy: Column, fy: Column, used: Column, most: Column) -> Column:
    """Whether a certificate covers the date and year and isn't used up."""
    return (on >= valid_from) & (on <= valid_to) & (cert_fy == fy) & (F.coalesce(used, F.lit(0)) < most)


def threshold_tax(base: Column, before: Column, deducted: Column, bps: Column, single: Column, annual: Column) -> Column:
    """TAX-04: struct<tax, crossed, state>. At the annual threshold is below it; the crossing catches up on the whole year."""
    after = before + base
    below = (annual > 0) & (after <= annual)
    crossing = (annual > 0) & (before <= annual) & (after > annual)
    small = (single > 0) & (base < single)
    tax = F.when(below, F.lit(0)).when(crossing, F.greatest(F.lit(0), share_bps(after, bps) - deducted)).when(small, F.lit(0)).otherwise(share_bps(base, bps))
    state = F.when(below, "BELOW_ANNUAL").when(crossing, "CROSSED").when(small, "BELOW_SINGLE").otherwise("ABOVE")
    return F.struct(tax.cast("bigint").alias("tax"), crossing.alias("crossed"), state.alias("state"))


def collected_at_source(total: Column, percent: Column, rounded: bool = False) -> Column:
    """TAX-06: floored, or rounded as reconciliation does it."""
    raw = total * percent / 100
    return round_half_up(raw) if rounded else F.floor(raw).cast("bigint")


def cumulative_before(entries: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """WIN-04: adds `before`, the sum of the key's earlier rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("before", F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("bigint"))


def ledger(entries: DataFrame, bps: int, single: int, annual: int) -> DataFrame:
    """TAX-05 on clean ledgers with one rate, as a window: nothing is deducted before the crossing when there is an annual threshold."""
    df = entries.withColumn("fy", fiscal_year(F.col("invoice_date")))
    df = cumulative_before(df, ["vendor_id", "section", "fy"], ["invoice_date", "invoice_id", "line"], "base_minor")
    result = threshold_tax(F.col("base_minor"), F.col("before"), F.lit(0), F.lit(bps), F.lit(single), F.lit(annual))
    return df.withColumn("r", result).select("invoice_id", "line", "vendor_id", "section", "fy", "base_minor", "before", F.col("r.tax").alias("tax_minor"), F.col("r.crossed").alias("crossed"), F.col("r.state").alias("state"))


def ledger_fold(entries: DataFrame) -> DataFrame:
    """TAX-05 in general: rows bring their own bps, single and annual thresholds, and opening_base and opening_tax of their ledger.

    A ledger (vendor, section, year) is summed over its rows in order. The tax so far is the larger, at each crossing, of
    itself and the year's share, and else grows by the row's own tax: so after any row it is the taxes up to it, and above
    them the most by which a crossing's share, or the opening, exceeds the taxes before it.
    """
    keys = ["vendor_id", "section", "fy"]
    df = entries.withColumn("fy", fiscal_year(F.col("invoice_date")))
    ledger = Window.partitionBy(*keys)
    order = ledger.orderBy("invoice_date", "invoice_id", "line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    base, bps, annual = (F.col(c) for c in ("base_minor", "bps", "annual"))
    opening = {f"opening_{x}": F.coalesce(F.max(f"opening_{x}").over(ledger), F.lit(0)).cast("bigint") for x in ("base", "tax")}
    df = df.withColumns(opening).withColumn("after", F.col("opening_base") + F.sum(base).over(so_far))
    below = (annual > 0) & (F.col("after") <= annual)
    crossing = (annual > 0) & (F.col("after") - base <= annual)
    state = F.when(below, "BELOW_ANNUAL").when(crossing, "CROSSED").when((F.col("single") > 0) & (base < F.col("single")), "BELOW_SINGLE").otherwise("ABOVE")
    df = df.withColumn("state", state)
    own = F.when(F.col("state") == "ABOVE", floor_share(base, bps)).otherwise(F.lit(0).cast("bigint"))
    due = F.when(F.col("state") == "CROSSED", floor_share(F.col("after"), bps))
    df = df.withColumns({"own": own, "due": due}).withColumn("owned", F.sum("own").over(so_far))
    most = F.greatest(F.col("opening_tax"), F.max(F.col("due") - F.col("owned")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    tax = F.when(F.col("state") == "CROSSED", F.greatest(F.lit(0), F.col("due") - F.col("owned") - most)).otherwise(F.col("own"))
    crossed = F.col("state") == "CROSSED"
    return df.select(*keys, "invoice_id", "line", base.cast("bigint").alias("base_minor"), tax.cast("bigint").alias("tax_minor"), crossed.alias("crossed"), "state")


def section_rule(items: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-15, WIN-10: the most specific rule for (gl_category, pan_category, tenant_id), ties of priority marked.

    items: item_id, tenant_id, gl_category, pan_category; rules: tenant_id (null: all), gl_category, pan_category ('*': any), section, priority.
    """
    r = rules.select(F.col("tenant_id").alias("r_tenant"), F.col("gl_category").alias("r_gl"), F.col("pan_category").alias("r_pan"), "section", "priority")
    joined = items.join(r, (F.col("gl_category") == F.col("r_gl")) & (F.col("r_tenant").isNull() | (F.col("r_tenant") == F.col("tenant_id"))) & ((F.col("r_pan") == "*") | (F.col("r_pan") == F.col("pan_category"))), "left")
    rank = F.when(F.col("r_tenant").isNotNull(), 0).otherwise(2) + F.when(F.col("r_pan") != "*", 0).otherwise(1)
    joined = joined.withColumn("rank", rank)
    w = Window.partitionBy("item_id").orderBy("rank", F.desc("priority"), "section")
    top = joined.select("item_id", "section", F.row_number().over(w).alias("k"), (F.lead("priority").over(w) == F.col("priority")).alias("p"), (F.lead("rank").over(w) == F.col("rank")).alias("q"))
    return top.filter("k = 1").select("item_id", "section", F.when(F.col("section").isNull(), "none").when(F.col("p") & F.col("q"), "medium").otherwise("high").alias("confidence"))


def resolved_rates(items: DataFrame, overrides: DataFrame, rates: DataFrame) -> DataFrame:
    """JN-16: the rate of each item (item_id, tenant_id, section, pan_category): the tenant's own, none if that is inactive, else the current one.

    overrides: tenant_id, section, active, company, individual (basis points), threshold; one row a tenant and section.
    rates: section, active, valid_to (null: current), company, individual, single, annual; one current row a section.
    """
    pick = lambda side: F.when(F.col("pan_category") == "C", F.col(f"{side}.company")).otherwise(F.col(f"{side}.individual"))
    current = rates.filter("active AND valid_to IS NULL").alias("r")
    i, o = items.alias("i"), overrides.alias("o")
    joined = i.join(o, (F.col("i.tenant_id") == F.col("o.tenant_id")) & (F.col("i.section") == F.col("o.section")), "left").join(current, F.col("i.section") == F.col("r.section"), "left")
    own, table = F.col("o.section").isNotNull(), F.col("r.section").isNotNull()
    use = lambda mine, common: F.when(own & F.col("o.active"), mine).when(~own & table, common)
    return joined.select(
        "i.item_id",
        use(pick("o"), pick("r")).cast("bigint").alias("bps"),
        use(F.col("o.threshold"), F.col("r.single")).cast("bigint").alias("single_minor"),
        use(F.lit(0), F.col("r.annual")).cast("bigint").alias("annual_minor"),
        use(F.lit("tenant"), F.lit("rateTable")).alias("source"),
    )
