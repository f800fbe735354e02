"""Queries of rules over rows: all risk signals, vendor names, workflows, versions, corrections, cascades, split payments, boxes, fields, joins and orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from duespark.functions import text as txt
from duespark.functions.dates import days_between, fiscal_year
from duespark.operators import changes, documents, extraction, reconcile, risk, suggest, tax, workflow
from duespark.plans.adapt import ctes, entries, invoices, vendors
from duespark.plans.overview import _fy
from duespark.sources.tables import table

AS_OF = "1998-01-01"
PANS = [None, "bad", "ABCPD1234E", "ABCCD1234E", "AAACA1111A"]
GSTINS = [None, "29ABCPD1234E1Z5", "27ABCCD1234E1Z5"]
IRNS = [None, "", "zz", "ab" * 32]
DOMAINS = [None, "gmail.com", "a.com", "b.com", "B.com"]


def _of(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def row_signals(spark, d):
    """TAX-07: every invoice's list of signals, of all 24 codes."""
    k, total = F.col("invoice_id"), F.col("total_minor")
    as_of = F.lit(f"{AS_OF} 00:00:00").cast("timestamp")
    pan, gstin = _of(PANS, k), _of(GSTINS, k)
    level = risk.pan_level(pan, gstin)
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    known = F.when(k % 3 == 0, texts()).when(k % 3 == 1, texts("A.com")).otherwise(texts("gmail.com"))
    history = F.when(k % 4 == 0, texts()).when(k % 4 == 1, texts("h0", "h1")).otherwise(texts("h2"))
    before = (k % 5) * 10_000_000
    tds = tax.threshold_tax(total, before, F.lit(0), F.lit(100), F.lit(9_000_000), F.when(k % 2 == 0, 30_000_000).otherwise(0))["state"]
    copies = F.count(F.lit(1)).over(Window.partitionBy("vendor_id", "number_key"))
    paid = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("invoice_id")).filter("invoice_id % 3 = 0").distinct().withColumn("paid", F.lit(True))
    i = invoices(spark, d).withColumn("number_key", F.concat(F.lit("N"), (k % 211).cast("string"))).withColumn("copies", F.when(F.col("vendor_id").isNotNull(), copies))
    i = i.join(paid, "invoice_id", "left")
    conditions = {
        "PAN_FORMAT_INVALID": level == "invalid", "PAN_GSTIN_MISMATCH": level == "mismatch", "TDS_NO_PAN_PENALTY_RATE": level.isin("missing", "invalid"), "TDS_SECTION_AMBIGUOUS": k % 13 == 0,
        "TDS_BELOW_THRESHOLD": tds == "BELOW_SINGLE", "TDS_BELOW_ANNUAL_THRESHOLD": tds == "BELOW_ANNUAL", "TDS_ANNUAL_THRESHOLD_CROSSED": tds == "CROSSED", "TDS_BACKDATED_THRESHOLD_ADJUSTMENT": fiscal_year(F.col("created_at")) != fiscal_year(as_of),
        "TDS_SECTION_197_APPLIED": k % 10 == 0, "TDS_CATCHUP_RATE_VARIANCE": (tds == "CROSSED") & (k % 3 == 0), "MISSING_MANDATORY_FIELDS": risk.missing_fields(vendor=F.col("vendor_id"), total=F.when(total > 0, total)).isNotNull(),
        "DUPLICATE_INVOICE_NUMBER": F.col("copies") > 1, "VENDOR_BANK_CHANGED": risk.bank_changed(_of(["h0", "h1", "h2"], k), history), "BANK_PAYMENT_VERIFIED": F.col("paid"),
    }
    amounts = [risk.above_expected(total, F.lit(20_000_000)), risk.below_minimum(total, F.lit(1_000_000)), risk.due_too_far(F.col("due_at"), as_of, 60)]
    codes = [risk.irn_signal(_of(IRNS, k), gstin, total, 5_000_000), F.when(k % 4 == 0, risk.msme_state(F.col("created_at"), as_of)), risk.sender_signal(_of(DOMAINS, k), known)]
    found = i.select("invoice_id", risk.row_signals(amounts, codes, conditions).alias("s"))
    listed = F.array_join(F.array_sort(F.transform("s", lambda x: F.concat_ws("/", x["code"], x["category"], x["severity"], x["penalty"].cast("string")))), ",")
    return found.select("invoice_id", F.size("s").cast("bigint").alias("n"), listed.alias("signals"), risk.penalty_sum(F.col("s"), 30).alias("penalty"), risk.max_severity(F.col("s")).alias("severity"))


def vendor_scores(spark, d):
    """REC-02, STR-06: a vendor's name in a description as it is, at its beginning, with letters left out, or not at all."""
    k, name = F.col("vendor_id"), F.col("name")
    said = F.when(k % 5 == 0, F.concat(F.lit("payment "), name, F.lit(" ok"))).when(k % 5 == 1, F.substring(name, F.lit(1), (2 + k % 7).cast("int"))).when(k % 5 == 2, F.regexp_replace(name, "(..).", "$1")).when(k % 5 == 3, F.reverse(name)).otherwise("")
    return vendors(spark, d).select("vendor_id", reconcile.vendor_score(said, F.when(k % 11 != 0, name)).cast("bigint").alias("score"))


def workflow_findings(spark, d):
    """FLT-22: findings of each workflow step against the holders of its role."""
    c = table(spark, d, "customer")
    roles = c.filter("c_custkey % 3 = 0").select((F.col("c_nationkey") % 7).alias("tenant_id"), F.col("c_mktsegment").alias("role"))
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    role = _of(["BUILDING", "AUTOMOBILE", "MACHINERY", "NOBODY"], k)
    steps = o.select(k.alias("workflow_id"), (k % 9).cast("int").alias("tenant_id"), (k % 3).alias("step_no"), F.when(k % 2 == 0, "role").otherwise("users").alias("kind"), role.alias("role"), F.when(k % 4 == 1, F.array(F.lit("u"))).when(k % 4 == 3, F.array(F.lit("u"), F.lit("v"))).alias("users"), (k % 5).alias("needed"))
    return workflow.step_findings(steps, roles).select("workflow_id", "step_no", F.array_join("findings", ",").alias("findings"))


def findings_totals(spark, d):
    """AG-33: steps with findings, and findings of all kinds."""
    return workflow_findings(spark, d).agg(F.count_if(F.col("findings") != "").alias("steps"), F.sum(F.when(F.col("findings") != "", F.size(F.split("findings", ","))).otherwise(0)).cast("bigint").alias("findings"))


def rate_versions(spark, d):
    """TAX-10, TAX-09: rates of sections, of which every third changes."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    at = lambda days: F.timestamp_micros((F.lit(9000) + days) * F.lit(86_400_000_000))
    rates = p.select(F.concat(F.lit("S"), k.cast("string")).alias("section"), (k % 40 * 25).cast("bigint").alias("bps"), at(k % 100).alias("valid_from"), F.when(k % 4 == 0, at(k % 100 + 50)).alias("valid_to"))
    new = p.filter(k % 3 == 0).select(F.concat(F.lit("S"), k.cast("string")).alias("section"), (k % 40 * 25 + 5).cast("bigint").alias("bps"), at(k % 100 + 200).alias("valid_from"))
    return changes.new_rate_version(rates, new).select("section", "bps", F.unix_date(F.col("valid_from").cast("date")).cast("bigint").alias("from_day"), F.unix_date(F.col("valid_to").cast("date")).cast("bigint").alias("to_day"))


def corrections(spark, d):
    """SET-06: corrections of fields, known ones and those that come in, the three newest of each group."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select((F.col("o_custkey") % 50).alias("group"), F.concat(F.lit("f"), (k % 8).cast("string")).alias("field"), F.concat(F.lit("v"), k.cast("string")).alias("value"), F.lit(1).cast("bigint").alias("n"), k.alias("seen"), (k % 2 == 0).alias("known"))
    side = lambda known: rows.filter(F.col("known") == known).groupBy("group", "field").agg(F.max_by("value", "seen").alias("value"), F.sum("n").alias("n"), F.max("seen").alias("seen"))
    return suggest.corrections(side(True), side(False), 3).select("group", "field", "value", "n", "seen")


def code_cascade(spark, d):
    """GLS-01, GLS-04: a code by the vendor's history, else by its category, else by its name, else none."""
    used = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("vendor_id"), F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("uses"))
    best = used.groupBy("vendor_id").agg(F.max_by(F.struct("code", "uses"), F.struct("uses", "code")).alias("h")).filter("h.uses >= 3")
    v = vendors(spark, d).join(best, "vendor_id", "left")
    source = lambda code, confidence, name: F.struct(code.alias("code"), confidence.cast("bigint").alias("confidence"), F.lit(name).alias("source"))
    picked = suggest.cascade(source(F.col("h.code"), F.least(F.lit(100), 15 * F.col("h.uses")), "history"), source(F.when(F.col("category") != "FURNITURE", F.col("category")), F.lit(70), "category"), source(F.when(F.col("name").rlike("[02468]$"), F.substring("name", -3, 3)), F.lit(40), "description"))
    return v.select("vendor_id", picked.alias("p")).select("vendor_id", "p.code", "p.confidence", "p.source")


def split_payments(spark, d):
    """E-01: payments of some of a vendor's invoices at once, found among its open ones."""
    i = invoices(spark, d).filter("vendor_id IS NOT NULL").select("vendor_id", "invoice_id", F.col("total_minor").alias("net_minor"))
    paid = i.filter("invoice_id % 4 = 0").groupBy("vendor_id").agg(F.sum("net_minor").alias("s"), F.min("invoice_id").alias("txn_id"))
    pairs = paid.select("vendor_id", "txn_id", (F.col("s") + F.col("txn_id") % 3 * 70).cast("bigint").alias("debit_minor")).join(i, "vendor_id")
    return reconcile.split_matches(pairs.select("txn_id", "debit_minor", "invoice_id", "net_minor")).select("txn_id", F.array_join("ids", ",").alias("invoices"), F.col("sum").alias("sum_minor"))


def field_rules(spark, d):
    """TXT-10, TXT-11, TXT-12, TXT-17, TXT-18, MTH-11, TXT-04, STR-15."""
    e, k = entries(spark, d), F.col("invoice_id") * 10 + F.col("line")
    base = F.col("base_minor").cast("double")
    near = F.array(base * 10, F.when(k % 2 == 0, base * 1.01), base * 3)
    raw = F.when(k % 3 == 0, F.concat(F.lit(" 29abcpd"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("e1z5 "))).when(k % 3 == 1, "29ABCPD")
    names = F.array(F.lit("none"), F.concat(F.lit("A"), (k % 7).cast("string")), F.repeat(F.lit("7"), (k % 5).cast("int")), F.lit("no number"))
    box = F.array((k % 90 - 5).cast("double"), F.lit(10.0), (k % 90 + 30).cast("double"), F.when(k % 8 == 0, 10.0).otherwise(250.0))
    clamped = extraction.clamp_box(box, F.lit(100.0), F.lit(200.0))
    said = _of(["GSTIN 29", "pay usd 5", "EUR 5", "Rs. 50", "₹5", "5 £", "nothing"], k)
    return e.select(
        "invoice_id", "line", documents.scale_correction(F.col("base_minor"), F.array_compact(near)).alias("corrected"), extraction.tax_sum(F.when(k % 2 == 0, F.col("tax_minor")), F.when(k % 3 == 0, F.col("line")), F.lit(None).cast("bigint")).alias("tax_sum"),
        extraction.normal_gstin(raw).alias("gstin"), extraction.positive_whole(F.when(k % 4 == 0, base / 4).otherwise(base - 5_000_000)).alias("whole"), documents.fill(F.col("line"), F.when(k % 5 == 0, F.col("tax_minor"))).alias("filled"),
        extraction.pick_number(names).alias("number"), F.array_join(F.transform(clamped, lambda x: F.floor(x * 1_000_000 + 0.5).cast("bigint").cast("string")), ",").alias("box"), documents.currency(said).alias("currency"), txt.low_quality_token(F.concat(F.lit("a"), F.repeat(F.lit("-"), (k % 4).cast("int")))).alias("low"),
    )


def low_tokens(spark, d):
    """CNF-03: the share of low-quality tokens of each document, in thousandths."""
    t = table(spark, d, "documents")
    return t.select("doc_id", documents.quality_metrics(F.col("text"))["low_permille"].alias("low_permille"))


def _boxes(spark, d, shift):
    li, k = table(spark, d, "lineitem"), F.col("l_partkey")
    x, y = k % 40 + shift, (k * 7) % 30
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint")
    return li.select(F.col("l_orderkey").alias("page_id"), place.alias("box_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 12 + F.col("l_linenumber")).cast("double").alias("x2"), (y + 10 + F.col("l_linenumber") % 3).cast("double").alias("y2"))


def overlaps(spark, d):
    """JN-21: boxes of order lines assigned to shifted ones."""
    found = extraction.overlap_assignment(_boxes(spark, d, 0), _boxes(spark, d, 4))
    return found.select("page_id", "box_id", "target_id", F.floor(F.col("overlap") * 1_000_000 + 0.5).cast("bigint").alias("overlap_ppm"))


def row_boxes(spark, d):
    """TXT-30, TXT-29: each order's box around its lines' boxes, and the bands of lines that share a box."""
    boxes = _boxes(spark, d, 0)
    whole = extraction.union_box(boxes.withColumn("confidence", (F.col("box_id") % 4) / 4), ["page_id"]).select("page_id", *(F.col(c).cast("bigint").alias(f"all_{c}") for c in ("x1", "y1", "x2", "y2")), F.floor(F.col("confidence") * 1_000_000 + 0.5).cast("bigint").alias("confidence_ppm"))
    shared = boxes.select("page_id", F.col("box_id").alias("item_no"), F.floor(F.col("y1") / 10).cast("double").alias("y1"), (F.floor(F.col("y1") / 10) + 6).cast("double").alias("y2"))
    bands = extraction.split_bands(shared)
    ppm = lambda c: F.floor(F.col(c) * 1_000_000 + 0.5).cast("bigint").alias(c)
    return bands.select("page_id", "item_no", ppm("y1"), ppm("y2")).join(whole, "page_id")


def assigned_mailboxes(spark, d):
    """JN-05: assignments with their integrations, if there are any, in the order of the tenant's e-mail addresses; those without one come first."""
    boxes = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("integration_id"), F.lower(F.concat(F.translate("s_name", "#", "."), F.lit("@x.example"))).alias("email"))
    assigned = vendors(spark, d).select("tenant_id", "vendor_id", (F.col("vendor_id") % 13).alias("integration_id"))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.col("email").asc_nulls_first(), "vendor_id"))
    return assigned.join(boxes, "integration_id", "left").select("vendor_id", "email", place.alias("place"))


def matches_first(spark, d):
    """SRT-06: a tenant's vendors, those of a given category first, then by name."""
    v = vendors(spark, d)
    hit = (F.col("category") == "MACHINERY") & (F.col("region") == "ASIA")
    return v.select("vendor_id", hit.alias("hit"), F.row_number().over(Window.partitionBy("tenant_id").orderBy(hit.desc(), "name", "vendor_id")).alias("place"))


def invoice_age(spark, d):
    """DT-04: whole days between an invoice and its approval, as RSK-07 counts them."""
    return invoices(spark, d).select("invoice_id", F.floor(days_between(F.col("approved_at"), F.col("created_at"))).cast("bigint").alias("days"))


QUERIES = {
    "tax07_row_signals": row_signals,
    "rec02_str06_vendor_scores": vendor_scores,
    "flt22_workflow_findings": workflow_findings,
    "ag33_findings_totals": findings_totals,
    "tax10_rate_versions": rate_versions,
    "set06_corrections": corrections,
    "gls01_gls04_code_cascade": code_cascade,
    "e01_split_payments": split_payments,
    "txt10_txt18_field_rules": field_rules,
    "cnf03_low_tokens": low_tokens,
    "jn21_overlaps": overlaps,
    "txt29_txt30_row_boxes": row_boxes,
    "jn05_assigned_mailboxes": assigned_mailboxes,
    "srt06_matches_first": matches_first,
    "dt04_invoice_age": invoice_age,
}


def _pick(key, values):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"


_state = "CASE WHEN annual > 0 AND before + total_minor <= annual THEN 'BELOW_ANNUAL' WHEN annual > 0 AND before <= annual THEN 'CROSSED' WHEN total_minor < 9000000 THEN 'BELOW_SINGLE' ELSE 'ABOVE' END"
_coded = {c: f"'{c}/{g}/{s}/{p}'" for c, (g, s, p) in risk.SIGNALS.items()}
_when = lambda c, holds: f"CASE WHEN {holds} THEN {_coded[c]} END"
_lists = {
    "PAN_FORMAT_INVALID": "level = 'invalid'", "PAN_GSTIN_MISMATCH": "level = 'mismatch'", "TDS_NO_PAN_PENALTY_RATE": "level IN ('missing', 'invalid')", "TDS_SECTION_AMBIGUOUS": "k % 13 = 0", "TDS_BELOW_THRESHOLD": "tds = 'BELOW_SINGLE'", "TDS_BELOW_ANNUAL_THRESHOLD": "tds = 'BELOW_ANNUAL'",
    "TDS_ANNUAL_THRESHOLD_CROSSED": "tds = 'CROSSED'", "TDS_BACKDATED_THRESHOLD_ADJUSTMENT": "fy <> '1997-98'", "TDS_SECTION_197_APPLIED": "k % 10 = 0", "TDS_CATCHUP_RATE_VARIANCE": "tds = 'CROSSED' AND k % 3 = 0", "TOTAL_AMOUNT_BELOW_MINIMUM": "total_minor > 0 AND total_minor < 1000000",
    "MISSING_MANDATORY_FIELDS": "vendor_id IS NULL OR total_minor <= 0", "DUPLICATE_INVOICE_NUMBER": "vendor_id IS NOT NULL AND copies > 1", "VENDOR_BANK_CHANGED": "k % 4 > 0 AND CASE WHEN k % 4 = 1 THEN k % 3 = 2 ELSE k % 3 <> 2 END", "IRN_MISSING": "coalesce(irn, '') = '' AND gstin IS NOT NULL AND total_minor > 5000000",
    "IRN_FORMAT_INVALID": "irn = 'zz'", "MSME_PAYMENT_OVERDUE": "k % 4 = 0 AND age > 45", "MSME_PAYMENT_DUE_SOON": "k % 4 = 0 AND age > 30 AND age <= 45", "SENDER_FIRST_TIME": "domain IS NOT NULL AND k % 3 = 0", "SENDER_FREEMAIL": "domain = 'gmail.com' AND k % 3 = 1",
    "SENDER_DOMAIN_MISMATCH": "(k % 3 = 1 AND domain IN ('b.com', 'B.com')) OR (k % 3 = 2 AND domain <> 'gmail.com')", "BANK_PAYMENT_VERIFIED": "k % 3 = 0 AND paid IS NOT NULL",
}
_sql_lists = ", ".join(_when(c, h) for c, h in _lists.items())
_penalty = " + ".join(f"CASE WHEN {h} THEN {risk.SIGNALS[c][2]} ELSE 0 END" for c, h in _lists.items() if risk.SIGNALS[c][2])
_severe = lambda level: " OR ".join(f"({h})" for c, h in _lists.items() if risk.SIGNALS[c][1] == level)
_above = "least(30, CAST(floor(15 + 25 * ((total_minor - 20000000) / 20000000) + 0.5) AS BIGINT))"
_far = "least(20, CAST(floor(8 + (ahead - 60) / 4.0 + 0.5) AS BIGINT))"
_key = "(invoice_id * 10 + line)"
_compact = lambda c: f"regexp_replace(lower({c}), '\\s+', '', 'g')"
_long = lambda c: f"list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(w) > 2)"
_BOXES = lambda shift: f"SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_id, CAST(l_partkey % 40 + {shift} AS DOUBLE) AS x1, CAST(l_partkey * 7 % 30 AS DOUBLE) AS y1, CAST(l_partkey % 40 + {shift} + 12 + l_linenumber AS DOUBLE) AS x2, CAST(l_partkey * 7 % 30 + 10 + l_linenumber % 3 AS DOUBLE) AS y2 FROM lineitem"
_findings = f"""f AS (SELECT s.workflow_id, s.step_no, CASE WHEN kind = 'role' AND holders = 0 THEN 'no approver' WHEN kind = 'role' AND holders < needed THEN 'too few approvers' WHEN kind = 'users' AND users < needed THEN 'too few users' ELSE '' END AS findings FROM (
  SELECT o_orderkey AS workflow_id, o_orderkey % 3 AS step_no, CASE WHEN o_orderkey % 2 = 0 THEN 'role' ELSE 'users' END AS kind, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS users, o_orderkey % 5 AS needed, coalesce(h.n, 0) AS holders
  FROM orders LEFT JOIN (SELECT c_nationkey % 7 AS t, c_mktsegment AS r, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2) h ON h.t = o_orderkey % 9 AND h.r = {_pick('o_orderkey', ['BUILDING', 'AUTOMOBILE', 'MACHINERY', 'NOBODY'])}) s)"""
ORACLES = {
    "tax07_row_signals": f"""{ctes('invoices')}, a AS (SELECT *, invoice_id AS k, {_pick('invoice_id', PANS)} AS pan, {_pick('invoice_id', GSTINS)} AS gstin, {_pick('invoice_id', IRNS)} AS irn, {_pick('invoice_id', DOMAINS)} AS domain, invoice_id % 5 * 10000000 AS before, CASE WHEN invoice_id % 2 = 0 THEN 30000000 ELSE 0 END AS annual,
    datediff('day', TIMESTAMP '{AS_OF}', due_at) AS ahead, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000.0) AS age, count(*) OVER (PARTITION BY vendor_id, invoice_id % 211) AS copies, {_fy.replace('invoice_date', 'created_at')} AS fy FROM invoices),
  b AS (SELECT a.*, p.o AS paid, CASE WHEN pan IS NULL THEN 'missing' WHEN NOT regexp_matches(pan, '{txt.PAN}') THEN 'invalid' WHEN gstin IS NOT NULL AND substr(gstin, 3, 10) <> pan THEN 'mismatch' WHEN gstin IS NOT NULL THEN 'L2' ELSE 'L1' END AS level, {_state} AS tds FROM a LEFT JOIN (SELECT DISTINCT l_orderkey AS o FROM lineitem) p ON p.o = a.invoice_id),
  c AS (SELECT *, list_filter([{_sql_lists}, CASE WHEN total_minor > 20000000 THEN 'TOTAL_AMOUNT_ABOVE_EXPECTED/financial/warning/' || {_above} END, CASE WHEN ahead > 60 THEN 'DUE_DATE_TOO_FAR/data-quality/warning/' || {_far} END], lambda x: x IS NOT NULL) AS l FROM b)
  SELECT invoice_id, len(l) AS n, array_to_string(list_sort(l), ',') AS signals, least(30, {_penalty} + CASE WHEN total_minor > 20000000 THEN {_above} ELSE 0 END + CASE WHEN ahead > 60 THEN {_far} ELSE 0 END) AS penalty,
    CASE WHEN {_severe('critical')} THEN 'critical' WHEN {_severe('warning')} OR total_minor > 20000000 OR ahead > 60 THEN 'warning' WHEN {_severe('info')} THEN 'info' END AS severity FROM c""",
    "rec02_str06_vendor_scores": f"""WITH RECURSIVE {ctes('vendors').removeprefix('WITH ')}, b AS (SELECT vendor_id, CASE WHEN vendor_id % 11 <> 0 THEN name END AS name, CASE vendor_id % 5 WHEN 0 THEN 'payment ' || name || ' ok' WHEN 1 THEN substring(name, 1, 2 + vendor_id % 7) WHEN 2 THEN regexp_replace(name, '(..).', '\\1', 'g') WHEN 3 THEN reverse(name) ELSE '' END AS said FROM vendors),
  x AS (SELECT *, {_compact('said')} AS p, {_compact('name')} AS q FROM b), y AS (SELECT *, CASE WHEN length(p) <= length(q) THEN p ELSE q END AS s, CASE WHEN length(p) <= length(q) THEN q ELSE p END AS l FROM x),
  walk AS (SELECT vendor_id, s, l, 0 AS i, 0 AS reached, 0 AS hits FROM y WHERE s IS NOT NULL UNION ALL SELECT vendor_id, s, l, i + 1, CASE WHEN reached >= 0 AND strpos(substring(l, reached + 1), s[i + 1]) > 0 THEN reached + strpos(substring(l, reached + 1), s[i + 1]) ELSE -1 END, hits + CASE WHEN reached >= 0 AND strpos(substring(l, reached + 1), s[i + 1]) > 0 THEN 1 ELSE 0 END FROM walk WHERE i < length(s)),
  hits AS (SELECT vendor_id, hits FROM walk WHERE i = length(s))
  SELECT y.vendor_id, CAST(CASE WHEN name IS NULL THEN 0 WHEN len(list_intersect({_long('said')}, {_long('name')})) >= 1 THEN 20 WHEN length(p) >= 3 AND length(q) >= 3 AND (starts_with(p, q) OR starts_with(q, p)) THEN 20 WHEN length(s) > 0 AND hits >= length(s) * 0.8 THEN 15 ELSE 0 END AS BIGINT) AS score FROM y LEFT JOIN hits h ON h.vendor_id = y.vendor_id""",
    "flt22_workflow_findings": f"WITH {_findings} SELECT workflow_id, step_no, findings FROM f",
    "ag33_findings_totals": f"WITH {_findings} SELECT count(*) FILTER (findings <> '') AS steps, count(*) FILTER (findings <> '') AS findings FROM f",
    "tax10_rate_versions": """SELECT 'S' || p_partkey AS section, CAST(p_partkey % 40 * 25 AS BIGINT) AS bps, CAST(9000 + p_partkey % 100 AS BIGINT) AS from_day, CAST(CASE WHEN p_partkey % 4 = 0 THEN 9050 + p_partkey % 100 WHEN p_partkey % 3 = 0 THEN 9200 + p_partkey % 100 END AS BIGINT) AS to_day FROM part
  UNION ALL SELECT 'S' || p_partkey, CAST(p_partkey % 40 * 25 + 5 AS BIGINT), CAST(9200 + p_partkey % 100 AS BIGINT), NULL FROM part WHERE p_partkey % 3 = 0""",
    "set06_corrections": """WITH m AS (SELECT o_custkey % 50 AS "group", 'f' || o_orderkey % 8 AS field, count(*) AS n, max(o_orderkey) AS seen FROM orders GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY seen DESC, field) AS k FROM m) SELECT "group", field, 'v' || seen AS value, n, seen FROM r WHERE k <= 3""",
    "gls01_gls04_code_cascade": f"""{ctes('vendors')}, u AS (SELECT o_custkey, o_orderpriority AS code, count(*) AS uses FROM orders GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY uses DESC, code DESC) AS k FROM u),
  b AS (SELECT v.*, CASE WHEN uses >= 3 THEN code END AS used, uses FROM vendors v LEFT JOIN h ON h.o_custkey = v.vendor_id AND h.k = 1)
  SELECT vendor_id, CASE WHEN used IS NOT NULL THEN used WHEN category <> 'FURNITURE' THEN category WHEN regexp_matches(name, '[02468]$') THEN name[-3:] END AS code, CAST(CASE WHEN used IS NOT NULL THEN least(100, 15 * uses) WHEN category <> 'FURNITURE' THEN 70 WHEN regexp_matches(name, '[02468]$') THEN 40 END AS BIGINT) AS confidence,
    CASE WHEN used IS NOT NULL THEN 'history' WHEN category <> 'FURNITURE' THEN 'category' WHEN regexp_matches(name, '[02468]$') THEN 'description' END AS source FROM b""",
    "e01_split_payments": f"""{ctes('invoices')}, i AS (SELECT vendor_id, invoice_id, total_minor AS net FROM invoices WHERE vendor_id IS NOT NULL),
  paid AS (SELECT vendor_id, min(invoice_id) AS txn_id, CAST(sum(net) + min(invoice_id) % 3 * 70 AS BIGINT) AS debit FROM i WHERE invoice_id % 4 = 0 GROUP BY 1),
  ran AS (SELECT p.txn_id, p.debit, i.invoice_id, i.net, sum(i.net) OVER (PARTITION BY p.txn_id ORDER BY i.net DESC, i.invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - i.net AS before FROM paid p JOIN i ON i.vendor_id = p.vendor_id AND i.net <= p.debit + 100),
  near AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(debit - net), invoice_id) AS k FROM ran WHERE before <= debit), ten AS (SELECT txn_id, debit, list(invoice_id ORDER BY invoice_id) AS ids, list(net ORDER BY invoice_id) AS nets FROM near WHERE k <= 10 GROUP BY 1, 2),
  subs AS (SELECT txn_id, debit, ids, nets, unnest(range(1, CAST(power(2, len(ids)) AS BIGINT))) AS m FROM ten),
  sums AS (SELECT txn_id, debit, list_filter(ids, lambda x, k: (m >> (k - 1)) & 1 = 1) AS ids, CAST(list_sum(list_filter(nets, lambda x, k: (m >> (k - 1)) & 1 = 1)) AS BIGINT) AS s FROM subs),
  best AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY len(ids), abs(debit - s), ids) AS k FROM sums WHERE abs(debit - s) <= 100)
  SELECT txn_id, array_to_string(ids, ',') AS invoices, s AS sum_minor FROM best WHERE k = 1""",
    "txt10_txt18_field_rules": f"""{ctes('entries')}, e AS (SELECT *, {_key} AS k, CAST(base_minor AS DOUBLE) AS base FROM entries)
  SELECT invoice_id, line, CASE WHEN k % 2 = 0 THEN base * 1.01::DOUBLE ELSE base * 10 END AS corrected, CAST(CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN tax_minor ELSE 0 END + CASE WHEN k % 3 = 0 THEN line ELSE 0 END END AS BIGINT) AS tax_sum,
    CASE WHEN k % 3 = 0 THEN '29ABCPD' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || 'E1Z5' END AS gstin, CAST(CASE WHEN k % 4 = 0 THEN CASE WHEN base_minor % 4 = 0 AND base > 0 THEN base_minor // 4 END WHEN base_minor > 5000000 THEN base_minor - 5000000 END AS BIGINT) AS whole, CASE WHEN k % 5 = 0 THEN tax_minor ELSE line END AS filled,
    CASE WHEN k % 5 > 2 THEN repeat('7', CAST(k % 5 AS INTEGER)) WHEN k % 5 = 2 THEN least('77', 'A' || k % 7) ELSE 'A' || k % 7 END AS number,
    CASE WHEN k % 8 <> 0 THEN array_to_string([CAST(greatest(0, k % 90 - 5) * 10000 AS BIGINT), 50000, CAST(least(100, k % 90 + 30) * 10000 AS BIGINT), 1000000], ',') END AS box, CASE k % 7 WHEN 0 THEN 'INR' WHEN 2 THEN 'EUR' WHEN 3 THEN 'INR' WHEN 4 THEN 'INR' WHEN 5 THEN 'GBP' END AS currency, k % 4 <> 1 AS low FROM e""",
    "cnf03_low_tokens": """WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
  n AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: length(x) < 2 OR length(regexp_replace(x, '[A-Za-z0-9]', '', 'g')) * 2 > length(x) OR regexp_matches(x, '(?:aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz|AAA|BBB|CCC|DDD|EEE|FFF|GGG|HHH|III|JJJ|KKK|LLL|MMM|NNN|OOO|PPP|QQQ|RRR|SSS|TTT|UUU|VVV|WWW|XXX|YYY|ZZZ)'))) AS low FROM t)
  SELECT doc_id, CAST(floor(low * 1000 / greatest(n, 1) + 0.5) AS BIGINT) AS low_permille FROM n""",
    "jn21_overlaps": f"""WITH RECURSIVE a AS ({_BOXES(0)}), b AS ({_BOXES(4)}), n AS (SELECT page_id, max(box_id) AS n FROM a GROUP BY 1),
  o AS (SELECT a.page_id, a.box_id, b.box_id AS target, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS share FROM a JOIN b ON a.page_id = b.page_id WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)),
  good AS (SELECT page_id, box_id, list({{'neg': -share, 'target': target}} ORDER BY share DESC, target) AS l FROM o GROUP BY 1, 2),
  walk AS (SELECT page_id, n, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS target, CAST(NULL AS DOUBLE) AS share FROM n
    UNION ALL SELECT page_id, n, i, CASE WHEN share >= 0.55 THEN list_append(used, target) ELSE used END, CASE WHEN share >= 0.55 THEN target END, share FROM (
      SELECT w.page_id, w.n, w.i + 1 AS i, w.used, list_filter(g.l, lambda x: NOT list_contains(w.used, x.target))[1].target AS target, -list_filter(g.l, lambda x: NOT list_contains(w.used, x.target))[1].neg AS share FROM walk w LEFT JOIN good g ON g.page_id = w.page_id AND g.box_id = w.i + 1 WHERE w.i < w.n))
  SELECT page_id, i AS box_id, target AS target_id, CAST(floor(share * 1000000 + 0.5) AS BIGINT) AS overlap_ppm FROM walk WHERE target IS NOT NULL""",
    "txt29_txt30_row_boxes": f"""WITH a AS ({_BOXES(0)}), w AS (SELECT page_id, CAST(min(x1) AS BIGINT) AS all_x1, CAST(min(y1) AS BIGINT) AS all_y1, CAST(max(x2) AS BIGINT) AS all_x2, CAST(max(y2) AS BIGINT) AS all_y2, CAST(floor(avg(box_id % 4 / 4) * 1000000 + 0.5) AS BIGINT) AS confidence_ppm FROM a GROUP BY 1),
  s AS (SELECT page_id, box_id, floor(y1 / 10) AS top FROM a), b AS (SELECT *, 6 / count(*) OVER (PARTITION BY page_id, top) AS h, row_number() OVER (PARTITION BY page_id, top ORDER BY box_id) - 1 AS k FROM s)
  SELECT b.page_id, b.box_id AS item_no, CAST(floor((top + h * k) * 1000000 + 0.5) AS BIGINT) AS y1, CAST(floor((top + h * (k + 1)) * 1000000 + 0.5) AS BIGINT) AS y2, w.* EXCLUDE (page_id) FROM b JOIN w ON w.page_id = b.page_id""",
    "jn05_assigned_mailboxes": f"""{ctes('vendors')}, m AS (SELECT s_suppkey, lower(replace(s_name, '#', '.') || '@x.example') AS email FROM supplier WHERE s_suppkey % 3 <> 0)
  SELECT vendor_id, email, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY email NULLS FIRST, vendor_id) AS INTEGER) AS place FROM vendors LEFT JOIN m ON s_suppkey = vendor_id % 13""",
    "srt06_matches_first": f"{ctes('vendors')} SELECT vendor_id, category = 'MACHINERY' AND region = 'ASIA' AS hit, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY CASE WHEN category = 'MACHINERY' AND region = 'ASIA' THEN 0 ELSE 1 END, name, vendor_id) AS INTEGER) AS place FROM vendors",
    "dt04_invoice_age": f"{ctes('invoices')} SELECT invoice_id, CAST(floor((epoch_us(approved_at) - epoch_us(created_at)) / 86400000000.0) AS BIGINT) AS days FROM invoices",
}
