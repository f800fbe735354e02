"""Queries of semi-structured extracts, file signatures, working days, quiet times and the order of labels."""

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from duespark.operators import extracts, projections, reconcile
from duespark.operators.calendar import calendar
from duespark.plans.accounting import _matchable, _n, _reconcile
from duespark.plans.adapt import ctes, transactions, vendors
from duespark.sources import signatures
from duespark.sources.tables import spread, table
from duespark.streaming import ingest

FIRST, LAST = date(1990, 1, 1), date(2010, 12, 31)


def _extract(key):
    """JSON of an extract for each event, in which a value's type depends on the event: texts, numbers, lists, nulls, numbers as texts."""
    k = key.cast("string")
    either = lambda n, *values: F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (key % n + 1).cast("int"))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    number = either(5, join('" INV-', k, ' "'), k, '""', "null", '["x"]')
    total = either(4, join(k, ".5"), join('"', k, '"'), "null", k)
    tax = either(3, join((key % 90).cast("string"), ".25"), "0", '"9"')
    day = either(4, '"2024-03-05"', '"nonsense"', "20240305", '"7 Feb 2024"')
    items = either(5, join('[{"description": " Pen ", "amount": ', k, ', "quantity": 2, "hsn_sac": 99, "cgst": 1.005}, {"description": 5, "amount": 3}, {"amount": 0}, {"amount": "7"}, null]'), "[]", "null", '{"amount": 1}', '[{"amount": 0.5, "rate": 0.25, "hsn_sac": " 84 "}]')
    box = either(4, join("[0.1, 0.2, ", (key % 3).cast("string"), '.5, "0.9"]'), "[1, 2, 3]", "[0.3, 0.2, 0.1, 0.9]", join('{"a": ', k, "}"))
    page = either(5, "2.5", '"3"', "0", '"x"', "true")
    sure = either(6, "0.123456", "77", "-1", "300", '" 0.5 "', "null")
    index = either(5, "4", '"6"', "null", "-2", "1.5")
    source = either(3, '" ocr "', "5", '""')
    return join(
        '{"fields": {"invoice_number": ', number, ', "total_amount": ', total, ', "cgst_amount": ', tax, ', "invoice_date": ', day, ', "line_items": ', items, ', "vendor_gstin": "29X"}, ',
        '"found": {"total": {"source": ', source, ', "page": ', page, ', "bbox": ', box, ', "block_index": ', index, ', "confidence": ', sure, '}, "other": [1], "plain": {"page": 1}}, ',
        '"sure": {"total": ', sure, ', "vendor": ', page, ', "list": [1]}, "blocks": {"total": ', index, ', "vendor": ', k, '}, ',
        '"items": [{"rowIndex": ', index, ', "row": {"bbox": ', box, '}}, {"index": 1, "fields": {"rate": {"bboxModel": [0, 0, 1, 1]}, "bad": 1}}, {"index": 2}, 7], ',
        '"kind": {"category": ', source, ', "classification": "goods", "gl_category": "Rent ", "tds": "194', (key % 3).cast("string"), '"}}',
    )


def _variant(spark, d):
    e = spread(table(spark, d, "events").select("event_id"), "event_id")
    return e.select("event_id", F.parse_json(_extract(F.col("event_id"))).alias("v"))


def extracted_records(spark, d):
    """TXT-24: records of extracts whose values have mixed types."""
    r = extracts.invoice_record(extracts.part(F.col("v"), "$.fields"))
    shown = _variant(spark, d).select("event_id", r.alias("r"))
    item = lambda x: F.concat_ws("/", x["description"], x["amountMinor"].cast("string"), F.coalesce(x["hsnSac"], F.lit("-")), F.coalesce(x["quantity"].cast("string"), F.lit("-")), F.coalesce(x["rate"].cast("string"), F.lit("-")), F.coalesce(x["cgstMinor"].cast("string"), F.lit("-")))
    return shown.select("event_id", F.col("r.invoiceNumber").alias("number"), F.col("r.totalAmountMinor").alias("total_minor"), F.col("r.cgstMinor").alias("cgst_minor"), F.col("r.totalTaxMinor").alias("tax_minor"), F.date_format("r.invoiceDate", "yyyy-MM-dd").alias("day"), F.col("r.vendorGstin").alias("gstin"), F.array_join(F.transform("r.lineItems", item), ";").alias("items"))


def normalised_provenance(spark, d):
    """TXT-27: provenance, confidences, blocks, line items and classification of extracts, wrong types dropped."""
    v, at = F.col("v"), extracts.part
    found = _variant(spark, d).select("event_id", extracts.field_provenance(at(v, "$.found")).alias("f"), extracts.field_confidence(at(v, "$.sure")).alias("c"), extracts.block_indices(at(v, "$.blocks")).alias("b"), extracts.item_provenance(at(v, "$.items")).alias("i"), extracts.classification(at(v, "$.kind"), F.when(F.col("event_id") % 4 == 0, " 206C ")).alias("k"))
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    total = of("f", "total")
    return found.select(
        "event_id", F.size("f").cast("bigint").alias("fields"), total["source"].alias("source"), total["page"].alias("page"), F.element_at(total["bbox"], 3).alias("x2"), total["blockIndex"].alias("block"), total["confidence"].alias("confidence"),
        F.size("c").cast("bigint").alias("confidences"), of("c", "vendor").alias("vendor_confidence"), F.array_join(F.array_sort(F.map_keys("b")), ",").alias("blocks"), of("b", "total").alias("total_block"),
        F.array_join(F.transform("i", lambda x: F.concat_ws("/", x["index"].cast("string"), F.when(x["row"].isNotNull(), "row"), F.array_join(F.map_keys(x["fields"]), "+"))), ";").alias("items"), F.col("k.category").alias("category"), F.col("k.glCategory").alias("gl"), F.col("k.tdsSection").alias("section"),
    )


def layout_signatures(spark, d):
    """STR-20: signatures of files made of the documents: PDFs with some pages, pictures of given sides, cut off and foreign ones."""
    t = table(spark, d, "documents")
    k, n = F.col("doc_id"), F.length("text").cast("bigint")
    text = F.col("text").cast("binary")
    four = lambda x, w: F.lpad(F.hex(x), w, "0")
    width, height = n % 3000 + 1, k % 700 + 1
    png = F.concat(F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(width, 8), four(height, 8))), text)
    pad = F.substring(text, 1, 200)
    jpeg = F.concat(F.unhex(F.concat(F.lit("FFD8FFE0"), four(F.octet_length(pad) + 2, 4))), pad, F.unhex(F.concat(F.lit("00FFC4000455AAFFC2001108"), four(height, 4), four(width, 4), F.lit("03"))), text)
    pdf = F.concat(F.lit("%PDF /Type /Pages "), F.repeat(F.lit("<< /Type\n/Page >> /Type/Page. "), (k % 4).cast("int")), F.col("text")).cast("binary")
    content = F.when(k % 5 == 0, pdf).when(k % 5 == 1, png).when(k % 5 == 2, jpeg).when(k % 5 == 3, F.substring(png, 1, 20)).otherwise(text)
    mime = F.element_at(F.array(*(F.lit(m) for m in ("application/pdf", "image/png", "image/jpeg", "image/png", "image/webp"))), (k % 5 + 1).cast("int"))
    files = t.select("doc_id", mime.alias("mime"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return signatures.layout_signatures(files).select("doc_id", "signature")


def _holidays(spark, d):
    """Every day on which an order of more than a given total came in is a holiday here."""
    return table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_orderdate").cast("date").alias("day"))


def working_day_reconcile(spark, d):
    """E-04: reconciliation whose date score counts working days."""
    return reconcile.reconcile(transactions(spark, d), _matchable(spark, d), calendar=calendar(spark, FIRST, LAST, _holidays(spark, d)))


def quiet_notices(spark, d):
    """WIN-12: errors of a user as notices, of which one a day goes out."""
    rows = table(spark, d, "events").filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ingest.quiet_for_a_day(rows, "user_id", "ts")


def _labels(spark, d):
    k = F.col("vendor_id")
    name = F.element_at(F.array(*(F.lit(n) for n in LABELS)), (k % len(LABELS) + 1).cast("int"))
    return vendors(spark, d).select("tenant_id", "vendor_id", name.alias("name"), F.lpad(k.cast("string"), 8, "0").alias("code"))


LABELS = ["Zebra", "énergie", "Energie", "zebra", "Énergie", "energie", "Ångström", "angstrom", "Angstrom", "éclair", "Eclair", "Oslo", "øre"]


def locale_ranks(spark, d):
    """SRT-07: the place of each vendor's label in the reader's order, and how many labels have the same letters."""
    rows = _labels(spark, d)
    of_tenant = Window.partitionBy("tenant_id")
    place = F.row_number().over(of_tenant.orderBy(projections.locale_order(F.col("name")), "code"))
    alike = rows.groupBy("tenant_id", projections.same_letters(F.col("name")).alias("letters")).agg(F.count(F.lit(1)).alias("alike"))
    ranked = rows.withColumns({"place": place, "letters": projections.same_letters(F.col("name"))})
    return ranked.join(alike, ["tenant_id", "letters"]).select("vendor_id", "place", "alike")


QUERIES = {
    "txt24_extracted_records": extracted_records,
    "txt27_provenance": normalised_provenance,
    "str20_layout_signatures": layout_signatures,
    "e04_working_day_reconcile": working_day_reconcile,
    "win12_quiet_notices": quiet_notices,
    "srt07_locale_ranks": locale_ranks,
}

_DAYS = """, holidays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 450000),
days AS (SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', INTERVAL 1 DAY)) AS day)),
cal AS (SELECT d.day, sum(CASE WHEN dayofweek(d.day) IN (0, 6) OR h.day IS NOT NULL THEN 0 ELSE 1 END) OVER (ORDER BY d.day) AS n FROM days d LEFT JOIN holidays h ON h.day = d.day)"""
_near = lambda c: f"coalesce(abs((SELECT n FROM cal WHERE day = CAST(paid_at AS DATE)) - (SELECT n FROM cal WHERE day = CAST({c} AS DATE))) <= 2, false)"
_at = _reconcile.index(",\nm AS (")
_greatest = _reconcile.index("  + greatest(")
_line_end = _reconcile.index(" AS score", _greatest)
_WORKING = _reconcile[:_at] + _DAYS + _reconcile[_at:_greatest] + f"  + CASE WHEN {_near('created_at')} OR {_near('approved_at')} OR {_near('due_at')} THEN 10 ELSE {_reconcile[_greatest + 4 : _line_end]} END" + _reconcile[_line_end:]
_ORDER = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(["angstrom", "Angstrom", "Ångström", "Eclair", "éclair", "energie", "Energie", "énergie", "Énergie", "øre", "Oslo", "zebra", "Zebra"]))
_e = "event_id"
_one = lambda n, *values: f"CASE {_e} % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v is not None) + " END"
_SURE = _one(6, "0.1235", "0.77", "0", "1", "0.5", "0")
ORACLES = {
    "txt24_extracted_records": f"""SELECT event_id, {_one(5, "'INV-' || event_id")} AS number, CAST({_one(4, "event_id * 100 + 50", None, None, "event_id * 100")} AS BIGINT) AS total_minor, CAST({_one(3, "event_id % 90 * 100 + 25", "0")} AS BIGINT) AS cgst_minor, CAST({_one(3, "event_id % 90 * 100 + 25")} AS BIGINT) AS tax_minor,
  {_one(4, "'2024-03-05'", None, None, "'2024-02-07'")} AS day, '29X' AS gstin, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id > 0 THEN 'Pen/' || event_id * 100 || '/-/2.0/-/100;' ELSE '' END || '/300/-/-/-/-' WHEN 4 THEN '/50/84/-/0.25/-' END AS items FROM events""",
    "txt27_provenance": f"""WITH e AS (SELECT event_id, event_id % 4 = 0 AS boxed FROM events),
  t AS (SELECT event_id, boxed, CASE WHEN boxed THEN {_one(3, "'ocr'")} END AS source, CASE WHEN boxed THEN {_one(5, "3", "3", None, None, "1")} END AS page, CASE WHEN boxed AND event_id % 3 + 0.5 > 0.1 THEN CAST(event_id % 3 AS DOUBLE) + 0.5 END AS x2, CASE WHEN boxed THEN {_one(5, "4", "6", "0")} END AS block, CASE WHEN boxed THEN CAST({_SURE} AS DOUBLE) END AS confidence FROM e)
  SELECT event_id, CASE WHEN boxed THEN CAST(1 AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS fields, source, CAST(page AS BIGINT) AS page, x2, CAST(block AS BIGINT) AS block, confidence,
    CAST(CASE WHEN event_id % 5 = 3 THEN 1 ELSE 2 END AS BIGINT) AS confidences, CAST({_one(5, "0.025", "0.03", "0", None, "1")} AS DOUBLE) AS vendor_confidence, CASE WHEN event_id % 5 IN (3, 4) THEN 'vendor' ELSE 'total,vendor' END AS blocks, CAST({_one(5, "4", "6", "0")} AS BIGINT) AS total_block,
    CASE WHEN boxed THEN CASE event_id % 5 WHEN 0 THEN '4/row;' WHEN 1 THEN '6/row;' WHEN 2 THEN '0/row;' ELSE '' END ELSE '' END || '1/rate' AS items,
    {_one(3, "'ocr'", "'goods'")} AS category, 'Rent' AS gl, CASE WHEN event_id % 4 = 0 THEN '206C' ELSE '194' || event_id % 3 END AS section FROM t""",
    "str20_layout_signatures": """WITH d AS (SELECT doc_id, strlen(text) AS bytes, length(text) % 3000 + 1 AS w, doc_id % 700 + 1 AS h FROM documents),
  f AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 18 + 30 * (doc_id % 4) + bytes WHEN 1 THEN 24 + bytes WHEN 2 THEN 6 + least(200, bytes) + 17 + bytes WHEN 3 THEN 20 ELSE bytes END AS n FROM d)
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' WHEN 4 THEN 'image/webp' ELSE 'image/png' END || '|size-bucket:' || CAST(greatest(1, ceil(n / 32768.0)) AS BIGINT)
    || CASE WHEN doc_id % 5 = 0 THEN '|pages:' || greatest(1, 2 * (doc_id % 4)) WHEN doc_id % 5 IN (1, 2) THEN '|w:' || w || '|h:' || h || '|ratio:' || CASE WHEN w / h < 0.8 THEN 'portrait' WHEN w / h > 1.3 THEN 'landscape' ELSE 'square-ish' END ELSE '' END AS signature FROM f""",
    "e04_working_day_reconcile": f"{_WORKING} SELECT * FROM f",
    "win12_quiet_notices": """WITH RECURSIVE r AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error'),
  sent AS (SELECT user_id, min(ts) AS ts FROM r GROUP BY user_id UNION ALL SELECT s.user_id, (SELECT min(r.ts) FROM r WHERE r.user_id = s.user_id AND r.ts > s.ts + INTERVAL 1 DAY) AS ts FROM sent s WHERE s.ts IS NOT NULL)
  SELECT user_id, ts FROM sent WHERE ts IS NOT NULL""",
    "srt07_locale_ranks": f"""{ctes('vendors')}, l AS (SELECT tenant_id, vendor_id, [{', '.join(f"'{n}'" for n in LABELS)}][vendor_id % {len(LABELS)} + 1] AS name FROM vendors)
  SELECT vendor_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY CASE name {_ORDER} END, vendor_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY tenant_id, lower(replace(strip_accents(name), 'ø', 'o'))) AS alike FROM l""",
}
