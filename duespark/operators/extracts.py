"""Records and provenance out of semi-structured extracts, as VARIANT: typed getters that drop what has the wrong type.

A getter reads a path of a variant and gives null unless the value there has the type asked for, so that "12" is no
number and 12 no string. Where a number may be written otherwise, as_number reads it as loosely as the extracts' own
consumers do: numbers, texts of numbers, true and false as 1 and 0, JSON's null and blank texts as 0; other texts,
lists and records are none.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from duespark.functions.dates import parse_date
from duespark.functions.money import bound, round_half_up

NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def part(v: Column, path: str) -> Column:
    """What a variant has at a path, as a variant; null where there is nothing (JSON's null is something)."""
    return F.try_variant_get(v, path, "variant")


def as_text(v: Column, path: str = "$") -> Column:
    """A text without blanks around; null if it is none, or empty."""
    def trimmed(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.regexp_replace(F.try_variant_get(x, "$", "string"), r"^\s+|\s+$", ""))

    return bound(bound(part(v, path), trimmed), lambda x: F.nullif(x, F.lit("")))


def as_double(v: Column, path: str = "$") -> Column:
    """A number; null if it is none."""
    return bound(part(v, path), lambda x: F.when(F.schema_of_variant(x).rlike(NUMERIC), F.try_variant_get(x, "$", "double")))


def as_number(v: Column, path: str = "$") -> Column:
    """A number, loosely read; null if there is nothing at the path or it says none."""
    def read(x: Column) -> Column:
        said = lambda text: F.when(text == "", 0.0).when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))
        text = F.trim(F.try_variant_get(x, "$", "string"))
        of = lambda kind: F.when(kind.rlike(NUMERIC), F.try_variant_get(x, "$", "double")).when(kind == "STRING", bound(text, said)).when(kind == "VOID", 0.0).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double"))
        return F.when(x.isNotNull(), bound(F.schema_of_variant(x), of))

    return bound(part(v, path), read)


def as_record(v: Column, path: str = "$") -> Column:
    """A record's entries as a map of variants; null if it is none."""
    return F.try_variant_get(v, path, "map<string,variant>")


def as_list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def confidence(x: Column) -> Column:
    """0..1 with four decimals of 0..1 or 0..100; below 0 is 0, above 100 is 1."""
    return F.when(x < 0, 0.0).when(x <= 1, F.round(x, 4)).when(x <= 100, F.round(x / 100, 4)).when(x.isNotNull(), 1.0)


# Names of an extract's texts and amounts, and the fields that they are.
TEXTS = {"invoice_number": "invoiceNumber", "vendor_name": "vendorName", "vendor_address": "vendorAddress", "currency": "currency", "vendor_pan": "vendorPan", "customer_name": "customerName", "customer_address": "customerAddress", "customer_gstin": "customerGstin", "vendor_gstin": "vendorGstin"}
DATES = {"invoice_date": "invoiceDate", "due_date": "dueDate"}
AMOUNTS = {"total_amount": "totalAmountMinor", "subtotal": "subtotalMinor", "cgst_amount": "cgstMinor", "sgst_amount": "sgstMinor", "igst_amount": "igstMinor", "cess_amount": "cessMinor"}
SOURCES = {**{k: v for k, v in TEXTS.items() if k != "currency"}, **DATES, "total_amount": "totalAmountMinor"}
ITEM_AMOUNTS = {"cgst": "cgstMinor", "sgst": "sgstMinor", "igst": "igstMinor"}


def invoice_record(v: Column) -> Column:
    """TXT-24: a struct of an extract's texts, days, amounts in minor units, their tax and line items; what is missing or of another type is null.

    The tax is the sum of its parts in the major unit, null if that isn't above zero. Items without a positive amount are left out.
    """
    minor = lambda x: round_half_up(x * 100)
    amounts = {k: as_double(v, f"$.{k}") for k in AMOUNTS}
    tax = sum((F.coalesce(amounts[k], F.lit(0.0)) for k in ("cgst_amount", "sgst_amount", "igst_amount", "cess_amount")), F.lit(0.0))
    number = lambda x, k: as_double(x, f"$.{k}")
    item = lambda x: F.struct(F.coalesce(as_text(x, "$.description"), F.lit("")).alias("description"), minor(number(x, "amount")).alias("amountMinor"), as_text(x, "$.hsn_sac").alias("hsnSac"), *(number(x, k).alias(a) for k, a in (("quantity", "quantity"), ("rate", "rate"), ("tax_rate", "taxRate"))), *(minor(number(x, k)).alias(a) for k, a in ITEM_AMOUNTS.items()))
    items = F.transform(F.filter(as_list(v, "$.line_items"), lambda x: F.coalesce(number(x, "amount") > 0, F.lit(False))), item)
    return F.struct(
        *(as_text(v, f"$.{k}").alias(a) for k, a in TEXTS.items()),
        *(parse_date(as_text(v, f"$.{k}")).alias(a) for k, a in DATES.items()),
        *(minor(amounts[k]).alias(a) for k, a in AMOUNTS.items()),
        F.when(tax > 0, minor(tax)).alias("totalTaxMinor"),
        F.when(F.size(items) > 0, items).alias("lineItems"),
    )


BOXES = ("bbox", "bboxNormalized", "bboxModel")


def whole_number(n: Column) -> Column:
    """A whole number from 0; null if it is none."""
    return F.when((n >= 0) & (n == F.floor(n)), n.cast("bigint"))


def box(v: Column, path: str) -> Column:
    """Four numbers of a box with an area; null if they are none."""
    numbers = lambda a: F.transform(a, lambda x: as_number(x))
    whole = lambda n: F.when(F.forall(n, lambda x: x.isNotNull()) & (F.get(n, F.lit(2)) > F.get(n, F.lit(0))) & (F.get(n, F.lit(3)) > F.get(n, F.lit(1))), n)
    return bound(as_list(v, path), lambda a: F.when(F.size(a) == 4, bound(numbers(a), whole)))


def provenance(v: Column) -> Column:
    """TXT-27: where a field was found: a struct of source, page, bbox, bboxNormalized, bboxModel, blockIndex, confidence; null without any box."""
    page = bound(as_number(v, "$.page"), lambda n: F.when(n > 0, round_half_up(n)))
    given = bound(part(v, "$.blockIndex"), lambda n: F.when(n.isNull() | F.is_variant_null(n), as_number(v, "$.block_index")).otherwise(as_number(n)))
    boxes = F.struct(*(box(v, f"$.{k}").alias(k) for k in BOXES))

    def found(b: Column) -> Column:
        own = F.struct(as_text(v, "$.source").alias("source"), page.alias("page"), *(b[k].alias(k) for k in BOXES), bound(given, whole_number).alias("blockIndex"), bound(as_number(v, "$.confidence"), confidence).alias("confidence"))
        return F.when(F.coalesce(*(b[k] for k in BOXES)).isNotNull(), own)

    return F.when(v.isNotNull(), bound(boxes, found))


def _entries(entries: Column, value) -> Column:
    """A map of the entries whose value isn't null, or null if there is none."""
    kept = F.filter(F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    return bound(kept, lambda k: F.when(F.size(k) > 0, F.map_from_entries(k)))


def field_provenance(v: Column) -> Column:
    """TXT-27: a map of field to provenance, without fields that have none; null if v is no record or nothing is left."""
    return _entries(as_record(v), provenance)


def field_confidence(v: Column) -> Column:
    """TXT-27: a map of field to confidence; null if v is no record or nothing is left."""
    return _entries(as_record(v), lambda x: bound(as_number(x), confidence))


def block_indices(v: Column) -> Column:
    """TXT-27: a map of field to the number of its block: whole numbers from 0."""
    return _entries(as_record(v), lambda x: bound(as_number(x), whole_number))


def item_provenance(v: Column) -> Column:
    """TXT-27: a list of structs of a line item's index, the provenance of its row and of its fields.

    The index is called index, itemIndex, rowIndex or line; items without one, or without any provenance, are left out.
    """
    def index(x: Column) -> Column:
        named = [part(x, f"$.{k}") for k in ("index", "itemIndex", "rowIndex", "line")]
        given = F.coalesce(*(bound(n, lambda n: F.when(~F.is_variant_null(n), n)) for n in named), *named)
        return bound(as_number(given), whole_number)

    item = lambda x: F.struct(index(x).alias("index"), bound(part(x, "$.row"), provenance).alias("row"), field_provenance(part(x, "$.fields")).alias("fields"))
    kept = F.filter(F.transform(as_list(v), item), lambda i: i["index"].isNotNull() & (i["row"].isNotNull() | i["fields"].isNotNull()))
    return bound(kept, lambda k: F.when(F.size(k) > 0, k))


def classification(v: Column, section: Column | None = None) -> Column:
    """TXT-27: a struct of invoiceType, category, glCategory, tdsSection by their names or aliases, the section replaced by a given one; null if nothing is left.

    The first name that holds a text decides, also if the text is blank.
    """
    def named(*names: str) -> Column:
        texts = [bound(part(v, f"$.{n}"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.regexp_replace(F.try_variant_get(x, "$", "string"), r"^\s+|\s+$", ""))) for n in names]
        return bound(F.coalesce(*texts), lambda x: F.nullif(x, F.lit("")))

    names = ("invoiceType", "category", "glCategory", "tdsSection")
    own = [named("invoiceType"), named("category", "classification"), named("glCategory", "gl_category"), named("tdsSection", "tdsCategory", "tds")]
    given = F.nullif(F.trim(section), F.lit("")) if section is not None else F.lit(None).cast("string")
    own[3] = F.coalesce(given, own[3])
    return bound(F.struct(*(c.alias(n) for c, n in zip(own, names, strict=True))), lambda k: F.when(F.coalesce(*(k[n] for n in names)).isNotNull(), k))


def extract_provenance(v: Column) -> Column:
    """TXT-24: a map of field to page, box and confidences of an extract's own provenance record; fields that aren't known, or that say nothing, are left out."""
    def entry(k: str, field: str) -> Column:
        at = f"$.{k}"
        values = [as_double(v, f"{at}.page"), F.transform(as_list(v, f"{at}.bboxNormalized"), lambda x: as_double(x)), *(as_double(v, f"{at}.{c}") for c in ("confidence", "parsingConfidence", "extractionConfidence"))]
        found = F.struct(*(x.alias(n) for x, n in zip(values, ("page", "bboxNormalized", "confidence", "parsingConfidence", "extractionConfidence"), strict=True)))
        return F.when(functools.reduce(Column.__or__, (x.isNotNull() for x in values)), F.struct(F.lit(field).alias("key"), found.alias("value")))

    kept = F.array_compact(F.array(*(entry(k, f) for k, f in SOURCES.items())))
    return bound(kept, lambda x: F.when(F.size(x) > 0, F.map_from_entries(x)))
