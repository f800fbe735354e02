"""Field extraction from text and page blocks: rule-based parse, field rules, boxes."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from duespark.functions.dates import parse_date
from duespark.functions.money import parse_amount, to_minor
from duespark.functions.text import GSTIN, PAN
from duespark.operators.documents import currency
from duespark.operators.folds import in_order

#: Boxes up to this number are compared one by one; an array's operations cost more than they save.
FEW = 64
NUMBER = r"(?im)^.*?\b(?:invoice|bill)\s*(?:no|number|#)\s*[.:#-]*\s*([A-Z0-9][A-Z0-9/\-]{2,})"
DATE = r"(?im)\b(?:invoice|bill)?\s*date\s*[.:-]*\s*([0-9A-Za-z ./\-]{6,18}?)\s*$"
DUE = r"(?im)\bdue\s*(?:date|on)\s*[.:-]*\s*([0-9A-Za-z ./\-]{6,18}?)\s*$"
TOTAL = r"(?im)\b(?:grand total|amount payable|total amount|total)\b[^0-9\n]*([0-9][0-9,.]*)"


def _field(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def parse_invoice(text: Column) -> Column:
    """TXT-01: struct of number, dates, currency, total and tax ids, with a list of what is missing."""
    number, day, due = _field(text, NUMBER), parse_date(_field(text, DATE)), parse_date(_field(text, DUE))
    total = to_minor(parse_amount(_field(text, TOTAL)))
    gstin = _field(text, GSTIN.replace("^", r"\b(").replace("$", r")\b"))
    pan = _field(text, PAN.replace("^", r"\b(").replace("$", r")\b"))
    missing = F.array_compact(F.array(F.when(number.isNull(), "number"), F.when(day.isNull(), "date"), F.when(total.isNull(), "total")))
    return F.struct(number.alias("number"), day.alias("date"), due.alias("due"), currency(text).alias("currency"), total.alias("total_minor"), gstin.alias("gstin"), F.coalesce(pan, F.substring(gstin, 3, 10)).alias("pan"), missing.alias("missing"))


def vendor_line(lines: Column, first: int = 18) -> Column:
    """TXT-05: the line most like a company's name among the first: legal suffixes, capitals; digits and labels count against it; ties to the earlier."""
    score = lambda x: F.when(x.rlike(r"(?i)\b(pvt|private|ltd|limited|llp|inc|gmbh|corp|company)\b"), 40).otherwise(0) + F.when(x.rlike(r"^[A-Z][A-Za-z&.,' -]+$"), 15).otherwise(0) - F.when(x.rlike(r"\d"), 20).otherwise(0) - F.when(x.rlike(r"(?i)\b(invoice|date|gstin|total|bill to|ship to|phone|email)\b"), 50).otherwise(0)
    ranked = F.array_sort(F.transform(F.slice(lines, 1, first), lambda x, k: F.struct((-score(x)).alias("s"), k.alias("k"), x.alias("x"))))
    top = F.get(ranked, F.lit(0))
    return F.when(top["s"] < 0, top["x"])


def tax_sum(*parts: Column) -> Column:
    """TXT-11: the sum of the parts that there are; null if there is none."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def normal_gstin(raw: Column) -> Column:
    """TXT-12: trimmed, upper case, null unless well formed."""
    x = F.upper(F.regexp_replace(raw, r"\s+", ""))
    return F.when(x.rlike(GSTIN), x)


def positive_whole(raw: Column) -> Column:
    """TXT-12: a positive whole number of minor units, else null."""
    return F.when((raw > 0) & (F.floor(raw) == raw), raw.cast("bigint"))


def pick_number(candidates: Column) -> Column:
    """TXT-18: the longest candidate with a digit, ties to the first by text."""
    ok = F.filter(candidates, lambda c: c.rlike(r"\d"))
    return F.get(F.array_sort(F.transform(ok, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), F.lit(0))["c"]


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """MTH-11: pixels [x1, y1, x2, y2] to the unit square; null for a box without area."""
    unit = lambda v: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 6)
    out = F.array(unit(box[0] / width), unit(box[1] / height), unit(box[2] / width), unit(box[3] / height))
    return F.when((F.size(box) == 4) & (box[0] < box[2]) & (box[1] < box[3]), out)


def union_box(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AG-34, TXT-30: the smallest box around each group's boxes x1, y1, x2, y2, and the mean confidence."""
    return rows.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.avg("confidence").alias("confidence"))


def split_bands(items: DataFrame) -> DataFrame:
    """TXT-29: items (page_id, item_no, y1, y2) that share a box get equal bands of it, from the top."""
    w = Window.partitionBy("page_id", "y1", "y2")
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("item_no")) - 1
    height = (F.col("y2") - F.col("y1")) / n
    return items.select("page_id", "item_no", (F.col("y1") + height * k).alias("y1"), (F.col("y1") + height * (k + 1)).alias("y2"))


def _assigned(ids: list[int], p: np.ndarray, targets: list[int], q: np.ndarray, least: float):
    """(box, target, share) of a page's boxes p that take one of q."""
    if not len(q):
        return
    if len(q) <= FEW and not (np.isnan(q).any() or np.isnan(p).any()):
        free = [(*r, (r[2] - r[0]) * (r[3] - r[1]), t) for r, t in zip(q.tolist(), targets, strict=True)]
        for box_id, (x1, y1, x2, y2) in zip(ids, p.tolist(), strict=True):
            size, best, at = (x2 - x1) * (y2 - y1), 0.0, None
            for k, (a1, b1, a2, b2, area, _) in enumerate(free):
                w, h = min(x2, a2) - max(x1, a1), min(y2, b2) - max(y1, b1)
                if w > 0 and h > 0 and (low := min(size, area)) > 0 and (share := w * h / low) > best:
                    best, at = share, k
            if at is not None and best >= least:
                yield box_id, free.pop(at)[-1], best
        return
    area = lambda r: (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
    free, of_q = np.ones(len(q), bool), area(q)
    for box_id, r, size in zip(ids, p, area(p), strict=True):
        w, h = np.minimum(r[2], q[:, 2]) - np.maximum(r[0], q[:, 0]), np.minimum(r[3], q[:, 3]) - np.maximum(r[1], q[:, 1])
        low = np.minimum(size, of_q)
        share = np.where(free & (w > 0) & (h > 0) & (low > 0), w * h / np.where(low > 0, low, 1), 0.0)
        k = int(share.argmax())
        if share[k] > 0 and share[k] >= least:
            free[k] = False
            yield box_id, targets[k], float(share[k])


def overlap_assignment(left: DataFrame, right: DataFrame, least: float = 0.55) -> DataFrame:
    """JN-21: per page, boxes of left take the best free box of right in order, if the overlap's share of the smaller area reaches `least`.

    left, right: page_id, box_id, x1, y1, x2, y2. A page's boxes are held by one task, page after page; the choice is sequential.
    """
    box = ["x1", "y1", "x2", "y2"]
    rows = lambda df, side: df.select(F.col("page_id").cast("bigint").alias("page_id"), F.lit(side).alias("side"), F.col("box_id").cast("bigint").alias("box_id"), *(F.col(c).cast("double").alias(c) for c in box))
    both = rows(left, 0).unionByName(rows(right, 1))
    wanted = "page_id bigint, box_id bigint, target_id bigint, overlap double"
    arrow = to_arrow_schema(both.sparkSession.createDataFrame([], wanted).schema)

    def run(batches):
        held = []

        def done(table, cuts):
            pages, sides, ids = (table.column(c).to_pylist() for c in ("page_id", "side", "box_id"))
            at = np.column_stack([table.column(c).to_numpy() for c in box])
            second = np.concatenate([[0], np.cumsum(sides)])
            out = []
            for a, b in pairwise(cuts):
                m = b - int(second[b] - second[a])
                out += [(pages[a], *r) for r in _assigned(ids[a:m], at[a:m], ids[m:b], at[m:b], least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            page = batch.column(0).to_pylist()
            starts = [k for k in range(1, len(page)) if page[k] != page[k - 1]]
            first = not held or held[-1].column(0)[-1].as_py() != page[0]
            if held and (first or starts):
                # What is held ends where this batch's first page does.
                end = 0 if first else starts[0]
                table = pa.Table.from_batches([*held, batch.slice(0, end)])
                yield from done(table, [0, table.num_rows])
                batch, starts, held = batch.slice(end), [k - end for k in starts if k > end], []
            if starts:
                table = pa.Table.from_batches([batch.slice(0, starts[-1])])
                yield from done(table, [0, *starts])
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            table = pa.Table.from_batches(held)
            yield from done(table, [0, table.num_rows])

    return in_order(both, ["page_id"], ["side", F.col("box_id").asc_nulls_last()]).mapInArrow(run, wanted)
