"""Extraction operators on small cases."""

import datetime as dt
import time

from pyspark.sql import functions as F

from duespark.operators import extraction as ex


def test_parse_invoice(spark):
    text = "Acme Traders Pvt Ltd\nInvoice No: INV/2026-17\nInvoice Date: 03/04/2026\nDue Date: 3 May 2026\nGSTIN 27AABCD3611Q1ZI\nSub 100\nGrand Total: 1,18,000.50"
    r = spark.range(1).select(ex.parse_invoice(F.lit(text)).alias("r")).first().r
    assert (r.number, r.date, r.due, r.currency, r.total_minor, r.gstin, r.pan, r.missing) == ("INV/2026-17", dt.date(2026, 4, 3), dt.date(2026, 5, 3), "INR", 11_800_050, "27AABCD3611Q1ZI", "AABCD3611Q", [])
    r = spark.range(1).select(ex.parse_invoice(F.lit("nothing here")).alias("r")).first().r
    assert r.number is None and r.missing == ["number", "date", "total"]


def test_fields(spark):
    row = spark.range(1).select(
        ex.vendor_line(F.array(F.lit("Invoice 5"), F.lit("Acme Traders Pvt Ltd"), F.lit("Bob"))).alias("v"),
        ex.tax_sum(F.lit(None).cast("int"), F.lit(5)).alias("t"),
        ex.tax_sum(F.lit(None).cast("int")).alias("n"),
        ex.normal_gstin(F.lit(" 27aabcd3611q1zi ")).alias("g"),
        ex.pick_number(F.array(F.lit("ABC"), F.lit("A1"), F.lit("INV-12"))).alias("p"),
        ex.positive_whole(F.lit(1.5)).alias("w"),
        ex.clamp_box(F.array(*[F.lit(x) for x in (-5.0, 0.0, 50.0, 300.0)]), F.lit(100), F.lit(200)).alias("b"),
    ).first()
    assert tuple(row) == ("Acme Traders Pvt Ltd", 5, None, "27AABCD3611Q1ZI", "INV-12", None, [0.0, 0.0, 0.5, 1.0])


def test_boxes(spark):
    cols = "page_id bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.1, 0.0, 1.1, 1.0)], cols)
    b = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 1.0), (1, 8, 5.0, 5.0, 6.0, 6.0)], cols)
    assert [tuple(r)[:3] for r in ex.overlap_assignment(a, b).collect()] == [(1, 1, 7)]
    items = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, 1.0), (1, 3, 2.0, 3.0)], "page_id bigint, item_no int, y1 double, y2 double")
    assert [(r.item_no, r.y1, r.y2) for r in ex.split_bands(items).orderBy("item_no").collect()] == [(1, 0.0, 0.5), (2, 0.5, 1.0), (3, 2.0, 3.0)]


def test_assignment_of_many_small_pages_and_of_a_large_one(spark):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    boxes = [(None if p == 0 else p, k, *(float(v) for v in (x, y, x + 4 + k % 3, y + 3))) for p in range(300) for k, (x, y) in enumerate(draw.integers(0, 12 if p else 60, (90 if p == 7 else p % 6, 2)).tolist())]
    schema = "page_id bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double"
    other = [(p, k + 100, x1 + 1, y1, x2 + 1, y2) for p, k, x1, y1, x2, y2 in boxes if k % 5 != 4]
    found = ex.overlap_assignment(spark.createDataFrame(boxes, schema), spark.createDataFrame(other, schema)).collect()
    want = []
    for page in dict.fromkeys(b[0] for b in boxes):
        free = [b for b in other if b[0] == page]
        for _, k, *a in (b for b in boxes if b[0] == page):
            share = lambda b, a=a: max(0, min(a[2], b[4]) - max(a[0], b[2])) * max(0, min(a[3], b[5]) - max(a[1], b[3])) / min((a[2] - a[0]) * (a[3] - a[1]), (b[4] - b[2]) * (b[5] - b[3]))
            best = max(free, key=lambda b: (share(b), -b[1]), default=None)
            if best and share(best) >= 0.55:
                free.remove(best)
                want.append((page, k, best[1], share(best)))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    # A page's boxes cost microseconds: a data frame of its own for each page took two milliseconds.
    n = 20_000
    ids = np.repeat(np.arange(n), 4)
    pages = spark.createDataFrame(pa.table({"page_id": ids, "box_id": np.tile(np.arange(4), n), "x1": np.tile([0.0, 20, 40, 60], n), "y1": np.zeros(4 * n), "x2": np.tile([10.0, 30, 50, 70], n), "y2": np.ones(4 * n)})).cache()
    assert pages.count() == 4 * n
    began = time.time()
    assert ex.overlap_assignment(pages, pages).count() == 4 * n
    assert time.time() - began < 5
