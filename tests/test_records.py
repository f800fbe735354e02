"""Streams with timers, the mailbox source, file signatures, extracts as variants, working days, the order of labels, totals and chunks."""

import datetime as dt
import json
import random
import struct
import zlib
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from duespark.functions.money import round_half_up
from duespark.operators import calendar, documents, extracts, projections, reconcile
from duespark.sources import signatures
from duespark.sources.mailbox import MailboxSource
from duespark.streaming import ingest, timers

DAY = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def at(hours):
    return (DAY + dt.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S")


class Stream:
    """A folder of JSON files as a stream; each run takes in what is there and stops."""

    def __init__(self, spark, folder, schema, work, delay="0 seconds"):
        self.spark, self.folder, self.schema, self.work, self.delay, self.files = spark, folder, schema, work, delay, 0
        (folder / "in").mkdir()

    def run(self, *rows):
        if rows:
            self.files += 1
            (self.folder / f"in/{self.files:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        stream = self.spark.readStream.schema(self.schema).json(str(self.folder / "in")).withWatermark("at", self.delay)
        query = self.work(stream).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        return self.spark.read.parquet(str(self.folder / "out")).orderBy("at").collect()


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_retries_over_restarts(stateful, tmp_path):
    """Back-offs of 1, 2, 4 and 8 hours, a success, giving up; every run is a query of its own that goes on after the checkpoint."""
    stream = Stream(stateful, tmp_path, "id string, at timestamp, ok boolean", lambda s: timers.retries(s, "EventTime"))
    fail = lambda i, h: {"id": i, "at": at(h), "ok": False}
    tick = lambda h: {"id": "tick", "at": at(h), "ok": True}
    order = ["wait", "try again", "done", "give up"]
    seen = lambda rows, i: [(r.action, r.attempts, r.at.strftime("%d %H")) for r in sorted(rows, key=lambda r: (r.at, order.index(r.action))) if r.id == i]
    rows = stream.run(fail("a", 0), fail("b", 0), tick(0))
    assert seen(rows, "a") == [("wait", 0, "01 01")]
    rows = stream.run(tick(2))
    assert seen(rows, "a") == [("wait", 0, "01 01"), ("try again", 0, "01 01")]
    rows = stream.run(fail("a", 3), {"id": "b", "at": at(3), "ok": True}, {"id": "c", "at": at(3), "ok": True})
    assert seen(rows, "a")[2:] == [("wait", 1, "01 05")] and seen(rows, "b")[-1] == ("done", 0, "01 03") and not seen(rows, "c")
    rows = stream.run(tick(6))
    assert seen(rows, "a")[3:] == [("try again", 1, "01 05")]
    stream.run(fail("a", 7), tick(7))
    stream.run(tick(12))
    stream.run(fail("a", 13), tick(13))
    stream.run(tick(22))
    rows = stream.run(fail("a", 23), tick(23))
    assert [x[:2] for x in seen(rows, "a")][4:] == [("wait", 2), ("try again", 2), ("wait", 3), ("try again", 3), ("give up", 4)]
    rows = stream.run(tick(90))
    assert seen(rows, "a")[-1] == ("give up", 4, "01 23") and [x[0] for x in seen(rows, "b")] == ["wait", "try again", "done"]


def test_notices_over_restarts(stateful, tmp_path):
    stream = Stream(stateful, tmp_path, "key string, at timestamp, failed boolean", lambda s: timers.notices(s, "EventTime"), "2 hours")
    ask = lambda k, h, failed=False: {"key": k, "at": at(h), "failed": failed}
    stream.run(ask("m", 0), ask("m", 1), ask("n", 1, True), ask("n", 2))
    stream.run(ask("m", 24), ask("m", 25))
    rows = stream.run(ask("m", 49), ask("m", 50), ask("n", 60))
    sent = lambda k: [(r.at - DAY.replace(tzinfo=None)).total_seconds() / 3600 for r in rows if r.key == k and r.sent]
    assert sent("m") == [0, 25, 50] and sent("n") == [1, 2, 60]
    assert {r.skipped for r in rows if not r.sent} == {"duplicate_within_24h"} and len(rows) == 9


def test_quiet_days_in_batches(spark):
    rows = spark.createDataFrame([("m", dt.datetime(2026, 1, 1, 0)), ("m", dt.datetime(2026, 1, 2, 0)), ("m", dt.datetime(2026, 1, 2, 1)), ("m", None), (None, dt.datetime(2026, 1, 1))], "m string, at timestamp")
    assert sorted((r.m or "", r.at.strftime("%d %H")) for r in ingest.quiet_for_a_day(rows, "m", "at").collect()) == [("", "01 00"), ("m", "01 00"), ("m", "02 01")]


def mail(folder, uid, sender="Bills <bills@acme.example>", files=(("a.pdf", "application/pdf", b"%PDF"),), date="Thu, 01 Jan 2026 10:00:00 +0530"):
    m = EmailMessage()
    m["From"], m["Subject"], m["Message-ID"] = sender, f"mail {uid}", f"<{uid}@x>"
    if date:
        m["Date"] = date
    m.set_content("text")
    for name, mime, data in files:
        main, sub = mime.split("/")
        m.add_attachment(data, maintype=main, subtype=sub, filename=name)
    (folder / f"{uid}.eml").write_bytes(m.as_bytes())


def test_mailbox_as_a_table(spark, tmp_path):
    spark.dataSource.register(MailboxSource)
    mail(tmp_path, 5)
    mail(tmp_path, 7, files=(("b.png", "image/x-png", b"\x89PNG"), ("c.txt", "text/plain", b"no"), ("d.JPG", "image/jpg", b"\xff\xd8")))
    mail(tmp_path, 8, sender="other@example.org", date=None)
    mail(tmp_path, 9, files=(), date="never")
    (tmp_path / "10.eml").write_bytes(b"not a message \xff\x00")
    (tmp_path / "notes.txt").write_text("x")
    read = lambda **o: sorted(map(tuple, spark.read.format("mailbox").options(**o).load(str(tmp_path)).select("uid", "attachment", "name", "mime", "content", F.date_format("received_at", "HH:mm").alias("t")).collect()))
    assert read(messages_per_partition=1) == [(5, 0, "a.pdf", "application/pdf", b"%PDF", "04:30"), (7, 0, "b.png", "image/png", b"\x89PNG", "04:30"), (7, 2, "d.JPG", "image/jpeg", b"\xff\xd8", "04:30"), (8, 0, "a.pdf", "application/pdf", b"%PDF", None)]
    assert [r[0] for r in read(after_uid=5, sender="@ACME")] == [7, 7]
    assert [r[2] for r in read(types="text/plain")] == ["c.txt"] and read(after_uid=99) == []


def test_mailbox_as_a_stream_takes_each_message_once(spark, tmp_path):
    spark.dataSource.register(MailboxSource)
    box, out, ck = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "ck")
    box.mkdir()

    def run():
        stream = spark.readStream.format("mailbox").option("after_uid", 1).option("messages_per_partition", 2).load(str(box))
        query = stream.select("uid", "name").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        return sorted(r.uid for r in spark.read.parquet(out).collect())

    for uid in (1, 2, 3, 5):
        mail(box, uid)
    assert run() == [2, 3, 5]
    assert run() == [2, 3, 5]
    for uid in (6, 20):
        mail(box, uid)
    assert run() == [2, 3, 5, 6, 20]


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(width, height, *segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 9


def test_signatures_of_files(spark, tmp_path):
    files = {
        "a.pdf": (b"%PDF /Type /Pages /Type /Page /Type\n/Page>> /Type/PageX", "application/pdf|size-bucket:1|pages:2"),
        "b.PDF": (b"x" * 32769, "application/pdf|size-bucket:2|pages:1"),
        "c.png": (png(800, 600), "image/png|size-bucket:1|w:800|h:600|ratio:landscape"),
        "d.png": (png(70, 100)[:23], "image/png|size-bucket:1"),
        "e.png": (png(0, 100), "image/png|size-bucket:1"),
        "f.jpg": (jpeg(70, 100, (0xE0, b"abc"), (0xC4, b"zz")), "image/jpeg|size-bucket:1|w:70|h:100|ratio:portrait"),
        "g.jpeg": (b"\xff\xd8\x00\x01" + jpeg(100, 100)[2:], "image/jpeg|size-bucket:1|w:100|h:100|ratio:square-ish"),
        "h.jpg": (b"\xff\xd8\xff\xe0\x00\x00rest and rest", "image/jpeg|size-bucket:1"),
        "i.jpg": (png(5, 5), "image/jpeg|size-bucket:1"),
        "j.webp": (b"RIFF", "image/webp|size-bucket:1"),
        "k": (b"foreign", "application/octet-stream|size-bucket:1"),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: r.signature for r in signatures.file_signatures(spark, str(tmp_path)).collect()}
    assert found == {name: s for name, (_, s) in files.items()}
    nothing = spark.createDataFrame([("image/jpeg", None, None), (None, 5, b"x")], "mime string, length bigint, content binary")
    assert [r.signature for r in signatures.layout_signatures(nothing).collect()] == ["image/jpeg|size-bucket:1", "size-bucket:1"]


def of(spark, value, use):
    return spark.createDataFrame([(json.dumps(value),)], "j string").select(use(F.parse_json("j")).alias("x")).first().x


def test_typed_getters(spark):
    v = {"t": " a ", "e": " ", "n": 5, "d": 1.5, "s": "1.5", "b": True, "z": None, "l": [1], "o": {}}
    read = lambda f: of(spark, v, lambda x: F.array(*(f(x, f"$.{k}") for k in "tendsbzloq")))
    assert read(extracts.as_text) == ["a", None, None, None, "1.5", None, None, None, None, None]
    assert read(extracts.as_double) == [None, None, 5.0, 1.5, None, None, None, None, None, None]
    assert read(extracts.as_number) == [None, 0.0, 5.0, 1.5, 1.5, 1.0, 0.0, None, None, None]


def test_records_of_extracts(spark):
    full = {"invoice_number": " I1 ", "vendor_name": 5, "invoice_date": "2024-03-05", "due_date": "bad", "total_amount": 10.005, "cgst_amount": 0.5, "sgst_amount": "1", "vendor_gstin": "G", "line_items": [{"description": " x ", "amount": 2, "rate": "1"}, {"amount": -1}, 5, None]}
    r = of(spark, full, extracts.invoice_record)
    assert (r.invoiceNumber, r.vendorName, r.invoiceDate, r.dueDate, r.cgstMinor, r.sgstMinor, r.totalTaxMinor, r.vendorGstin) == ("I1", None, dt.date(2024, 3, 5), None, 50, None, 50, "G")
    assert [(i.description, i.amountMinor, i.rate) for i in r.lineItems] == [("x", 200, None)]
    r = of(spark, [1], extracts.invoice_record)
    assert r.invoiceNumber is None and r.lineItems is None and r.totalTaxMinor is None
    found = of(spark, {"total_amount": {"page": 2, "confidence": 0.5}, "currency": {"page": 1}, "vendor_name": {}, "x": {"page": 1}, "vendor_pan": {"bboxNormalized": [0, 0, 1, 1]}}, extracts.extract_provenance)
    assert {k: (v.page, v.confidence, v.bboxNormalized) for k, v in found.items()} == {"totalAmountMinor": (2.0, 0.5, None), "vendorPan": (None, None, [0.0, 0.0, 1.0, 1.0])}
    assert of(spark, {}, extracts.extract_provenance) is None


def test_provenance_is_normalised(spark):
    entry = {"bbox": [0, "0", 1, True], "page": "2.5", "blockIndex": None, "block_index": "3", "confidence": 250, "source": " ocr "}
    found = of(spark, {"a": entry, "b": {"bbox": [1, 1, 0, 0], "page": 1}, "c": 5, "d": {"bboxModel": [0, 0, 1, 1], "page": 0, "blockIndex": -1, "confidence": "x"}}, extracts.field_provenance)
    assert set(found) == {"a", "d"} and (found["a"].source, found["a"].page, found["a"].bbox, found["a"].blockIndex, found["a"].confidence) == ("ocr", 3, [0.0, 0.0, 1.0, 1.0], 3, 1.0)
    assert tuple(found["d"])[:1] + (found["d"].page, found["d"].blockIndex, found["d"].confidence) == (None, None, None, None)
    assert of(spark, [entry], extracts.field_provenance) is None and of(spark, {"b": 1}, extracts.field_provenance) is None
    assert of(spark, {"a": 55, "b": "0.12345", "c": "x", "d": -3, "e": {}}, extracts.field_confidence) == {"a": 0.55, "b": 0.1235, "d": 0.0}
    assert of(spark, {"a": 1, "b": 1.5, "c": "2", "d": -1}, extracts.block_indices) == {"a": 1, "c": 2} and of(spark, {"b": -1}, extracts.block_indices) is None
    items = of(spark, [{"line": 2, "row": entry}, {"index": None, "rowIndex": "1", "fields": {"rate": entry, "x": 1}}, {"index": 0}, {"row": entry}, 7, {"index": 1.5, "row": entry}], extracts.item_provenance)
    assert [(i["index"], i.row is not None, sorted(i.fields or {})) for i in items] == [(2, True, []), (1, False, ["rate"])]
    kind = of(spark, {"category": 1, "classification": " goods ", "gl_category": "rent", "tdsSection": "", "tds": "194C"}, extracts.classification)
    assert tuple(kind) == (None, "goods", "rent", None)
    assert tuple(of(spark, {}, lambda v: extracts.classification(v, F.lit(" 206C ")))) == (None, None, None, "206C") and of(spark, 5, extracts.classification) is None


def test_working_days(spark):
    holidays = spark.createDataFrame([(dt.date(2026, 1, 5),), (dt.date(2026, 1, 5),), (dt.date(2026, 1, 10),), (None,), (dt.date(1999, 1, 1),)], "day date")
    days = calendar.calendar(spark, dt.date(2026, 1, 1), dt.date(2026, 1, 12), holidays)
    assert [r.n for r in days.orderBy("day").collect()] == [1, 2, 2, 2, 2, 3, 4, 5, 6, 6, 6, 7]
    rows = spark.createDataFrame([("2026-01-02", "2026-01-06"), ("2026-01-03", "2026-01-02"), ("2026-01-01", "2027-01-01"), (None, "2026-01-01")], "a string, b string")
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in "ab"})
    found = calendar.with_working_days(rows, days, n_a="a", n_b="b").select("a", calendar.working_days_between(F.col("n_a"), F.col("n_b")).alias("n"))
    assert sorted((str(r.a), r.n) for r in found.collect()) == [("2026-01-01 00:00:00", None), ("2026-01-02 00:00:00", 1), ("2026-01-03 00:00:00", 0), ("None", None)]
    assert calendar.calendar(spark, dt.date(2026, 1, 3), dt.date(2026, 1, 4)).agg(F.max("n")).first()[0] == 0


def test_dates_score_by_working_days(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    txns = spark.createDataFrame([(1, 0, 500, ts("2026-01-06"), "x"), (2, 0, 900, ts("2026-01-09"), "x")], "txn_id bigint, tenant_id bigint, debit_minor bigint, paid_at timestamp, description string")
    invoices = spark.createDataFrame([(1, 0, 500, "n", None, ts("2026-01-01"), None, None), (2, 0, 900, "n", None, ts("2026-01-01"), None, None)], "invoice_id bigint, tenant_id bigint, net_minor bigint, number string, vendor_name string, created_at timestamp, approved_at timestamp, due_at timestamp")
    free = spark.createDataFrame([(dt.date(2026, 1, 5),)], "day date")
    score = lambda days: {r.txn_id: r.score for r in reconcile.candidates(txns, invoices, calendar=days).collect()}
    assert score(None) == {1: 55, 2: 52} and score(calendar.calendar(spark, dt.date(2025, 1, 1), dt.date(2027, 1, 1), free)) == {1: 60, 2: 52}


def test_labels_in_a_readers_order(spark):
    rows = spark.createDataFrame([("c1", "Zebra"), ("c2", "énergie"), ("c3", "Energie"), ("c4", "energie"), ("c5", None), ("c6", ""), ("", "x"), (None, "y"), ("c1", "Zebra"), ("c7", "éclair")], "code string, name string")
    found = [r.label for r in projections.labelled(rows, "code", "name").collect()]
    assert found == ["c5", "c6", "éclair (c7)", "énergie (c2)", "Energie (c3)", "energie (c4)", "Zebra (c1)"] and found != sorted(found)
    letters = projections.same_letters(F.col("name"))
    assert sorted(r["count"] for r in rows.filter("name <> ''").groupBy(letters.alias("l")).count().collect()) == [1, 1, 1, 2, 3]
    other = spark.createDataFrame([("ENERGIE",)], "wanted string")
    assert rows.join(other, letters == projections.same_letters(F.col("wanted"))).count() == 3


def test_totals_with_lookahead(spark):
    texts = {
        1: "Item 5.00\nSub total 1,000.00\nGrand Total Rs. 1,180.00\nThanks",
        2: "none",
        3: "Grand Total\n\n1,500.00\nnote\n99,999.00",
        4: "Amount due\nsee below\n700.50",
        5: "Total\n10.5012.75\r20",
        6: "Tax total 5.00\nThing 7.25 EUR\nYear 2024",
        7: "discount 5.00\nroom 12\nfood 13.50",
        8: "Total 18%  2000\nTotal 20",
        9: None,
        10: "Total\nwords only\nmore words\n5.00",
        11: "Total 0.00\nTotal -3.00",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: (r.amount, r.line) for r in documents.totals(docs).collect()}
    assert found == {1: (1180.0, 2), 2: (None, None), 3: (1500.0, 0), 4: (700.5, 0), 5: (2.75, 0), 6: (7.25, 1), 7: (13.5, 2), 8: (20.0, 1), 9: (None, None), 10: (5.0, 3), 11: (None, None)}


def slow_chunks(text, most):
    import re

    target = most * 3 // 4
    pages = [p for p in re.split(r"\n(?=\f)|(?<=\f)\n|\f", text) if p.strip()]
    out, current = [], ""
    for part in pages if len(pages) > 1 else text.split("\n"):
        if len(current) + len(part) + (len(pages) <= 1) > target and current:
            out.append(current)
            current = part
        else:
            current += ("\n" if current else "") + part
    if current.strip():
        out.append(current)
    return out or [text]


def test_chunks_of_lines_and_pages(spark):
    draw = random.Random(8)
    texts = ["", " \n ", "\f", "a\fb", "one\n\ftwo\f\nthree", "x" * 50] + ["".join(draw.choice("ab \n\n\f") for _ in range(draw.randint(1, 80))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, t string")
    found = {r.k: r.c for r in rows.select("k", documents.chunks(F.col("t"), 20).alias("c")).collect()}
    assert found == {k: slow_chunks(t, 20) for k, t in enumerate(texts)} | {99: None}


def test_halves_round_up(spark):
    assert spark.range(1).select(round_half_up(F.lit(2.5)).alias("x")).first().x == 3
