"""Golden cases of the domain kernels, and file and stream round trips."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duespark.functions import dates, money, text
from duespark.operators import changes, documents, reconcile, risk, tax, vouchers
from duespark.sources import files
from duespark.streaming import ingest


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def ts(s):
    return F.lit(s).cast("timestamp")


@pytest.mark.parametrize(
    "at,fy,quarter",
    [("2026-03-31 23:00:00", "2026-27", "Q1"), ("2026-03-31 18:00:00", "2025-26", "Q4"), ("2026-01-15 00:00:00", "2025-26", "Q4"), ("2026-03-31 18:30:00", "2026-27", "Q1"), ("2009-04-15 00:00:00", "2009-10", "Q1"), ("2099-04-01 00:00:00", "2099-00", "Q1")],
)
def test_fiscal_calendar(spark, at, fy, quarter):
    assert tuple(one(spark, fy=dates.fiscal_year(ts(at)), q=dates.fiscal_quarter(ts(at)))) == (fy, quarter)


@pytest.mark.parametrize(
    "base,before,deducted,single,bps,want",
    [
        (5_000_000, 0, 0, 0, 100, (0, False, "BELOW_ANNUAL")),
        (10_000_000, 0, 0, 0, 100, (0, False, "BELOW_ANNUAL")),
        (2_000_000, 15_000_000, 5_000, 0, 100, (20_000, False, "ABOVE")),
        (3_000_000, 9_000_000, 0, 0, 100, (120_000, True, "CROSSED")),
        (2_000_000, 9_000_000, 0, 3_000_000, 100, (110_000, True, "CROSSED")),
        (3_000_000, 9_000_000, 0, 0, 1500, (1_800_000, True, "CROSSED")),
        (1_000_000, 9_000_000, 0, 0, 100, (0, False, "BELOW_ANNUAL")),
    ],
)
def test_thresholds(spark, base, before, deducted, single, bps, want):
    lit = F.lit
    r = one(spark, r=tax.threshold_tax(lit(base), lit(before), lit(deducted), lit(bps), lit(single), lit(10_000_000))).r
    assert (r.tax, r.crossed, r.state) == want


def test_rates(spark):
    rate = lambda pan, cert, ok: tuple(one(spark, r=tax.effective_rate(F.lit(100), F.lit(pan), F.lit(cert), F.lit(ok))).r)
    assert rate(None, None, False) == (2000, "206aa-no-pan") and rate(None, 75, True) == (75, "section-197") and rate("ABCPD1234E", None, None) == (100, "standard")


def test_fold_with_opening_balance_and_changing_rates(spark):
    rows = [(1, 1, 5, "194C", "2026-04-15", 9_000_000, 1000), (2, 1, 5, "194C", "2026-05-15", 3_000_000, 1500), (3, 1, 5, "194C", "2026-06-15", 1_000_000, 1500)]
    df = spark.createDataFrame(rows, "invoice_id bigint, line bigint, vendor_id bigint, section string, d string, base_minor bigint, bps int")
    df = df.withColumns({"invoice_date": F.col("d").cast("timestamp"), "single": F.lit(0), "annual": F.lit(10_000_000), "opening_base": F.lit(0), "opening_tax": F.lit(100)})
    found = [(r.invoice_id, r.tax_minor, r.crossed) for r in tax.ledger_fold(df).orderBy("invoice_id").collect()]
    assert found == [(1, 0, False), (2, 1_799_900, True), (3, 150_000, False)]


@pytest.mark.parametrize("net,want", [(100_000, 50), (100_001, 50), (100_050, 10), (200_000, -1)])
def test_amount_scores(spark, net, want):
    assert one(spark, s=reconcile.amount_score(F.lit(100_000), F.lit(net))).s == want


@pytest.mark.parametrize("description,vendor,want", [("Payment Acme Corporation ref", "Acme Corporation", 20), ("SprintoTechPvt", "Sprinto Technology Private Limited", 15), ("HDFC Bank NEFT", "Sprinto Technology Private Limited", 0), ("x", "", 0), ("x", None, 0)])
def test_vendor_scores(spark, description, vendor, want):
    assert one(spark, s=reconcile.vendor_score(F.lit(description), F.lit(vendor).cast("string"))).s == want


@pytest.mark.parametrize("day,want", [("2026-01-14", 10), ("2026-01-09", 5), ("2025-12-20", 2), ("2025-06-01", 0), (None, 0)])
def test_date_scores(spark, day, want):
    assert one(spark, s=reconcile.date_score(ts("2026-01-15"), ts(day), ts(None))).s == want


def test_number_scores(spark):
    score = lambda d, n: one(spark, s=reconcile.number_score(F.lit(d), F.lit(n))).s
    assert (score("Payment for INV-001 completed", "INV-001"), score("payment for inv-001", "INV-001"), score("Payment", "")) == (30, 30, 0)


def test_band_join_finds_all_pairs_without_a_nested_loop(spark):
    left = spark.range(0, 300).selectExpr("id AS a", "id * 37 % 1000 AS x", "id % 2 AS t")
    right = spark.range(0, 300).selectExpr("id AS b", "id * 91 % 1000 - 50 AS y", "id % 2 AS t")
    found = reconcile.band_join(left, right, "x", "y", 20, ["t"])
    pairs = {(r.a, r.b) for r in found.collect()}
    want = {(a, b) for a in range(300) for b in range(300) if a % 2 == b % 2 and abs(a * 37 % 1000 - (b * 91 % 1000 - 50)) <= 20}
    assert pairs == want and found.count() == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_split_match(spark):
    pairs = spark.createDataFrame([(1, 1000, 10, 400), (1, 1000, 11, 600), (1, 1000, 12, 300), (2, 500, 13, 100)], "txn_id bigint, debit_minor bigint, invoice_id bigint, net_minor bigint")
    assert [(r.txn_id, r.ids, r["sum"]) for r in reconcile.split_matches(pairs, tolerance=1, most=3).collect()] == [(1, [10, 11], 1000)]


def test_rounding_and_amounts(spark):
    r = one(spark, a=money.round_half_up(F.lit(-2.5)), b=money.round_half_up(F.lit(2.5)), c=money.to_major_text(F.lit(-5)), d=money.parse_amount(F.lit("1.234,56")), e=money.parse_amount(F.lit("(1,00,000.5)")), f=money.parse_amount(F.lit("12 kg")), g=money.compact(F.lit(123_456_789_00)), h=money.indian_grouping(F.lit(12345678)))
    assert tuple(r) == (-2, 3, "-0.05", 1234.56, -100000.5, None, "12.3Cr", "1,23,45,678")


def test_dates(spark):
    parse = lambda s: one(spark, d=dates.parse_date(F.lit(s))).d
    assert parse("31/12/2025") == parse("2025-12-31T10:00") == parse("31 December 2025") == parse("31-12-25") == dt.date(2025, 12, 31)
    assert parse("31/31/2025") is None and parse("soon") is None


def test_risk(spark):
    assert one(spark, r=risk.pan_level(F.lit("ABCDE1234F"), F.lit("27ABCDE1234F1Z5"))).r == "L2"
    assert one(spark, r=risk.pan_level(F.lit("ABCDE1234F"), F.lit("27AAAAA1234F1Z5"))).r == "mismatch"
    assert one(spark, r=risk.irn_signal(F.lit(""), F.lit("27ABCDE1234F1Z5"), F.lit(100), 50)).r == "IRN_MISSING"
    assert one(spark, r=risk.bank_changed(F.lit("x"), F.array(F.lit("y")))).r and not one(spark, r=risk.bank_changed(F.lit("x"), F.array().cast("array<string>"))).r
    assert one(spark, r=risk.sender_signal(F.lit("gmail.com"), F.array(F.lit("a.com")))).r == "SENDER_FREEMAIL"
    signals = F.array(F.struct(F.lit("A").alias("code"), F.lit("c").alias("category"), F.lit("info").alias("severity"), F.lit(9).alias("penalty")), F.struct(F.lit("B").alias("code"), F.lit("c").alias("category"), F.lit("info").alias("severity"), F.lit(9).alias("penalty")))
    kept = one(spark, r=risk.filtered_signals(signals, ["B"], {"A": "critical"}, {"A": 3})).r
    assert [tuple(s) for s in kept] == [("A", "c", "critical", 3)]


def test_vouchers_balance_and_render(spark):
    rows = spark.createDataFrame([(1, 118, 100, 9, 9, 0, 0, 10)], "invoice_id bigint, total_minor bigint, sub_minor bigint, cgst bigint, sgst bigint, igst bigint, cess bigint, tds bigint")
    lines = vouchers.ledger_lines(rows)
    assert lines.agg(F.sum("minor")).first()[0] == 0
    heads = spark.createDataFrame([(1, "A&B", "20260401", "<x>")], "invoice_id bigint, number string, date string, party string")
    xml = vouchers.xml_vouchers(lines, heads).first().xml
    assert "<REFERENCE>A&amp;B</REFERENCE>" in xml and "<AMOUNT>-1.00</AMOUNT>" in xml and xml.index("party") < xml.index("purchase")
    r = one(spark, r=vouchers.parse_response(F.lit("<R><CREATED>2</CREATED><ERRORS>1</ERRORS><LINEERROR>a</LINEERROR><LINEERROR>b</LINEERROR></R>"))).r
    assert tuple(r) == (2, 1, ["a", "b"])


def test_next_states(spark):
    cur = spark.createDataFrame([("k", 5, ["a"])], "k string, n bigint, t array<string>")
    new = spark.createDataFrame([("k", 2, ["b"]), ("z", 1, ["c"])], "k string, n bigint, t array<string>")
    found = sorted((r.k, r.n, r.t) for r in changes.upsert(cur, new, "k", [], [], ["n"], ["t"]).collect())
    assert found == [("k", 7, ["a", "b"]), ("z", 1, ["c"])]
    led = spark.createDataFrame([(1, [1, 2, 3])], "v int, e array<int>")
    r = changes.split_overflow(led, "e", 2).first()
    assert r.e == [1, 2] and r.overflow == [3]
    rates = spark.createDataFrame([("194C", 100, dt.datetime(2024, 4, 1), None)], "section string, bps int, valid_from timestamp, valid_to timestamp")
    ch = spark.createDataFrame([("194C", 200, dt.datetime(2025, 4, 1))], "section string, bps int, valid_from timestamp")
    assert sorted((r.bps, r.valid_to is None) for r in changes.new_rate_version(rates, ch).collect()) == [(100, False), (200, True)]


def test_section_rules(spark):
    items = spark.createDataFrame([(1, "t", "rent", "C"), (2, "t", "rent", "P"), (3, "u", "x", "C")], "item_id bigint, tenant_id string, gl_category string, pan_category string")
    rules = spark.createDataFrame([(None, "rent", "*", "194I", 1), ("t", "rent", "C", "194C", 1), (None, "rent", "P", "194J", 5), (None, "rent", "P", "194H", 5)], "tenant_id string, gl_category string, pan_category string, section string, priority int")
    assert sorted(tuple(r) for r in tax.section_rule(items, rules).collect()) == [(1, "194C", "high"), (2, "194H", "medium"), (3, None, "none")]


def test_text_functions(spark):
    assert one(spark, x=text.unique_texts(F.array(F.lit(" a "), F.lit("a"), F.lit(""), F.lit("b")))).x == ["a", "b"]
    assert one(spark, x=text.pan_of_gstin(F.lit("27AABCD3611Q1ZI"))).x == "AABCD3611Q"
    assert one(spark, x=text.low_quality_token(F.lit("aaab"))).x and not one(spark, x=text.low_quality_token(F.lit("total"))).x
    assert one(spark, x=documents.currency(F.lit("GSTIN 27"))).x == "INR"
    assert one(spark, x=documents.chunks(F.lit("aa\nbb\ncccc\ndd"), 8)).x == ["aa\nbb", "cccc", "dd"]
    docs = spark.createDataFrame([(1, "Item 5.00\nSub total 1,000.00\nGrand Total Rs. 1,180.00\nThanks"), (2, "none")], "doc_id bigint, text string")
    assert [(r.doc_id, r.amount) for r in documents.totals(docs).orderBy("doc_id").collect()] == [(1, 1180.0), (2, None)]


def test_bank_statement_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Date,Text,Out,In,Ref\n01/04/2026,"NEFT ""A"", x","1,000.50",,r1\nbad,x,1,,\n02/04/2026,fee,,,\n03-04-2026,sale,,20,\n')
    rows = files.bank_statement(spark, str(tmp_path / "s.csv"), {"date": 0, "description": 1, "debit": 2, "credit": 3, "reference": 4}).orderBy("date").collect()
    assert [(str(r.date), r.description, r.debit_minor, r.credit_minor) for r in rows] == [("2026-04-01", 'NEFT "A", x', 100_050, 0), ("2026-04-03", "sale", 0, 2000)]


def test_code_list_file(spark, tmp_path):
    (tmp_path / "g.csv").write_text("GL Code,Description,Type\n5000,Rent,rent\n,No code,x\n6000,,y\n")
    good, bad = files.code_list(spark, str(tmp_path / "g.csv"))
    assert [tuple(r) for r in good.collect()] == [("5000", "Rent", "rent", None)] and bad.count() == 2


def test_files_after_a_marker(spark):
    t = dt.datetime(2026, 1, 1)
    listing = spark.createDataFrame([("a.pdf", t), ("b.pdf", t), ("c.txt", t), ("d.PNG", dt.datetime(2026, 1, 2)), ("e.pdf", dt.datetime(2025, 1, 1))], "path string, modified timestamp")
    assert sorted(r.path for r in files.new_files(listing, (t, "a.pdf"), ("pdf", "png")).collect()) == ["b.pdf", "d.PNG"]


def test_stream_goes_on_after_its_checkpoint(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    schema = "key string, at timestamp"
    (tmp_path / "in/1.json").write_text('{"key":"a","at":"2026-01-01T00:00:00"}\n{"key":"a","at":"2026-01-01T01:00:00"}\n')
    run = lambda: ingest.run_to_end(ingest.once_each(ingest.file_stream(spark, src, schema), ["key"], "at"), out, ck).awaitTermination(60)
    assert run()
    (tmp_path / "in/2.json").write_text('{"key":"a","at":"2026-01-01T02:00:00"}\n{"key":"b","at":"2026-01-01T02:00:00"}\n')
    assert run()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_retries_and_quiet_days(spark):
    assert one(spark, t=ingest.next_try(F.lit(1), ts("2026-01-01 00:00:00")).cast("string")).t == "2026-01-01 02:00:00"
    assert one(spark, t=ingest.next_try(F.lit(4), ts("2026-01-01"))).t is None
    rows = spark.createDataFrame([("m", f"2026-01-0{d} {h}:00:00") for d, h in ((1, "00"), (1, "20"), (2, "10"), (2, "21"), (3, "11"))], "m string, s string").withColumn("at", F.col("s").cast("timestamp"))
    assert [r.s for r in ingest.quiet_for_a_day(rows, "m", "at").select(F.date_format("at", "dd HH").alias("s")).orderBy("s").collect()] == ["01 00", "02 10", "03 11"]
    batch = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "key string, error string")
    assert tuple(ingest.run_summary(batch).first()) == (1, 1, 1)
