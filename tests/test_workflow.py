"""Workflow and mapping operators on small cases."""

from pyspark.sql import functions as F

from duespark.operators import relational, suggest, workflow


def test_eligibility_and_findings(spark):
    lit = F.lit
    row = spark.range(1).select(
        workflow.may_approve(lit("role"), lit("admin"), lit("admin"), lit("u"), F.array().cast("array<string>"), lit(None).cast("bigint"), lit(5)).alias("a"),
        workflow.may_approve(lit("users"), lit("x"), lit(None).cast("string"), lit("u"), F.array(lit("v")), lit(None).cast("bigint"), lit(5)).alias("b"),
        workflow.may_approve(lit("any"), lit("x"), lit(None).cast("string"), lit("u"), F.array(lit("v")), lit(4), lit(5)).alias("c"),
    ).first()
    assert tuple(row) == (True, False, False)
    steps = spark.createDataFrame([(1, "t", 1, "role", "admin", None, 1), (1, "t", 2, "role", "cfo", None, 1), (2, "t", 1, "users", None, ["a"], 2)], "workflow_id int, tenant_id string, step_no int, kind string, role string, users array<string>, needed int")
    roles = spark.createDataFrame([("t", "admin")], "tenant_id string, role string")
    found = sorted((r.workflow_id, r.step_no, r.findings) for r in workflow.step_findings(steps, roles).collect())
    assert found == [(1, 1, []), (1, 2, ["no approver"]), (2, 1, ["too few users"])]


def test_triage(spark):
    rows = spark.createDataFrame([(1, "PENDING_TRIAGE", None), (2, "PENDING_TRIAGE", None), (3, "PARSED", "o"), (4, "PENDING_TRIAGE", None)], "invoice_id int, status string, org_id string")
    dec = spark.createDataFrame([(1, "assign", "a", None, None), (2, "reject", None, "other", ""), (3, "assign", "b", None, None)], "invoice_id int, action string, org_id string, reason string, notes string")
    assert [tuple(r) for r in workflow.triage(rows, dec).orderBy("invoice_id").collect()] == [(1, "PENDING", "a", True), (2, "PENDING_TRIAGE", None, False), (3, "PARSED", "o", False), (4, "PENDING_TRIAGE", None, False)]


def test_mapping_and_cascade(spark):
    rows = spark.createDataFrame([("g1", "x"), (None, " Acme  LTD "), (None, "other")], "gstin string, name string")
    out = suggest.canonical_names(rows, spark.createDataFrame([("g1", "One")], "gstin string, canonical string"), spark.createDataFrame([("acme ltd", "Acme")], "key string, canonical string"))
    assert sorted(r.name for r in out.collect()) == ["Acme", "One", "other"]
    none, some = F.struct(F.lit(None).cast("string").alias("code")), F.struct(F.lit("5000").alias("code"))
    assert spark.range(1).select(suggest.cascade(none, some).alias("s")).first().s.code == "5000"


def test_alternatives_and_corrections(spark):
    scores = spark.createDataFrame([(1, "a", 5, 50, 1), (1, "b", 3, 30, 2), (1, "c", 2, 20, 3), (2, "a", 9, 90, 1), (2, "b", 1, 10, 2)], "vendor_id int, code string, score bigint, confidence bigint, rank bigint")
    assert sorted((r.vendor_id, r.alternatives) for r in suggest.alternatives(scores).collect()) == [(1, "b,c"), (2, "")]
    cols = "group string, field string, value string, n bigint, seen int"
    cur = spark.createDataFrame([("g", "f", "old", 2, 1), ("g", "h", "x", 1, 2)], cols)
    new = spark.createDataFrame([("g", "f", "new", 1, 3)], cols)
    assert [tuple(r) for r in suggest.corrections(cur, new, 1).collect()] == [("g", "f", "new", 3, 3)]


def test_org_resolution_and_paging(spark):
    files = spark.createDataFrame([(1, "g1", ["a", "b"]), (2, "zz", ["a"]), (3, "zz", ["a", "b"]), (4, "g1", None)], "file_id int, gstin string, candidates array<string>")
    orgs = spark.createDataFrame([("a", "g1"), ("b", "g2")], "org_id string, org_gstin string")
    assert [r.org_id for r in relational.resolve_org(files, orgs).orderBy("file_id").collect()] == ["a", "a", None, None]
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in relational.keyset_page(rows, ["k"], 3, {"k": 7}).collect()] == [6, 5, 4, 3]
    plan = relational.keyset_page(rows, ["k"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
