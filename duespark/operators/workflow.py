"""Approval workflows: eligibility, health, row actions, the steps' outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = {"select": ("PARSED", "NEEDS_REVIEW", "AWAITING_APPROVAL", "APPROVED", "FAILED_OCR", "FAILED_PARSE"), "approve": ("PARSED", "NEEDS_REVIEW"), "export": ("APPROVED",), "retry": ("FAILED_OCR", "FAILED_PARSE", "NEEDS_REVIEW")}


def row_actions(status: Column) -> Column:
    """FLT-18: the actions that a status allows."""
    return F.array_compact(F.array(*[F.when(status.isin(*states), F.lit(name)) for name, states in ACTIONS.items()]))


def may_approve(step_kind: Column, role: Column, step_role: Column, user: Column, step_users: Column, limit: Column, total: Column) -> Column:
    """FLT-17: anyone, a role or listed users, within the user's limit (null: none)."""
    who = F.when(step_kind == "any", True).when(step_kind == "role", role == step_role).when(step_kind == "users", F.array_contains(step_users, user)).otherwise(False)
    return F.coalesce(who, F.lit(False)) & (limit.isNull() | (total <= limit))


def action_flags(status: Column, can_approve: Column, can_edit: Column) -> Column:
    """FLT-23."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        (yes(can_approve) & status.isin("PARSED", "NEEDS_REVIEW", "AWAITING_APPROVAL")).alias("approve"),
        (yes(can_edit) & ~status.isin("EXPORTED", "REJECTED")).alias("edit"),
        (yes(can_approve) & (status == "APPROVED")).alias("export"),
    )


def step_findings(steps: DataFrame, roles: DataFrame) -> DataFrame:
    """FLT-22, AG-33: findings of steps (workflow_id, tenant_id, step_no, kind, role, users, needed) against role holders (tenant_id, role)."""
    holders = roles.groupBy("tenant_id", "role").agg(F.count(F.lit(1)).alias("holders"))
    df = steps.join(holders, ["tenant_id", "role"], "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    users = F.coalesce(F.size("users"), F.lit(0))
    found = F.array_compact(F.array(F.when((F.col("kind") == "role") & (F.col("holders") == 0), F.lit("no approver")), F.when((F.col("kind") == "role") & (F.col("holders") > 0) & (F.col("holders") < F.col("needed")), F.lit("too few approvers")), F.when((F.col("kind") == "users") & (users < F.col("needed")), F.lit("too few users"))))
    return df.select("workflow_id", "step_no", found.alias("findings"))


def advance(steps: DataFrame, approvals: DataFrame) -> DataFrame:
    """DML-11: state of each invoice's workflow. steps: invoice_id, step_no, rule (any, all), approvers, applies; approvals: invoice_id, step_no, user_id.

    Steps that don't apply are skipped; the first applying step that isn't complete is the current one.
    """
    got = approvals.groupBy("invoice_id", "step_no").agg(F.count_distinct("user_id").alias("n"))
    df = steps.join(got, ["invoice_id", "step_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    done = F.when(~F.col("applies"), True).when(F.col("rule") == "all", F.col("n") >= F.col("approvers")).otherwise(F.col("n") >= 1)
    out = df.groupBy("invoice_id").agg(F.min(F.when(~done, F.col("step_no"))).alias("current_step"))
    return out.withColumn("state", F.when(F.col("current_step").isNull(), "approved").otherwise("in_progress"))


def triage(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """DML-15: decisions (invoice_id, action, org_id, reason, notes) on rows in triage; a rejection for `other` needs notes."""
    d = decisions.select(F.col("invoice_id").alias("__id"), "action", F.col("org_id").alias("__org"), "reason", "notes")
    ok = (F.col("status") == "PENDING_TRIAGE") & (((F.col("action") == "assign") & F.col("__org").isNotNull()) | ((F.col("action") == "reject") & ((F.col("reason") != "other") | (F.length(F.coalesce("notes", F.lit(""))) > 0))))
    ok = F.coalesce(ok, F.lit(False))
    joined = rows.join(d, F.col("invoice_id") == F.col("__id"), "left")
    out = joined.withColumns({"status": F.when(ok & (F.col("action") == "assign"), "PENDING").when(ok, "REJECTED").otherwise(F.col("status")), "org_id": F.when(ok & (F.col("action") == "assign"), F.col("__org")).otherwise(F.col("org_id")), "applied": ok})
    return out.select(*rows.columns, "applied")


def archive_or_delete(orgs: DataFrame, dependents: DataFrame) -> DataFrame:
    """DML-12: orgs with dependents are archived, others deleted."""
    n = dependents.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    return orgs.join(n, "org_id", "left").select("org_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) > 0, "archive").otherwise("delete").alias("action"))
