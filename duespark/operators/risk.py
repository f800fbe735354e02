"""Row-level compliance kernels: risk signals, validation, action classification, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duespark.functions.dates import days_between
from duespark.functions.money import round_half_up
from duespark.functions.text import GSTIN, IRN, PAN, pan_of_gstin

#: CLS-01: the order in which reasons are tried, and their severity.
action_severity = {"FAILED": 100, "EXPORT_FAILED": 90, "CRITICAL_RISK": 80, "MISSING_GSTIN": 70, "NEEDS_REVIEW": 50, "AWAITING_APPROVAL": 30}
FREEMAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "rediffmail.com")


def action_reason(status: Column, export_error: Column, open_critical: Column, has_gstin: Column, currency: Column) -> Column:
    return (
        F.when(status.isin("FAILED_OCR", "FAILED_PARSE"), "FAILED")
        .when(F.length(F.coalesce(export_error, F.lit(""))) > 0, "EXPORT_FAILED")
        .when(open_critical, "CRITICAL_RISK")
        .when(~has_gstin & (currency == "INR") & (status != "PENDING"), "MISSING_GSTIN")
        .when(status == "NEEDS_REVIEW", "NEEDS_REVIEW")
        .when(status == "AWAITING_APPROVAL", "AWAITING_APPROVAL")
    )


def severity_of(reason: Column) -> Column:
    cases = F.when(F.lit(False), 0)
    for name, value in action_severity.items():
        cases = cases.when(reason == name, value)
    return cases


def signal(condition: Column, code: str, category: str, severity: str, penalty: Column | int) -> Column:
    """One risk signal, or null; array_compact(array(...)) makes the list."""
    penalty = F.lit(penalty) if isinstance(penalty, int) else penalty
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), penalty.cast("bigint").alias("penalty")))


def above_expected(total: Column, expected_max: Column) -> Column:
    """RSK-01."""
    over = (total - expected_max) / expected_max
    return signal((expected_max > 0) & (total > expected_max), "TOTAL_AMOUNT_ABOVE_EXPECTED", "financial", "warning", F.least(F.lit(30), round_half_up(15 + 25 * over)))


def below_minimum(total: Column, minimum: Column) -> Column:
    """RSK-02."""
    return signal((total > 0) & (total < minimum), "TOTAL_AMOUNT_BELOW_MINIMUM", "financial", "info", 0)


def due_too_far(due: Column, as_of: Column, days: int) -> Column:
    """RSK-03, in days of the calendar."""
    ahead = F.datediff(due.cast("date"), as_of.cast("date"))
    return signal(ahead > days, "DUE_DATE_TOO_FAR", "data-quality", "warning", F.least(F.lit(20), round_half_up(8 + (ahead - days) / F.lit(4.0))))


def missing_fields(**fields: Column) -> Column:
    """RSK-04: the names of the missing fields, joined, or null."""
    names = F.array_compact(F.array(*[F.when(x.isNull() | (x.cast("string") == ""), F.lit(k)) for k, x in fields.items()]))
    return F.when(F.size(names) > 0, F.concat_ws(", ", names))


def pan_level(pan: Column, gstin: Column) -> Column:
    """RSK-05: missing, bad format, mismatch with the GSTIN, or the level that was verified."""
    of_gstin = pan_of_gstin(gstin)
    return F.when(F.coalesce(pan, F.lit("")) == "", "missing").when(~pan.rlike(PAN), "invalid").when(of_gstin.isNotNull() & (of_gstin != pan), "mismatch").when(of_gstin == pan, "L2").otherwise("L1")


def irn_signal(irn: Column, gstin: Column, total: Column, threshold: int) -> Column:
    """RSK-06: needed above a threshold where there is a tax identifier; else checked for its form."""
    empty = F.coalesce(irn, F.lit("")) == ""
    needed = (F.coalesce(gstin, F.lit("")) != "") & F.coalesce(total > threshold, F.lit(False))
    return F.when(empty & needed, "IRN_MISSING").when(~empty & ~F.trim(irn).rlike(IRN), "IRN_FORMAT_INVALID")


def msme_state(invoice_date: Column, as_of: Column) -> Column:
    """RSK-07: overdue after 45 days, due soon after 30."""
    days = F.floor(days_between(as_of, invoice_date))
    return F.when(days > 45, "MSME_PAYMENT_OVERDUE").when(days > 30, "MSME_PAYMENT_DUE_SOON")


def bank_changed(account_hash: Column, history: Column) -> Column:
    """RSK-08: an account that isn't in the history before this row; an empty history tells nothing."""
    return F.coalesce((F.size(history) > 0) & ~F.array_contains(history, account_hash), F.lit(False))


def sender_signal(domain: Column, known: Column, freemail: tuple[str, ...] = FREEMAIL) -> Column:
    """RSK-09: a domain that the vendor hasn't used; freemail is told only where the vendor has written from a domain of its own."""
    own = F.exists(known, lambda d: ~F.lower(d).isin(*freemail))
    used = F.exists(known, lambda d: F.lower(d) == F.lower(domain))
    fresh = F.when(F.lower(domain).isin(*freemail) & own, "SENDER_FREEMAIL").otherwise("SENDER_DOMAIN_MISMATCH")
    return F.when(F.coalesce(domain, F.lit("")) == "", None).when(F.coalesce(F.size(known), F.lit(0)) <= 0, "SENDER_FIRST_TIME").when(~used, fresh)


# Every code with its category, severity and penalty; null where the amount decides.
SIGNALS = {
    "PAN_FORMAT_INVALID": ("compliance", "warning", 4), "PAN_GSTIN_MISMATCH": ("compliance", "warning", 4), "TDS_NO_PAN_PENALTY_RATE": ("compliance", "critical", 10), "TDS_SECTION_AMBIGUOUS": ("compliance", "warning", 4),
    "TDS_BELOW_THRESHOLD": ("compliance", "info", 0), "TDS_BELOW_ANNUAL_THRESHOLD": ("compliance", "info", 0), "TDS_ANNUAL_THRESHOLD_CROSSED": ("compliance", "warning", 3), "TDS_BACKDATED_THRESHOLD_ADJUSTMENT": ("compliance", "warning", 5),
    "TDS_SECTION_197_APPLIED": ("compliance", "info", 0), "TDS_CATCHUP_RATE_VARIANCE": ("compliance", "warning", 6), "TOTAL_AMOUNT_ABOVE_EXPECTED": ("financial", "warning", None), "TOTAL_AMOUNT_BELOW_MINIMUM": ("financial", "info", 0),
    "DUE_DATE_TOO_FAR": ("data-quality", "warning", None), "MISSING_MANDATORY_FIELDS": ("data-quality", "warning", 4), "DUPLICATE_INVOICE_NUMBER": ("fraud", "critical", 10), "VENDOR_BANK_CHANGED": ("fraud", "critical", 10),
    "IRN_MISSING": ("compliance", "warning", 4), "IRN_FORMAT_INVALID": ("compliance", "warning", 4), "MSME_PAYMENT_OVERDUE": ("compliance", "critical", 10), "MSME_PAYMENT_DUE_SOON": ("compliance", "warning", 4),
    "SENDER_FREEMAIL": ("fraud", "warning", 4), "SENDER_DOMAIN_MISMATCH": ("fraud", "warning", 4), "SENDER_FIRST_TIME": ("fraud", "info", 0), "BANK_PAYMENT_VERIFIED": ("financial", "info", 0),
}


def row_signals(amounts: list[Column], codes: list[Column], conditions: dict[str, Column]) -> Column:
    """TAX-07: the list of a row's signals: those that bring their penalty (amounts), those of code columns, those of conditions by code; null and false give none."""
    known = lambda code, k: F.coalesce(*(F.when(code == c, F.lit(v[k])) for c, v in SIGNALS.items() if v[2] is not None))
    coded = [F.when(c.isNotNull(), F.struct(c.alias("code"), known(c, 0).alias("category"), known(c, 1).alias("severity"), known(c, 2).cast("bigint").alias("penalty"))) for c in codes]
    return F.array_compact(F.array(*amounts, *coded, *(signal(holds, code, *SIGNALS[code]) for code, holds in conditions.items())))


def filtered_signals(signals: Column, disabled: list[str], severities: dict[str, str], penalties: dict[str, int]) -> Column:
    """TAX-08, MAP-01: drops disabled codes and applies overrides."""
    kept = F.filter(signals, lambda s: ~s["code"].isin(disabled)) if disabled else signals
    pick = lambda table, s, field: F.coalesce(*[F.when(s["code"] == k, F.lit(v)) for k, v in table.items()], s[field]) if table else s[field]
    return F.transform(kept, lambda s: F.struct(s["code"].alias("code"), s["category"].alias("category"), pick(severities, s, "severity").alias("severity"), pick(penalties, s, "penalty").cast("bigint").alias("penalty")))


def penalty_sum(signals: Column, cap: int) -> Column:
    """AG-27."""
    return F.least(F.lit(cap).cast("bigint"), F.aggregate(signals, F.lit(0).cast("bigint"), lambda a, s: a + s["penalty"]))


def max_severity(signals: Column) -> Column:
    """AG-26: critical above warning above info."""
    rank = lambda s: F.when(s["severity"] == "critical", 3).when(s["severity"] == "warning", 2).when(s["severity"] == "info", 1).otherwise(0)
    return F.get(F.array(F.lit(None).cast("string"), F.lit("info"), F.lit("warning"), F.lit("critical")), F.coalesce(F.array_max(F.transform(signals, rank)), F.lit(0)))


def document_confidence(ocr: Column, completeness: Column, warnings: Column, risk: Column) -> Column:
    """CNF-01: 0..100."""
    raw = F.coalesce(ocr, F.lit(0.6)) * 100 * 0.65 + completeness * 0.35 - F.least(F.lit(25), 4 * warnings) - risk
    return F.least(F.lit(100), F.greatest(F.lit(0), round_half_up(raw))).cast("bigint")


def tone(score: Column) -> Column:
    return F.when(score >= 91, "green").when(score >= 80, "yellow").otherwise("red")


def status_after_extraction(warnings: Column, open_signals: Column, has_org: Column) -> Column:
    """CLS-02."""
    return F.when(~has_org, "PENDING_TRIAGE").when((warnings > 0) | (open_signals > 0), "NEEDS_REVIEW").otherwise("PARSED")
