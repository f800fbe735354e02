"""Vouchers: validation, ledger lines, batches, CSV and XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duespark.functions.money import to_major_text
from duespark.functions.text import csv_escape, xml_escape

BATCH = 25


def subtotal(total: Column, given: Column, taxes: Column) -> Column:
    """VCH-01: the given subtotal if it balances within one unit, else total less taxes."""
    return F.when(given.isNotNull() & (F.abs(given + taxes - total) <= 1), given).otherwise(total - taxes)


def first_failure(*rules: tuple[Column, str]) -> Column:
    """FLT-19: the message of the first rule that fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules])


def all_failures(*rules: tuple[Column, str]) -> Column:
    """FLT-20."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules]))


def ledger_lines(rows: DataFrame) -> DataFrame:
    """VCH-02: signed lines of invoice_id, total_minor, sub_minor, cgst, sgst, igst, cess, tds; they add up to 0.

    The party is credited with what is payable, so the withheld tax is a credit too.
    """
    line = lambda name, x, sign: F.when(F.coalesce(x, F.lit(0)) != 0, F.struct(F.lit(name).alias("ledger"), (x * sign).cast("bigint").alias("minor")))
    tds = F.coalesce("tds", F.lit(0))
    lines = F.array_compact(F.array(line("party", F.col("total_minor") - tds, -1), line("purchase", F.col("sub_minor"), 1), line("cgst", F.col("cgst"), 1), line("sgst", F.col("sgst"), 1), line("igst", F.col("igst"), 1), line("cess", F.col("cess"), 1), line("tds", tds, -1)))
    return rows.select("invoice_id", F.posexplode(lines).alias("position", "l")).select("invoice_id", F.col("position").cast("bigint").alias("position"), "l.ledger", "l.minor")


def batches(rows: DataFrame, partition: list[str], order: str, size: int = BATCH, width: int = 100_000) -> DataFrame:
    """SNK-04: numbers batches of `size` rows within each partition, by a whole-number key.

    Rows are numbered within ranges of `width` keys and the ranges' counts are summed up before them,
    so a partition with very many rows isn't sorted in one task. Partition columns aren't null.
    """
    df = rows.withColumn("__range", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*partition, "__range").agg(F.count(F.lit(1)).alias("n")).select(*partition, "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*partition, "__range").orderBy(order)
    numbered = df.join(before, [*partition, "__range"]).withColumn("batch", F.floor((F.col("__before") + F.row_number().over(within) - 1) / size).cast("bigint"))
    return numbered.select(*rows.columns, "batch")


def csv_rows(rows: DataFrame, columns: dict[str, str], money: set[str] = frozenset()) -> DataFrame:
    """SNK-01, SNK-02: one text column `line`; columns maps names to headers, which csv_header joins."""
    cells = [csv_escape(to_major_text(F.col(c)) if c in money else F.col(c).cast("string")) for c in columns]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def csv_header(columns: dict[str, str]) -> str:
    return ",".join('"' + h.replace('"', '""') + '"' if any(x in h for x in ',"\n\r') else h for h in columns.values())


def xml_vouchers(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """SNK-03: one XML text a voucher. heads: invoice_id, number, date (yyyymmdd), party."""
    entry = F.concat(F.lit("<LEDGERENTRIES.LIST><LEDGERNAME>"), xml_escape(F.col("ledger")), F.lit("</LEDGERNAME><ISDEEMEDPOSITIVE>"), F.when(F.col("minor") > 0, "Yes").otherwise("No"), F.lit("</ISDEEMEDPOSITIVE><AMOUNT>"), to_major_text(-F.col("minor")), F.lit("</AMOUNT></LEDGERENTRIES.LIST>"))
    body = lines.select("invoice_id", F.struct("position", entry.alias("x")).alias("e")).groupBy("invoice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "").alias("body"))
    text = F.concat(F.lit('<VOUCHER VCHTYPE="Purchase"><DATE>'), F.col("date"), F.lit("</DATE><REFERENCE>"), xml_escape(F.col("number")), F.lit("</REFERENCE><PARTYLEDGERNAME>"), xml_escape(F.col("party")), F.lit("</PARTYLEDGERNAME>"), F.col("body"), F.lit("</VOUCHER>"))
    return body.join(heads, "invoice_id").select("invoice_id", text.alias("xml"))


def parse_response(xml: Column) -> Column:
    """SNK-05."""
    return F.struct(F.xpath_int(xml, F.lit("//CREATED")).alias("created"), F.xpath_int(xml, F.lit("//ERRORS")).alias("errors"), F.xpath(xml, F.lit("//LINEERROR/text()")).alias("messages"))
