"""Queries of string, number, date, array, map and JSON functions over the driver tables."""

from pyspark.sql import functions as F

from duespark.functions import dates, money, text
from duespark.operators import relational as rel
from duespark.plans.adapt import ctes, entries, invoices
from duespark.sources.tables import table


def strings(spark, d):
    """STR-01, 03..05, 07, 12, 14, 19, 24, 25, SNK-02."""
    c = table(spark, d, "customer")
    name = F.concat(F.col("c_name"), F.lit("  Pvt & Co"))
    return c.select(
        "c_custkey",
        text.collapsed_key(name).alias("key"),
        F.size(text.lines_of(F.concat(name, F.lit("\r\n \n"), F.col("c_mktsegment")))).alias("n_lines"),
        text.word_overlap(name, F.lit("pvt co limited")).alias("overlap"),
        text.prefix_match(F.col("c_mktsegment"), F.lit("Build")).alias("prefix"),
        text.contains_ignoring_case(name, F.lit("CUSTOMER#0")).alias("contains"),
        text.email_domain(F.concat(F.lit("ap@"), F.col("c_mktsegment"), F.lit(".COM"))).alias("domain"),
        text.xml_escape(name).alias("xml"),
        text.csv_escape(F.concat(name, F.lit(', "x"'))).alias("csv"),
        F.sha2(F.col("c_name"), 256).alias("sha256"),
        F.substring(F.sha1(F.col("c_name")), 1, 24).alias("sha1_prefix"),
        text.length_prefixed(F.col("c_name"), F.col("c_mktsegment")).alias("guid"),
        text.first_not_empty(F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, ""), F.col("c_mktsegment")).alias("first"),
        text.token_estimate(name).alias("tokens"),
        money.percent_bucket(F.col("c_name"), F.lit("flag")).alias("bucket"),
    )


def identifiers(spark, d):
    """STR-08, STR-09."""
    c = table(spark, d, "customer")
    digits = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    holder = F.when(F.col("c_custkey") % 3 == 0, "C").otherwise("P")
    pan = F.concat(F.lit("ABC"), holder, F.lit("E"), digits, F.lit("F"))
    gstin = F.when(F.col("c_custkey") % 5 == 0, "bad").otherwise(F.concat(F.lit("27"), pan, F.lit("1Z5")))
    return c.select("c_custkey", gstin.rlike(text.GSTIN).alias("valid"), text.pan_of_gstin(gstin).alias("pan"), text.holder_category(text.pan_of_gstin(gstin)).alias("holder"))


def numbers(spark, d):
    """MTH-01..06, MTH-10, STR-22."""
    o = table(spark, d, "orders")
    currency = F.when(F.col("o_orderkey") % 3 == 0, "JPY").when(F.col("o_orderkey") % 3 == 1, "KWD").otherwise("INR")
    total = F.col("o_totalprice")
    sign = F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)
    return o.select(
        "o_orderkey",
        money.minor_digits(currency).cast("bigint").alias("digits"),
        money.to_minor(total, money.minor_digits(currency)).alias("minor"),
        money.to_major_text(money.to_minor(total) * sign).alias("major"),
        money.probability(F.col("o_orderkey") % 150 / F.lit(1.0)).alias("probability"),
        money.indian_grouping(money.to_minor(total) * sign).alias("grouped"),
        money.parse_amount(F.concat(F.lit("1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".50"))).alias("parsed"),
    )


def calendar(spark, d):
    """DT-01..05, 08, 10."""
    e = entries(spark, d)
    at = F.timestamp_micros(F.unix_micros("invoice_date") + F.col("line") * 4 * 3_600_000_000)
    prior = dates.prior_period(at, dates.plus_days(at, 30))
    return e.select(
        "invoice_id",
        "line",
        dates.utc_day(at).alias("day"),
        dates.fiscal_year(at).alias("fy"),
        dates.fiscal_quarter(at).alias("quarter"),
        F.floor(dates.days_between(at, F.lit("1996-01-01").cast("timestamp"))).cast("bigint").alias("days"),
        dates.plus_days(at, 45).cast("timestamp_ntz").alias("deadline"),
        prior["prior_start"].cast("timestamp_ntz").alias("prior_start"),
        dates.voucher_date(F.when(F.col("line") == 1, at), F.col("invoice_date")).alias("voucher"),
    )


def parsed_dates(spark, d):
    """DT-06, DT-07."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("ts", "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("ts", "d-M-yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "d MMM yyyy"))
    return o.select("o_orderkey", F.date_format(dates.parse_date(shown), "yyyy-MM-dd").alias("date"))


def arrays(spark, d):
    """ARR-01..07, SET-07, SET-10, SRT-11, AG-25, AG-28."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_agg("l_suppkey")).alias("s"), F.array_agg("l_linestatus").alias("st"))
    s = F.col("s")
    return li.select(
        "l_orderkey",
        F.size(s).alias("n"),
        F.array_join(F.slice(s, 1, 2), ",").alias("head"),
        F.array_join(F.slice(s, F.greatest(F.lit(1), F.size(s) - 1), 2), ",").alias("tail"),
        F.array_join(F.filter(s, lambda x: x % 2 == 0), ",").alias("even"),
        F.array_join(F.transform(s, lambda x: F.when(x > 5, x * 10).otherwise(x)), ",").alias("changed"),
        F.array_join(F.array_sort(F.array_except(s, F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))), ",").alias("rest"),
        F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.size(F.filter("st", lambda x: x == "O")).alias("open"),
        F.exists(s, lambda x: x == 3).alias("has_three"),
    )


def event_json(spark, d):
    """JSN-01..04, MAP-02: keys of the JSON text of events."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", k.alias("k"), F.get_json_object(F.to_json(F.struct(k.alias("a"), F.col("user_id").alias("b"))), "$.b").cast("bigint").alias("b"), (F.when(k.isNotNull(), 50).otherwise(0) + F.when(F.col("event_type") != "", 50).otherwise(0)).cast("bigint").alias("complete"))


def cursors(spark, d):
    """SRT-04: codes of rows' keys."""
    return invoices(spark, d).select("invoice_id", rel.encode_cursor("invoice_id", "priority").alias("cursor"))


QUERIES = {
    "str_strings": strings,
    "str08_str09_identifiers": identifiers,
    "mth_numbers": numbers,
    "dt_calendar": calendar,
    "dt06_dt07_parsed_dates": parsed_dates,
    "arr_arrays": arrays,
    "jsn_event_json": event_json,
    "srt04_cursors": cursors,
}

_name = "(c_name || '  Pvt & Co')"
_at = "(invoice_date + to_hours(CAST(line * 4 AS INTEGER)))"
_ist = f"({_at} + INTERVAL 330 MINUTE)"
_start = f"(year({_ist}) - CASE WHEN month({_ist}) < 4 THEN 1 ELSE 0 END)"
_words = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: length(w) > 2))"
_m = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"
_t = f"CAST({_m} AS VARCHAR)"
_pan = "('ABC' || CASE WHEN c_custkey % 3 = 0 THEN 'C' ELSE 'P' END || 'E' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F')"
ORACLES = {
    "str_strings": f"""SELECT c_custkey, trim(regexp_replace(lower({_name}), '\\s+', ' ', 'g')) AS key, 2 AS n_lines,
  CAST(len(list_intersect({_words(_name)}, {_words("'pvt co limited'")})) AS INTEGER) AS overlap, starts_with(lower(c_mktsegment), 'build') AS prefix, contains(lower({_name}), 'customer#0') AS contains,
  lower(c_mktsegment) || '.com' AS domain, replace({_name}, '&', '&amp;') AS xml, '"' || {_name} || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) AS csv, sha256(c_name) AS sha256, left(sha1(c_name), 24) AS sha1_prefix,
  sha256(length(c_name) || ':' || c_name || length(c_mktsegment) || ':' || c_mktsegment) AS guid, c_mktsegment AS first, CAST(len(string_split_regex(trim({_name}), '\\s+')) AS INTEGER) AS tokens,
  CAST(CAST('0x' || left(sha256(c_name || ':flag'), 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM customer""",
    "str08_str09_identifiers": f"SELECT c_custkey, c_custkey % 5 <> 0 AS valid, CASE WHEN c_custkey % 5 <> 0 THEN {_pan} END AS pan, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'C' ELSE 'P' END END AS holder FROM customer",
    "mth_numbers": f"""SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS BIGINT) AS digits,
  CAST(floor(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE ELSE 100.0::DOUBLE END + 0.5) AS BIGINT) AS minor,
  CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || {_m} // 100 || '.' || lpad(CAST({_m} % 100 AS VARCHAR), 2, '0') AS major,
  round(CASE WHEN o_orderkey % 150 > 1 THEN least(1.0, (o_orderkey % 150) / 100) ELSE o_orderkey % 150 END, 4)::DOUBLE AS probability,
  CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || CASE WHEN length({_t}) > 3 THEN
    CASE WHEN length({_t}) > 7 THEN left({_t}, length({_t}) - 7) || ',' ELSE '' END || CASE WHEN length({_t}) > 5 THEN left(right({_t}, least(7, length({_t}))), least(7, length({_t})) - 5) || ',' || left(right({_t}, 5), 2) ELSE left({_t}, length({_t}) - 3) END || ',' || right({_t}, 3) ELSE {_t} END AS grouped,
  1000 + o_orderkey % 1000 + 0.5::DOUBLE AS parsed FROM orders""",
    "dt_calendar": f"""{ctes('entries')} SELECT invoice_id, line, strftime({_at}, '%Y-%m-%d') AS day, {_start} || '-' || lpad(CAST(({_start} + 1) % 100 AS VARCHAR), 2, '0') AS fy, 'Q' || ((month({_ist}) + 8) % 12 // 3 + 1) AS quarter,
  CAST(floor((epoch_us({_at}) - epoch_us(TIMESTAMP '1996-01-01')) / 86400000000.0) AS BIGINT) AS days, {_at} + to_days(45) AS deadline, {_at} - to_microseconds(1) - to_days(30) AS prior_start,
  strftime(CASE WHEN line = 1 THEN {_at} ELSE invoice_date END, '%Y%m%d') AS voucher FROM entries""",
    "dt06_dt07_parsed_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders",
    "arr_arrays": """WITH g AS (SELECT l_orderkey, list_sort(list(l_suppkey)) AS s, list(l_linestatus) AS st FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(s) AS INTEGER) AS n, array_to_string(s[1:2], ',') AS head, array_to_string(s[greatest(1, len(s) - 1):], ',') AS tail, array_to_string(list_filter(s, lambda x: x % 2 = 0), ',') AS even,
  array_to_string(list_transform(s, lambda x: CASE WHEN x > 5 THEN x * 10 ELSE x END), ',') AS changed, array_to_string(list_sort(list_distinct(list_filter(s, lambda x: x NOT IN (1, 2)))), ',') AS rest,
  CAST(list_sum(s) AS BIGINT) AS total, CAST(len(list_filter(st, lambda x: x = 'O')) AS INTEGER) AS open, list_contains(s, 3) AS has_three FROM g""",
    "jsn_event_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS b, CAST(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN event_type <> '' THEN 50 ELSE 0 END AS BIGINT) AS complete FROM events",
    "srt04_cursors": f"""{ctes('invoices')} SELECT invoice_id, rtrim(translate(base64(CAST('{{"invoice_id":' || invoice_id || ',"priority":"' || priority || '"}}' AS BLOB)), '+/', '-_'), '=') AS cursor FROM invoices""",
}
