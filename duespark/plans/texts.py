"""Queries of the text operators over documents and conversations."""

from pyspark.sql import functions as F

from duespark.operators import documents as doc
from duespark.sources.tables import table


def languages(spark, d):
    """TXT-06, TXT-09, CNF-03."""
    t = table(spark, d, "documents")
    m = doc.quality_metrics(F.col("text"))
    return t.select("doc_id", doc.language(F.col("text")).alias("language"), doc.strategy(F.col("text")).alias("strategy"), m["printable_permille"].alias("printable_permille"))


def chunk_sizes(spark, d):
    """TXT-08: chunks of 1,000 characters; a third of the documents have a page for each line."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\f"))).otherwise(F.col("text"))
    t = table(spark, d, "documents").select("doc_id", doc.chunks(text, 1000).alias("c"))
    return t.select("doc_id", F.size("c").cast("bigint").alias("n"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("bigint").alias("largest"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


def language_accuracy(spark, d):
    """TXT-19: languages found against those stated."""
    t = table(spark, d, "documents")
    return doc.accuracy(t.select("doc_id", "lang"), t.select("doc_id", doc.language(F.col("text")).alias("lang")), "doc_id", ["lang"])


def repeated_lines(spark, d):
    """WIN-06: characters left once repeated lines are gone."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length(doc.without_repeated_lines(F.col("text"))).cast("bigint").alias("n_chars"))


def first_texts(spark, d):
    """TXT-07."""
    return doc.dedup_by_text(table(spark, d, "documents"))


def turns(spark, d):
    """SET-12, SET-09: conversations joined from their turns in order."""
    c = table(spark, d, "conversations")
    parts = F.array_sort(F.array_agg(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.size("p").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("text_md5"))


QUERIES = {
    "txt02_totals": lambda spark, d: doc.totals(table(spark, d, "documents")),
    "txt06_txt09_languages": languages,
    "txt07_first_texts": first_texts,
    "txt08_chunk_sizes": chunk_sizes,
    "txt19_language_accuracy": language_accuracy,
    "win06_repeated_lines": repeated_lines,
    "set09_set12_turns": turns,
}

_lex = lambda k: "[" + ", ".join(f"'{w}'" for w in doc.LEXICON[k].split()) + "]"
_hits = ", ".join(f"len(list_filter(t, lambda w: list_contains({_lex(k)}, w))) AS {k}" for k in doc.LEXICON)
_language = f"""t AS (SELECT *, string_split_regex(lower(text), '[^\\p{{L}}]+') AS t FROM documents), h AS (SELECT * EXCLUDE (t), {_hits} FROM t),
l AS (SELECT *, CASE WHEN greatest(en, de, fr, es) = 0 THEN NULL WHEN de >= en AND de >= fr AND de >= es THEN 'de' WHEN en >= fr AND en >= es THEN 'en' WHEN es >= fr THEN 'es' ELSE 'fr' END AS language FROM h)"""


def _token_sql(x: str) -> str:
    """The amount that a token says, as money.amount_token reads it."""
    body = f"regexp_replace(regexp_replace({x}, '[^0-9,.+-]', '', 'g'), '^[-+]', '')"
    at_end = lambda c: f"CASE WHEN length(string_split({body}, '{c}')[-1]) <= 2 THEN array_to_string(string_split({body}, '{c}')[:-2], '') || '.' || string_split({body}, '{c}')[-1] ELSE replace({body}, '{c}', '') END"
    both = f"CASE WHEN length(string_split({body}, '.')[-1]) < length(string_split({body}, ',')[-1]) THEN replace({body}, ',', '') ELSE replace(replace({body}, '.', ''), ',', '.') END"
    dots = f"len(string_split({body}, '.'))"
    plain = f"CASE WHEN contains({body}, ',') AND contains({body}, '.') THEN {both} WHEN contains({body}, ',') THEN {at_end(',')} WHEN {dots} > 2 THEN {at_end('.')} WHEN {dots} = 2 AND regexp_full_match({body}, '[^.]+\\.[^.]{{3}}') THEN replace({body}, '.', '') ELSE {body} END"
    value = f"CASE WHEN starts_with({x}, '-') THEN -1 ELSE 1 END * try_cast({plain} AS DOUBLE)"
    return f"CASE WHEN abs({value}) < 1e12 THEN round({value}, 2) ELSE {value} END"


_compact = "regexp_replace(r, '\\s+', '', 'g')"
_parted = " ".join(f"WHEN regexp_full_match({_compact}, '\\d+{m}\\d{{2}}(?:\\d+{m}\\d{{2}})+') THEN regexp_extract_all({_compact}, '\\d+{m}\\d{{2}}')" for m in ("\\.", ","))
_magnitude = "(CASE WHEN a = floor(a) THEN 0 ELSE 6 END - CASE WHEN a = floor(a) AND a BETWEEN 1900 AND 2100 THEN 18 ELSE 0 END - CASE WHEN a >= 1000000 THEN 8 ELSE 0 END + CASE WHEN a >= 10000 THEN 6 WHEN a >= 100 THEN 4 WHEN a >= 1 THEN 1 ELSE -5 END)"
_TOTALS = f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(13), chr(10)), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM l),
t AS (SELECT *, flatten(list_transform(regexp_extract_all(regexp_replace(replace(line, chr(160), ' '), '\\s+', ' ', 'g'), '{doc.AMOUNT}'), lambda r: CASE {_parted} ELSE [r] END)) AS tokens FROM e),
v AS (SELECT *, list_filter(list_transform(tokens, lambda r: {_token_sql('r')}), lambda x: x > 0) AS amounts, regexp_matches(line, '{doc.STRONG}') AS strong, regexp_matches(line, '{doc.WEAK}') AS weak, regexp_matches(line, '{doc.NEGATIVE}') AS negative, CASE WHEN k >= floor(n * CAST(0.6 AS DOUBLE)) THEN 8 ELSE 0 END AS place FROM t),
n AS (SELECT *, coalesce(lead(amounts, 1) OVER w, []) AS a1, coalesce(lead(amounts, 2) OVER w, []) AS a2, coalesce(lead(amounts, 3) OVER w, []) AS a3, coalesce(regexp_matches(lead(line, 2) OVER w, '[A-Za-z]'), true) AND len(coalesce(lead(amounts, 2) OVER w, [])) = 0 AS e2, coalesce(regexp_matches(lead(line, 3) OVER w, '[A-Za-z]'), true) AND len(coalesce(lead(amounts, 3) OVER w, [])) = 0 AS e3 FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT *, CASE WHEN strong THEN 120 WHEN weak THEN 55 ELSE 0 END - CASE WHEN negative THEN 85 ELSE 0 END + CASE WHEN regexp_matches(line, '{doc.CURRENCY_MARK}') THEN 6 ELSE 0 END + place - CASE WHEN contains(line, '%') THEN 12 ELSE 0 END AS base,
  CASE WHEN len(amounts) > 0 THEN amounts WHEN e2 THEN a1 WHEN e3 THEN list_concat(a1, a2) ELSE list_concat(list_concat(a1, a2), a3) END AS near FROM n),
labelled AS (SELECT doc_id, k, base, unnest(near) AS a FROM c WHERE (strong OR weak) AND base > 0),
money AS (SELECT doc_id, k, place AS base, unnest(amounts) AS a FROM c WHERE NOT negative AND (weak OR regexp_matches(line, '{doc.MONEY_MARK}') OR regexp_matches(line, '{doc.FRACTION}') OR len(list_filter(amounts, lambda x: x <> floor(x))) > 0)),
every AS (SELECT doc_id, 1 AS own, k, base + {_magnitude} AS score, a FROM labelled UNION ALL SELECT doc_id, 0, k, base + {_magnitude}, a FROM money),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY own DESC, score DESC, a DESC, k DESC) AS r FROM every)
SELECT d.doc_id, CAST(b.score AS BIGINT) AS score, b.a AS amount, CAST(b.k AS BIGINT) AS line FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1"""
_CHUNKS = """WITH RECURSIVE src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(12)) ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) ELSE [] END AS pages FROM documents),
p AS (SELECT doc_id, text, CASE WHEN len(pages) > 1 THEN pages ELSE string_split(text, chr(10)) END AS parts, CASE WHEN len(pages) > 1 THEN 0 ELSE 1 END AS sign FROM src),
step AS (SELECT doc_id, parts, sign, 1 AS i, parts[1] AS cur, CAST([] AS VARCHAR[]) AS done FROM p
  UNION ALL SELECT doc_id, parts, sign, i + 1, CASE WHEN length(cur) = 0 THEN parts[i + 1] WHEN length(cur) + length(parts[i + 1]) + sign > 750 THEN parts[i + 1] ELSE cur || chr(10) || parts[i + 1] END,
    CASE WHEN length(cur) > 0 AND length(cur) + length(parts[i + 1]) + sign > 750 THEN list_append(done, cur) ELSE done END FROM step WHERE i < len(parts)),
whole AS (SELECT s.doc_id, p.text, CASE WHEN regexp_matches(cur, '\\S') THEN list_append(done, cur) ELSE done END AS c FROM step s JOIN p ON p.doc_id = s.doc_id WHERE i = len(s.parts)),
f AS (SELECT doc_id, CASE WHEN len(c) = 0 THEN [text] ELSE c END AS c FROM whole)
SELECT doc_id, len(c) AS n, list_max(list_transform(c, lambda x: length(x))) AS largest, md5(array_to_string(c, '|')) AS chunks_md5 FROM f"""
ORACLES = {
    "txt02_totals": _TOTALS,
    "txt08_chunk_sizes": _CHUNKS,
    "txt06_txt09_languages": f"""WITH {_language} SELECT doc_id, language, CASE WHEN length(text) = 0 THEN 'none' WHEN length(text) <= 6000 THEN 'single' ELSE 'chunked' END AS strategy,
  CAST(floor(length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) * 1000 / greatest(length(text), 1) + 0.5) AS BIGINT) AS printable_permille FROM l""",
    "txt07_first_texts": "SELECT md5(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "txt19_language_accuracy": f"WITH {_language} SELECT doc_id, CAST(coalesce(language = lang, false) AS BIGINT) AS passed, CAST(1 AS BIGINT) AS checks, coalesce(language = lang, false) AS ok FROM l",
    "win06_repeated_lines": """WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
  f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY k) AS y FROM s) SELECT doc_id, CAST(sum(length(x) + 1) FILTER (y IS DISTINCT FROM x OR k = 1) - 1 AS BIGINT) AS n_chars FROM f GROUP BY 1""",
    "set09_set12_turns": "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS text_md5 FROM conversations GROUP BY 1",
}
