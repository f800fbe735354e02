"""DuckDB statements for the rows of those queries that SQL can express."""

from __future__ import annotations

#: CRC-32 (reflected 0xEDB88320) of four bits at a time. Fixed values.
CRC_STEPS = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_HALF = f"xor(x >> 4, {CRC_STEPS}[CAST(x & 15 AS INTEGER) + 1])"
#: The unsigned CRC-32 of a list of byte values.
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda acc, b: list_reduce([xor(acc, b), 0, 0], lambda x, unused: " + _HALF + ")), 4294967295)"

#: Nodes are lists of the digests of first turns; figures are grouped from every conversation's every opening.
PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS mark, length(coalesce(text, '')) AS points,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS family, {CRC.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
picked AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.mark, t.points FROM convs c JOIN turns t ON t.conv_id = c.family AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.mark, t.points FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
rebuilt AS (SELECT conv_id, list(mark ORDER BY own, pos) AS marks, list(points ORDER BY own, pos) AS points FROM picked GROUP BY conv_id),
whole AS (SELECT c.conv_id, coalesce(r.marks, []) AS marks, coalesce(r.points, []) AS points FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id),
openings AS (SELECT conv_id, marks, points, unnest(range(len(marks) + 1)) AS depth FROM whole),
nodes AS (
  SELECT marks[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN any_value(points[depth]) ELSE 0 END AS points,
    sha256(coalesce(string_agg(CASE WHEN len(marks) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM openings GROUP BY marks[1:depth], depth),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT node[1:d] AS node, count(*) FILTER (childless) AS n_leaves, sum((n_convs - 1) * points) AS saved_tokens
  FROM (SELECT n.node, n.n_convs, n.points, c.n IS NULL AS childless, unnest(range(n.depth + 1)) AS d FROM nodes n LEFT JOIN children c ON c.node = n.node) GROUP BY node[1:d])
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""

#: Near words meet by what is left of them without one code point; the runs' letters are at most two bytes in UTF-8.
SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
sums AS (
  SELECT run, n, {CRC.format(bytes="flatten(list_transform(string_split(concat(id, ':', run), ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) AS BIGINT) - 64] END))")} AS h FROM counted),
noted AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) ELSE run END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noted WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT DISTINCT word, n, k, concat(substring(word, 1, k), substring(word, k + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cuts c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cuts c ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.next)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""
