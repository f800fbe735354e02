"""The trie of conversations against one built turn by turn in Python, on the tables and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from duespark.llm import prefix_trie
from duespark.llm.queries import ORACLES, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn int, role string, text string, depth string, key int"


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, mark(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - c % 100 if c >= 0 else -(-c - -c % 100)
        out[c] = own.get(family, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, children, leaves, saved = {}, {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(convs[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def odd_rows():
    """Nulls, hot openings, copies, one conversation that is the opening of another, ties, repeated rows, absent families."""
    draw = random.Random(3)
    hot = [("system", "be kind é日"), ("user", "hello"), ("assistant", "hi")]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 207, 208, 311, 10**12, -5, -200, -205]:
        turns = (hot if draw.random() < 0.6 else []) + [(draw.choice(["user", "assistant"]), draw.choice("abcdef") * draw.randint(0, 5)) for _ in range(draw.randint(0, 9))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(400 + c, k, "user", f"same {k}") for c in range(12) for k in range(8)]
    rows += [(500, 1, "user", "a"), (500, 1, "user", "b"), (500, None, None, None), (500, 2, "user", "a"), (500, 2, "user", "a"), (501, None, "user", None), (None, 0, "user", "lost")]
    rows += [(600 + c, k, "u", "long" if k < 70 - c else f"{k % 3}{c}") for c in range(4) for k in range(90)]
    draw.shuffle(rows)
    return rows


def test_query_on_the_tables(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert found(QUERIES["op11_prefix_trie"](spark, small)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    rows = con.execute(ORACLES["op11_prefix_trie"])
    assert [c[0] for c in rows.description] == COLUMNS and sorted(rows.fetchall()) == want


@pytest.mark.parametrize(("least", "partitions"), [(256, 4), (2, 7), (1, 13)])
def test_odd_rows_over_many_ranges(spark, monkeypatch, least, partitions):
    """Long sequences are cut and told apart by doublings; points at the edges of ranges get all of their rows."""
    rows = odd_rows()
    monkeypatch.setattr(prefix_trie, "BUCKET", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefix_trie.nodes(frame(spark, rows), least)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing_one_turn_and_turnless(spark):
    assert found(prefix_trie.nodes(frame(spark, []))) == []
    for rows in ([(0, 0, "user", "x")], [(1, 0, "user", "x"), (2, 5, None, "y")], [(c, k, "user", "x" * c) for c in (1, 2, 3, 4, 6, 7) for k in range(2)]):
        assert found(prefix_trie.nodes(frame(spark, rows))) == brute(rows)


def test_one_conversation_over_many_ranges_and_a_hot_opening(spark):
    """A third of the rows are one conversation; its turns are numbered over several ranges."""
    draw = random.Random(9)
    rows = [(700, k, "user", draw.choice("ab")) for k in range(900)] + [(701, k, "user", "a") for k in range(900)]
    rows += [(c, k, "user", "a") for c in range(702, 790) for k in range(draw.randint(1, 12))]
    assert found(prefix_trie.nodes(frame(spark, rows).repartition(9), 4)) == brute(rows)


def test_common_turns():
    a, b = (b"".join(mark("u", x) for x in s) for s in ("aabcab", "aabdab"))
    assert prefix_trie.common(a, b) == 3 and prefix_trie.common(a, a[:32]) == 2 and prefix_trie.common(a, b"") == 0 and prefix_trie.common(a, a) == 6
