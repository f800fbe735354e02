"""SimHash components and spelling variants against brute force, through their registered queries and on odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from duespark.llm import simhash, spelling
from duespark.llm.queries import ORACLES, QUERIES

from .conftest import SCHEMA, odd_rows, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """The index of the least print that links reach, for each print."""
    at = np.array(prints, np.uint64)
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j in np.flatnonzero(np.bitwise_count(at ^ p) <= radius)) for p in at]
        if new == label:
            return label
        label = new


def test_simhash_query(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [print_of(t) for _, t in docs]
    want = sorted((i, f"{p:016x}", docs[k][0]) for (i, _), p, k in zip(docs, prints, components(prints), strict=True))
    found = QUERIES["op12_simhash"](spark, small)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect())) == want
    assert any(i != c for i, _, c in want)


def test_simhash_of_odd_rows(spark, odd):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [print_of(t) for _, t in rows]
    label = components(prints)
    least = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in label}
    want = Counter((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()) == want


def test_simhash_of_nothing_and_of_string_ids(spark, empty):
    assert simhash.near_duplicates(empty).collect() == []
    named = spark.createDataFrame([("b", "x y z w"), ("a", "X  y\tz w"), (None, None), (None, "p q r")], "name string, body string")
    found = simhash.near_duplicates(named, id_col="name", text_col="body").collect()
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id} == {("b", "a"), ("a", "a")}
    assert {r.component_id for r in found if r.doc_id is None} == {None} and {r.fingerprint for r in found if r.doc_id is None} == {"0" * 16, f"{print_of('p q r'):016x}"}


def test_long_texts_come_in_blocks(monkeypatch):
    draw = random.Random(8)
    texts = [prose(draw, n) for n in (1, 2, 3, 7, 8, 40, 41)] + ["", "one  ", "A b"]
    monkeypatch.setattr(simhash, "AT_ONCE", 5)
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = simhash.majority_bits([t.encode() for t in texts]).view(">u8").ravel().tolist()
        assert found == [print_of(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    bits = list(range(64)) if radius < 3 else list(range(0, 64, 3))
    masks = simhash.covering_masks(bits, radius)
    for flipped in itertools.combinations(bits, radius):
        changed = sum(1 << b for b in flipped)
        assert any(not mask & changed for mask in masks)
    if radius == 2:
        assert all(bin(m).count("1") >= 35 for m in masks)


def test_large_buckets_are_split_without_a_loss(spark):
    """Many prints alike in all but the low bits: each bucket is over the limit, and links and components stay whole."""
    draw = random.Random(4)
    prints = sorted({(0xABCD << 48 | draw.getrandbits(9) << 9) - (1 << 64) for _ in range(300)} | {draw.getrandbits(62) for _ in range(300)})
    frame = spark.createDataFrame([(p,) for p in prints], "print bigint")
    split = simhash.buckets(frame, most=8)
    assert split.filter("table_id >= 7").count() > 1000
    edges = simhash.links(split).collect()
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[max(top(e.u), top(e.v))] = min(top(e.u), top(e.v))
    label = components([p % (1 << 64) for p in prints])
    assert len({top(p) for p in prints}) == len(set(label))
    assert {(top(a) == top(b)) == (label[x] == label[y]) for x, a in enumerate(prints) for y, b in enumerate(prints)} == {True}


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    form, near = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)]
        best = min(((-words[x], x) for x in others), default=None)
        form[w], near[w] = (best[1] if best and -best[0] >= 2 * n else None), len(others)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def sortable(rows):
    return sorted(rows, key=lambda r: r[0])


def test_spelling_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = QUERIES["op13_spelling_variants"](spark, small)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = sortable(brute_variants(docs))
    assert sortable((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()) == want
    assert sum(1 for r in want if r[1]) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rows = con.execute(ORACLES["op13_spelling_variants"])
    assert [c[0] for c in rows.description] == found.columns and sortable(rows.fetchall()) == want


def test_spelling_of_odd_rows(spark, odd, empty):
    assert sortable(rows_of(spelling.variants(odd))) == sortable(brute_variants(odd_rows()))
    assert spelling.variants(empty).collect() == []


def test_spelling_chains_ties_doubled_letters_and_long_words(spark, monkeypatch):
    """Chains of forms, ties of counts, words of doubled letters, one hot pattern, accents, a long word, blocks of one run."""
    draw = random.Random(6)
    bag = []
    for word, n in [("abcde", 200), ("abcdef", 90), ("abcdefg", 40), ("abcdefgh", 20), ("abcdefghi", 9), ("xbcde", 3), ("aaaaa", 7), ("aaaaaa", 14), ("aaaaaaa", 28), ("tiesa", 3), ("tiesb", 6), ("tiesc", 6), ("éclair", 5), ("eclair", 10), ("ÉCLAIR", 4), ("x×÷yzw", 4), ("q" * 3000, 4), ("q" * 2999 + "r", 9), ("swapped", 5), ("wsapped", 12)]:
        bag += [word] * n
    for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ":
        bag += [f"hot{c}pattern"] * draw.randint(3, 60)
    draw.shuffle(bag)
    rows = [(k % 7 if k % 5 else None, " ".join(bag[k : k + 40])) for k in range(0, len(bag), 40)]
    frame = spark.createDataFrame([(i, t, "en", None, len(t), 0.5, "n", 7) for i, t in rows], SCHEMA)
    want = sortable(brute_variants(rows))
    assert sortable(rows_of(spelling.variants(frame))) == want
    by = {r[0]: r for r in want}
    assert by["abcdefghi"][2] == "abcde" and by["tiesa"][1] == "tiesb" and by["swapped"][1] is None and by["hotapattern"][4] >= 50
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 0)
    assert sortable(rows_of(spelling.variants(frame))) == want


def test_blocks_of_runs_and_keys(monkeypatch):
    text = "One two two, three-four four four"
    whole = sum(spelling.runs_of(text), Counter())
    monkeypatch.setattr(spelling, "AT_ONCE", 3)
    monkeypatch.setattr(spelling, "HELD", 2)
    assert sum(spelling.runs_of(text), Counter()) == whole
    words = ["aab", "ab", "aabb", "xaab"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0] + [len(w) for w in words[:-1]])
    full, word, place, rest, fresh = spelling.deletion_keys(points, starts)
    text_of = {h: w for h, w in zip(full.tolist(), words, strict=True)}
    left = [words[w][:p] + words[w][p + 1 :] for w, p in zip(word, place, strict=True)]
    assert all((text_of.get(h) == s) == (s in words) for h, s in zip(rest.tolist(), left, strict=True))
    assert all(len({x for x, s in zip(rest.tolist(), left, strict=True) if s == t}) == 1 for t in left)
    assert sorted((w, s) for w, s, f in zip(word, left, fresh, strict=True) if f) == sorted({(w, s) for w, s in zip(word, left, strict=True)})
