"""Quality rules, fingerprints, secrets and the archive against brute force."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duespark.llm import fingerprints, quality_rules, secrets, warc

from .conftest import odd_rows, words


def base_rules(text):
    w, seen, doubled = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            doubled += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {x for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for x in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), doubled, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


@pytest.mark.parametrize("bits", [24, 58])
def test_base_counts(odd, spark, bits, monkeypatch):
    # With most bits given to positions, hashes clash and the windows themselves are compared.
    monkeypatch.setattr(quality_rules, "POSITION_BITS", bits)
    texts = [t or "" for _, t in odd_rows()] + ["a b c a b c # d\na b c a b c # d\n\n \n \n", "x x x x", "x x x", "| a | b |"]
    if bits > 24:
        texts = [t for t in texts if len(t) < 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = quality_rules.judge(docs, [0] * quality_rules.BUCKETS).orderBy("doc_id").collect()
    for r, text in zip(found, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(text), text[:50]
        assert r.score == 0 and r.kept == (not r.base_failed)


def test_ratios_and_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    ratios = quality_rules.fit_ratios(docs, labels.filter("quality = 1").select("doc_id"))
    grams = docs.select("doc_id", quality_rules._buckets(quality_rules.ngrams_of(F.col("text"))).alias("b")).collect()
    raw, trusted = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for r in grams:
        np.add.at(raw, r.b, 1)
        if r.doc_id in good:
            np.add.at(trusted, r.b, 1)
    want = np.round(1e6 * np.log(trusted / trusted.sum() * raw.sum() / raw))
    assert np.abs(want - ratios).max() <= 1
    scores = {r.doc_id: r for r in quality_rules.judge(docs, ratios).collect()}
    for r in grams:
        assert abs(scores[r.doc_id].score - sum(ratios[b] for b in r.b) / 1e6 / max(1, len(r.b))) < 1e-9
    marked = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(scores[i].kept, q) for i, q in marked.items() if i in scores and not scores[i].base_failed]
    assert all(kept == (q == 1) for kept, q in judged)


def test_one_reading_gives_the_same_verdicts(spark, small, odd):
    labels = spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1").select("doc_id")
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        want = quality_rules.judge(docs, quality_rules.fit_ratios(docs, labels))
        assert Counter(map(tuple, quality_rules.fit_and_judge(docs, labels).collect())) == Counter(map(tuple, want.collect()))


def weighted_jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    return sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0


def test_fingerprints_follow_the_next_document(spark, odd):
    found = fingerprints.fingerprint_pairs(odd)
    found = found.select("*", fingerprints.likeness("fp", "edited_fp").alias("near_edited"), fingerprints.likeness("fp", "next_fp").alias("near_next")).collect()
    rows = sorted(((i, t or "") for i, t in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, errors = Counter(), []
    by_edit = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[(i, len(t), digest)] += 1
        by_edit[(i, digest)] = (weighted_jaccard(t, edited), weighted_jaccard(t, nxt))
    assert Counter((r.doc_id, r.n_chars, r.edited) for r in found) == want
    for r in found:
        a, b = by_edit[(r.doc_id, r.edited)]
        errors += [r.near_edited - a, r.near_next - b]
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12
    prints = {}
    for r in found:
        prints.setdefault(r.doc_id, set()).add(tuple(r.fp))
    assert prints[0] == prints[25] == prints[26] and prints[20] == prints[21] == prints[22] and len(prints[0]) == 1


def test_one_document_follows_itself(spark):
    r = fingerprints.fingerprint_pairs(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id bigint, text string")).first()
    assert r.edited == hashlib.sha256(b"a b c d e f a b").hexdigest() and r.next_fp == r.fp


def test_secrets_are_found_and_masked(spark, odd):
    forest = secrets.train(spark)
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'a token = "{key}" b', f"commit {key} done", "card 4785380592391139 x", None, "", f'token="{key}" api_key: Zk3' + "Qw8rT2yU6iO1pA5sD9fG" + " é", "see src/main/test/data/config1/file2 ok", "9" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.scan(docs, forest).collect()
    for r in found:
        assert texts[r.doc_id][r.start : r.start + r.length] == r.candidate
    assert sorted((r.doc_id, r.start) for r in found if r.secret) == [(0, 11), (5, 7), (5, 58)]
    assert {r.doc_id for r in found} >= {1, 2, 7}
    masked = [r.text for r in secrets.redact(docs, forest).orderBy("doc_id").collect()]
    assert masked[0] == 'a token = "[SECRET]" b' and masked[1] == texts[1] and masked[3] == "" and masked[5] == 'token="[SECRET]" api_key: [SECRET] é'
    assert secrets.redact(odd, forest).columns == odd.columns and secrets.redact(odd, forest).count() == odd.count()


def test_short_and_lettered_secrets_after_key_words(spark):
    forest = secrets.train(spark)
    planted = {'password = "hunter2Xy!" ok': "hunter2Xy!", "oauth2_client_secret=Zk3Qw8rT2yU6iO1pA5sD9f next": "Zk3Qw8rT2yU6iO1pA5sD9f", 'secret="p@ss:w0rd#1"': "p@ss:w0rd#1", "key qWeRtYuIoPaSdFgHjKlZxCvB done": "qWeRtYuIoPaSdFgHjKlZxCvB"}
    plain = ["password: everything is", "auth: https://host.example/path/main", "see getUserNameFromTableColumn()", "api_key = abcdefgh", "the secret garden: a token of esteem"]
    docs = spark.createDataFrame(list(enumerate([*planted, *plain])), "doc_id bigint, text string")
    found = {(r.doc_id, r.candidate) for r in secrets.scan(docs, forest).filter("secret").collect()}
    assert found == set(enumerate(planted.values()))


def test_secrets_planted_in_documents(spark, small):
    """Recall and precision of drawn secrets at drawn places of documents that hold none."""
    forest, draw = secrets.train(spark), np.random.default_rng(8)
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect() if not re.search("token|secret|password|key", r.text or "")]
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    rows, want = [], set()
    for r in docs:
        words, key = r.text.split(" "), "".join(draw.choice(letters, int(draw.integers(20, 48))))
        at = int(draw.integers(0, len(words) + 1))
        lead = ["api_key = ", "password: ", "AUTH_TOKEN=", 'client_secret: "'][r.doc_id % 4]
        if r.doc_id % 2:
            words.insert(at, lead + key + ('"' if lead.endswith('"') else ""))
            want.add((r.doc_id, key))
        else:
            words.insert(at, ["commit ", "sha1: ", "md5 "][r.doc_id % 3] + "".join(draw.choice(list("0123456789abcdef"), 40)))
        rows.append((r.doc_id, " ".join(words)))
    found = {(r.doc_id, r.candidate) for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), forest).filter("secret").collect()}
    assert len(want) > 40 and len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.9 * len(found)


def test_very_many_candidates(spark):
    forest, one = secrets.train(spark), "id=9f86d081884c7d659 é "
    docs = spark.createDataFrame([(1, one * 3000)], "doc_id bigint, text string")
    found = sorted(r.start for r in secrets.scan(docs, forest).collect())
    assert found == [3 + len(one) * k for k in range(3000)]


def test_redact_keeps_columns_of_any_name(spark):
    forest = secrets.train(spark)
    docs = spark.createDataFrame([(1, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "a", "b", "c", "d")], "doc_id bigint, text string, __pieces string, __found string, __candidates string, __SEEN string")
    (r,) = secrets.redact(docs, forest).collect()
    assert r.text == 'token = "[SECRET]"' and tuple(r)[2:] == ("a", "b", "c", "d")


def test_forest_on_held_out_findings(spark):
    forest = secrets.train(spark)
    fresh = secrets.labelled_findings(400, seed=99)
    docs = spark.createDataFrame([(k, r["before"] + r["candidate"] + r["after"]) for k, r in enumerate(fresh)], "doc_id bigint, text string")
    found = {(r.doc_id, r.candidate): r.secret for r in secrets.scan(docs, forest).collect()}
    judged = [(found[k, r["candidate"]], r["label"]) for k, r in enumerate(fresh) if (k, r["candidate"]) in found]
    assert len(judged) > 300 and np.mean([s == bool(y) for s, y in judged]) > 0.95


def test_archive_round_trip(spark):
    pages = [(1, "http://a", "x"), (2, "http://b", "x"), (9, "http://c", "x"), (3, None, None), (4, "u", ""), (5, "é\r\n", "é" * 9000), (5, "é\r\n", "é" * 9000), (None, "n", "x"), (7, "w", "y"), (7, "w", "z")]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id bigint, url string, html string, key int, sha256 string")
    found = warc.round_trip(df)
    rows = found.collect()
    assert all(r.intact for r in rows) and len(rows) == len(pages)
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in rows) == Counter((i, h or "") for i, _, h in pages)
    for r in rows:
        assert r.stated_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert {(9, "response", None), (1, "revisit", 9), (2, "revisit", 9), (None, "revisit", 9), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "revisit", 5)} <= kinds
    small_ones = warc.round_trip(df, min_bytes=2)
    assert {(r.page_id, r.record_type) for r in small_ones.collect() if r.page_id in (1, 2, 3, 9)} == {(i, "response") for i in (1, 2, 3, 9)}
    record = next(bytes(r.record) for r in warc.records(found).collect() if r.page_id == 9)
    head, body = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and body == b"x\r\n\r\n" and re.search(rb"Content-Length: 1$", head)


def test_records_are_rebuilt_and_checked(spark):
    from duespark.llm.scratch import fresh_path

    pages = [(1, "http://a/%0A", "x"), (2, "http://b\r\n", "x"), (9, "http://c", "x"), (3, None, None), (5, "é\n", "é\r\n\r\n" * 900), (None, "n", "x"), (5, "é\n", "é\r\n\r\n" * 900)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for least in (0, 2):
        rows = warc.checked_round_trip(df, least).collect()
        assert all(r.intact for r in rows)
        want = Counter((i, u or "", len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, u, h in pages)
        assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in rows) == want
        assert Counter((r.record_type, r.refers_to) for r in rows if r.payload_bytes == 1) == (Counter({("revisit", 9): 3, ("response", None): 1}) if least < 2 else Counter({("response", None): 4}))
    path = fresh_path(spark, "warc")
    warc.write_archive(df, path, date="2024-01-31T12:00:00Z")
    heads = [bytes(r.header).decode() for r in warc.read_headers(spark, path).collect()]
    assert len(heads) == len(pages) and all("\r\nWARC-Date: 2024-01-31T12:00:00Z\r\n" in h and h.count("\r\n\r\n") == 1 for h in heads)


def test_query_of_the_archive(spark, small):
    from duespark.llm.queries import QUERIES

    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()
    last = {}
    for r in pages:
        last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    want = set()
    for r in pages:
        raw, first = (r.html or "").encode(), last[r.html or ""] == r.page_id
        want.add((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last[r.html or ""]))
    found = QUERIES["op6_warc"](spark, small).drop("intact").collect()
    assert len(found) == len(pages) and {tuple(r) for r in found} == want


def test_payloads_are_stored_once(spark):
    from duespark.llm.scratch import fresh_path

    df = spark.createDataFrame([(k, f"u{k}", "same" if k % 3 else f"own {k}") for k in range(60)], "page_id bigint, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 21 and spark.read.parquet(f"{path}/headers").count() == 60


def test_empty_tables(spark, empty):
    assert quality_rules.judge(empty, [0] * quality_rules.BUCKETS).count() == 0
    assert len(quality_rules.fit_ratios(empty, empty.select("doc_id"))) == quality_rules.BUCKETS
    assert fingerprints.fingerprint_pairs(empty).count() == 0
    assert secrets.scan(empty, secrets.grow_forest(np.zeros((4, len(secrets.NAMES))), np.array([0, 1, 0, 1]))).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
