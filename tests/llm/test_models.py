"""The quality classifier, the language model and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duespark.llm import lm_score, quality
from duespark.llm.queries import BYTE_BPE, QUERIES

from .conftest import odd_rows, words


@pytest.fixture(autouse=True, scope="module")
def quick():
    """A smaller language model, for time."""
    patch = pytest.MonkeyPatch()
    patch.setattr(lm_score, "STEPS", 60)
    patch.setattr(lm_score, "HEAD", 50)
    yield
    patch.undo()


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op4_quality_classifier"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    judged = [(r.predicted, marked[r.doc_id]) for r in found if r.held_out and r.doc_id in marked]
    assert len(judged) > 50 and np.mean([p == y for p, y in judged]) > 0.95


def test_classifier_on_odd_rows(spark, odd, empty):
    fitted = quality.SubwordClassifier()
    found = quality.score_rows(odd, fitted)
    assert found.count() == odd.count() and sorted(found.columns) == sorted(odd.columns)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[20] == by_id[21] == by_id[22] and by_id[26][0] == by_id[26][1] == by_id[25][0]
    assert quality.score(empty, fitted).count() == 0
    labels = spark.createDataFrame([(0, 1), (28, 0), (None, 1), (1, None)], "doc_id bigint, label int")
    assert quality.score(odd, quality.train(odd, labels)).count() == odd.count()
    assert quality.train(empty, labels.limit(0)) is not None


def brute_features(text):
    w = words(text)
    return sum(1 + sum(max(0, len(x) + 2 - n + 1) for n in quality.GRAMS) for x in w) + max(0, len(w) - 1)


def test_features_are_counted_whole(spark):
    texts = ["the cat é sat the the", "", "ab", "long " * 3000]
    df = spark.createDataFrame([(1, t) for t in texts], "label int, text string")
    assert sorted(int(quality.wide(bytes(r.counts)).sum()) for r in quality._features(df).collect()) == sorted(map(brute_features, texts))


def test_base_scores(spark, odd):
    held = lambda c: quality.fold(c, 7) == 2
    found = lm_score.score(odd, BYTE_BPE, held).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts, want = Counter(), Counter()
    for i, t in odd_rows():
        if crc(i) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in odd_rows():
        w = tokens(t)
        want[(i, crc(i) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


CORPUS = ["the cat sat on the mat, the end", "a cat, the cat; catalogue of cats", "é the théâtre naïve", "on and on the mat the rat", "the, the; the"]


def test_scores_of_one_word_texts_sum_to_at_most_one(spark):
    found = {w for t in CORPUS for w in t.split()}
    asked = sorted(found | {w[:k] for w in found for k in range(1, len(w))} | {w + c for w in found for c in "s,;."} | {""})
    docs = spark.createDataFrame([*enumerate(CORPUS), *enumerate(asked, 1000)], "doc_id bigint, text string")
    rows = lm_score.score(docs, BYTE_BPE, lambda c: c >= 1000).filter("held_out").collect()
    assert len(rows) == len(asked) and 0.05 < sum(10**r.score for r in rows) <= 1


def test_scores_from_single_ids(spark):
    """The score anew from the probabilities of all ids at each place, which say how likely a word opens there."""
    learn = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    asked = ["the cat", "zebra! the mat,", ""]
    docs = learn.union(spark.createDataFrame(list(enumerate(asked, 1000)), learn.schema))
    words_of = lm_score.word_counts(learn).cache()
    scorer, compact = lm_score.fit(learn, words_of, BYTE_BPE)
    counts = {r.word and bytes(r.word): r.n for r in words_of.collect()}
    unit = sum(counts.values()) + len(counts) + 1
    enc, end = lm_score.encoder(BYTE_BPE), len(scorer.base) - 1
    spaced = [i for i, b in enc.bytes_of.items() if b[:1] == b" "]
    opening = Counter(compact[spaced].tolist()) + Counter([end])
    got = {r.doc_id: r.score for r in lm_score.score(docs, BYTE_BPE, lambda c: c >= 1000).collect()}
    for k, text in enumerate(asked):
        split = [*text.encode().lower().split(), None]
        ids = [[end] if w is None else [int(compact[i]) for i in enc.ordinary(" " + w.decode())] for w in split]

        def chances(before):
            return np.array([10 ** scorer.log10(np.array([*before, i], np.int32), np.array([len(before) + 1]))[-1] for i in range(end + 1)])

        def opens(before):
            p = chances(before)
            return sum(p[i] * n for i, n in opening.items())

        before, want = [], 0.0
        for w, own in zip(split, ids, strict=True):
            p = 1 / opens(before)
            for i in own:
                p *= chances(before)[i]
                before = [*before, i]
            p *= 1.0 if w is None else opens(before)
            want += math.log10(0.3 * (counts[w] + 1) / unit + 0.7 * p if w in counts else (0.3 / unit + 0.7) * p)
        assert abs(got[1000 + k] - want) < 1e-3 * max(1, abs(want)), text


def test_windows_score_each_place_once():
    lengths = np.array([1, 31, 32, 33, 56, 57, 500])
    first, end, skip = lm_score.window_index(lengths)
    seen = Counter(p for f, e, s in zip(first, end, skip, strict=True) for p in range(f + s, min(f + lm_score.WINDOW, e)))
    assert seen == Counter(range(lengths.sum()))


def test_model_is_causal_and_sums_to_one():
    draw = np.random.default_rng(0)
    m = lm_score.AttentionModel(np.full(12, 1 / 12))
    seqs = [draw.integers(0, 11, 40).astype(np.int32) for _ in range(30)]
    m.fit(seqs, steps=30)
    s = m.scorer()
    text = seqs[0][:9]
    total = 0.0
    for last in range(12):
        flat = np.append(text, last).astype(np.int32)
        total += 10 ** s.log10(flat, np.array([10]))[-1]
        assert np.allclose(s.log10(flat, np.array([10]))[:9], s.log10(text, np.array([9])))
    assert abs(total - 1) < 1e-4
    # The slow form used in training gives the same probabilities.
    shown = np.concatenate([[11], text[:-1]])[None, :]
    m2 = np.pad(shown, ((0, 0), (0, lm_score.WINDOW - 9)))
    *_, weights = m._states(m2)
    _, p = m._mix(weights[0, :9], text)
    assert np.allclose(np.log10(p), s.log10(text, np.array([9])), atol=1e-4)


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(1)
    m = lm_score.AttentionModel(np.full(9, 1 / 9), seed=2)
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64)
    ids, targets = draw.integers(0, 9, (2, lm_score.WINDOW)), draw.integers(0, 9, (2, lm_score.WINDOW))
    live = np.ones_like(ids, bool)
    grad, _ = m._gradients(ids, targets, live)

    def loss():
        *_, weights = m._states(ids)
        return -np.log(m._mix(weights, targets)[1]).mean()

    for k, at in (("q", (1, 2)), ("k", (0, 3)), ("v", (2, 2)), ("own", (0, 0)), ("gate", (3, 5)), ("emb", (int(ids[0, 0]), 4)), ("near", (2,)), ("bias", (1,))):
        kept = m.w[k][at]
        m.w[k][at] = kept + 1e-4
        up = loss()
        m.w[k][at] = kept - 1e-4
        down = loss()
        m.w[k][at] = kept
        assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-3 * max(1e-2, abs(grad[k][at])) + 2e-6, k


def test_empty_tables(empty):
    assert lm_score.score(empty, BYTE_BPE, lambda c: quality.fold(c, 7) == 2).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.write_table(stage(spark, before, sf), "stage")
        if name != "packing":
            assert after.columns == columns
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
            assert after.filter(F.length("text") != F.col("n_chars")).count() == 0 or name in ("quality classifier", "n-gram Jaccard join")
            before = after
        kept.append(after.count())
    assert kept[0] > kept[1] >= kept[2] == kept[3] == kept[4]
    assert before.filter("text LIKE '%token = \"%'").filter("text NOT LIKE '%[SECRET]%'").count() == 0
    assert after.select("doc_id").distinct().count() == kept[4]


def test_one_document_of_each_group_stays(spark, odd):
    """Near copies and repeated rows go; an id that no class has as its least goes too."""
    docs = odd.select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, None).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 3, 5, 20, 28, 29, 30, 31, 33} <= set(ids) and not {25, 26, 21, 24} & set(ids)
