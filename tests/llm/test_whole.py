"""Whole results: cases in which less than the whole job was done before."""

import random

import corpus_pipeline
from duespark.llm import lm_score, quality, substring_dedup
from duespark.llm.queries import BYTE_BPE

from .conftest import SCHEMA, prose, words


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t) if t else None, 0.5, "n", 7) for i, t in rows], SCHEMA)


def near(text, word="zz"):
    w = text.split()
    w[len(w) // 2] = word
    return " ".join(w)


def test_only_the_row_judged_a_duplicate_goes(spark):
    """A repeated id with a unique and a copied text, near copies of one id, and near copies with null ids."""
    draw = random.Random(1)
    a, b, c, d, e = (prose(draw, 120) for _ in range(5))
    rows = [(1, a), (7, b), (7, a), (7, near(a)), (7, b), (8, c), (8, near(c)), (None, near(c, "yy")), (None, d), (None, near(d)), (None, e)]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows).select(*corpus_pipeline.COLUMNS), None).collect()]
    assert len(kept) == 5 and {(1, a), (7, b), (None, e)} <= set(kept)
    assert len({(8, c), (8, near(c))} & set(kept)) == 1 and len({(None, d), (None, near(d))} & set(kept)) == 1


def test_passages_over_lines_and_inside_lines(spark):
    """Planted passages of over 50 words as short lines, inside longer lines, and at the edges; short lines that repeat."""
    draw = random.Random(2)
    p, q, s, t = (prose(draw, n).split() for n in (60, 52, 50, 49))
    short = prose(draw, 9)
    own = lambda n: prose(draw, n)
    lines = lambda w: "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))
    rows = [
        (1, f"{own(80)} {' '.join(p)} {own(30)}\n{short}\n{own(20)}"),
        (2, f"{own(20)}\n{lines(p)}\n{own(12)}"),
        (3, f"{own(70)} {' '.join(p)}\n{own(90)} {' '.join(q)} {own(70)}"),
        (4, f"{' '.join(q)} {own(100)} {' '.join(s)}"),
        (5, f"{lines(s)} {own(40)} {' '.join(t)} {own(40)}\n{short}"),
        (6, f"é日 {own(90)} {' '.join(t)} {own(90)} {' '.join(q)}"),
        (None, own(60)),
    ]
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    # Brute force over the lines that are left: every run of 50 words that an earlier document has.
    seen, want = {}, {}
    for i, text in sorted(rows[:-1]):
        w = words(text if i != 5 else text.removesuffix("\n" + short))
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {x for k, r in enumerate(runs) if r in seen for x in range(k, k + 50)}
        want[i] = [x for k, x in enumerate(w) if k not in gone]
        for r in runs:
            seen.setdefault(r, i)
    assert {i: words(found[i].text) for i in want} == want and found[None].text == rows[-1][1]
    assert {i: (r.n_removed, r.kept_in) for i, r in found.items()} == {None: (0, []), 1: (0, []), 2: (1, [1]), 3: (1, [1]), 4: (1, [3]), 5: (2, [1, 4]), 6: (1, [3])}
    assert found[2].text == rows[1][1].replace(lines(p) + "\n", "") and found[6].text.endswith(" ") and found[6].text.startswith("é日 ")


def test_experts_learn_from_every_document(spark, monkeypatch):
    """The expectation step's sums hold each id to learn from, whatever the ids of the documents."""
    monkeypatch.setattr(lm_score, "STEPS", 20)
    draw = random.Random(3)
    learn = frame(spark, [(7, prose(draw, 40)) for _ in range(9)] + [(i, prose(draw, 40)) for i in (None, 1, 2, 3)]).select("doc_id", "text")
    seen = []
    settle = lm_score.AttentionModel.settle
    monkeypatch.setattr(lm_score.AttentionModel, "settle", lambda self, *a: (seen.append(self.sums.sum()), settle(self, *a))[1])
    fitted = []
    fit = lm_score.AttentionModel.fit
    monkeypatch.setattr(lm_score.AttentionModel, "fit", lambda self, *a: (fit(self, *a), fitted.append(self.sums.sum()))[0])
    words = lm_score.write_table(lm_score.word_counts(learn), "words")
    n_ids = lm_score.id_counts(words, BYTE_BPE).sum() + 13
    lm_score.fit(learn, words, BYTE_BPE)
    assert abs(seen[-1] - lm_score.FIT_WEIGHT * fitted[-1] - n_ids) < 1e-3 * n_ids


def test_attention_learns_from_every_document(spark, monkeypatch):
    """Each of 1,600 documents has an id of its own, whose embedding only that document can move; the start may see few words."""
    monkeypatch.setattr(lm_score, "STEPS", 1)
    monkeypatch.setattr(lm_score, "START_WORDS", 1, raising=False)
    enc = lm_score.encoder(BYTE_BPE)
    own = [b for b in sorted(enc.bytes_of.values()) if b[:1] == b" " and len(b) > 4 and b[1:].isalpha() and b.islower() and b.isascii() and len(enc.ordinary(b.decode())) == 1][:1600]
    learn = frame(spark, [(i, b.decode()) for i, b in enumerate(own)]).select("doc_id", "text").repartition(3)
    kept = []
    begin = lm_score.Scorer.__init__
    monkeypatch.setattr(lm_score.Scorer, "__init__", lambda self, model, *a: (begin(self, model, *a), kept.append(model))[0])
    lm_score.fit(learn, lm_score.write_table(lm_score.word_counts(learn), "words"), BYTE_BPE)
    moved = (kept[-1].w["emb"] != lm_score.AttentionModel(kept[-1].base).w["emb"]).any(1)
    assert len(own) == 1600 and len(moved) == 1602 and moved[:1600].all()


def test_one_id_on_many_rows_keeps_the_sample(spark, monkeypatch):
    """A labelled id on a third of the rows: at most `sample` documents reach the driver, each text once."""
    draw = random.Random(4)
    rows = [(7, prose(draw, 8)) for _ in range(400)] + [(7, "the same text")] * 300 + [(i, prose(draw, 8)) for i in range(100, 900)] + [(None, "x")]
    labels = spark.createDataFrame([(7, 1), (7, 0), (101, 0), (102, 1), (None, 1), (103, None)], "doc_id bigint, label int")
    seen = []
    monkeypatch.setattr(quality.SubwordClassifier, "fit", lambda self, rows: (seen.append(rows), self)[1])
    docs = frame(spark, rows)
    for sample in (10, 100):
        quality.train(docs, labels, sample)
        assert len(seen[-1]) == sample
    quality.train(docs, labels)
    assert len(seen[-1]) == 2 * 401 + 2 and [r[0] for r in seen[-1]].count(1) == 402
