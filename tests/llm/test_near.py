"""The n-gram join and substring dedup against brute force."""

from collections import Counter

import numpy as np
import pytest

from duespark.llm import groups, ngram_join, shingles, substring_dedup

from .conftest import odd_rows, words
from .conftest import shingles as sets


def union(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def brute_links(rows):
    s = [sets(t) for _, t in rows]
    out = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(s[a] & s[b])
            if (rows[a][1] or "") == (rows[b][1] or "") or both and both >= 0.8 * (len(s[a]) + len(s[b]) - both) - 1e-9:
                out.append((a, b))
    return out


@pytest.mark.parametrize("chunk", [2000, 3])
def test_links_and_classes(odd, chunk, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIGNATURE_CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "SHINGLE_CHUNK", chunk)
    rows = odd_rows()
    pairs = brute_links(rows)
    links = Counter(x for p in pairs for x in p)
    label = union(len(rows), pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = Counter((i, least.get(label[k]), links[k]) for k, (i, _) in enumerate(rows))
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(odd).collect())
    assert found == want


def test_pruning_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(0)
    sig = draw.integers(0, 1 << 32, (2000, 63), dtype=np.uint32)
    same = draw.random((1000, 63)) < 0.8
    sig[1000:][same] = sig[:1000][same]
    a, _ = ngram_join.prune(sig, np.arange(1000), np.arange(1000, 2000), 0.8, 1e-6)
    assert len(a) == 1000
    a, _ = ngram_join.prune(sig, np.arange(0, 999), np.arange(1, 1000), 0.8, 1e-6)
    assert len(a) == 0


def test_shingle_hashes_name_shingles():
    import pyarrow as pa

    texts = ["a b c d e f", "b c d e f", "", "a b", "a b", " a\tb c d e f ", "x a b c d e"]
    found = []
    for _, data, offsets in shingles.text_chunks(pa.array(texts)):
        start, end, row = shingles.words(data, offsets)
        h, of = shingles.shingle_hashes(shingles.span_hashes(data, start, end), row)
        found += [set(h[of == k].tolist()) for k in range(len(texts))]
    assert [len(x) for x in found] == [2, 1, 0, 1, 1, 2, 2]
    assert found[0] == found[5] and found[3] == found[4] and found[1] < found[0] and len(found[0] & found[6]) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(200, 200), (7, 1)]
    found = {r.node: r.root for r in groups.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 40)}}


def test_removed_paragraphs(odd):
    rows = sorted({(i, t or "") for i, t in odd_rows() if i is not None})
    units = [(i, k, line) for i, t in rows for k, line in enumerate(t.split("\n")) if len(words(line)) >= substring_dedup.MIN_WORDS]
    s = [sets(line) for _, _, line in units]
    pairs = [(a, b) for a in range(len(units)) for b in range(a + 1, len(units)) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9]
    gone = {units[k][:2] for k, root in enumerate(union(len(units), pairs)) if root != k}
    found = substring_dedup.remove_repeats(odd.filter("doc_id IS NOT NULL")).collect()
    assert len(found) == sum(i is not None for i, _ in odd_rows())
    texts = dict(rows)
    for r in found:
        assert r.text == "\n".join(line for k, line in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone)
        assert r.n_removed == sum(i == r.doc_id for i, _ in gone) and r.lang == "en"
    assert {r.doc_id for r in found if r.n_removed} >= {31, 32, 25}


def test_empty_tables(empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_plans_have_no_product_of_rows(odd, monkeypatch):
    """No step joins every row with every other."""
    plans = []
    keep = ngram_join.write_table
    for module in (ngram_join, substring_dedup, groups):
        monkeypatch.setattr(module, "write_table", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, label))[1])
    ngram_join.near_duplicates(odd).count()
    substring_dedup.remove_repeats(odd).count()
    assert len(plans) > 10 and not any("Cartesian" in p or "NestedLoop" in p for p in plans)


def test_scratch_follows_the_session(spark):
    from duespark.llm import scratch

    class Named:
        conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
        sparkContext = spark.sparkContext

    assert scratch.shared_dir(Named) == "hdfs://x/y"
    assert scratch.fresh_path(Named, "t").startswith("hdfs://x/y/duespark/")
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)
