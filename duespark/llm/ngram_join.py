"""Near-duplicate join of documents by Jaccard similarity of word shingles, with Bayesian pruning of MinHash candidates.

1. Equal texts become one node, with their number of copies.
2. Nodes that share a MinHash band meet. Their signatures are compared piece by piece; a pair is
   dropped once the posterior probability that its similarity reaches the threshold (uniform
   prior, hence a binomial tail) is below the tolerance. Survivors only join nodes into groups.
3. Each node's shingles go to its group once, or once for each pair of chunks of a large group.
   Pairs that survive the same pruning are verified exactly. Links are counted where they are
   found and only spanning edges leave the task, so no list of all pairs is ever made.
4. Components of the verified links are the classes.

The bands miss a pair at the threshold with a probability of 3e-7 (21 bands of 3), and the
tolerance is 1e-6, so practically no link is lost.

Defined results: a null text counts as empty; a text of one to four words is one shingle; a text
without words is only like other empty texts that equal it; equal texts are links of each other;
repeated rows and ids are documents of their own; a null id belongs to a class like any other;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duespark.llm.groups import connected_components, dealt, local_roots, pairs_within, whole_groups
from duespark.llm.scratch import broadcast_if, write_table
from duespark.llm.shingles import MinHash, row_starts, shingle_hashes, span_hashes, text_chunks, words

THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 21, 3
STEP = 9
#: Nodes that meet in one task at most, by signatures and by shingles.
SIGNATURE_CHUNK, SHINGLE_CHUNK = 2000, 500
#: Digests of grouped nodes up to this number are broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 300_000


@functools.cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values among n for which P(similarity >= threshold) is at least the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are left after comparing signatures STEP values at a time."""
    same = np.zeros(len(a), np.int32)
    for lo in range(0, sig.shape[1], STEP):
        hi = min(lo + STEP, sig.shape[1])
        same += (sig[a, lo:hi] == sig[b, lo:hi]).sum(1, dtype=np.int32)
        keep = same >= least_matches(hi, threshold, tolerance)
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def _sig_array(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(len(column), -1)


def signatures(rows: DataFrame, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """digest, sig of rows (digest, text); sig is null for texts without words."""

    def run(batches):
        maker = MinHash(bands, band_rows)
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                start, end, row = words(data, offsets)
                hashes, of = shingle_hashes(span_hashes(data, start, end), row)
                starts = row_starts(of)
                sig: list = [None] * (len(offsets) - 1)
                if len(starts):
                    for k, s in zip(of[starts].tolist(), maker.signatures(hashes, starts), strict=True):
                        sig[k] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sig)), batch.column(2).slice(first, len(sig)), pa.array(sig, pa.binary())], names=["digest", "doc_id", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("digest", "text", "doc_id").mapInArrow(run, f"digest binary, doc_id {kind}, sig binary")


def band_members(nodes: DataFrame, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """key, node, n for all bands that at least two nodes share."""

    def run(batches):
        maker = MinHash(bands, band_rows)
        for batch in batches:
            if batch.num_rows:
                keys = maker.band_keys(_sig_array(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["key", "node"])

    keys = nodes.filter("sig IS NOT NULL").select("node", "sig").mapInArrow(run, "key bigint, node bigint")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(shared, "key")


def likely_groups(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """node, root: components of the pairs that share a band and survive the pruning."""

    def run(batches):
        for table, starts in whole_groups(batches, ["key", "block_i", "block_j"]):
            sig, node = _sig_array(table.column("sig")), table.column("node").to_numpy()
            left, right = [], []
            for a, b in pairs_within(starts, table.num_rows, *(table.column(c).to_numpy() for c in ("chunk", "block_i", "block_j"))):
                a, b = prune(sig, a, b, threshold, tolerance)
                left.append(a), right.append(b)
            if left:
                root = local_roots(table.num_rows, np.concatenate(left), np.concatenate(right))
                out = np.unique(np.stack([node, node[root]], 1)[node != node[root]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    members = write_table(band_members(nodes), "bands")
    rows = dealt(members, "key", "n", SIGNATURE_CHUNK).join(nodes.select("node", "sig"), "node")
    rows = rows.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")
    return connected_components(rows.select("key", "block_i", "block_j", "chunk", "node", "sig").mapInArrow(run, "u bigint, v bigint"))


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(a) <= 24:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    flat = np.concatenate([sets[k] for k in used])
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, ident, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[ident] > 1
    renumber = np.cumsum(times > 1) - 1
    ident, row = renumber[ident[shared]], row[shared]
    out = np.zeros(len(a), np.int64)
    order = np.argsort(ident, kind="stable")
    ident, row = ident[order], row[order]
    for lo in range(0, int(times[times > 1].size), 4096):
        x, y = np.searchsorted(ident, [lo, lo + 4096])
        dense = np.zeros((len(used), 4096), np.float32)
        dense[row[x:y], ident[x:y] - lo] = 1
        out += (dense @ dense.T)[a, b].astype(np.int64)
    return out


def verified_links(grouped: DataFrame, threshold: float, candidates) -> DataFrame:
    """u, v, links: for a node the number of documents that it is linked with (v null), and spanning edges (links null).

    grouped: root, n, node, copies, sig, text. candidates(sig, a, b) gives the pairs to verify.
    """

    def sets(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            kept = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            for first, data, offsets in text_chunks(texts):
                start, end, row = words(data, offsets)
                hashes, of = shingle_hashes(span_hashes(data, start, end), row)
                cuts = np.searchsorted(of, np.arange(len(offsets)))
                made = [np.unique(hashes[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                part = batch.slice(first, len(made))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(made, pa.binary())], names=[*(batch.schema.names[k] for k in kept), "shingles"])

    def run(batches):
        for table, starts in whole_groups(batches, ["root", "block_i", "block_j"], 4_000):
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            sig = _sig_array(table.column("sig"))
            own = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            size = np.array([len(x) for x in own])
            links = np.zeros(len(node), np.int64)
            left, right = [], []
            for a, b in pairs_within(starts, len(node), *(table.column(c).to_numpy() for c in ("chunk", "block_i", "block_j"))):
                ok = node[a] != node[b]
                a, b = candidates(sig, a[ok], b[ok])
                cuts = np.append(np.searchsorted(a, starts), len(a)) if len(a) else np.zeros(1, np.int64)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if x < y:
                        p, q = a[x:y], b[x:y]
                        both = overlaps(own, p, q)
                        ok = both >= threshold * (size[p] + size[q] - both) - 1e-9
                        p, q = p[ok], q[ok]
                        np.add.at(links, p, copies[q])
                        np.add.at(links, q, copies[p])
                        left.append(p), right.append(q)
            if left:
                root = local_roots(len(node), np.concatenate(left), np.concatenate(right))
                edge, linked = np.flatnonzero(root != np.arange(len(node))), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[edge], node[linked]])), pa.array([*node[root[edge]].tolist(), *[None] * len(linked)], pa.int64()), pa.array([*[None] * len(edge), *links[linked].tolist()], pa.int64())],
                    names=["u", "v", "links"],
                )

    kept = "root bigint, n bigint, node bigint, copies bigint, sig binary"
    with_sets = grouped.select("root", "n", "node", "copies", "sig", "text").mapInArrow(sets, f"{kept}, shingles binary")
    rows = dealt(with_sets, "root", "n", SHINGLE_CHUNK).repartition("root", "block_i", "block_j").sortWithinPartitions("root", "block_i", "block_j", "node")
    return rows.mapInArrow(run, "u bigint, v bigint, links bigint")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, digest (MD5 of the text), class_id (the least id of its class), class_digest (the least digest of the texts of that id in the class), n_links (documents at the threshold or above, itself aside)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    known = write_table(signatures(rows), "signatures")
    nodes = known.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("sig").alias("sig"))
    nodes = write_table(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    groups = write_table(likely_groups(nodes, threshold, tolerance), "groups")
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    chosen = write_table(nodes.join(sized, "node").select("node", "root", "n", "digest", "copies", "least", "sig"), "grouped")
    # One document brings the text of each node; with a repeated id and text there may be more, which the verification ignores.
    keys = broadcast_if(chosen.select("digest", F.col("least").alias("doc_id_least")), BROADCAST_NODES)
    texts = rows.join(keys, "digest").filter(F.col("doc_id").eqNullSafe(F.col("doc_id_least"))).select("digest", "text").dropDuplicates(["digest"])
    likely = functools.partial(prune, threshold=threshold, tolerance=tolerance)
    links = write_table(verified_links(chosen.drop("least").join(texts, "digest"), threshold, likely), "links")

    roots = connected_components(links.filter("v IS NOT NULL").select("u", "v"))
    counts = links.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    classed = nodes.select("node", "digest", "copies", "least").join(roots, "node", "left").join(counts, "node", "left")
    classed = classed.withColumn("root", F.coalesce("root", "node"))
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("without"), "least", "digest")).alias("first"))
    facts = classed.join(first, "root").select("digest", F.col("first.least").alias("class_id"), F.col("first.digest").alias("class_digest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return known.select("doc_id", "digest").join(facts, "digest").select("doc_id", "digest", "class_id", "class_digest", "n_links")
