"""Removal of paragraphs that repeat, exactly or nearly, and of passages that another document has word for word.

A paragraph is a line of at least MIN_WORDS words, as many as a shingle has. Equal paragraphs become
one node. MinHash bands, tuned so that a pair at the threshold is missed with a probability of at most
1e-4, bring nodes together; nodes that share a band are verified by exact Jaccard similarity of
their five-word shingles; components of the verified pairs are clusters. Of each cluster the
occurrence with the least (id, line) stays and all others are removed.

Of what is left, each run of PASSAGE words that a document with a lesser (id, MD5 of the text) has is
removed, wherever the lines break and whatever surrounds it. Only runs around shared anchors are
compared: of every SPAN consecutive runs of ANCHOR words the one of the least hash is an anchor, so two
equal runs of PASSAGE words always share one. None is missed; two unequal runs are taken for
one another only if their 64-bit hashes are equal.

Defined results: a null text counts as empty and comes back empty; texts without repeats come
back as they are; rows alike in id and text count as one document; of equal ids with different
texts the text's MD5 decides the order; a null id sorts first; an empty table gives no rows.
A passage inside a line that repeats within one document only stays, as does one embedded in a line that is
like another but not equal to it. With a removed passage goes the white space after it, up to a line's end.
Columns other than the id and the text pass through unread, whatever their names; only columns called
n_removed or kept_in are replaced. Ids may be of any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duespark.llm.groups import connected_components
from duespark.llm.ngram_join import verified_links
from duespark.llm.scratch import broadcast_if, unused, write_table
from duespark.llm.shingles import WIDTH, MinHash, anchors, bands_for, row_starts, run_hashes, shingle_hashes, span_hashes, text_chunks, words

THRESHOLD = 0.8
MIN_WORDS = WIDTH
#: Words of a passage and of an anchor; SPAN runs of ANCHOR words make up a passage.
PASSAGE, ANCHOR = 50, 25
SPAN = PASSAGE - ANCHOR + 1
BAND_ROWS = 4
RECALL = 1 - 1e-4
#: Rows of broadcast sides (clusters, candidate paragraphs, documents with removals), each of about 100 bytes.
BROADCAST_ROWS = 400_000


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, line, digest, paragraph of rows (doc_id, text); lines too short in characters are left out."""
    lines = docs.select("doc_id", F.unhex(F.md5("text")).alias("doc_key"), F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    return lines.filter(F.length("paragraph") >= 2 * MIN_WORDS - 1).select("doc_id", "doc_key", "line", F.unhex(F.md5("paragraph")).alias("digest"), "paragraph")


def banded(units: DataFrame, maker_args: tuple[int, int]) -> DataFrame:
    """Adds the band keys and drops the text and paragraphs of too few words."""

    def run(batches):
        maker = MinHash(*maker_args)
        for batch in batches:
            texts, rest = batch.column(batch.num_columns - 1), batch.columns[:-1]
            for first, data, offsets in text_chunks(texts):
                start, end, row = words(data, offsets)
                enough = np.bincount(row, minlength=len(offsets) - 1) >= MIN_WORDS
                hashes, of = shingle_hashes(span_hashes(data, start, end), row)
                long = enough[of] if len(of) else np.zeros(0, bool)
                hashes, of = hashes[long], of[long]
                starts = row_starts(of)
                if len(starts):
                    keys = maker.band_keys(maker.signatures(hashes, starts))
                    at = pa.array(of[starts] + first)
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in rest), pa.array([k.tobytes() for k in keys], pa.binary())], names=["doc_id", "doc_key", "line", "digest", "sig"])

    kind = units.schema["doc_id"].dataType.simpleString()
    return units.mapInArrow(run, f"doc_id {kind}, doc_key binary, line int, digest binary, sig binary")


def share_band(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.ascontiguousarray(sig).view(np.int64)
    hit = (keys[a] == keys[b]).any(1)
    return a[hit], b[hit]


def colliding_groups(nodes: DataFrame) -> DataFrame:
    """node, root: components of the nodes that share bands."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    keys = nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")
    # A band's members link to its least one, which pre-aggregation finds; no band is gathered.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    return connected_components(keys.join(shared, "key").select(F.col("node").alias("u"), F.col("least").alias("v")))


def repeats(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, doc_key, line, kept_in, cluster: the paragraphs of rows (doc_id, text) to remove, and the document that keeps one of their cluster."""
    bands = bands_for(threshold, BAND_ROWS, RECALL)
    units = write_table(banded(paragraphs(docs), (bands, BAND_ROWS)), "paragraphs")
    place = F.struct("doc_id", "doc_key", "line")
    nodes = units.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"), F.max("sig").alias("sig"))
    nodes = write_table(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    groups = write_table(colliding_groups(nodes), "groups")
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    chosen = write_table(sized.join(nodes.select("node", "digest", "sig"), "node").withColumn("copies", F.lit(1).cast("bigint")), "grouped")
    keys = broadcast_if(chosen.select("digest"), BROADCAST_ROWS)
    texts = paragraphs(docs).select("digest", F.col("paragraph").alias("text")).join(keys, "digest").dropDuplicates(["digest"])
    links = verified_links(chosen.join(texts, "digest"), threshold, share_band)
    roots = write_table(connected_components(links.filter("v IS NOT NULL").select("u", "v")), "clusters")

    clustered = nodes.join(roots, "node", "left").withColumn("cluster", F.coalesce("root", "node"))
    clustered = clustered.filter("times > 1 OR root IS NOT NULL").select("digest", "cluster", "first")
    keeper = clustered.groupBy("cluster").agg(F.min("first").alias("keeper"))
    clustered = write_table(clustered.join(keeper, "cluster").select("digest", "cluster", "keeper"), "clustered")
    found = units.drop("sig").join(broadcast_if(clustered, BROADCAST_ROWS), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("doc_key") == F.col("keeper.doc_key")) & (F.col("line") == F.col("keeper.line"))
    return found.filter(~kept).select("doc_id", "doc_key", "line", F.col("keeper.doc_id").alias("kept_in"), "cluster").distinct()


def each_text(batch: pa.RecordBatch):
    """Chunks of a batch whose last column is the text: first row, bytes, offsets, and the words' start, end, row and hashes."""
    for first, data, offsets in text_chunks(batch.column(batch.num_columns - 1)):
        start, end, row = words(data, offsets)
        yield first, data, offsets, start, end, row, span_hashes(data, start, end)


def shared_anchors(texts: DataFrame) -> DataFrame:
    """doc, places: of each document of rows (doc, doc_id, doc_key, text) the places of the anchors that another has too."""

    def run(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for first, _, _, _, _, row, hashes in each_text(batch.select(["doc", "text"])):
                found, at = run_hashes(hashes, row, ANCHOR)
                chosen = anchors(found, at, SPAN)
                found, at = found[chosen], at[chosen]
                of = row[at]
                place = at - np.searchsorted(row, of)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(docs[first + of]), pa.array(place.astype(np.int32))], names=["anchor", "doc", "place"])

    found = write_table(texts.select("doc", "text").mapInArrow(run, "anchor bigint, doc bigint, place int"), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("anchor")
    shared = broadcast_if(write_table(shared, "shared"), BROADCAST_ROWS)
    return write_table(found.join(shared, "anchor").groupBy("doc").agg(F.collect_set("place").alias("places")), "places")


def windows(texts: DataFrame) -> DataFrame:
    """window, doc, doc_id, doc_key, place: the runs of PASSAGE words around the places of rows (doc, doc_id, doc_key, places, text)."""

    def run(batches):
        for batch in batches:
            places = batch.column(3)
            for first, _, offsets, _, _, row, hashes in each_text(batch):
                n = len(offsets) - 1
                begin = np.searchsorted(row, np.arange(n))
                here = places.slice(first, n)
                of = np.repeat(np.arange(n), here.value_lengths().to_numpy())
                at = begin[of] + here.flatten().to_numpy()
                near = np.zeros(len(row) + 1, np.int32)
                # A window holds an anchor if it starts at it or at most SPAN - 1 words before it, in the same text.
                np.add.at(near, np.maximum(at - SPAN + 1, begin[of]), 1)
                np.add.at(near, at + 1, -1)
                found, start = run_hashes(hashes, row, PASSAGE)
                asked = np.cumsum(near)[start] > 0
                found, start = found[asked], start[asked]
                take = pa.array(row[start] + first)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(batch.column(k).take(take) for k in range(3)), pa.array((start - begin[row[start]]).astype(np.int32))], names=["window", "doc", "doc_id", "doc_key", "place"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc", "doc_id", "doc_key", "places", "text").mapInArrow(run, f"window bigint, doc bigint, doc_id {kind}, doc_key binary, place int")


def pieces_left(text: str, spans: np.ndarray, removed: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """(first character, length) of what is left without the removed words, and the number of runs removed. spans: the words' bytes."""
    data = text.encode()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    left, last = [], 0
    for x, y in edge.reshape(-1, 2).tolist():
        lo, hi = int(spans[x, 0]), int(spans[y, 0]) if y < len(spans) else len(data)
        tail = data[spans[y - 1, 1] : hi]
        if b"\n" in tail and lo and data[lo - 1 : lo] != b"\n":
            hi = int(spans[y - 1, 1]) + tail.index(b"\n")
        left.append((last, lo))
        last = hi
    left.append((last, len(data)))
    chars = lambda k: len(data[:k].decode())
    return [(chars(lo) + 1, chars(hi) - chars(lo)) for lo, hi in left if lo < hi], len(edge) // 2


def passages(texts: DataFrame) -> DataFrame:
    """doc_id, doc_key, pieces (of the text, to keep), n, kept_in: the documents of rows (doc_id, doc_key, text) that lose passages."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = texts.withColumn("doc", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "doc_key"))
    places = broadcast_if(shared_anchors(texts), BROADCAST_ROWS)
    found = write_table(windows(texts.join(places, "doc")), "windows")
    first = found.groupBy("window").agg(F.min(F.struct("doc_id", "doc_key")).alias("first"), F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b")
    again = found.join(first.select("window", "first"), "window")
    again = again.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_key") == F.col("first.doc_key"))))
    gone = write_table(again.groupBy("doc").agg(F.array_sort(F.collect_set("place")).alias("places"), F.collect_set(F.struct("first.doc_id")).alias("kept_in")), "passages")

    def run(batches):
        for batch in batches:
            out = []
            for first, _, offsets, start, end, row, _ in each_text(batch):
                for k in range(len(offsets) - 1):
                    lo, hi = np.searchsorted(row, [k, k + 1])
                    cover = np.zeros(hi - lo + 1, np.int32)
                    at = np.array(batch.column(2)[first + k].as_py())
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + PASSAGE, -1)
                    spans = np.stack([start[lo:hi], end[lo:hi]], 1) - offsets[k]
                    out.append(pieces_left(batch.column(4)[first + k].as_py(), spans, np.cumsum(cover[:-1]) > 0))
            pieces = pa.array([[{"at": x, "len": n} for x, n in p] for p, _ in out], pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pieces, pa.array([n for _, n in out], pa.int32()), batch.column(3)], names=["doc_id", "doc_key", "pieces", "n", "kept_in"])

    cut = texts.join(broadcast_if(gone, BROADCAST_ROWS), "doc").dropDuplicates(["doc"])
    cut = cut.select("doc_id", "doc_key", "places", F.transform("kept_in", lambda x: x["doc_id"]).alias("kept_in"), "text")
    return write_table(cut.mapInArrow(run, f"doc_id {kind}, doc_key binary, pieces array<struct<at: int, len: int>>, n int, kept_in array<{kind}>"), "pieces")


def remove_repeats(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cut, and n_removed (paragraphs and passages) and kept_in (ids of the documents that keep the removed ones)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_, key, lines, kept, own, pieces, n, too = (unused(docs, f"__{k}") for k in ("id", "key", "lines", "kept", "own", "pieces", "n", "too"))
    cut = repeats(plain, threshold).groupBy(F.col("doc_id").alias(id_), F.col("doc_key").alias(key)).agg(F.collect_set("line").alias(lines), F.array_sort(F.collect_set("kept_in")).alias(kept))
    cut = broadcast_if(write_table(cut, "removals"), BROADCAST_ROWS)
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = docs.drop("kept_in", "n_removed").withColumn(own, F.unhex(F.md5(text)))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key))
    joined = joined.join(cut, same, "left")
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, k: ~F.array_contains(lines, k)), "\n")
    joined = joined.withColumn(text_col, F.when(F.col(lines).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(rest)).drop(id_, key)

    left = write_table(joined.select(F.col(id_col).alias("doc_id"), F.col(own).alias("doc_key"), F.col(text_col).alias("text")), "lines-cut")
    found = passages(left).select(F.col("doc_id").alias(id_), F.col("doc_key").alias(key), F.col("pieces").alias(pieces), F.col("n").alias(n), F.col("kept_in").alias(too))
    joined = joined.join(broadcast_if(found, BROADCAST_ROWS), same, "left")
    rest = F.array_join(F.transform(pieces, lambda p: F.substring(F.col(text_col), p["at"], p["len"])), "")
    none = F.array().cast(f"array<{docs.schema[id_col].dataType.simpleString()}>")
    out = joined.withColumns(
        {
            text_col: F.when(F.col(pieces).isNull(), F.col(text_col)).otherwise(rest),
            "n_removed": F.coalesce(F.size(lines), F.lit(0)) + F.coalesce(n, F.lit(0)),
            "kept_in": F.when(F.col(too).isNull(), F.coalesce(kept, none)).otherwise(F.array_sort(F.array_union(F.coalesce(kept, none), too))),
        }
    )
    return out.drop(id_, key, lines, own, kept, pieces, n, too)
