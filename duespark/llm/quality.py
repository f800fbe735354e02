"""Supervised subword embeddings for text quality.

Every word, its character n-grams (with marks at the word's ends) and every pair of words in a
row are hashed to learned vectors; all pairs of equal words share one. A document is the average
of the vectors of its features and of NEUTRAL zero vectors, which keep texts of a few words
near the bias. A softmax over a linear layer gives the classes. Training is stochastic gradient descent in numpy on the driver,
over at most `sample` labelled documents, however many rows an id has: the bound is a parameter, and what
reaches the driver is one short list of hashed features and counts for each of them.

Scoring reads all documents. Because the output layer is linear in the average, each bucket
carries one number, its vector times the difference of the two output columns; a worker adds
these up for the distinct words of a chunk of text and then over the documents' words.

Defined results: a null or empty text, or one without words, has no features and gets the score
of the bias alone; rows with a null label aren't learned from; rows alike in id and text are learned from
once for each label that the id has; without any labelled row scores come from the first weights, near 0.5; an empty table gives no rows. Only the
id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from duespark.llm.scratch import write_table
from duespark.llm.shingles import mix, span_hashes, text_chunks, words

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 16
SAMPLE = 4000
EPOCHS, RATE, DECAY = 8, 0.5, 1e-5
NEUTRAL = 30
_END = ord("\n")
_TWICE = BUCKETS - 1


def pair_features(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each pair of neighbouring words, and the row of each."""
    same = row[1:] == row[:-1]
    left, right = hashes[:-1][same], hashes[1:][same]
    bucket = (mix(left * np.uint64(3) + right) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return np.where(left == right, np.int32(_TWICE), bucket), row[1:][same]


def word_features(hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its index among the distinct words; the buckets of their features, and where each distinct word's begin."""
    kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    marked = "".join(f"\n{raw[s:e].decode('utf-8', 'replace')}\n" for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True))
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = codes == _END
    owner = (np.cumsum(ends) - 1) // 2
    found, of = [mix(kinds)], [np.arange(len(kinds))]
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + codes[j : j + m]
        same = owner[:m] == owner[n - 1 :]
        found.append(mix(value[same])), of.append(owner[:m][same])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    buckets = (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int32)[order]
    return which, buckets, np.searchsorted(of[order], np.arange(len(kinds)))


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each that hold them all: that width, then the numbers."""
    width = next(w for w in (1, 2, 4) if not len(numbers) or numbers.max() < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


def _features(docs: DataFrame) -> DataFrame:
    """label, buckets, counts of rows (label, text): each document's hashed features, about three bytes each.

    buckets holds the steps from each bucket to the next, as they are in order; wide unpacks both.
    """

    def run(batches):
        for batch in batches:
            labels = batch.column(0)
            for first, data, offsets in text_chunks(batch.column(1)):
                start, end, row = words(data, offsets)
                out_b, out_c = [], []
                if len(start):
                    hashes = span_hashes(data, start, end)
                    which, buckets, at = word_features(hashes, data, start, end)
                    pairs, of = pair_features(hashes, row)
                    sizes = np.diff(np.append(at, len(buckets)))
                for k in range(len(offsets) - 1):
                    lo, hi = np.searchsorted(row, [k, k + 1])
                    if lo == hi:
                        out_b.append(narrow(np.zeros(0, np.int64))), out_c.append(narrow(np.zeros(0, np.int64)))
                        continue
                    kind, times = np.unique(which[lo:hi], return_counts=True)
                    spread = np.repeat(at[kind], sizes[kind]) + np.arange(sizes[kind].sum()) - np.repeat(np.cumsum(sizes[kind]) - sizes[kind], sizes[kind])
                    total = np.bincount(buckets[spread], np.repeat(times, sizes[kind]), BUCKETS)
                    total += np.bincount(pairs[slice(*np.searchsorted(of, [k, k + 1]))], minlength=BUCKETS)
                    used = np.flatnonzero(total)
                    out_b.append(narrow(np.diff(used, prepend=0))), out_c.append(narrow(total[used].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([labels.slice(first, len(out_b)), pa.array(out_b, pa.binary()), pa.array(out_c, pa.binary())], names=["label", "buckets", "counts"])

    return docs.select("label", "text").mapInArrow(run, "label int, buckets binary, counts binary")


class SubwordClassifier:
    """vectors (BUCKETS x DIM), output (DIM x 2) and bias (2)."""

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.vectors = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.output = draw.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, rows: list[tuple[int, bytes, bytes]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> "SubwordClassifier":
        """rows: label, buckets and counts as _features gives them; one row at a time is unpacked."""
        if not rows:
            return self
        draw = np.random.default_rng(seed)
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for k in draw.permutation(len(rows)):
                label, buckets, counts = rows[k][0], np.cumsum(wide(rows[k][1])), wide(rows[k][2])
                step = rate * (1 - done / steps)
                done += 1
                share = (counts / (counts.sum() + NEUTRAL)).astype(np.float32)
                mean = share @ self.vectors[buckets]
                logits = mean @ self.output + self.bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label] -= 1
                back = self.output @ p
                self.output -= step * (np.outer(mean, p) + DECAY * self.output)
                self.bias -= 0.1 * step * p
                # A shared step size for the features of a document, as if each came alone.
                self.vectors[buckets] -= step * np.minimum(1.0, share * len(buckets) * 0.2)[:, None] * back
        return self

    def collapsed(self) -> tuple[np.ndarray, float]:
        """Each bucket's part in logit(1) - logit(0), and the bias's."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> SubwordClassifier:
    """Fits on at most `sample` labelled documents, told apart by id, text and label: those whose ids, then digests of the text, come first. labels: the id and the label, 0 or 1."""
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna().orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # An id may have many rows, so the documents are chosen by their keys alone before any text is taken; `sample` bounds both broadcasts.
    keys = rows.join(F.broadcast(marks), F.col("doc_id") == F.col("label_id")).select("label_id", "label", F.md5("text").alias("digest")).distinct()
    chosen = write_table(keys.orderBy(F.xxhash64("label_id"), "label_id", "digest", "label").limit(sample), "chosen")
    same = (F.col("doc_id") == F.col("label_id")) & (F.md5("text") == F.col("digest"))
    texts = rows.join(F.broadcast(chosen), same).groupBy("label_id", "digest", "label").agg(F.first("text").alias("text"))
    # From a written table the driver takes one partition after the other, as bytes: no feature becomes a Python object.
    features = write_table(_features(texts), "features")
    rows = [(r[0], bytes(r[1]), bytes(r[2])) for r in features.toLocalIterator()]
    rows.sort(key=lambda r: (r[0], (len(r[2]) - 1) // r[2][0], np.cumsum(wide(r[1]))[:50].astype("<i4").tobytes(), wide(r[2])[:50].tobytes()))
    return SubwordClassifier().fit(rows)


def score(docs: DataFrame, fitted: SubwordClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1 for every document."""
    return score_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fitted, "text").drop("text")


def score_rows(docs: DataFrame, fitted: SubwordClassifier, text_col: str = "text") -> DataFrame:
    """docs with a score, of which a column of that name is replaced. The rows keep their order and meet no shuffle."""
    docs = docs.drop("score")
    text_at = docs.columns.index(text_col)
    parts = docs.sparkSession.sparkContext.broadcast(fitted.collapsed())

    def run(batches):
        value, bias = parts.value
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(text_at).fill_null("")):
                n = len(offsets) - 1
                start, end, row = words(data, offsets)
                logit = np.full(n, bias)
                if len(start):
                    hashes = span_hashes(data, start, end)
                    which, buckets, at = word_features(hashes, data, start, end)
                    pairs, of = pair_features(hashes, row)
                    total = np.add.reduceat(value[buckets], at)
                    size = np.diff(np.append(at, len(buckets))).astype(np.float64)
                    logit += (np.bincount(row, total[which], n) + np.bincount(of, value[pairs], n)) / (NEUTRAL + np.bincount(row, size[which], n) + np.bincount(of, minlength=n))
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-logit)))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
