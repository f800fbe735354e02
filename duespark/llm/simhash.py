"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked by covering locality-sensitive hashing.

Covering masks: each bit gets one of the 2**(radius + 1) - 1 vectors that aren't zero, and the table of
such a vector v keeps the bits whose vector has an odd product with v. The vectors of `radius` differing
bits span at most `radius` dimensions, so some v has even products with all of them: in its table the two
fingerprints have equal keys. No pair within the radius is missed, whatever its bits.

Defined results: a null text is an empty one; a text without words has fingerprint zero, which is linked
like any other; a text of fewer words than the width is one shingle. Repeated rows and equal ids are rows of
their own. A component's id is the least id that isn't null; it is null only where all ids of the component
are. Ids of any type that has an order will do. Other columns, whatever their names, aren't read. An empty
table gives no rows. Long texts are hashed by blocks of words, so that memory doesn't grow with them.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duespark.llm.groups import connected_components, local_roots, pairs_within, whole_groups
from duespark.llm.scratch import broadcast_under, write_table

WIDTH, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Fingerprints of one bucket that are compared with each other; a larger bucket is split by a second level of masks.
#: Two levels keep 52 of 64 bits at radius 2, so that no bucket of the second level has more than 2**12 fingerprints.
BUCKET = 256
#: Fingerprints with their components are broadcast if they take at most so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 20_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of a text that are split at once; words of a longer one come in blocks.
AT_ONCE = 1_000_000
BLOCK = 50_000


def word_blocks(data: bytes):
    """The words of a text, A-Z lower-cased, in lists."""
    data = data.translate(_LOWER)
    if len(data) <= AT_ONCE:
        yield data.split()
        return
    found = (m.group() for m in _WORD.finditer(data))
    while block := list(islice(found, BLOCK)):
        yield block


def shingle_digests(data: bytes, width: int = WIDTH):
    """Lists of the XXH64 digests of a text's shingles, repeats included."""
    before: list[bytes] = []
    n = 0
    for block in word_blocks(data):
        n += len(block)
        block = before + block
        yield [xxhash.xxh64_digest(b" ".join(s), SEED) for s in zip(*(block[k:] for k in range(width)), strict=False)]
        before = block[max(0, len(block) - width + 1) :]
    if 0 < n < width:
        yield [xxhash.xxh64_digest(b" ".join(before), SEED)]


def majority_bits(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """One row of 8 bytes for each text, most significant first: the bits that over half of its shingle hashes have."""
    ones = np.zeros((len(texts), BITS), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    sizes: list[tuple[int, int]] = []

    def count():
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, BITS // 8), axis=1)
        row, size = np.array(sizes).T
        np.add.at(ones, row, np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int64))
        np.add.at(total, row, size)
        held.clear(), sizes.clear()

    for k, text in enumerate(texts):
        for digests in shingle_digests(text, width):
            if digests:
                held += digests
                sizes.append((k, len(digests)))
            if len(held) >= BLOCK:
                count()
    if held:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1)


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a signed bigint)."""

    def run(batches):
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            prints = majority_bits(batch.column(1).cast(pa.large_binary()).to_pylist(), width).view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, print bigint")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bits such that of any `radius` of them some mask has none."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << b for k, b in enumerate(bits) if bin((1 + k % vectors) & v).count("1") % 2) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def buckets(prints: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """table_id, key, print: buckets in which every two different prints within the radius meet. prints has each print once.

    Buckets of one print are left out. Those of over `most` are told by a count and not gathered: their prints go to
    the buckets of a second level of masks over the bits that their table doesn't keep.
    """
    masks = covering_masks(list(range(BITS)), radius)
    free = [[b for b in range(BITS) if not mask >> b & 1] for mask in masks]
    finer = [[mask | sub for sub in covering_masks(bits, radius)] for mask, bits in zip(masks, free, strict=True)]

    def keys(of: list[tuple[int, int]]):
        return F.array(*(F.struct(F.lit(t).alias("table_id"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in of))

    first = prints.select("print", F.explode(keys(list(enumerate(masks)))).alias("b")).select("b.table_id", "b.key", "print")
    sized = first.join(first.groupBy("table_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["table_id", "key"])
    sized = write_table(sized, "buckets")
    of_table = F.element_at(F.array(*(keys([(len(masks) * (t + 1) + k, m) for k, m in enumerate(subs)]) for t, subs in enumerate(finer))), F.col("table_id") + 1)
    large = sized.filter(F.col("n") > most).select("print", F.explode(of_table).alias("b")).select("b.table_id", "b.key", "print")
    return sized.filter(F.col("n") <= most).select("table_id", "key", "print").unionByName(large)


def links(bucketed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: for each bucket edges that span its components of prints within the radius, every pair held against it."""

    def run(batches):
        for table, starts in whole_groups(batches, ["table_id", "key"]):
            prints = table.column("print").to_numpy()
            one = np.zeros(len(prints), np.int64)
            left, right = [], []
            for a, b in pairs_within(starts, len(prints), one, one, one):
                near = np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64)) <= radius
                left.append(a[near]), right.append(b[near])
            if left:
                root = local_roots(len(prints), np.concatenate(left), np.concatenate(right))
                node = np.flatnonzero(root != np.arange(len(prints)))
                yield pa.RecordBatch.from_arrays([pa.array(prints[node]), pa.array(prints[root[node]])], names=["u", "v"])

    rows = bucketed.repartition("table_id", "key").sortWithinPartitions("table_id", "key", "print")
    return rows.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, print, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    known = write_table(fingerprints(docs, width, id_col, text_col), "prints")
    prints = write_table(known.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = connected_components(links(buckets(prints.select("print"), radius), radius))
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = write_table(rooted, "rooted-prints")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = write_table(rooted.join(first, "root").select("print", "component_id"), "components")
    found = known.join(broadcast_under(facts, BROADCAST_BYTES), "print")
    return found.select("doc_id", "print", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
