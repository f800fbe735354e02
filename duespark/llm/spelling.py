"""Spelling variants: words one edit apart, found by rolling hashes of their deletions, and the forms that they lead to.

Two words differ by one replaced code point if they are alike without the code point at the same place, and by
one inserted or deleted one if the longer without a code point is the shorter. Each word gives integer keys of
its deletions, from running polynomial hashes of the code points before and after the deleted one, computed for
whole batches at once; keys are dealt and sorted as integers, and only those that words share bring the strings.
The strings decide: words are grouped by the text that is left, so that a collision of keys never links any.

A group is worked on by a window and never spelt out as pairs: words that share a place's deletion are all near
each other, so a member's count is the group's size less one and its best neighbour is the first or the second.
Such a group has a member for each letter that can stand in the place, so at most one for each letter in use.

Defined results: a null text has no words; a null id counts as an empty one where a run's checksum is taken.
Repeated rows count as often as they stand there. Ties of n go to the least word in code-point order. Other
columns, whatever their names, aren't read; an empty table gives no rows. A long text is read in blocks; a long
word gives as many keys as it has code points, and its string once for each word that it shares a key with.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duespark.llm.groups import whole_groups
from duespark.llm.scratch import broadcast_under, write_table
from duespark.llm.shingles import mix

#: In one of so many runs, by checksum, a code point is dropped.
DROP_ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: The words are broadcast if they take at most so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 20_000_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters of a text or of words that are handled at once, and distinct words that are held before they are passed on.
AT_ONCE = 1_000_000
HELD = 200_000


def runs_of(text: str):
    """Counts of the lower-cased runs of a text, block by block; a run may be in several blocks."""
    if len(text) <= AT_ONCE:
        yield Counter(_RUN.findall(text))
        return
    found = (m.group() for m in _RUN.finditer(text))
    while block := Counter(islice(found, HELD)):
        yield block


def noted(doc_id: str, run: str) -> str:
    """The run as it counts: where the checksum of id and run says so, without one code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROP_ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n over all documents: counted in each task first, then by a shuffle of words."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                for block in runs_of(data.as_py().translate(_LOWER).decode()):
                    for r, n in block.items():
                        seen[noted(doc_id, r)] += n
                    if len(seen) >= HELD:
                        yield _counted(seen)
                        seen.clear()
        if seen:
            yield _counted(seen)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


def deletion_keys(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words as flat code points: hashes of the words, and of each deletion the word's index, its place and the hash of the rest.

    Of equal neighbouring code points any deletion leaves the same text; `place` counts all, and the last result tells the first of each.
    """
    n = len(points)
    power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64) for b in (_BASE, _INVERSE))
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], out=running[1:])
    ends = np.append(starts[1:], n)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    at, first, last = np.arange(n), starts[word], ends[word]
    # The code points after the deleted one move down by one power.
    prefix = running[at] - running[first]
    suffix = (running[last] - running[at + 1]) * np.uint64(_INVERSE)
    rest = mix((prefix + suffix) * inverse[first] + (last - first - 1).astype(np.uint64))
    whole = mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    fresh = np.concatenate([[True], points[1:] != points[:-1]]) | (at == first) if n else np.zeros(0, bool)
    return whole, word, at - first, rest, fresh


def keys(words: DataFrame) -> DataFrame:
    """key, id, place, kind of words (id, word): kind 0 the word itself, 1 its texts without one code point, 2 these by place.

    Kinds 0 and 1 have the same key if their texts are equal; kind 2 only with the same place.
    """

    def run(batches):
        for batch in batches:
            length = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64)
            cut = 0
            while cut < len(length):
                to = max(cut + 1, cut + int(np.searchsorted(np.cumsum(length[cut:]), AT_ONCE, "right")))
                part = batch.slice(cut, to - cut)
                points = np.frombuffer("".join(part.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
                starts = np.cumsum(length[cut:to]) - length[cut:to]
                whole, word, place, rest, fresh = deletion_keys(points, starts)
                ids = part.column(0).to_numpy()
                by_place = mix(rest + (place + 1).astype(np.uint64) * np.uint64(_BASE))
                key = np.concatenate([whole, rest[fresh], by_place]).view(np.int64)
                who = np.concatenate([ids, ids[word[fresh]], ids[word]])
                where = np.concatenate([np.full(len(whole), -1), place[fresh], place])
                kind = np.repeat(np.array([0, 1, 2], np.int8), [len(whole), int(fresh.sum()), len(place)])
                for k in range(0, len(key), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(who[s]), pa.array(where[s]), pa.array(kind[s])], names=["key", "id", "place", "kind"])
                cut = to

    return words.select("id", "word").mapInArrow(run, "key bigint, id bigint, place bigint, kind tinyint")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows whose key can link: a word with a deletion of another, or two deletions by place."""

    def run(batches):
        for table, starts in whole_groups(batches, ["key"], 100_000):
            kind = table.column("kind").to_numpy()
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(kind))))
            each = [np.bincount(of[kind == k], minlength=len(starts)) for k in range(3)]
            edit, swap = (each[0] > 0) & (each[1] > 0), each[2] > 1
            take = np.where(kind == 2, swap[of], edit[of])
            yield from table.select(["id", "place", "kind"]).filter(pa.array(take)).to_batches()

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id bigint, place bigint, kind tinyint")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct of -n and word; the least is the nearest form) of words (id, word, n); words without near ones are left out."""
    shared = write_table(shared_keys(keys(words)), "shared-keys")
    named = shared.join(broadcast_under(words, BROADCAST_BYTES), "id")
    rest = F.when(F.col("kind") == 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, cast(place AS int))"), F.expr("substring(word, cast(place AS int) + 2)")))
    # Deletions by place meet where text and place are equal, the others where the text is.
    named = named.select("id", "word", "kind", "n", F.when(F.col("kind") == 2, F.col("place")).otherwise(-1).alias("place"), rest.alias("rest"))
    own = F.struct((-F.col("n")).alias("below"), "word")
    deleted = F.col("kind") > 0
    w = Window.partitionBy("place", "rest")
    ordered = w.orderBy(F.col("kind") == 0, -F.col("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = named.select(
        "id", "kind", own.alias("own"),
        F.count_if(deleted).over(w).alias("n_deleted"),
        F.max(F.when(~deleted, own)).over(w).alias("whole"),
        F.first(F.when(deleted, own)).over(ordered).alias("first"),
        F.nth_value(F.when(deleted, own), 2).over(ordered).alias("second"),
    )
    n_near = F.when(F.col("kind") == 0, F.col("n_deleted")).when(F.col("kind") == 1, F.when(F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("n_deleted") - 1)
    best = F.when(F.col("kind") == 0, F.col("first")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.when(F.col("first") == F.col("own"), F.col("second")).otherwise(F.col("first")))
    return found.select("id", n_near.alias("n_near"), best.alias("best")).filter("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the rows of (word, form) that have a form: each round doubles the steps taken.

    A form has at least twice its word's count, so that chains are no longer than the logarithm of the largest count.
    """
    at = write_table(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = write_table(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word."""
    words = write_table(word_counts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = words.join(near_words(words), "id", "left")
    enough = -F.col("best.below") >= TIMES * F.col("n")
    formed = write_table(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.below")).alias("form_n")), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
