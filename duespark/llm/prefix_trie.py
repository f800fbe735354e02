"""Prefix trie of conversations that share openings, built as a Patricia tree from sorted sequences.

A conversation is rebuilt from the opening that it shares with the first of its family, and a node of the trie
is a distinct sequence of first turns. Only branches, ends and leaves are made (points), out of the sequences in
sorted order: two neighbours part at a point, and the rows of a point follow each other. Every figure of a point
is a sum over these rows, taken with a stack in one pass over each range of the order; sums of a point that
several ranges share are added up. The unary nodes on an edge are then written out: they have the conversations
and leaves of the edge's lower point, and its saved tokens plus the edge's suffix sum of code points.

Nothing grows with one conversation, opening or group of copies but a sort that spills. Turns are numbered by
ranges of (conversation, turn) and the totals before each range, so that a long conversation lies in many tasks.
Equal conversations are one row with a count; sequences are told apart by their length and two sums of 64-bit
hashes of (turn, depth). A sequence is cut where no other has its opening; of two that stay alike to the end the
whole lies in one row of 24 bytes a turn, so an opening that different conversations share may be of tens of
millions of turns at most. A range's neighbours and the points at its two edges pass through the driver: one
row for each range. Ids that end at one node are written as text by ranges and hashed in order, in one task a
node but never held; SHA-256 can't be split.

Defined results: turns are ordered by `turn`, null first; equal ones by the MD5 of role and text. Null role and
text are empty ones. Rows without a conversation id belong to none and are left out. Repeated rows are turns
of their own. Conversation ids are whole numbers; a negative one's family begins at c - c % 100 by SQL's
remainder, towards zero. Other columns aren't read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duespark.llm.scratch import write_table

#: Conversations c - c % FAMILY to the next such number share openings of up to SHARED - 1 turns.
FAMILY, SHARED = 100, 6
#: Turns of a sequence that are sorted by at least; more only where other sequences begin alike.
LEAST_TURNS = 256
#: Depths of an edge that meet in one bucket.
BUCKET = 1024
_MARK = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def marked(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, mark (MD5 of role and text, told apart by the role's length), points (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", mark.alias("mark"), F.length(text).cast("bigint").alias("points"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), mark, points, upto (code points up to this turn, itself included)."""

    def run(batches):
        part, last, count, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, points = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            fresh = np.append(True, conv[1:] != conv[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
            upto = np.cumsum(points)
            pos, upto = np.arange(len(conv)) - first, upto - (upto - points)[first]
            if conv[0] == last:
                pos[conv == last] += count
                upto[conv == last] += total
            last, count, total = conv[-1], int(pos[-1]) + 1, int(upto[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos), batch.column(1), batch.column(2), pa.array(upto)],
                names=["conv_id", "part", "pos", "mark", "points", "upto"],
            )

    ranged = turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "mark").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "mark")
    rows = write_table(ranged.select("conv_id", "mark", "points").mapInArrow(run, "conv_id bigint, part int, pos bigint, mark binary, points bigint, upto bigint"), "numbered")
    parts = rows.groupBy("conv_id", "part").agg((F.max("pos") + 1).alias("n"), F.max("upto").alias("total"))
    w = Window.partitionBy("conv_id").orderBy("part")
    before = parts.select("conv_id", "part", (F.sum("n").over(w) - F.col("n")).alias("n_before"), (F.sum("total").over(w) - F.col("total")).alias("total_before"))
    # Only a range's first conversation can have begun in an earlier range: one row for each range at most.
    before = F.broadcast(before.filter("n_before > 0"))
    at = lambda c, b: (F.col(c) + F.coalesce(b, F.lit(0))).alias(c)
    return rows.join(before, ["conv_id", "part"], "left").select("conv_id", at("pos", "n_before"), "mark", "points", at("upto", "total_before"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their rebuilt turns: conv_id, depth (from 1), mark, points, upto."""
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    skipped = F.coalesce(F.sum(F.when(F.col("pos") < h, F.col("points"))), F.lit(0))
    convs = turns.groupBy("conv_id").agg(skipped.alias("skipped")).select("conv_id", "skipped", family.alias("family"))
    opening = F.array_sort(F.collect_list(F.struct("pos", "mark", "points", "upto")))
    openings = turns.filter(F.col("pos") < SHARED - 1).groupBy(F.col("conv_id").alias("family")).agg(opening.alias("opening"))
    taken = F.coalesce(F.filter("opening", lambda t: t["pos"] < h), F.array().cast(openings.schema["opening"].dataType))
    convs = write_table(convs.join(openings, "family", "left").select("conv_id", "skipped", taken.alias("taken")), "conversations")
    borrowed = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.mark", "t.points", "t.upto")
    shift = convs.select("conv_id", F.size("taken").alias("got"), (F.coalesce(F.get("taken", F.size("taken") - 1)["upto"], F.lit(0)) - F.col("skipped")).alias("moved"))
    own = turns.filter(F.col("pos") >= h).join(shift, "conv_id").select("conv_id", (F.col("pos") - h + F.col("got") + 1).alias("depth"), "mark", "points", (F.col("upto") + F.col("moved")).alias("upto"))
    return convs.select("conv_id"), write_table(borrowed.unionByName(own), "rebuilt")


def distinct_sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """first (the least conversation with the sequence), turns, total, last (code points of all and of the last text), copies, ends_sha256."""
    hashes = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")) for c in (("depth", "mark"), ("mark", "depth"))]
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("upto").alias("total"), F.max(F.struct("depth", "points"))["points"].alias("last"), *(h.cast("string").alias(f"s{k}") for k, h in enumerate(hashes)))
    key = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("turns", "total", "last", "s0", "s1")))
    keyed = write_table(convs.join(whole, "conv_id", "left").select(key.alias("key"), "conv_id"), "sequence-keys")

    def texts(batches):
        for batch in batches:
            if batch.num_rows:
                key, ids = batch.column(0).to_pylist(), batch.column(1).cast(pa.string()).to_pylist()
                cuts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[a] for a in cuts[:-1]]), batch.column(1).take(pa.array(cuts[:-1])), pa.array([b - a for a, b in pairwise(cuts)]), pa.array([",".join(ids[a:b]) for a, b in pairwise(cuts)])],
                    names=["key", "first", "n", "ids"],
                )

    def hashed(batches):
        held, first, copies, digest = None, 0, 0, None
        for batch in batches:
            out = []
            for key, conv, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held:
                    if held is not None:
                        out.append((held, first, copies, digest.hexdigest()))
                    held, first, copies, digest = key, conv, 0, hashlib.sha256()
                digest.update((("," if copies else "") + ids).encode())
                copies += n
            yield from _rows(out)
        if held is not None:
            yield from _rows([(held, first, copies, digest.hexdigest())])

    def _rows(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "first", "copies", "ends_sha256"])

    written = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(texts, "key string, first bigint, n bigint, ids string")
    found = written.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, first bigint, copies bigint, ends_sha256 string")
    part = F.split("key", " ")
    return write_table(found.select("first", *(part[k].cast("bigint").alias(c) for k, c in enumerate(("turns", "total", "last"))), "copies", "ends_sha256"), "sequences")


def needed_turns(sequences: DataFrame, turns: DataFrame, least: int) -> DataFrame | None:
    """first, needed: how many turns of a long sequence tell it from all others; in doublings of `least`. None if no sequence is long."""
    long = sequences.filter(F.col("turns") > least).select(F.col("first").alias("conv_id"))
    if long.isEmpty():
        return None
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("depth") / F.lit(float(least)))).cast("int"))
    sums = turns.join(long, "conv_id").groupBy("conv_id", level.alias("level")).agg(*(F.sum(F.xxhash64(*c).cast("decimal(20,0)")).alias(s) for s, c in (("a", ("depth", "mark")), ("b", ("mark", "depth")))))
    w = Window.partitionBy("conv_id").orderBy("level")
    upto = write_table(sums.select("conv_id", "level", *(F.sum(s).over(w).cast("string").alias(s) for s in "ab")), "openings")
    alone = upto.groupBy("level", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    found = upto.join(alone, ["level", "a", "b"]).groupBy("conv_id").agg(F.min(F.when(F.col("n") == 1, F.col("level"))).alias("alone"), F.max("level").alias("all"))
    return found.select(F.col("conv_id").alias("first"), (F.lit(least) * F.pow(F.lit(2.0), F.coalesce("alone", "all"))).cast("bigint").alias("needed"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences of marks begin alike with."""
    low, high = 0, min(len(a), len(b)) // _MARK
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * _MARK : mid * _MARK] == b[low * _MARK : mid * _MARK]:
            low = mid
        else:
            high = mid - 1
    return low


def ordered(sequences: DataFrame, turns: DataFrame, least: int) -> DataFrame:
    """The sequences in sorted order: part (range), seq (marks), turns, upto, total, last, copies, first, and lcp, the turns shared with the row before.

    low is the least lcp so far in the range (null for its first row, as lcp is), steps the rising lcps that lead to its last row.
    """
    rows = turns.join(sequences.select(F.col("first").alias("conv_id")), "conv_id")
    needed = needed_turns(sequences, turns, least)
    if needed is not None:
        rows = rows.join(needed.withColumnRenamed("first", "conv_id"), "conv_id", "left").filter(F.col("depth") <= F.coalesce("needed", F.lit(least)))
    marks = F.array_sort(F.collect_list(F.struct("depth", F.hex("mark").alias("mark"), "upto")))
    arrays = rows.groupBy(F.col("conv_id").alias("first")).agg(marks.alias("t"))
    arrays = arrays.select("first", F.unhex(F.concat_ws("", F.col("t.mark"))).alias("seq"), F.col("t.upto").alias("upto"))
    seqs = sequences.drop("ends_sha256").join(arrays, "first", "left")
    seqs = write_table(seqs.select(F.coalesce("seq", F.lit(b"")).alias("seq"), "turns", F.coalesce("upto", F.array().cast("array<bigint>")).alias("upto"), "total", "last", "copies", "first"), "arrays")

    def run(batches):
        part, before, steps, low, held = TaskContext.get().partitionId(), None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held(None)
            lcps, lows = [], []
            for seq in batch.column(0).to_pylist():
                if before is None:
                    lcps.append(None)
                else:
                    lcp = common(before, seq)
                    while steps and steps[-1] > lcp:
                        steps.pop()
                    if not steps or steps[-1] < lcp:
                        steps.append(lcp)
                    low = lcp if low is None else min(low, lcp)
                    lcps.append(lcp)
                lows.append(low)
                before = seq

            def held(steps, batch=batch, lcps=lcps, lows=lows):
                n = batch.num_rows
                return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), *batch.columns, pa.array(lcps, pa.int64()), pa.array(lows, pa.int64()), pa.array([None] * (n - 1) + [steps], pa.list_(pa.int64()))], names=["part", *batch.schema.names, "lcp", "low", "steps"])

        if held is not None:
            yield held(steps)

    ranged = seqs.repartitionByRange("seq", "turns").sortWithinPartitions("seq", "turns")
    return write_table(ranged.mapInArrow(run, "part int, seq binary, turns bigint, upto array<bigint>, total bigint, last bigint, copies bigint, first bigint, lcp bigint, low bigint, steps array<bigint>"), "ordered")


def range_edges(rows: DataFrame) -> dict[int, tuple[int, list[int], int, list[int]]]:
    """For each range the turns that its first and last row share with their neighbours outside, and the depths of the points there.

    A point seen at one edge of a range is at the other edge too if nothing within the range parts at its depth or above.
    """
    found = rows.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("low").alias("low"), F.collect_set("low").alias("falls"), F.max("steps").alias("steps"))
    parts = sorted(found.collect(), key=lambda r: r["part"])
    shared = [common(p["last"], q["first"]) for p, q in pairwise(parts)]
    points: list[set[int]] = [{s} for s in shared]
    for order, seen in ((range(len(shared)), "steps"), (range(len(shared) - 1, -1, -1), "falls")):
        before: set[int] = set()
        for k in order:
            p = parts[k] if seen == "steps" else parts[k + 1]
            through = {d for d in before if p["low"] is None or d < p["low"]}
            points[k] |= {d for d in through | set(p[seen] or []) if d <= shared[k]}
            before = points[k]
    out = {}
    for k, p in enumerate(parts):
        left = (shared[k - 1], sorted(points[k - 1])) if k else (-1, [])
        right = (shared[k], sorted(points[k])) if k < len(shared) else (-1, [])
        out[p["part"]] = (*left, *right)
    return out


class _Point:
    """An open point of the path to the current row: sums over its rows so far."""

    __slots__ = ("base", "copies", "depth", "ends", "first", "key", "leaves", "opened", "read", "texts")

    def __init__(self, depth, key, base, opened):
        #: base: code points above its last text; opened: those above the part of the path that its first row added, None if that row lies in an earlier range.
        self.depth, self.key, self.base, self.opened = depth, key, base, opened
        #: texts: code points of the texts of all its conversations; read: of those texts that a row was the first to have.
        self.copies = self.leaves = self.texts = self.read = 0
        self.first = self.ends = None

    def add(self, copies, first, leaves, texts, read):
        self.copies += copies
        self.first = first if self.first is None else min(self.first, first)
        self.leaves += leaves
        self.texts += texts
        self.read += read

    def saved(self):
        own = self.read + (self.opened - self.base if self.opened is not None else 0)
        return self.texts - self.copies * self.base - own


def points(rows: DataFrame) -> DataFrame:
    """key, depth, parent_key, parent_depth, base, n_convs, first, n_leaves, saved, ends (first of the sequence that ends here) of each point."""
    edges = range_edges(rows)
    names = ["seq", "turns", "upto", "total", "last", "copies", "first", "lcp"]
    out_names = ["key", "depth", "parent_key", "parent_depth", "base", "n_convs", "first", "n_leaves", "saved", "ends"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 7]

    def run(batches):
        out, stack, row, part = [], [], None, None

        def above(row, depth):
            return row["upto"][depth - 1] if depth > 0 else 0

        def point(row, depth, opened):
            return _Point(depth, hashlib.md5(row["seq"][: depth * _MARK]).digest(), above(row, depth - 1), opened)

        def emit(x, parent):
            out.append((x.key, x.depth, parent and parent.key, parent and parent.depth, x.base, x.copies, x.first, x.leaves, x.saved(), x.ends))

        def close(depth, row):
            """Ends the points below that depth; what they leave goes to the one there, which is made if it is new."""
            while stack[-1].depth > depth:
                x = stack.pop()
                if stack[-1].depth < depth:
                    stack.append(point(row, depth, x.opened))
                stack[-1].add(x.copies, x.first, x.leaves, x.texts, x.read)
                emit(x, stack[-1])

        def take(row, next_lcp):
            lcp = max(row["lcp"], 0)
            close(lcp, row)
            read = row["total"] - above(row, lcp)
            if row["turns"] > stack[-1].depth:
                # A sequence that is cut is alone below the cut; its number tells it from one that ends there.
                cut = row["turns"] * _MARK > len(row["seq"])
                key = hashlib.md5(row["seq"] + b"%d" % row["first"] if cut else row["seq"]).digest()
                stack.append(_Point(row["turns"], key, row["total"] - row["last"], above(row, lcp)))
            stack[-1].add(row["copies"], row["first"], int(next_lcp < row["turns"]), row["copies"] * row["total"], read)
            stack[-1].ends = row["first"]

        def finish():
            _, _, shared, right = edges[part]
            take(row, shared)
            for depth in reversed(right):
                close(depth, row)
            close(0, row)
            emit(stack.pop(), None)

        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in ["part", *names]), strict=True):
                new = dict(zip(names, values[1:], strict=True))
                if values[0] != part:
                    if row is not None:
                        finish()
                    part = values[0]
                    new["lcp"], left, _, _ = edges[part]
                    stack[:] = [point(new, d, 0 if new["lcp"] < 0 else None) for d in sorted({0, *left})]
                else:
                    take(row, new["lcp"])
                row = new
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=out_names)
                out.clear()
        if row is not None:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=out_names)

    dealt = rows.select("part", *names).repartition("part").sortWithinPartitions("part", "seq", "turns")
    found = dealt.mapInArrow(run, "key binary, depth bigint, parent_key binary, parent_depth bigint, base bigint, n_convs bigint, first bigint, n_leaves bigint, saved bigint, ends bigint")
    same = [F.first(c).alias(c) for c in ("depth", "parent_key", "parent_depth", "base")]
    sums = [F.sum("n_convs").alias("n_convs"), F.min("first").alias("first"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends")]
    return write_table(found.groupBy("key").agg(*same, *sums), "points")


def expanded(tree: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of a tree of points: each point, and the unary nodes of the edge to it."""
    long = tree.filter("depth - parent_depth > 1")
    blocks = F.explode(F.sequence(F.floor(F.col("parent_depth") / BUCKET), F.floor((F.col("depth") - 2) / BUCKET))).alias("bucket")
    # Nothing is saved on the edge of one conversation, so its texts aren't needed.
    inner = F.explode(F.sequence(F.greatest(F.col("parent_depth"), F.col("bucket") * BUCKET) + 1, F.least(F.col("depth") - 1, (F.col("bucket") + 1) * BUCKET)))
    single = long.filter("n_convs = 1").select("*", blocks).select("first", "parent_depth", "top", "n_convs", "n_leaves", inner.alias("at"), F.lit(0).cast("bigint").alias("saved"))
    texts = turns.select(F.col("conv_id").alias("first"), F.floor((F.col("depth") - 1) / BUCKET).alias("bucket"), F.col("depth").alias("at"), (F.col("upto") - F.col("points")).alias("above"))
    shared = long.filter("n_convs > 1").select("*", blocks).join(texts, ["first", "bucket"]).filter("at > parent_depth AND at < depth")
    shared = shared.select("first", "parent_depth", "top", "n_convs", "n_leaves", "at", (F.col("saved") + (F.col("n_convs") - 1) * (F.col("base") - F.col("above"))).alias("saved"))
    parent = lambda depth: F.when(F.col("parent_depth") == depth - 1, F.col("top")).when(F.col("parent_depth").isNotNull(), F.col("first")).alias("parent_conv_id")
    unary = single.unionByName(shared)
    unary = unary.select(F.col("first").alias("conv_id"), F.col("at").alias("depth"), parent(F.col("at")), "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.lit(_NO_ENDS).alias("ends_sha256"))
    own = tree.select(F.col("first").alias("conv_id"), "depth", parent(F.col("depth")), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    return own.unionByName(unary)


def nodes(conversations: DataFrame, least: int = LEAST_TURNS) -> DataFrame:
    """One row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(numbered(write_table(marked(conversations), "turns")))
    sequences = distinct_sequences(convs, turns)
    tree = points(ordered(sequences, turns, least))
    children = tree.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    tops = tree.select(F.col("key").alias("parent_key"), F.col("first").alias("top"))
    ends = sequences.select(F.col("first").alias("ends"), "ends_sha256")
    tree = tree.join(children, "key", "left").join(tops, "parent_key", "left").join(ends, "ends", "left")
    tree = tree.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(_NO_ENDS))})
    return expanded(write_table(tree, "tree"), turns)
