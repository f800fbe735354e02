"""Connected components over DataFrames, and pair work on groups of bounded size inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duespark.llm.scratch import write_table


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (u bigint, v bigint).

    Alternating large and small stars: in each round nodes link to the least neighbour, so that the
    rounds grow with the logarithm of the largest component. A round is two pre-aggregated shuffles
    and two joins, which adaptive execution splits where one node has very many neighbours. Each
    round is written to the shared folder.
    """
    edges = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m")), F.struct(F.col("u").alias("a"), F.col("m")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        edges = write_table(small, "edges")
        # A star forest no longer changes; equal counts and checksums of two rounds show that.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def whole_groups(batches, keys: list[str], rows: int = 20_000):
    """Tables of whole groups, with the starts of the groups, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    size = 0

    def starts_of(table):
        changed = np.zeros(table.num_rows, bool)
        changed[0] = True
        for key in keys:
            x = table.column(key).to_numpy()
            changed[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(changed)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = starts_of(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
                table = table.slice(starts[-1])
            held = table.to_batches()
            size = table.num_rows
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table)


def dealt(rows: DataFrame, key: str, count: str, most: int, node: str = "node") -> DataFrame:
    """Adds block_i, block_j and chunk: a group of over `most` rows becomes pairs of its chunks, each a task's bounded group.

    Every two rows of a group meet in one pair of chunks, whatever its size.
    """
    chunks = F.ceil(F.col(count) / most).cast("int")
    chunk = F.pmod(F.xxhash64(node, F.lit(11)), chunks).cast("int")
    df = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return df.withColumns({"block_i": F.least("chunk", "other"), "block_j": F.greatest("chunk", "other")}).drop("other")


def pairs_within(starts: np.ndarray, total: int, chunk: np.ndarray, block_i: np.ndarray, block_j: np.ndarray, most: int = 100_000):
    """Index pairs (a < b) of rows of the same group, in arrays of about `most` pairs; of a pair of chunks only the pairs across."""
    sizes = np.diff(np.append(starts, total))
    for m in np.unique(sizes):
        if m < 2:
            continue
        of = starts[sizes == m]
        if m * (m - 1) // 2 <= most:
            x, y = np.triu_indices(m, 1)
            step = max(1, most // len(x))
            for k in range(0, len(of), step):
                base = of[k : k + step, None]
                yield from _across((base + x).ravel(), (base + y).ravel(), chunk, block_i, block_j)
        else:
            for s in of:
                step = max(1, most // m)
                for k in range(0, m, step):
                    a = np.arange(k, min(m, k + step))
                    x, y = np.broadcast_arrays(a[:, None], np.arange(m)[None, :])
                    up = y > x
                    yield from _across(s + x[up], s + y[up], chunk, block_i, block_j)


def _across(a, b, chunk, block_i, block_j):
    ok = (block_i[a] == block_j[a]) | (chunk[a] != chunk[b])
    yield a[ok], b[ok]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected with each index."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
