"""Concatenate-and-cut packing of token ids into fixed windows.

Two passes. The first tokenises every document once, writes its ids with the number of
ids before it in its own input partition, and so yields a token total for each partition.
Prefix sums over those totals (one number a task) give each partition its global offset.
The second pass reads the written ids and cuts them at multiples of the window; no row is
shuffled in either pass, and a document that crosses boundaries becomes several pieces.

Defined results: a null text counts as empty and still yields its end id; empty input gives
no rows; repeated rows and equal or null ids are packed as separate documents; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duespark.llm.scratch import write_table

WINDOW = 2048
END_ID = 1
#: Fixed value: the public splitting pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of more white space than this goes to the file's own library; the fast encoder's pattern can't cross a million.
LONG_BLANKS = 100_000

_encoders: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """Ids of the tokenizer file: the fast encoder, and the file's own library for texts that hold a special token or a very long run of white space."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])))
        self.width = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")

    @functools.cached_property
    def full(self):
        """The library's own tokenizer, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def long_blanks(self, text: str) -> bool:
        return len(text) > LONG_BLANKS and max(map(len, re.findall(r"\s+", text)), default=0) > LONG_BLANKS

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text that isn't searched for special tokens."""
        if self.long_blanks(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or self.long_blanks(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _shown_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: doc_id, n, ids (little-endian, width bytes each), width, part, before (ids before it in its partition)."""

    def run(batches):
        enc, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 1000):
                ids = [np.append(enc.encode(t), np.uint32(end_id)).astype(enc.width) for t in texts[k : k + 1000]]
                n = np.fromiter((len(x) for x in ids), np.int64, len(ids))
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, len(ids)), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.full(len(ids), enc.width.itemsize, np.int32)), pa.array(np.full(len(ids), part, np.int32)), pa.array(start)],
                    names=["doc_id", "n", "ids", "width", "part", "before"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, ids binary, width int, part int, before bigint")


def global_offsets(tokens: DataFrame) -> dict[int, int]:
    """The prefix sums of the partitions' totals. Holds one number for each task of pass one, never one for each document."""
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).collect()
    offsets, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets[row["part"]] = at
        at += row["total"]
    return offsets


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Only the last sequence can be shorter than the window.
    """
    tokens = write_table(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    offsets = docs.sparkSession.sparkContext.broadcast(global_offsets(tokens))

    def cut(batches):
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            named = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            n = named["n"].to_numpy()
            base = np.fromiter((offsets.value[p] for p in named["part"].to_pylist()), np.int64, len(n))
            at = base + named["before"].to_numpy()
            first = at // window
            pieces = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + nth
            lo = np.maximum(seq * window, at[row])
            hi = np.minimum((seq + 1) * window, at[row] + n[row])
            flat = np.concatenate([np.frombuffer(x, dtype=f"<u{w}") for x, w in zip(named["ids"].to_pylist(), named["width"].to_pylist(), strict=True)]).astype("<u4")
            # Pieces follow each other without gaps, so their lengths alone cut the flat ids.
            ends = np.concatenate([[0], np.cumsum(hi - lo)])
            for k in range(0, len(row), 5000):
                cuts = ends[k : k + 5001]
                ids = flat[cuts[0] : cuts[-1]]
                binary = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(((cuts - cuts[0]) * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                s = slice(k, k + len(cuts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [named["doc_id"].take(pa.array(row[s])), pa.array((lo - at[row])[s]), pa.array((hi - lo)[s]), pa.array(n[row][s]), pa.array(seq[s]), pa.array((lo - seq * window)[s]), binary],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens, ids. A group holds one window at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
