"""BPE encoding and decoding with a public piece model, by vectorised merge rounds in numpy.

A batch's distinct words become one flat array of symbols. In each round every word finds
the smallest rank among its adjacent pairs (a segmented minimum), merges all leftmost
non-overlapping pairs of that rank at once, and the array is compacted, until no word has a
pair left. Merging all pairs of a rank at once equals merging them one by one unless a piece
made forms a pair of smaller rank with its neighbour, which is then to be merged first: up to
and including the leftmost such piece of a word, merges are done in the round, later ones wait.

No merge reaches over two neighbouring characters that stand together in no piece, so words are
cut there first, and a long word is no harder than as many short ones.

Words can be taken apart at white space because no piece holds a space mark after another
character; this is checked too.

Defined results: a null text counts as empty; an empty text has the end id alone and decodes
to ""; characters without a piece become byte pieces; U+2581 reads as a space. Repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NO_RANK = np.iinfo(np.int32).max
#: Words whose ids a worker keeps between batches, and characters of text that it handles at once.
CACHED_WORDS = 200_000
CHUNK_CHARS = 4_000_000

_models: dict[str, "PieceModel"] = {}


def model(path: str) -> "PieceModel":
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        self.unknown = sp.unk_id()
        plain = {}
        self.byte_id = {}
        self.surface: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                plain[piece] = i
                self.surface.append(piece.replace(MARK, " ").encode())
        if len(self.byte_id) != 256:
            raise ValueError("a model with byte fallback is needed")
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("pieces reach over white space, so words can't be encoded alone")
        order = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: -sp.get_score(i)))}
        # Symbols: pieces by their id, then characters of pieces that are no piece themselves.
        letters = sorted({c for p in plain for c in p} - set(plain))
        symbols = plain | {c: n + k for k, c in enumerate(letters)}
        self.n_symbols = n + len(letters)
        self.char_symbol = {c: s for c, s in symbols.items() if len(c) == 1}
        left, right, made, rank = [], [], [], []
        self.alone = np.zeros(self.n_symbols, bool)  # pieces that are part of a pair of smaller rank
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), rank.append(order[i])
                    for part in (a, b):
                        self.alone[part] |= order.get(part, -1) > order[i]
        self._pairs(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32), np.array(rank, np.int32))
        beside = {symbols[p[k]] * self.n_symbols + symbols[p[k + 1]] for p in plain for k in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        top = max(map(ord, self.char_symbol))
        self.by_code = np.full(top + 2, -1, np.int32)
        for c, s in self.char_symbol.items():
            self.by_code[ord(c)] = s
        self.cache: dict[str, bytes] = {}
        self.digits = [str(i) for i in range(n)]

    def _pairs(self, left, right, made, rank) -> None:
        """An open-addressed table of the pairs, so that a lookup is a few array reads."""
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(left)) * 8))))
        keys = left * self.n_symbols + right
        slots = 1 << self.bits
        self.keys = np.full(slots, -1, np.int64)
        self.made = np.zeros(slots, np.int32)
        self.rank = np.full(slots, NO_RANK, np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            k = todo[put]
            self.keys[at[put]], self.made[at[put]], self.rank[at[put]] = keys[k], made[k], rank[k]
            todo, at = todo[~put], (at[~put] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)) & ((1 << self.bits) - 1)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs; NO_RANK where there is none."""
        rank = np.full(len(a), NO_RANK, np.int32)
        made = np.zeros(len(a), np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[todo].astype(np.int64) * self.n_symbols + b[todo]
        at = self._slot(keys)
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            rank[todo[hit]], made[todo[hit]] = self.rank[at[hit]], self.made[at[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & (len(self.keys) - 1)
        return rank, made

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes. Words are not empty; spaces are marks already."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.by_code[np.minimum(codes, len(self.by_code) - 1)]
        char = codes.copy()  # of symbols that stay unknown
        owner = np.repeat(np.arange(len(words)), lengths)
        # Stretches that merges can't leave; what follows calls them words.
        keys = sym[:-1].astype(np.int64) * self.n_symbols + sym[1:]
        near = self.beside[np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)] == keys
        joined = near & (sym[:-1] >= 0) & (sym[1:] >= 0) & (owner[1:] == owner[:-1])
        word = np.concatenate([[0], np.cumsum(~joined)])
        owner = owner[np.concatenate([[True], ~joined])]
        rank, made = self._ranks(sym, word)
        done = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            per = np.repeat(least, np.diff(np.append(starts, len(sym))))
            ended = per == NO_RANK
            if ended.any():
                done.append((word[ended], sym[ended], char[ended]))
                live = ~ended
                sym, char, word, rank, made, per = sym[live], char[live], word[live], rank[live], made[live], per[live]
                if not len(sym):
                    break
            chosen = rank == per
            index = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), index, 0))
            chosen &= (index - run) % 2 == 0
            self._defer(chosen, sym, word, made, per)
            sym = np.where(chosen, made, sym)
            keep = ~np.concatenate([[False], chosen[:-1]])
            new = chosen[keep]
            sym, char, word, rank, made = sym[keep], char[keep], word[keep], rank[keep], made[keep]
            stale = new | np.concatenate([new[1:], [False]])
            at = np.flatnonzero(stale)
            last = at == len(sym) - 1
            nxt = np.where(last, at, at + 1)
            rank[at], made[at] = self.find(sym[at], np.where(last | (word[nxt] != word[at]), -1, sym[nxt]))
        word, sym, char = _in_order(done)
        return self._gather(len(words), owner[word], sym, char)

    def _defer(self, chosen, sym, word, made, per) -> None:
        """Takes out of chosen what comes after a merge whose piece forms a pair of smaller rank."""
        at = np.flatnonzero(chosen & self.alone[made])
        if not len(at):
            return
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        # To the left merges are done already, to the right not yet.
        left = np.where((at > 1) & chosen[np.maximum(at - 2, 0)], made[np.maximum(at - 2, 0)], sym[before])
        left = np.where((at > 0) & (word[before] == word[at]), left, -1)
        right = np.where((at + 2 < len(sym)) & (word[after] == word[at]), sym[after], -1)
        least = np.minimum(self.find(left, made[at])[0], self.find(made[at], right)[0])
        stops = at[least < per[at]]
        if len(stops):
            of, first = np.unique(word[stops], return_index=True)
            where = np.flatnonzero(chosen)
            k = np.minimum(np.searchsorted(of, word[where]), len(of) - 1)
            chosen[where[(of[k] == word[where]) & (where > stops[first][k])]] = False

    def _ranks(self, sym, word):
        same = np.append(word[1:] == word[:-1], False)
        return self.find(sym, np.where(same, np.append(sym[1:], -1), -1))

    def _gather(self, n: int, word, sym, char) -> list[bytes]:
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.surface)))
        if len(odd):  # no piece: the bytes of the character
            spelt = [[self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in char[odd]]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in spelt]
            at = np.cumsum(times) - times
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            for k, x in zip(odd, spelt, strict=True):
                sym[at[k] : at[k] + len(x)] = x
        ends = np.searchsorted(word, np.arange(n + 1)) * 4
        raw = sym.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        split = [self.words(t) for t in texts]
        fresh = list({w for ws in split for w in ws} - self.cache.keys())
        if len(self.cache) + len(fresh) > CACHED_WORDS:
            self.cache = {}
            fresh = list({w for ws in split for w in ws})
        if fresh:
            self.cache.update(zip(fresh, self.encode_words([MARK + w if w[:1] != " " else w.replace(" ", MARK) for w in fresh]), strict=True))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in split]

    @staticmethod
    def words(text: str) -> list[str]:
        """The words, each led by one unwritten space; a longer run of spaces is written out before its word."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w[:2].strip(" ") else w for w in re.findall(" +[^ ]*", " " + text)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _in_order(done):
    """The ended words of all rounds as one piece, in order."""
    word, sym, char = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return word[order], sym[order], char[order]


def _chunks(batch):
    """Slices of a batch of bounded text length; one longer text is a slice of its own."""
    texts, first, size = batch.column(1).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows, docs.schema[id_col].dataType.simpleString()


def encode_documents(docs: DataFrame, model_path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches):
        m = model(model_path)
        tail = [m.end] if end else []
        for batch in batches:
            for k, texts in _chunks(batch):
                ids = [x.tolist() + tail for x in m.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(ids)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text. Null ids decode to ""."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            texts = [m.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are of the decimal ids (end id included) joined by spaces, and of the decoded text in UTF-8.
    """

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for k, texts in _chunks(batch):
                n, of_ids, of_text = [], [], []
                for ids in m.encode(texts):
                    ids = np.append(ids, m.end)
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(m.digits.__getitem__, ids.tolist())).encode()).hexdigest())
                    of_text.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(n)), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
