"""Scoring of texts with a small causal self-attention language model, trained in numpy on subword ids.

A text is its words, lower-cased in A-Z, each encoded alone by a public byte-level BPE, then an
end. The model reads windows of WINDOW ids that overlap by WINDOW - STRIDE: every id is scored
once, by the window that shows it at least that much context (or all there is). One masked
attention layer, whose weights are the exponentials of keys and distances by channel (as in an
attention-free transformer), gives each position a state; the state gives weights for
EXPERTS distributions over the next id, and the id's probability is their mixture, with a small
share of the corpus's own id frequencies so that no id is impossible.

Every word's first id begins with a space, and no other id does, so the ids say where words end.
A word's probability by attention is the product over its ids, the first taken among the ids that
open a word, times the probability that such an id follows; over all words these sum to at most 1.
It is mixed, FREQUENT to 1 - FREQUENT, with the word's add-one frequency in the corpus, so that
frequent words aren't spelt out at a loss. The one count that add-one frequencies leave to unseen
words is shared by all of them as attention spells them. So a text's score is the logarithm of a
probability: over all texts these sum to at most 1.

What the model takes from the corpus covers all documents to learn from:
- word counts (pre-aggregated, then shuffled by word), and from them the id frequencies;
- a start, fitted on the driver on words drawn by these counts, so that all tasks mean the same by an expert;
- attention, gates and experts: each task goes once over all of its documents in small steps from
  that start, every id once; the tasks' weights are averaged by the ids they saw, the experts'
  expected counts are summed. A task sends one row an id and some more.

The base score of a text is that of its words' add-one frequencies alone. Counts of the HEAD
most frequent words are broadcast; the rarer words of each text, with their probabilities by
attention, are joined with their counts by a shuffle.

Defined results: a null text counts as empty and has the end alone; a null id is an id to learn
from (its remainder is that of the empty text); repeated rows are scored and counted as often as
they occur; nothing to learn from leaves the counts at 0; an empty table gives no rows. Only the
id and the text are read.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duespark.llm.packing import encoder
from duespark.llm.scratch import write_table

WINDOW, STRIDE = 32, 26
DIM, EXPERTS = 8, 16
FLOOR = 0.01
FREQUENT = 0.3
#: What the expected counts of the start weigh beside those of the documents.
FIT_WEIGHT = 1
#: Steps and windows of a step at the start; words of a sequence of the start.
STEPS, BATCH, START_WORDS = 500, 512, 200
RATE = 0.02
HEAD = 200_000
CACHED_WORDS = 500_000
CHUNK_CHARS = 2_000_000
#: White space beyond ASCII, which may be part of a word here.
BLANKS = re.compile(r"[^\S \t\n\r\x0b\x0c]")


def tokens_of(text: str) -> list[bytes]:
    """The words of a text; bytes.lower and bytes.split know A-Z and the white space of the contract only."""
    return text.encode().lower().split()


class WordIds:
    """Compact ids of words; ids that the corpus doesn't have share the last number but one, the end has the last.

    A word is looked up once, for its place in flat arrays of ids and counts; all else is array work.
    """

    def __init__(self, path: str, compact: np.ndarray, end: int, counts: dict[bytes, int] | None = None, ends: int = 0):
        """end: the end's id, and ends its count; counts: those of the frequent words, a word without one has -1."""
        self.encoding, self.compact, self.end, self.known, self.ends = encoder(path).fast, compact, end, counts or {}, ends
        self.ordinary = encoder(path).ordinary
        self.newline = self.encoding.encode_ordinary("\n")[0]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes | None, int] = {None: 0}
        self.flat, self.length, self.count = np.array([self.end], np.int32), np.array([1]), np.array([self.ends])

    def sequences(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts end to end, each closed by the end: ids, their numbers by text and by word, and the words' counts."""
        if len(self.place) > CACHED_WORDS:
            self._clear()
        for ws in texts:
            ws.append(None)
        place = np.fromiter(map(self.place.get, chain.from_iterable(texts), repeat(-1)), np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            words = list(compress(chain.from_iterable(texts), (place < 0).tolist()))
            self._learn(list(dict.fromkeys(words)))
            place[fresh] = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        by_word = self.length[place]
        start = np.cumsum(self.length) - self.length
        ends = np.cumsum(by_word)
        flat = self.flat[np.repeat(start[place] - ends + by_word, by_word) + np.arange(ends[-1])]
        n_words = np.fromiter(map(len, texts), np.int64, len(texts))
        return flat, np.add.reduceat(by_word, np.cumsum(n_words) - n_words), by_word, self.count[place]

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words in one text, a line each; a word with white space beyond ASCII is encoded alone."""
        text = b" " + b"\n ".join(words) + b"\n"
        order, others = words, []
        if BLANKS.search(text.decode()):
            others = [w for w in words if w.decode().split() != [w.decode()]]
            apart = set(others)
            order = [*(w for w in words if w not in apart), *others]
            text = b"".join(b" " + w + b"\n" for w in order[: len(order) - len(others)])
        ids = self.encoding.encode_to_numpy(text.decode(), disallowed_special=())
        cuts = np.flatnonzero(ids == self.newline)
        pieces, length = [self.compact[np.delete(ids, cuts)]], [np.diff(np.append(-1, cuts)) - 1]
        for w in others:
            own = self.compact[self.ordinary(" " + w.decode())]
            pieces.append(own), length.append(np.array([len(own)]))
        self.place.update(zip(order, range(len(self.place), len(self.place) + len(order)), strict=True))
        self.flat, self.length = np.concatenate([self.flat, *pieces]), np.concatenate([self.length, *length])
        self.count = np.concatenate([self.count, np.fromiter(map(self.known.get, order, repeat(-1)), np.int64, len(order))])


def window_index(lengths: np.ndarray, stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences laid end to end: first position of each window, its sequence's end, and how many of its first places are context only."""
    stride = stride or STRIDE
    windows = 1 + np.ceil(np.maximum(0, lengths - WINDOW) / stride).astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    offset = np.cumsum(lengths) - lengths
    return offset[of] + nth * stride, (offset + lengths)[of], np.where(nth > 0, WINDOW - stride, 0)


def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the order that puts the same ones together, and where each begins in it."""
    # Numbers of 16 bits are sorted by radix.
    small = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids
    order = np.argsort(small, kind="stable")
    inorder = small[order]
    start = np.flatnonzero(np.append(True, inorder[1:] != inorder[:-1]))
    return inorder[start].astype(np.int64), order, start


class AttentionModel:
    """Causal attention by channel: a place's value is the mean of those before it and its own, weighed by the exponential of their keys and of their distance, and let through as its query says.

    The sums over earlier places are then one product with the matrix of distances, for all windows at once.
    """

    def __init__(self, frequencies: np.ndarray, seed: int = 4):
        """frequencies: the corpus's share of each compact id; the last is the end."""
        draw = np.random.default_rng(seed)
        v = len(frequencies)
        self.base = frequencies.astype(np.float32)
        noise = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "emb": noise(v, DIM, scale=0.5), "q": noise(DIM, DIM, scale=0.3), "k": noise(DIM, DIM, scale=0.3), "v": noise(DIM, DIM, scale=0.5),
            "own": noise(DIM, DIM, scale=0.5), "bias": np.zeros(DIM, np.float32), "near": np.linspace(0, -1.5, WINDOW).astype(np.float32), "gate": noise(DIM, EXPERTS, scale=0.5), "gate0": np.zeros(EXPERTS, np.float32),
        }
        self.sums = (frequencies[:, None] * np.exp(draw.standard_normal((v, EXPERTS)) * 0.5)).astype(np.float32) * 4096 / EXPERTS
        self.lag = np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW))
        self.settle()

    def settle(self, prior: float = 3.0) -> None:
        """Experts from their expected counts, with a prior of the corpus's frequencies."""
        self.experts = ((self.sums + prior * self.base[:, None]) / (self.sums.sum(0) + prior)).astype(np.float32)

    def distances(self) -> np.ndarray:
        """The weight of each earlier place by its distance; nothing looks ahead."""
        near = np.exp(np.clip(self.w["near"], -30, 30))
        return np.where(self.lag >= 0, near[np.maximum(self.lag, 0)], 0).astype(near.dtype)

    def fit(self, sequences: list[np.ndarray], steps: int | None = None, rate: float = 0.01, seed: int = 6) -> None:
        """Steps on windows drawn from sequences of ids."""
        steps = steps or STEPS
        draw = np.random.default_rng(seed)
        flat = np.concatenate(sequences)
        lengths = np.array([len(s) for s in sequences])
        first, end, _ = window_index(lengths)
        shown = self.shown(flat, lengths)
        state = Steps(self)
        for step in range(1, steps + 1):
            pick = draw.integers(0, len(first), BATCH)
            state.take(*windows_of(shown, flat, first[pick], end[pick]), rate * min(1, step / 20) * (1 - 0.9 * step / steps))

    def shown(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What stands before each id: the id before it, the end before a text."""
        shown = np.concatenate([[len(self.base) - 1], flat[:-1]]).astype(np.int32)
        shown[np.cumsum(lengths)[:-1]] = len(self.base) - 1
        return shown

    def _forward(self, ids):
        """ids: places by windows. What depends on an id alone is reckoned once for each distinct one."""
        w = self.w
        found, order, start = grouped(ids.ravel())
        nth = np.empty(len(order), np.int64)
        nth[order] = np.repeat(np.arange(len(found)), np.diff(np.append(start, len(order))))
        e = w["emb"][found]
        key, v = np.exp(np.clip(e @ w["k"], -30, 30)), e @ w["v"]
        opened = 1 / (1 + np.exp(-np.clip(e @ w["q"], -30, 30)))
        held = np.concatenate([key * v, key], 1).take(nth, axis=0).reshape(WINDOW, -1)
        away = self.distances()
        sums = (away @ held).reshape(len(nth), -1)
        below = np.ascontiguousarray(sums[:, DIM:])
        mean = sums[:, :DIM] / below
        through = opened.take(nth, axis=0)
        h = through * mean
        h += (e @ w["own"] + w["bias"]).take(nth, axis=0)
        np.tanh(h, out=h)
        g = h @ w["gate"]
        g += w["gate0"]
        if np.abs(w["gate"]).sum(0).max() + np.abs(w["gate0"]).max() > 60:
            g -= g.max(1, keepdims=True)
        np.exp(g, out=g)
        return (found, order, start, e), (key, v, opened), (held, away, below, mean, through, h), g

    def _states(self, ids):
        """The weights of the experts at each place of windows."""
        *_, g = self._forward(ids.T)
        return ((g / g.sum(1, keepdims=True)).reshape(*ids.T.shape, -1).transpose(1, 0, 2),)

    def _mix(self, weights, targets):
        parts = weights * self.experts[targets]
        return parts, FLOOR * self.base[targets] + (1 - FLOOR) * parts.sum(-1)

    def _gradients(self, ids, targets, live):
        """Of windows of ids and their targets; live: the places that count. Also their shares of the experts: targets, rows."""
        w, targets, live = self.w, targets.T.ravel(), live.T.ravel()
        (found, order, start, e), (key, v, opened), (held, away, below, mean, through, h), g = self._forward(ids.T)
        ones = np.ones(EXPERTS, g.dtype)
        total = g @ ones
        parts = self.experts.take(targets, axis=0) * g
        own = (1 - FLOOR) * (parts @ ones) / total
        p = FLOOR * self.base.take(targets) + own
        parts *= ((1 - FLOOR) * live / (p * total)).astype(g.dtype)[:, None]
        g *= (live * own / (p * total)).astype(g.dtype)[:, None]
        g -= parts
        part = g.dtype.type(1 / max(1, live.sum()))
        dz = g @ (w["gate"].T * part)
        h2 = h * h
        np.subtract(1, h2, out=h2)
        dz *= h2
        dsums = np.empty((len(order), 2 * DIM), g.dtype)
        np.multiply(dz, through, out=dsums[:, :DIM])
        dsums[:, :DIM] /= below
        np.multiply(dsums[:, :DIM], -mean, out=dsums[:, DIM:])
        dsums = dsums.reshape(WINDOW, -1)
        by_id = lambda rows: np.add.reduceat(rows.take(order, axis=0), start, axis=0)
        dheld, dthrough, dz = by_id((away.T @ dsums).reshape(len(order), -1)), by_id(dz * mean), by_id(dz)
        d = np.concatenate([dthrough * opened * (1 - opened), (dheld[:, :DIM] * v + dheld[:, DIM:]) * key, dheld[:, :DIM] * key, dz], 1)
        emb = np.zeros_like(w["emb"])
        emb[found] = d @ np.concatenate([w["q"], w["k"], w["v"], w["own"]], 1).T
        near = np.bincount(np.maximum(self.lag, 0).ravel(), ((dsums @ held.T) * away).ravel(), WINDOW).astype(w["near"].dtype)
        grad = {"emb": emb, **dict(zip(("q", "k", "v", "own"), np.split(e.T @ d, 4, 1), strict=True)), "bias": dz.sum(0), "near": near, "gate": h.T @ g * part, "gate0": (np.ones(len(g), g.dtype) @ g) * part}
        return grad, (targets, parts)

    def scorer(self) -> "Scorer":
        return Scorer(self)


def windows_of(shown: np.ndarray, flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = first[:, None] + np.arange(WINDOW)
    live = at < end[:, None]
    return shown.take(at, mode="clip"), flat.take(at, mode="clip"), live


class Steps:
    """Adam on attention and gates, with stepwise expectation-maximisation of the experts."""

    def __init__(self, model: AttentionModel, past: int = 0):
        """past: steps that the model's expected counts have seen before."""
        self.model, self.step, self.past = model, 0, past
        self.m = {k: np.zeros_like(x) for k, x in model.w.items()}
        self.s = {k: np.zeros_like(x) for k, x in model.w.items()}

    def take(self, ids, targets, live, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """One step; returns ids and the sums of their shares of the experts, which are live places in all."""
        self.step += 1
        model, step = self.model, self.step
        grad, counts = model._gradients(ids, targets, live)
        eta = np.float32(max(0.01, (step + self.past + 2) ** -0.6))
        found, order, start = grouped(counts[0])
        sums = np.add.reduceat(counts[1].take(order, axis=0), start, axis=0)
        model.sums *= 1 - eta
        model.sums[found] += eta * sums
        model.settle()
        for k, g in grad.items():
            m, s = self.m[k], self.s[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            model.w[k] -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
        return found, sums


class Scorer:
    """The fitted model as tables by id, so that what a window needs of its ids are single reads.

    Batches are small enough for their arrays to stay in the processor's cache.
    """

    def __init__(self, model: AttentionModel, opens: np.ndarray | None = None):
        """opens: which share of each compact id's mass belongs to ids that open a word (or to the end)."""
        w = model.w
        key = np.exp(np.clip(w["emb"] @ w["k"], -30, 30))
        # What an id adds to later places, and what it takes for its own.
        self.held = np.concatenate([key * (w["emb"] @ w["v"]), key], 1).astype(np.float32)
        self.asks = np.concatenate([1 / (1 + np.exp(-np.clip(w["emb"] @ w["q"], -30, 30))), w["emb"] @ w["own"] + w["bias"]], 1).astype(np.float32)
        self.away = model.distances().astype(np.float32)
        # States lie within -1 and 1; beyond these bounds the gates shrink, so that no exponential overflows.
        shrink = min(1.0, 60 / max(1e-9, float(np.abs(w["gate"]).sum(0).max())))
        self.gate = (w["gate"] * np.float32(shrink)).astype(np.float32)
        self.start = np.exp(np.clip(w["gate0"], -60, 20)).astype(np.float32)
        self.base = model.base
        self.experts = (model.experts * self.start).astype(np.float32)
        self.end = len(model.base) - 1
        self.opens = np.ones(len(model.base), np.float32) if opens is None else opens.astype(np.float32)
        #: Of an expert's weight all of it, and the share of ids that open a word.
        self.sums = np.stack([self.start, self.opens @ self.experts], 1)
        self.base_opens = float(self.opens @ self.base)

    def walk(self, flat: np.ndarray, lengths: np.ndarray, batch: int = 64):
        """(positions, targets, gates) of all places of sequences laid end to end, each once."""
        shown = np.concatenate([[self.end], flat[:-1]]).astype(np.int32)
        shown[np.cumsum(lengths)[:-1]] = self.end
        first, end, skip = window_index(lengths)
        place = np.arange(WINDOW)[:, None]
        for context in (0, WINDOW - STRIDE):
            # Places that are context only are looked at, but don't ask.
            windows = np.flatnonzero(skip == context)
            for lo in range(0, len(windows), batch):
                of = windows[lo : lo + batch]
                at = first[of] + place
                ids = shown.take(at, mode="clip")
                sums = (self.away[context:] @ self.held.take(ids, axis=0).reshape(WINDOW, -1)).reshape(-1, 2 * DIM)
                at = at[context:]
                live = (at < end[of]).ravel()
                at, ids = at.ravel(), ids[context:].ravel()
                if not live.all():
                    at, ids, sums = at[live], ids[live], sums[live]
                asks = self.asks.take(ids, axis=0)
                h = sums[:, :DIM] / sums[:, DIM:]
                h *= asks[:, :DIM]
                h += asks[:, DIM:]
                np.tanh(h, out=h)
                g = h @ self.gate
                np.exp(g, out=g)
                yield at, flat[at], g

    def log10(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The logarithm of each id's probability."""
        return np.log10(self.both(flat, lengths)[0])

    def both(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id's probability, and the probability that a word opens at its place."""
        p, o = np.empty(len(flat), np.float64), np.empty(len(flat), np.float64)
        for at, target, g in self.walk(flat, lengths):
            total = g @ self.sums
            p[at] = np.einsum("nk,nk->n", g, self.experts.take(target, axis=0)) / total[:, 0]
            o[at] = total[:, 1] / total[:, 0]
        p *= 1 - FLOOR
        p += FLOOR * self.base[flat]
        o *= 1 - FLOOR
        o += FLOOR * self.base_opens
        return p, np.minimum(o, 1.0)

    def words(self, flat: np.ndarray, lengths: np.ndarray, by_word: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability by attention; each text's last word is the end, which nothing follows."""
        ids, opens = self.both(flat, lengths)
        first = np.cumsum(by_word) - by_word
        ids, own = np.log10(ids), np.log10(opens[first])
        after = np.append(own[1:], 0.0)
        after[np.searchsorted(first, np.cumsum(lengths) - 1)] = 0.0
        return np.add.reduceat(ids, first) - own + after


def _chunks(texts: list[str], chars: int = CHUNK_CHARS):
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars or k == len(texts) - 1:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0


def word_counts(learn: DataFrame) -> DataFrame:
    """word (null: the end), n of rows (text). Words are summed in each task before the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        docs = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([*counts.keys(), None], pa.binary()), pa.array([*counts.values(), docs], pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, texts in _chunks(batch.column(0).to_pylist(), 500_000):
                # A counter of few words stays in the processor's cache; the large one is touched once a word and chunk.
                counts.update(Counter(chain.from_iterable(map(tokens_of, texts))))
                docs += len(texts)
                if len(counts) > 500_000:
                    yield rows()
                    counts, docs = Counter(), 0
        yield rows()

    return learn.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(words: DataFrame, path: str) -> np.ndarray:
    """Counts of the tokenizer's ids over all words and their numbers."""

    def run(batches):
        encode, total = encoder(path).ordinary, Counter()
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in encode(" " + w.decode("utf-8", "replace")):
                    total[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    found = words.filter("word IS NOT NULL").select("word", "n").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(encoder(path).size, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def _open_share(path: str, counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """1 for ids that begin with a space, else 0; at last the share of these among the ids that the corpus doesn't have."""
    spaced = np.zeros(len(counts), bool)
    for i, token in encoder(path).bytes_of.items():
        spaced[i] = token[:1] == b" "
    rest = np.delete(spaced, used)
    return np.append(spaced[used].astype(np.float32), rest.mean() if len(rest) else 0.0)


def frequent_words(words: DataFrame, most: int) -> dict[bytes, int]:
    """The words of the largest counts, `most` of them at most: all whose counts reach a limit that a short table of counts gives."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).alias("size")
    rows = words.filter("word IS NOT NULL").select("word", "n", size)
    limit, total = None, 0
    for r in sorted(rows.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        total += r["count"]
        if total > most:
            break
        limit = r["size"]
    if limit is None:
        return {}
    found = rows.filter(F.col("size") >= limit).select("word", "n").toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))


def drawn_words(head: dict[bytes, int], ids: WordIds, seed: int = 8) -> list[np.ndarray]:
    """Sequences of words drawn by their counts, from which all tasks start: they know how words are spelt, but no text."""
    draw = np.random.default_rng(seed)
    words = sorted(head)
    shares = np.array([head[w] for w in words], np.float64)
    picked = draw.choice(len(words), (STEPS, START_WORDS), p=shares / shares.sum())
    flat, lengths, *_ = ids.sequences([[words[k] for k in row] for row in picked.tolist()])
    return np.split(flat, np.cumsum(lengths)[:-1])


def learn_from_all(model: AttentionModel, learn: DataFrame, path: str, compact: np.ndarray) -> None:
    """Each task goes once over all of its documents, from the same start; their weights are averaged by the ids they saw, their experts' counts summed.

    A row holds an id's counts and how far its embedding moved; rows below 0 hold the other weights.
    """
    others = [k for k in model.w if k != "emb"]
    packed = lambda w: np.concatenate([w[k].ravel() for k in others])
    width = EXPERTS + DIM
    state = learn.sparkSession.sparkContext.broadcast((model, compact, STEPS))

    def run(batches):
        start, compact, past = state.value
        model = copy.deepcopy(start)
        draw = np.random.default_rng(TaskContext.get().partitionId())
        ids, steps, total = WordIds(path, compact, len(model.base) - 1), Steps(model, past), np.zeros((len(model.base), EXPERTS))
        n = 0.0
        for batch in batches:
            for _, texts in _chunks(batch.column(0).to_pylist()):
                flat, lengths, *_ = ids.sequences([tokens_of(t) for t in texts])
                shown = model.shown(flat, lengths)
                first, end, _ = window_index(lengths, WINDOW)
                order = draw.permutation(len(first))
                for lo in range(0, len(order), BATCH):
                    of = order[lo : lo + BATCH]
                    rate = RATE * min(1, (steps.step + 1) / 20) / math.sqrt(1 + steps.step / 300)
                    found, sums = steps.take(*windows_of(shown, flat, first[of], end[of]), rate)
                    # Later steps know more of what the experts are for.
                    total[found] += steps.step * sums
                    n += sums.sum(dtype=np.float64)
        total *= n / max(1.0, total.sum())
        seen = np.flatnonzero(total.sum(1))
        moved = (model.w["emb"] - start.w["emb"])[seen] * total[seen].sum(1, keepdims=True)
        rest = (packed(model.w) - packed(start.w)) * n
        rest = np.pad(rest, (0, -len(rest) % width)).reshape(-1, width)
        rows = np.concatenate([rest, np.concatenate([total[seen], moved], 1)]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1 - np.arange(len(rest)), seen).astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(width))], names=["id", *(f"x{k}" for k in range(width))])

    names = [f"x{k}" for k in range(width)]
    found = learn.select("text").mapInArrow(run, "id int, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    state.unpersist()
    rows, ids = np.stack([found.column(c).to_numpy() for c in names], 1), found.column("id").to_numpy()
    model.sums = FIT_WEIGHT * model.sums.astype(np.float64)
    seen = ids >= 0
    counts = rows[seen, :EXPERTS]
    if counts.size:
        rest = rows[~seen][np.argsort(-ids[~seen])].ravel() / counts.sum()
        model.w["emb"][ids[seen]] += (rows[seen, EXPERTS:] / counts.sum(1, keepdims=True)).astype(np.float32)
        for k in others:
            size = model.w[k].size
            model.w[k] += rest[:size].reshape(model.w[k].shape).astype(np.float32)
            rest = rest[size:]
        model.sums[ids[seen]] += counts
    model.settle()


def fit(learn: DataFrame, words: DataFrame, path: str, head: dict[bytes, int] | None = None) -> tuple[Scorer, np.ndarray]:
    """The model and the compact numbers of the tokenizer's ids. learn: rows (doc_id, text); words: their word counts; head: those of the frequent words."""
    counts = id_counts(words, path)
    used = np.flatnonzero(counts)
    compact = np.full(len(counts), len(used), np.int32)
    compact[used] = np.arange(len(used), dtype=np.int32)
    n_docs = words.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    # Half a count for each id unseen, shared by all of them; the end is the last.
    unseen = 0.5 * max(1, len(counts) - len(used))
    share = np.concatenate([counts[used] + 0.5, [unseen], [n_docs + 0.5]])
    share /= share.sum()
    # An unseen id gets its part of that share.
    model = AttentionModel(share)
    opens = np.append(_open_share(path, counts, used), 1.0)
    head = frequent_words(words, HEAD) if head is None else head
    if len(used):
        model.fit(drawn_words(head, WordIds(path, compact, len(share) - 1)))
    else:
        model.sums *= 0
    learn_from_all(model, learn, path, compact)
    scorer = Scorer(model, opens)
    # From here on the shared row of unseen ids stands for any single one of them.
    lone = np.float32(1 / max(1, len(counts) - len(used)))
    scorer.experts, scorer.base = scorer.experts.copy(), scorer.base.copy()
    scorer.experts[-2] *= lone
    scorer.base[-2] *= lone
    return scorer, compact


def score(docs: DataFrame, tokenizer_path: str, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document. held_out(column) tells which ids not to learn from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = rows.filter(~held_out(F.col("doc_id")))
    words = write_table(word_counts(learn), "words").filter("n > 0")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    head = frequent_words(words, HEAD)
    scorer, compact = fit(learn, words, tokenizer_path, head)
    state = docs.sparkSession.sparkContext.broadcast((scorer, compact, head))
    unit = n + v + 1

    def run(batches):
        scorer, compact, head = state.value
        ids, at = WordIds(tokenizer_path, compact, scorer.end, head, ends), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in _chunks(batch.column(1).to_pylist()):
                split = [tokens_of(t) for t in texts]
                flat, lengths, by_word, counts = ids.sequences(split)
                spelt = scorer.words(flat, lengths, by_word)
                known = counts >= 0
                n_tokens = np.fromiter(map(len, split), np.int64, len(split))
                start = np.cumsum(n_tokens) - n_tokens
                share = np.maximum(counts + 1, 1) / unit
                mixed = np.log10(FREQUENT * share + (1 - FREQUENT) * 10.0**spelt)
                add = lambda x: np.add.reduceat(x, start)
                where = np.flatnonzero(~known)
                text = np.searchsorted(start, where, "right") - 1
                words = [split[t][k] for t, k in zip(text.tolist(), (where - start[text]).tolist(), strict=True)]
                cuts = np.searchsorted(text, np.arange(len(split) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(spelt[where])], names=["word", "spelt"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(split))), batch.column(0).slice(first, len(split)), pa.array(n_tokens), pa.array(add((counts > 0).astype(np.int64))), pa.array(add(np.where(known, np.log10(share), 0.0))), pa.array(add(np.where(known, mixed, 0.0))), rare],
                    names=["row", "doc_id", "n_tokens", "head_known", "head_base", "head_score", "rare"],
                )
                at += len(split)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = write_table(rows.mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, head_known bigint, head_base double, head_score double, rare array<struct<word: binary, spelt: double>>"), "scored")
    share = (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(unit))
    spelt = F.pow(F.lit(10.0), F.col("spelt"))
    seen = F.log10(F.lit(FREQUENT) * share + F.lit(1 - FREQUENT) * spelt)
    # Of a word that the corpus doesn't have, as attention spells it; a sum of logarithms can't become the logarithm of 0.
    mixed = F.when(F.col("n") > 0, seen).otherwise(F.log10(F.lit(FREQUENT / unit + 1 - FREQUENT)) + F.col("spelt"))
    tail = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.spelt").join(words, "word", "left")
    tail = tail.groupBy("row").agg(F.count("n").alias("tail_known"), F.sum(F.log10(share)).alias("tail_base"), F.sum(mixed).alias("tail_score"))
    zero = F.lit(0.0)
    return scored.drop("rare").join(tail, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", zero)).alias("score"),
    )
