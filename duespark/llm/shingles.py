"""Word shingles and MinHash signatures of Arrow text columns, in flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Characters of text handled at once; one longer text is handled alone.
CHUNK = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def text_chunks(column: pa.Array):
    """(first row, bytes, offsets) of runs of rows. The column has no nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are no white space."""
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running polynomial."""
    power, inverse = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=running[1:])
    return mix((running[end] - running[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word_hashes: np.ndarray, row: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words, and their rows. A row of fewer words is one shingle of all of them."""
    n = len(word_hashes)
    if not n:
        return word_hashes, row
    total = np.zeros(n, np.uint64)
    within = np.zeros(n, bool)
    for k in range(width):
        total *= np.uint64(0xFF51AFD7ED558CCD)
        within = np.concatenate([row[k:] == row[: n - k], np.zeros(min(k, n), bool)]) if k < n else np.zeros(n, bool)
        total[: n - k if k < n else 0] += np.where(within[: n - k], word_hashes[k:], np.uint64(0)) if k < n else np.zeros(0, np.uint64)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    count = np.diff(np.append(np.flatnonzero(first), n))
    short = np.repeat(count < width, count)
    take = within | (first & short)
    return mix(total[take]), row[take]


def run_hashes(word_hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words within a row, and the places of their first words. Their cost doesn't grow with width."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _power_tables(len(word_hashes) + 1)
    running = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * power[: len(word_hashes)], out=running[1:])
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix((running[at + width] - running[at]) * inverse[at]), at


def anchors(hashes: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Which of the runs at consecutive places are the least of some `span` consecutive ones; equal least ones all are.

    What is chosen depends on those runs alone, so equal stretches of `span` runs have an anchor in common.
    """
    n = len(at)
    if n < span:
        return np.zeros(n, bool)
    low, width = hashes, 1
    while width < span:
        step = min(width, span - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    # A stretch across rows skips places.
    whole = at[span - 1 :] - at[: n - span + 1] == span - 1
    high = np.zeros(n + span - 1, np.uint64)
    high[span - 1 : n] = np.where(whole, low, np.uint64(0))
    seen = np.zeros(n + span - 1, bool)
    seen[span - 1 : n] = whole
    width = 1
    while width < span:
        step = min(width, span - width)
        high, seen, width = np.maximum(high[:-step], high[step:]), seen[:-step] | seen[step:], width + step
    return seen & (high == hashes)


class MinHash:
    """Signatures of `bands` times `rows` 32-bit minima."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row for each start; starts cut hashes into sets that aren't empty."""
        out = np.empty((len(starts), len(self.a)), np.uint32)
        # Blocks that stay in the processor's cache.
        cut = 0
        while cut < len(starts):
            limit = starts[cut] + 60_000
            to = max(cut + 1, int(np.searchsorted(starts, limit, "right")) - 1)
            if starts[-1] < limit:
                to = len(starts)
            block = hashes[starts[cut] : starts[to] if to < len(starts) else len(hashes)]
            at = starts[cut:to] - starts[cut]
            for k in range(len(self.a)):
                out[cut:to, k] = np.minimum.reduceat(((block * self.a[k] + self.b[k]) >> np.uint64(32)).astype(np.uint32), at)
            cut = to
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One BIGINT for each row and band; equal keys mean equal bands."""
        sig = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)[None, :] * np.uint64(_ODD)
        for k in range(self.rows):
            key = mix(key + sig[:, :, k])
        return key.view(np.int64)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands that find a pair at the threshold with the given probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def row_starts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
