"""Texts of a whole Arrow batch seen as one array of bytes, words and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64; the rolling hashes are polynomials in it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NO_DOC = np.iinfo(np.int64).max


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Document ids; a missing id ranks behind all others."""
    column = column.cast(pa.int64()).fill_null(NO_DOC)
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the bounds of each text; a missing text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(bounds) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, so that what is made of a batch at once stays bounded."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to
        at = to


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without space, tab, line and page breaks) and the first
    word of each text, with one more bound at the end."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a polynomial hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any slices of one array of values, in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, size: int) -> np.ndarray:
        """Hash of the gram that starts at each place; what would run over the end is left out."""
        n = max(0, len(self.back) - size + 1)
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.back[:n])


def super_kmers(
    values: np.ndarray, bounds: np.ndarray, window: int, gram: int, size: int = 1 << 18
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share a minimiser.

    A window is ``window`` consecutive values of one document; its minimiser is its leftmost gram
    of ``gram`` values with the smallest hash. Returns per run the first window's start, the number
    of windows, and the minimiser's hash. Equal windows have equal minimisers wherever they stand.
    Documents are taken in portions of about ``size`` values, whose arrays fit the processor's cache.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in chunks(bounds, size):
        starts, counts, keys = _super_kmers(values[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], window, gram)
        parts.append((starts + bounds[a], counts, keys))
    starts, counts, keys = (np.concatenate(x) for x in zip(*parts))
    return starts, counts, keys


def _super_kmers(
    values: np.ndarray, bounds: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = np.diff(bounds)
    if len(values) < window or not (lengths >= window).any():
        return none
    hashes = Rolling(values).grams(gram)
    # hash above, place below: the smallest is the leftmost of the smallest hashes
    low = np.uint64(0xFFFFFFFF)
    lowest = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = window - gram + 1, 1
    while reach * 2 <= span:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    if reach < span:
        rest = span - reach
        lowest = np.minimum(lowest[:-rest], lowest[rest:])
    # window starts, without those that would run over a document's end
    valid = np.zeros(len(values) + 1, np.int8)
    full = lengths >= window
    np.add.at(valid, bounds[:-1][full], 1)
    np.add.at(valid, bounds[1:][full] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(lowest)]))
    place = (lowest[starts] & low).astype(np.int64)
    first = np.ones(len(starts), bool)
    first[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(starts)))
    return starts[at], counts, hashes[place[at]]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters and digits, and the first of each text, with one more bound."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Rolling(_LOWER[data]).slices(starts, ends), np.searchsorted(starts, bounds)
