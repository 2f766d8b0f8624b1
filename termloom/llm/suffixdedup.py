"""Suffix-array dedup over bytes: column-wise construction of a collection's BWT and common prefixes.

The corpus is cut to packed strings of consecutive windows (see ``repeats``), dealt to buckets so that
equal windows meet. A bucket's strings are the documents of a collection whose Burrows-Wheeler
transform is built from right to left: round j inserts one symbol, of several bytes, of every sequence that is long enough.
Each round reads the transform, the common prefixes and the string numbers of the round before
once, front to back, and writes the next ones; nothing is sorted but single symbols. The files of a round are
arrays in memory, as a bucket's size is bounded; what outlives a task is written by Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from termloom.llm.repeats import Rule, remove_repeats

#: Bytes of a window and of a minimiser; changes of ``gram`` change no result.
WINDOW, GRAM = 100, 32
#: Bytes that one round inserts of a string: a power of two, 8 at most; changes no result.
SYMBOL = 8
#: Strings whose transform is built together, unless one bucket has more; changes no result.
PORTION = 512


def collection_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: string number, length, common prefix with the one before, and BWT.

    A string ends in a terminator of its own, smaller than any byte and ordered by string number. In
    the BWT, values are byte + 1 and 0 stands where a whole string precedes.

    A column is ``SYMBOL`` bytes wide: the suffixes of a string whose lengths leave the same remainder are those of
    one sequence of symbols, whose last is filled up with terminators, so the transform is built of ``SYMBOL``
    sequences a string in as many times fewer rounds. Symbols are told apart again at the end.
    """
    count = len(strings)
    sizes = np.array([len(x) for x in strings], np.int64)
    # bytes as small codes, 0 kept for terminators
    data = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    if len(used) > 255:
        raise ValueError("UTF-8 has fewer than 256 different bytes")
    codes = np.zeros(256, np.uint8)
    codes[used] = np.arange(1, len(used) + 1)
    ends = np.cumsum(sizes + SYMBOL) - SYMBOL
    text = np.zeros(len(data) + (count + 1) * SYMBOL, np.uint8)
    inside = np.arange(len(data)) + np.repeat(np.arange(count) * SYMBOL, sizes)
    text[inside] = codes[data]
    # the symbol that starts at each byte, numbered in order from 1; 0 is for what precedes a whole string
    wide, reach = text.astype(np.uint64), 1
    while reach < SYMBOL:
        wide = (wide[:-reach] << np.uint64(8 * reach)) | wide[reach:]
        reach *= 2
    symbols = np.zeros(len(text), np.int64)
    kinds, order = np.unique(wide[inside], return_inverse=True)
    symbols[inside] = order + 1
    few = len(kinds) < 2**16
    symbol, kind, shift = (np.uint16, np.uint32, np.uint32(16)) if few else (np.uint32, np.uint64, np.uint64(32))
    symbols = symbols.astype(symbol)
    low_bits = (kind(1) << shift) - kind(1)
    # a string's sequences: the last symbol holds 1, 2, ..., SYMBOL of its bytes
    tail = np.tile(np.arange(1, SYMBOL + 1), count)
    final = np.repeat(ends, SYMBOL) - tail
    lengths = (np.repeat(sizes, SYMBOL) - tail + SYMBOL) // SYMBOL
    n, rounds = len(lengths), int(lengths.max(initial=0))
    if rounds >= 2 ** int(shift):
        raise ValueError("a string is too long for its columns")

    def before(which: np.ndarray, length: int) -> np.ndarray:
        """Symbols in front of the suffixes of a length."""
        out = np.zeros(len(which), symbol)
        more = lengths[which] > length
        out[more] = symbols[final[which[more]] - length * SYMBOL]
        return out

    # a cell holds a symbol of the transform in its low bits and a common prefix above
    which, at = np.arange(n), np.arange(n)  # sequences with a symbol set in the last round, and its places
    cells = before(which, 0).astype(kind)
    for j in range(1, rounds + 1):
        which, at = which[lengths[which] >= j], at[lengths[which] >= j]
        # a stable sort of the symbols puts the suffixes, each longer by its symbol, in order
        bwt = cells.astype(symbol)
        source = _stable_order(bwt)[n - len(which) :]  # a zero for each sequence that is used up
        new = np.full(len(cells), -1, np.int32)
        new[at] = which
        which = new[source]
        inserted = which >= 0
        fresh = np.flatnonzero(inserted)
        which = which[fresh]
        at = n + fresh
        out = np.empty(n + len(source), kind)
        out[:n] = cells[:n]
        np.place(out[n:], np.logical_not(inserted, out=inserted), cells[n:])
        out[at] = before(which, j)
        # common prefixes next to what was inserted: one more than the least between the two sources
        touched = np.empty(2 * len(fresh), np.int64)
        touched[::2], touched[1::2] = fresh, fresh + 1
        first = np.append(True, touched[1:] != touched[:-1])
        touched = touched[first & (touched > 0) & (touched < len(source))][::-1]
        low, high = source[touched - 1], source[touched]
        same = bwt[low] == bwt[high]
        out[n + touched[~same]] &= low_bits
        touched, low, high = touched[same], low[same], high[same]
        if len(touched):
            least = _least((cells >> shift).astype(symbol), low + 1, high + 1).astype(kind)
            out[n + touched] = (out[n + touched] & low_bits) | ((least + kind(1)) << shift)
        cells = out
    # number and length of the suffixes: each sequence is followed through the finished transform
    bwt = cells.astype(symbol)
    number, length, onward = np.empty(len(cells), np.int64), np.empty(len(cells), np.int64), np.zeros(len(cells), np.int64)
    source = _stable_order(bwt)[np.count_nonzero(bwt == 0) :]
    onward[source] = n + np.arange(len(source))
    which, at = np.arange(n), np.arange(n)
    for j in range(rounds + 1):
        number[at], length[at] = which // SYMBOL, tail[which] + (j - 1) * SYMBOL if j else 0
        more = bwt[at] > 0
        which, at = which[more], onward[at[more]]
    # one empty suffix a string, and bytes instead of symbols
    number, length = np.append(np.arange(count), number[n:]), np.append(np.zeros(count, np.int64), length[n:])
    prefix = np.append(np.zeros(count, np.int64), (cells[n:] >> shift).astype(np.int64) * SYMBOL)
    begin = ends[number] - length
    differ = wide[begin[1:] + prefix[1:]] ^ wide[begin[:-1] + prefix[1:]]
    for k in range(1, SYMBOL):
        prefix[1:] += differ < np.uint64(1 << 8 * k)
    prefix[1:] = np.minimum(prefix[1:], np.minimum(length[1:], length[:-1]))
    values = np.append(0, used + 1).astype(np.int16)
    return number, length, prefix, np.where(length < sizes[number], values[text[begin - 1]], 0)


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each range, from the least of every 1, 2, 4, ... values in a row: ranges between
    two of many symbols may be long and overlap."""
    out = np.empty(len(begin), values.dtype)
    level = np.frexp((end - begin).astype(np.float64))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            reach = 1 << (k - 1)
            values = np.minimum(values[:-reach], values[reach:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(values[begin[at]], values[end[at] - (1 << k)])
    return out


def _stable_order(symbols: np.ndarray) -> np.ndarray:
    """Places in order of their symbols; numpy sorts 16 bits by radix."""
    if symbols.dtype == np.uint16:
        return np.argsort(symbols, kind="stable")
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    return order[np.argsort((symbols >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def _by_common_prefix(
    rule: Rule, strings: list[bytes], keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray
) -> list[np.ndarray]:
    """Whole buckets, whose strings stand together, go through the rounds in portions whose arrays fit the processor's cache."""
    again: list[np.ndarray] = []
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).tolist()
    at = 0
    for to in ends:
        if to - at >= PORTION or to == ends[-1]:
            again += _portion(rule, strings[at:to], docs[at:to], starts[at:to], windows[at:to])
            at = to
    return again


def _portion(rule: Rule, strings: list[bytes], docs: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    number, length, prefix, _ = collection_order(strings)
    again = [np.zeros(n, bool) for n in windows.tolist()]
    # a group: neighbours with a whole window in common
    joined = prefix >= rule.window
    inside = joined.copy()
    inside[:-1] |= joined[1:]
    at = np.flatnonzero(inside)
    if not len(at):
        return again
    group = np.cumsum(~joined[at])
    which = number[at].astype(np.int64)
    offset = np.array([len(x) for x in strings], np.int64)[which] - length[at]
    doc, start = docs[which], starts[which] + offset
    order = np.lexsort((start, doc, group))
    first = np.append(True, np.diff(group[order]) > 0)
    lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = (doc[order] > doc[lead]) | (start[order] > start[lead])
    for i, o in zip(which[order][later].tolist(), offset[order][later].tolist()):
        again[i][o] = True
    return again


def suffix_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
    frequent: int = 50_000,
) -> DataFrame:
    """Removes each byte covered by a ``window``-byte string that also starts earlier: in a document of a
    smaller id, or earlier in the same document.

    All strings are judged on the input and lie in one document; matches may overlap. Returns the input's
    columns but the text, and ``kept`` (the bytes left), ``n_units`` (bytes), ``n_removed``, ``n_spans``.
    See ``repeats.remove_repeats`` for missing texts and ids.
    """
    if not 0 < gram <= window:
        raise ValueError("a minimiser has at least one byte and at most the window's")
    rule = Rule(window, gram, words=False, other_document=False, frequent=frequent)
    return remove_repeats(docs, rule, _by_common_prefix, "suffixdedup", id_column, text_column)
