"""Quality by Bradley-Terry ranking.

A document's score is a linear function of binned text statistics. Preference pairs, a good document over a
bad one, are fitted by the logistic loss on the difference of their features. The decision is a
quantile of the scores of all labelled documents that may be learned from: their share of bad ones lies below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.bytesview import Rolling, bytes_of, chunks, words_of
from termloom.llm.labelled import fold, logit, one_label, sampled, sigmoid
from termloom.llm.tables import Workspace

#: Labelled rows per label for fitting at most, preference pairs, and bins per statistic.
FIT_ROWS, PAIRS, BINS = 10_000, 40_000, 24
CUT = 0.3
STATISTICS = (
    "bytes", "words", "mean_word", "upper", "digits", "signs", "marks", "bars", "not_ascii", "lines", "line_bytes",
    "sentence_words", "ends_in_sign", "distinct", "next_equal", "top_word", "distinct_pairs", "short", "long",
    "one_case_words", "worst_line_signs", "distinct_lines", "double_marks", "odd_ends",
)


def _classes() -> dict[str, np.ndarray]:
    of = {name: np.zeros(256, bool) for name in ("upper", "lower", "digits", "signs", "marks", "bars", "not_ascii", "ends")}
    of["upper"][65:91] = of["lower"][97:123] = of["digits"][48:58] = of["not_ascii"][128:] = True
    of["signs"][[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True
    of["marks"][[*b"!?"]] = True
    of["bars"][[*b"|"]] = True
    of["ends"][[*b".!?\n"]] = True
    return of


_OF = _classes()


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group the number of distinct values and the largest count of one."""
    if not len(group):
        return np.zeros(groups), np.zeros(groups)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
    at = np.flatnonzero(new)
    most = np.zeros(groups)
    np.maximum.at(most, g[at], np.diff(np.append(at, len(g))))
    return np.bincount(g[at], minlength=groups).astype(float), most


def statistics_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n = len(bounds) - 1
    sizes = np.diff(bounds).astype(float)
    doc = np.repeat(np.arange(n), np.diff(bounds))

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[bounds]).astype(float)

    starts, ends, first = words_of(data, bounds)
    words = np.diff(first).astype(float)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    hashes = Rolling(data).slices(starts, ends)
    per_word = lambda mask: np.bincount(word_doc, mask, n) / np.maximum(words, 1)
    size = ends - starts
    same_doc = word_doc[1:] == word_doc[:-1]
    follows = np.zeros(len(starts), bool)
    follows[1:] = same_doc & (hashes[1:] == hashes[:-1])
    distinct, most = _distinct(word_doc, hashes, n)
    pair = hashes[1:] * np.uint64(31) + hashes[:-1]
    distinct_pairs, _ = _distinct(word_doc[1:][same_doc], pair[same_doc], n)
    upper = np.append(0, np.cumsum(_OF["upper"][data]))
    lower = np.append(0, np.cumsum(_OF["lower"][data]))
    shouted = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    ends_in_sign = _OF["signs"][last]
    double = np.zeros(len(starts), bool)
    double[size > 1] = last[size > 1] == data[ends[size > 1] - 2]
    odd = double & ~_OF["lower"][last] & ~_OF["upper"][last] & ~_OF["not_ascii"][last] & ~_OF["digits"][last]
    marks = total(_OF["marks"][data])
    # lines: their hashes, and the most signs a line has for its length
    breaks = data == 10
    line_starts = np.zeros(len(data) + 1, bool)
    line_starts[bounds[:-1][sizes > 0]] = True
    line_starts[1:] |= breaks
    line_at = np.flatnonzero(line_starts[: len(data)])
    line_end = np.append(line_at[1:], len(data))
    line_doc = doc[line_at] if len(line_at) else line_at
    distinct_lines, _ = _distinct(line_doc, Rolling(data).slices(line_at, line_end), n)
    signs = np.append(0, np.cumsum(_OF["signs"][data]))
    worst = np.zeros(n)
    if len(line_at):
        np.maximum.at(worst, line_doc, (signs[line_end] - signs[line_at]) / np.maximum(line_end - line_at, 20))
    lines = total(breaks) + (sizes > 0)
    some = np.maximum(sizes, 1)
    twice = np.zeros(len(data), bool)
    twice[1:] = _OF["marks"][data[1:]] & _OF["marks"][data[:-1]]
    columns = (
        np.log1p(sizes), np.log1p(words), sizes / np.maximum(words, 1), total(_OF["upper"][data]) / some,
        total(_OF["digits"][data]) / some, total(_OF["signs"][data]) / some, marks / some, total(_OF["bars"][data]) / some,
        total(_OF["not_ascii"][data]) / some, np.log1p(lines), np.log1p(sizes / np.maximum(lines, 1)),
        np.log1p(words / (total(_OF["ends"][data]) + 1)), per_word(ends_in_sign), distinct / np.maximum(words, 1),
        per_word(follows), most / np.maximum(words, 1), distinct_pairs / np.maximum(words - 1, 1), per_word(size <= 2),
        per_word(size >= 16), per_word(shouted), worst, distinct_lines / np.maximum(lines, 1), total(twice) / some,
        per_word(odd),
    )
    return np.stack(columns, axis=1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = bytes_of(batch.column(1))
        parts = [
            statistics_of(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            for low, high in chunks(bounds, 2 << 20)
        ]
        x = np.concatenate([*parts, np.zeros((0, len(STATISTICS)))])
        flat = pa.array(x.ravel())
        offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "features"]
        )


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for j, (edges, weights) in enumerate(zip(self.edges, self.weights)):
            total += weights[np.searchsorted(edges, x[:, j])]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x) - self.cut + logit(CUT))


def fit(x: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Logistic loss on feature differences of good and bad documents, paired round robin.

    Without both labels there is no pair: every score is then the cut itself or above.
    """
    k = len(STATISTICS)
    if not len(x):
        return Model(np.zeros((k, BINS - 1)), np.zeros((k, BINS)), 0.0)
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    weights = np.zeros((k, BINS))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(edges, weights, 0.0)
    bins = np.stack([np.searchsorted(edges[j], x[:, j]) + j * BINS for j in range(k)], axis=1)
    turn = np.arange(max(PAIRS, len(good), len(bad)) if len(good) * len(bad) > PAIRS else len(good) * len(bad))
    a = good[turn % len(good)]
    b = bad[(turn // len(good) + turn) % len(bad)]
    flat, mean, square = weights.ravel(), np.zeros(k * BINS), np.zeros(k * BINS)
    for step in range(1, rounds + 1):
        raw = flat[bins].sum(axis=1)
        pull = sigmoid(raw[b] - raw[a]) / len(a)
        by_doc = np.bincount(b, pull, len(x)) - np.bincount(a, pull, len(x))
        gradient = decay * flat / len(flat) + sum(np.bincount(bins[:, j], by_doc, k * BINS) for j in range(k))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        flat -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Model(edges, flat.reshape(k, BINS), 0.0)


def _ordered(raw: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (raw + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _double(key: int) -> float:
    bits = np.int64(key)
    return float((bits ^ np.int64(0x7FFFFFFFFFFFFFFF) if bits < 0 else bits).view(np.float64))


def _cut(keys: DataFrame, at: int) -> float:
    """The middle between the ``at``-th smallest of ``key`` and the next, by counts of 16 bits at a time."""
    prefix, left, own = 0, at, keys
    for shift in (48, 32, 16, 0):
        counts = own.groupBy(F.shiftright("key", shift).alias("digits")).agg(F.count("*").alias("n"))
        for digits, n in sorted(map(tuple, counts.collect())):
            prefix = digits
            if left <= n:
                break
            left -= n
        own = keys.where(F.shiftright("key", shift) == prefix)
    upto = F.col("key") <= prefix
    n, after = keys.agg(F.count(F.when(upto, 1)), F.min(F.when(~upto, F.col("key")))).first()
    return (_double(prefix) + _double(prefix if n > at or after is None else after)) / 2


def quality(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: 0 to 1, at least 0.3 for what ranks above the quantile.

    ``labels`` has ``doc_id, quality``; ``learn_from`` says, by document id, which may be learned from. At most
    ``fit_rows`` rows of each label are fitted on, and the quantile is that of all rows that may be learned from; every
    whole text is described and scored. A missing text is empty.
    """
    space = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    described = space.save(rows.mapInArrow(_describe, "doc_id long, features array<double>"), "features")
    known = one_label(labels.where(learn_from), "quality")
    learned = described.join(known, "doc_id")
    chosen = sampled(learned, fit_rows).orderBy(F.xxhash64("doc_id"), "doc_id", "features").toPandas()
    x = np.array(chosen["features"].tolist(), np.float64).reshape(len(chosen), len(STATISTICS))
    model = fit(x, chosen["label"].to_numpy(np.int64))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(_ordered(model.raw(x))), batch.column(1)], ["key", "label"])

    if {0, 1} <= set(chosen["label"]):
        keys = space.save(learned.select("features", "label").mapInArrow(order, "key long, label int"), "order")
        # as many below the cut as there are bad ones
        model = replace(model, cut=_cut(keys, keys.where("label = 0").count()))
        space.drop("order")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return described.mapInArrow(score, "doc_id long, score double")


def learnable(id_column: str = "doc_id") -> Column:
    """Rows whose crc32 modulo 5 is not 0; the others are held out."""
    return F.coalesce(fold(id_column, 5) != 0, F.lit(False))
