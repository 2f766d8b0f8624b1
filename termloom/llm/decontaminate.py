"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max pruning.

Every passage of every document is a query. Items are sorted by length and cut to blocks; a term's
greatest impact in each block bounds what a passage can score there, and blocks whose bound stays below
the threshold are skipped. All items above it are verified by the word shingles of question and answer.
Scores are relative to an item's own: a passage with all its terms scores one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.bytesview import Rolling, bytes_of, plain_words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE, OVERLAP = 5, 0.8
#: Items whose index is sent to the tasks at once; more items take further passes over the documents.
ITEMS_AT_ONCE = 5_000
BLOCK_ITEMS = 16
CHUNK_BYTES = 2 << 20
MATCH = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line, of a single line its last sentence; a single sentence is all question."""
    text = text.strip()
    for mark in ("\n", ". ", "? ", "! "):
        at = text.rfind(mark)
        if at > 0:
            return text[: at + 1], text[at + 1 :]
    return text, ""


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words, first = plain_words(*bytes_of(pa.array(texts, pa.string())))
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def _shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingles; of fewer words the one sequence."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(Rolling(words).grams(min(SHINGLE, len(words))))


@dataclass(frozen=True)
class Index:
    items: list[int | None]
    terms: np.ndarray  # sorted hashes
    impacts: np.ndarray  # term by item, relative to the item's own score
    block_max: np.ndarray  # term by block
    longest: int
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    question_words: list[int]
    answer_words: list[int]


def build_index(ids: list[int | None], texts: list[str], n: int, mean_length: float, frequency: dict[int, int]) -> Index:
    """frequency: documents of the whole benchmark that have a term."""
    words = _hashes(texts)
    order = sorted(range(len(ids)), key=lambda i: (len(words[i]), ids[i] is None, ids[i] or 0))
    ids, texts, words = [ids[i] for i in order], [texts[i] for i in order], [words[i] for i in order]
    terms = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    impacts = np.zeros((len(terms), len(ids)), np.float32)
    df = np.array([frequency[t] for t in terms.view(np.int64).tolist()], float)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    for i, own in enumerate(words):
        at, tf = np.unique(np.searchsorted(terms, own), return_counts=True)
        weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean_length))
        impacts[at, i] = weight / max(weight.sum(), 1e-12)
    blocks = range(0, len(ids), BLOCK_ITEMS)
    block_max = np.stack([impacts[:, b : b + BLOCK_ITEMS].max(axis=1) for b in blocks], axis=1)
    parts = [question_and_answer(t) for t in texts]
    question, answer = _hashes([q for q, _ in parts]), _hashes([a for _, a in parts])
    return Index(
        ids, terms, impacts, block_max, max(map(len, words)),
        [_shingles(w) for w in question], [_shingles(w) for w in answer],
        [len(w) for w in question], [len(w) for w in answer],
    )


def _candidates(index: Index, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(document, first word, word behind the last, item, score) of all passages at or above the threshold."""
    half = max(32, index.longest)
    n = np.diff(first)
    # a passage is two consecutive halves, so that no item is cut by every passage
    halves = np.maximum(1, -(-n // half))
    base = np.append(0, np.cumsum(halves))
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == words)
    doc = np.searchsorted(first, known, "right") - 1
    part = base[doc] + (known - first[doc]) // half
    before = part > base[doc]
    key = np.append(part, part[before] - 1) * len(index.terms) + np.append(at[known], at[known][before])
    key = np.unique(key)
    passage, term = key // len(index.terms), key % len(index.terms)
    found = []
    if not len(key):
        return found
    lead = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    bound = np.add.reduceat(index.block_max[term], lead, axis=0)
    size = np.diff(np.append(lead, len(key)))
    for block in range(bound.shape[1]):
        open_ = bound[:, block] >= THRESHOLD - 1e-4
        if not open_.any():
            continue
        columns = slice(block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS)
        rows = np.repeat(open_, size)
        starts = np.append(0, np.cumsum(size[open_]))[:-1]
        scores = np.add.reduceat(index.impacts[term[rows], columns], starts, axis=0)
        p, item = np.nonzero(scores >= THRESHOLD)
        for p_, item_, score in zip(passage[lead[open_][p]].tolist(), item.tolist(), scores[p, item].tolist()):
            d = int(np.searchsorted(base, p_, "right") - 1)
            low = int(first[d] + (p_ - base[d]) * half)
            found.append((d, low, min(low + 2 * half, int(first[d + 1])), block * BLOCK_ITEMS + item_, score))
    return found


def _verified(index: Index, data: np.ndarray, bounds: np.ndarray) -> list[dict[int, tuple[float, float, float]]]:
    """Per document the items whose question and answer it holds: best score and both overlaps."""
    words, first = plain_words(data, bounds)
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(len(bounds) - 1)]
    grams: dict[tuple[int, int, int], np.ndarray] = {}
    for d, low, high, item, score in _candidates(index, words, first):
        def share(wanted: np.ndarray, n_words: int) -> float:
            if not len(wanted):
                return 1.0
            size = min(SHINGLE, n_words)
            key = low, high, size
            if key not in grams:
                grams[key] = Rolling(words[low:high]).grams(size) if high - low >= size else wanted[:0]
            return float(np.isin(wanted, grams[key]).mean())

        question = share(index.questions[item], index.question_words[item])
        answer = share(index.answers[item], index.answer_words[item])
        if question >= OVERLAP and answer >= OVERLAP:
            old = out[d].get(item, (0.0, 0.0, 0.0))
            out[d][item] = max(old, (score, question, answer))
    return out


def _match(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = bytes_of(batch.column(batch.num_columns - 1))
        lists = []
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
            for old, found in zip(
                batch.column("leaks").slice(at, to - at).to_pylist(),
                _verified(index, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]),
            ):
                new = [
                    {"item_id": index.items[i], "score": s, "question": q, "answer": a}
                    for i, (s, q, a) in sorted(found.items())
                ]
                lists.append(old + new)
            at = to
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lists, batch.schema.field("leaks").type) if name == "leaks" else column
                for name, column in zip(batch.schema.names[:-1], batch.columns[:-1])
            ],
            batch.schema.names[:-1],
        )


def leaks(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The input's columns and ``leaks``: the benchmark items a document holds, with score and overlaps.

    ``items`` has ``item_id, text``; items without text or words are left out, of repeated ids each text counts, and
    a missing id is reported as missing.
    Passages are all stretches of two windows of the longest item's length, over the whole text. An input
    column named ``leaks`` gives way; a missing text holds nothing.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull()).distinct()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = plain_words(*bytes_of(batch.column("text")))
            lists = [np.unique(words[a:b]).view(np.int64).tolist() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(first)), pa.array(lists, pa.list_(pa.int64()))],
                [*batch.schema.names, "n_words", "terms"],
            )

    described = items.mapInArrow(describe, "item_id long, text string, n_words long, terms array<bigint>")
    described = described.where("n_words > 0")
    n, mean_length = described.agg(F.count("*"), F.avg("n_words")).first()
    docs = docs.drop(*[c for c in ("leaks",) if c in docs.columns])
    out = docs.withColumn("leaks", F.array().cast(MATCH))
    passes = -(-n // ITEMS_AT_ONCE)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in out.schema)
    frequency = described.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for part in range(passes):
        some = described.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part)
        rows = some.select("item_id", "text").orderBy("item_id", "text").collect()
        if not rows:
            continue
        terms = some.select(F.explode("terms").alias("term")).distinct()
        known = dict(map(tuple, frequency.join(terms, "term").collect()))
        index = build_index([r.item_id for r in rows], [r.text for r in rows], n, mean_length, known)
        given = out.select(*[F.col(f"`{c}`") for c in out.columns], F.col(text_column).cast("string").alias("__text_to_search"))
        out = given.mapInArrow(partial(_match, index), schema)
    return out
