"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and
word beginnings; a document's is the noisy-or of its sentences. Only documents carry labels: the likelihood of
the noisy-or trains the sentence scores, which then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.bytesview import Rolling, bytes_of, chunks
from termloom.llm.labelled import fold, logit, one_label, sampled, sigmoid
from termloom.llm.tables import Workspace

#: Labelled rows per label that the model is fitted on at most.
FIT_ROWS = 3000
#: Lengths of word beginnings in bytes, which are features beside the words.
BEGINNINGS = (4, 5, 6, 7, 8)
CUT, OFFENDING = 0.7, 0.5
#: Bytes of text whose words are held at once; what is made of them takes some 60 times as much.
AT_ONCE = 1 << 19
#: The logit of a sentence with nothing known in it, so that very many of them stay harmless.
BIAS = -9.0
#: A feature can get a weight if it stands in this many documents and the logarithm of its shares' ratio, toxic to
#: other documents and drawn towards zero by this many documents of the sample's own mixture, reaches the least evidence.
SEEN, EVIDENCE, DRAWN = 3, 1.0, 4.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[10, 13, 33, 46, 63]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Bags:
    """Hashes of each word and its beginnings, the sentence of each word and the document of each sentence."""

    features: np.ndarray
    sentence_of_word: np.ndarray
    doc_of_sentence: np.ndarray
    bounds: np.ndarray  # first and last byte of each sentence's words
    docs: int


def bags_of(data: np.ndarray, bounds: np.ndarray) -> Bags:
    """Sentences end at line breaks and at . ! ? and hold at least one word, a run of letters and digits."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    inside = _LETTER[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    breaks = np.cumsum(_END[data] | edge[:-1]) if n else np.zeros(0, np.int64)
    number = breaks[starts]
    new = np.append(True, number[1:] != number[:-1]) if len(number) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    rolling = Rolling(_LOWER[data])
    columns = [rolling.slices(starts, ends)]
    for size in BEGINNINGS:  # unlike the hash of the same word in full
        columns.append(~rolling.slices(starts, np.minimum(ends, starts + size)) ^ np.uint64(size))
    features = np.stack(columns)
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(starts)) - 1 if len(lead) else lead
    return Bags(
        features,
        sentence,
        np.searchsorted(bounds, starts[lead], "right") - 1,
        np.stack([starts[lead], ends[last]]) if len(lead) else np.zeros((2, 0), np.int64),
        len(bounds) - 1,
    )


@dataclass(frozen=True)
class Known:
    """What the fit needs of the sampled documents: the places of known features and their sentences."""

    places: np.ndarray
    sentence_of_place: np.ndarray
    doc_of_sentence: np.ndarray
    docs: int


def _places(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Place of each feature among the sorted known ones, and one behind the last for all others."""
    if not len(known):
        return np.zeros(features.shape, np.int32)
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return np.where(known[at] == features, at, len(known)).astype(np.int32)


def _none_toxic(bags: Bags | Known, logits: np.ndarray) -> np.ndarray:
    """Per document the logarithm of the chance that no sentence is toxic."""
    return np.bincount(bags.doc_of_sentence, -np.logaddexp(0, logits), bags.docs)


def _log_odds(none: np.ndarray) -> np.ndarray:
    """Of the noisy-or; a document without sentences has none."""
    none = np.minimum(none, -1e-300)
    return np.where(none > -1e-12, np.log(-none), np.log(-np.expm1(none)) - none)


@dataclass(frozen=True)
class Model:
    known: np.ndarray  # hashes of the features that count, in order
    weights: np.ndarray  # theirs, and a zero for all others
    bias: float

    def logits(self, bags: Bags) -> np.ndarray:
        words = self.weights[_places(self.known, bags.features)].sum(axis=0)
        return self.bias + np.bincount(bags.sentence_of_word, words, len(bags.doc_of_sentence))

    def scores(self, none: np.ndarray) -> np.ndarray:
        return np.where(none == 0, 0.0, sigmoid(_log_odds(none) + logit(CUT)))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Bags]]:
    """Bags of the batch's texts, its last column, in chunks of rows."""
    data, bounds = bytes_of(batch.column(batch.num_columns - 1))
    for low, high in chunks(bounds, AT_ONCE):
        yield low, high, bags_of(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])


def _lists(doc: np.ndarray, values: np.ndarray, docs: int) -> pa.Array:
    """Values, in order of their documents, as one list per document."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)), pa.array(values))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row a print of each sentence."""
    for batch in batches:
        for low, high, bags in _parts(batch):
            words = (bags.features[0] >> np.uint64(24)).astype(np.float64)
            prints = np.bincount(bags.sentence_of_word, words, len(bags.doc_of_sentence))
            lists = _lists(bags.doc_of_sentence, prints, bags.docs)
            yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:-1]), lists], [*batch.schema.names[:-1], "prints"])


def _own(prints: list[np.ndarray]) -> np.ndarray:
    """Documents of which most sentences do not stand in earlier ones, so copies are no evidence."""
    sizes = np.array([len(p) for p in prints], np.int64)
    fresh = np.zeros(sizes.sum())
    fresh[np.unique(np.concatenate([*prints, np.zeros(0)]), return_index=True)[1]] = 1
    return 2 * np.bincount(np.repeat(np.arange(len(sizes)), sizes), fresh, len(sizes)) > sizes


def _counted(own: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with their documents and their toxic ones, of the rows that are ``own``."""
    for batch in batches:
        labels = batch.column("label").to_numpy().astype(np.float64)
        counted = np.isin(batch.column("row").to_numpy(), own)
        for low, high, bags in _parts(batch):
            doc = bags.doc_of_sentence[bags.sentence_of_word]
            some = counted[low:high][doc]
            doc = doc[some]
            for column in bags.features:
                values, number = np.unique(column[some], return_inverse=True)
                pairs = np.unique(number * bags.docs + doc)
                shared = np.bincount(pairs // bags.docs, minlength=len(values))
                toxic = np.bincount(pairs // bags.docs, labels[low:high][pairs % bags.docs], len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(shared), pa.array(toxic.astype(np.int64))],
                    ["feature", "shared", "toxic"],
                )


def _found(own: np.ndarray, known: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row that is ``own`` the number of its sentences, and where which known features stand."""
    for batch in batches:
        batch = batch.filter(pa.array(np.isin(batch.column("row").to_numpy(), own)))
        for low, high, bags in _parts(batch):
            places = _places(known, bags.features)
            hit = places < len(known)
            sentence = np.broadcast_to(bags.sentence_of_word, places.shape)[hit]
            order = np.argsort(sentence, kind="stable")
            sentence, place = sentence[order], places[hit][order]
            doc = bags.doc_of_sentence[sentence]
            first = np.searchsorted(bags.doc_of_sentence, np.arange(bags.docs + 1))
            within = (sentence - first[doc]).astype(np.int64)
            columns = [pa.array(np.diff(first)), _lists(doc, within, bags.docs), _lists(doc, place, bags.docs)]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(low, high - low) for c in batch.columns[:-1]), *columns],
                [*batch.schema.names[:-1], "sentences", "within", "places"],
            )


def _in_order(rows: DataFrame, *lists: str) -> tuple[dict[str, np.ndarray], dict[str, list[np.ndarray]]]:
    table = rows.toArrow().sort_by([("order", "ascending"), ("row", "ascending")])
    flat = {c: table.column(c).to_numpy() for c in table.column_names if c not in lists}
    return flat, {c: [np.asarray(x.values) for x in table.column(c)] for c in lists}


def _telling(counts: DataFrame, base: float) -> DataFrame:
    """Features with enough evidence; it compares shares within each label, so the labels' own ratio does not move it."""
    toxic = (F.col("toxic") + DRAWN * base) / base
    other = (F.col("shared") - F.col("toxic") + DRAWN * (1 - base)) / (1 - base)
    return counts.where((F.col("shared") >= SEEN) & (F.log(toxic / other) >= EVIDENCE)).select("feature")


def learn(sample: DataFrame) -> Model:
    """Of ``order, row, label, text``, whole texts: tasks turn them to prints, counts and places of the features
    with some evidence, which alone reach the driver; the regularised fit decides what they weigh. Copies count once."""
    nothing = Model(np.zeros(0, np.uint64), np.zeros(1), BIAS)
    keys = "order long, row long, label int"
    flat, lists = _in_order(sample.mapInArrow(_prints, f"{keys}, prints array<double>"), "prints")
    labels = flat["label"].astype(np.int64)
    own = _own(lists["prints"]) if len(labels) else np.zeros(0, bool)
    if not own.any() or labels[own].min() == labels[own].max():
        return nothing
    rows = np.sort(flat["row"][own])
    counts = sample.mapInArrow(partial(_counted, rows), "feature long, shared long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("shared").alias("shared"), F.sum("toxic").alias("toxic"))
    telling = _telling(counts, float(labels[own].mean())).toArrow()
    known = np.sort(telling.column("feature").to_numpy().astype(np.int64).view(np.uint64))
    schema = f"{keys}, sentences long, within array<bigint>, places array<int>"
    flat, lists = _in_order(sample.mapInArrow(partial(_found, rows, known), schema), "within", "places")
    sentences, hits = flat["sentences"], np.array([len(x) for x in lists["places"]])
    first = np.append(0, np.cumsum(sentences))[:-1]
    bags = Known(
        np.concatenate([*lists["places"], np.zeros(0, np.int32)]).astype(np.int64),
        np.concatenate([*lists["within"], np.zeros(0, np.int64)]).astype(np.int64) + np.repeat(first, hits),
        np.repeat(np.arange(len(sentences)), sentences),
        len(sentences),
    )
    return Model(known, fit(len(known), bags, flat["label"].astype(np.int64)), BIAS)


def loss_of(weights: np.ndarray, bags: Known, labels: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the noisy-or with squared weights added, both labels weighing the same, and its
    gradient. The last weight stands for unknown words."""
    logits = BIAS + np.bincount(bags.sentence_of_place, weights[bags.places], len(bags.doc_of_sentence))
    none = _none_toxic(bags, logits)
    some = np.maximum(-np.expm1(none), 1e-12)
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    loss = float((share * np.where(labels == 1, -np.log(some), -none)).sum() + decay / 2 * (weights**2).sum())
    pull = np.where(labels == 1, -np.exp(none) / some, 1.0) * share
    by_sentence = pull[bags.doc_of_sentence] * sigmoid(logits)
    return loss, np.bincount(bags.places, by_sentence[bags.sentence_of_place], len(weights)) + decay * weights


def fit(known: int, bags: Known, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights of the features, and a zero for all others: gradient steps on the noisy-or likelihood, scaled by
    running means of the gradient and of its square."""
    weights, mean, square = np.zeros(known + 1), np.zeros(known + 1), np.zeros(known + 1)
    for i in range(1, rounds + 1):
        _, gradient = loss_of(weights, bags, labels, decay)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights = weights - rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return weights


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = bytes_of(batch.column(batch.num_columns - 1))
        scores, offending = [np.zeros(0)], [[] for _ in range(batch.num_rows)]
        for low, high in chunks(bounds, AT_ONCE):
            own = data[bounds[low] : bounds[high]]
            bags = bags_of(own, bounds[low : high + 1] - bounds[low])
            logits = model.logits(bags)
            scores.append(model.scores(_none_toxic(bags, logits)))
            for i in np.flatnonzero(logits >= logit(OFFENDING)).tolist():
                first, last = bags.bounds[:, i]
                text = own[first:last].tobytes().decode("utf-8", "replace")
                offending[low + bags.doc_of_sentence[i]].append(text)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.concatenate(scores)), pa.array(offending, pa.list_(pa.string()))],
            [*batch.schema.names[:-1], "score", "offending"],
        )


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The input's columns, with ``score`` (0 to 1) and ``offending`` (sentences that score at least 0.5).

    ``labels`` has ``doc_id, toxic``; ``learn_from`` says, by document id, which rows may be learned from. The
    model is fitted on the whole texts of at most ``fit_rows`` rows of each label, different texts of a repeated id
    being rows of their own and equal ones a single row; of labels that clash the larger counts, and others than 0 and 1 do not. Without both
    labels nothing is learned and every document scores low. A score of 0.7 means that a toxic sentence is as likely as none,
    both labels weighing the same. Every whole text is scored, in chunks of rows. A text without words scores 0. Missing
    texts are empty; input columns named like the two new ones give way.
    """
    docs = docs.drop(*[c for c in ("score", "offending") if c in docs.columns])
    known = one_label(labels.where(learn_from & F.col("toxic").isin(0, 1)), "toxic")
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    ).withColumn("print", F.xxhash64("text"))
    different = texts.select("doc_id", "print").join(known, "doc_id").distinct()
    chosen = F.broadcast(sampled(different, fit_rows, "doc_id", "print"))  # two labels, so twice fit_rows at most
    space = Workspace(docs.sparkSession, "toxicity")
    sample = texts.join(chosen, ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select(
        F.xxhash64("doc_id", "print").alias("order"), F.monotonically_increasing_id().alias("row"), "label", "text"
    )
    model = learn(space.save(sample, "sample"))
    space.drop("sample")
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(text_column).cast("string").alias("__text_to_score"))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    return given.mapInArrow(partial(_score, model), f"{schema}, score double, offending array<string>")


def learnable(id_column: str = "doc_id") -> Column:
    """Rows whose crc32 modulo 3 is not 1; the others are held out."""
    return F.coalesce(fold(id_column, 3) != 1, F.lit(False))
