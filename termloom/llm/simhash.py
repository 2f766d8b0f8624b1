"""SimHash near-dedup: fingerprints, a byte-position inverted index with count filtering, components.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most k bits share at
least 8 - k positional bytes, so with k = 4 a linked pair is sure to share four. The index's posting
keys are position triples with their bytes, chosen so that every four positions contain one of the
triples: pairs with too few common bytes to count mostly never meet. Where two fingerprints meet,
their common bytes are tallied, pairs below the guaranteed minimum dropped, the rest verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.bytesview import bytes_of, chunks, words_of
from termloom.llm.components import components
from termloom.llm.repeats import whole_groups
from termloom.llm.tables import Workspace

SHINGLE, MAX_BITS, SEED = 4, 4, 42


def posting_positions(matches: int) -> list[tuple[int, ...]]:
    """Position sets, of at most three positions, such that any ``matches`` of the eight contain one.

    For four: the triples within, or two-and-one around a ring of, three classes of positions. For
    others: all sets of the largest size up to three that ``matches`` positions contain.
    """
    if matches == 4:
        ring = [0, 0, 0, 1, 1, 1, 2, 2]

        def belongs(triple: tuple[int, ...]) -> bool:
            classes = sorted(ring[p] for p in triple)
            return classes[0] == classes[2] or classes in ([0, 0, 1], [1, 1, 2], [0, 2, 2])

        return [t for t in combinations(range(8), 3) if belongs(t)]
    return list(combinations(range(8), min(3, matches)))


def _bits(size: int, seed: int, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    starts, ends, first = words_of(data, bounds)
    # the words' lower-cased bytes, each word with a space behind
    inside = np.zeros(len(data) + 1, np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    to = np.cumsum(ends - starts + 1)
    packed = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    fill = np.ones(len(packed), bool)
    fill[to - 1] = False
    packed[fill] = lower[np.cumsum(inside[:-1]) > 0]
    text = packed.tobytes()
    begin, end = to - (ends - starts) - 1, to - 1
    out = np.zeros(len(bounds) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        n = max(1, b - a - size + 1)
        stops = end[b - n : b]
        hashes = np.array([digest(text[x:y], seed) for x, y in zip(begin[a : a + n].tolist(), stops.tolist())], np.uint64)
        totals = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            octets = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
            totals += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def _fingerprints(size: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = bytes_of(batch.column(batch.num_columns - 1))
        parts = [
            _bits(size, seed, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            for low, high in chunks(bounds)
        ]
        out = np.concatenate([*parts, np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.view(np.int64))], [*batch.schema.names[:-1], "bits"])


def fingerprints(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    seed: int = SEED,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, the long columns ``keys`` and ``bits``: the SimHash of word shingles of the ASCII-lower-cased
    whole text as a signed long."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), *keys, F.col(text_column).cast("string").alias("text")
    )
    schema = ", ".join(f"`{c}` long" for c in ("doc_id", *keys, "bits"))
    return rows.mapInArrow(partial(_fingerprints, shingle, seed), schema)


def _postings(sets: list[tuple[int, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(0).to_numpy()
        octets = np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8).astype(np.int64)
        for number, positions in enumerate(sets):
            key = np.full(len(bits), number, np.int64)
            for p in positions:
                key = (key << 8) | octets[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits)], ["key", "bits"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable place of each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(matches: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a posting list, pairs at growing distance; what is linked already is one tree, not all its pairs."""
    for table in whole_groups(batches, "key", 200_000):
        keys, bits = table.column("key").to_numpy(), table.column("bits").to_numpy()
        octets = bits.view(np.uint8).reshape(-1, 8)
        at, distance = np.arange(len(keys)), 0
        tree_a, tree_b, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while True:
            distance += 1
            at = at[at + distance < len(keys)]
            at = at[keys[at] == keys[at + distance]]
            if not len(at):
                break
            tally = (octets[at] == octets[at + distance]).sum(axis=1)
            a = at[tally >= matches]
            a = a[np.bitwise_count((bits[a] ^ bits[a + distance]).view(np.uint64)) <= most] if len(a) else a
            tree_a, tree_b = np.append(tree_a, a), np.append(tree_b, a + distance)
            if len(tree_a) - held > 1_000_000:
                root = _roots(len(keys), tree_a, tree_b)
                tree_a = np.flatnonzero(root != np.arange(len(keys)))
                tree_b, held = root[tree_a], len(tree_a)
        if len(tree_a):
            root = _roots(len(keys), tree_a, tree_b)
            a = np.flatnonzero(root != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(bits[a]), pa.array(bits[root[a]])], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row: documents linked by up to ``max_bits`` differing bits.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest doc_id reachable. A
    missing text is empty; a text without words has fingerprint zero and is linked like any
    other. Rows without an id take part; a component of only such rows has no id. Copies share a
    fingerprint and are compared once.
    """
    found = near_groups(docs, id_column, text_column, shingle, max_bits, seed)
    return found.select("doc_id", "fingerprint", "component_id")


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """As ``near_duplicates``, with the long columns ``keys`` and with ``root``, a fingerprint that names the
    component also where no row of it has an id."""
    if not 0 <= max_bits <= 7:
        raise ValueError("at most seven differing bits leave one positional byte to match")
    space = Workspace(docs.sparkSession, "simhash")
    prints = space.save(fingerprints(docs, id_column, text_column, shingle, seed, keys), "prints")
    distinct = space.save(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    matches = 8 - max_bits
    links = (
        distinct.select("bits")
        .mapInArrow(partial(_postings, posting_positions(matches)), "key long, bits long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(partial(_links, matches, max_bits), "a long, b long")
    )
    linked = components(links, space)
    rooted = distinct.join(linked, distinct.bits == linked.node, "left").select(
        "bits", "least", F.coalesce("component", "bits").alias("root")
    )
    rooted = space.save(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("bits", "component_id", "root")
    return prints.join(of_print, "bits").select(
        "doc_id", *keys, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )
