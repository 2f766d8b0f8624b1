"""Windows that occur more than once in a corpus, found by super-k-mers; shared by two operators.

1. Documents are packed into blocks of bounded size, a written table.
2. Each block reports the minimisers of its windows; those seen once in the corpus cannot belong to a
   repeated window, so only the others are reported back to the blocks that have them.
3. Consecutive windows sharing such a minimiser travel as one packed string to its bucket, each
   distinct string once per block. Windows of a very frequent minimiser travel singly, dealt by
   their own hash, so that no bucket gathers all that surrounds a common passage.
4. An operator's own ``match`` finds equal windows in a bucket.
5. The marks travel back to the blocks, which rewrite their documents.

Every step keys its rows by minimiser or block; a block holds any number of copies of a string in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.bytesview import NO_DOC, Rolling, bytes_of, ids_of, super_kmers, words_of
from termloom.llm.tables import Workspace

BLOCK_SCHEMA = "block long, docs binary, bounds binary, data binary, rest binary"
STRING_SCHEMA = "key long, string binary, first_doc long, first_start long, block long, starts binary, windows int"
MARK_SCHEMA = "block long, starts binary, first_doc long, first_start long, again binary"


@dataclass(frozen=True)
class Rule:
    """What a window is.

    ``words``: windows of words, else of bytes. ``other_document``: only what starts in a document
    of a smaller id counts, else also what starts earlier in the same one.
    """

    window: int
    gram: int
    words: bool
    other_document: bool
    block_bytes: int = 2 << 20
    #: Occurrences from which a minimiser's windows travel singly; changes no result.
    frequent: int = 50_000
    #: Distinct strings that are compared at once, unless one bucket has more.
    strings_at_once: int = 8_192


def blocks_of(docs: DataFrame, id_column: str, text_column: str, rule: Rule) -> DataFrame:
    """Rows of about ``block_bytes`` of text; a longer document is a block of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, (data, bounds) = ids_of(batch.column("__id_of_block_row")), bytes_of(batch.column("__text_of_block_row"))
            rest = batch.drop_columns(["__id_of_block_row", "__text_of_block_row"])
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + rule.block_bytes, "right")) - 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_batch(rest.slice(at, to - at))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number], pa.int64()),
                        "docs": [ids[at:to].tobytes()],
                        "bounds": [(bounds[at : to + 1] - bounds[at]).tobytes()],
                        "data": [squeeze.compress(data[bounds[at] : bounds[to]].tobytes())],
                        "rest": [squeeze.compress(sink.getvalue().to_pybytes())],
                    }
                )
                number, at = number + 1, to

    rows = docs.select(
        F.col(id_column).cast("long").alias("__id_of_block_row"),
        F.col(text_column).cast("string").alias("__text_of_block_row"),
        *[F.col(f"`{c}`") for c in docs.columns if c != text_column],
    )
    return rows.mapInArrow(pack, BLOCK_SCHEMA)


class Block:
    """A block's documents as windows' units: bytes, or words with their places in the bytes."""

    def __init__(self, row: dict, rule: Rule):
        self.rule = rule
        self.number = row["block"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.bytes = zstandard.ZstdDecompressor().decompress(row["data"])
        data = np.frombuffer(self.bytes, np.uint8)
        if rule.words:
            self.starts, self.ends, self.units = words_of(data, self.bounds)
            self.values = Rolling(data).slices(self.starts, self.ends)
        else:
            self.values, self.units = data, self.bounds
        self.row = row

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Super-k-mers: first window, number of windows, minimiser, place of the document."""
        starts, counts, keys = super_kmers(self.values, self.units, self.rule.window, self.rule.gram)
        return starts, counts, keys.view(np.int64), np.searchsorted(self.units, starts, "right") - 1

    def text(self, start: int, length: int) -> bytes:
        """Units as one packed string."""
        if self.rule.words:
            words = zip(self.starts[start : start + length].tolist(), self.ends[start : start + length].tolist())
            return b" ".join([self.bytes[a:b] for a, b in words])
        return self.bytes[start : start + length]


def _minimisers(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row | {"rest": b""}, rule)
            _, _, keys, place = block.runs()
            if rule.other_document:  # once per document
                order = np.lexsort((place, keys))
                keys, place = keys[order], place[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
                keys = keys[new]
            keys, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(keys),
                    "block": pa.array(np.full(len(keys), block.number)),
                    "n": pa.array(counts.astype(np.int32)),
                }
            )


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by a key, put together to tables of about ``rows`` rows or one whole group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            keys = batch.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # its last group may go on
            if cut or held[:-1] and held[-2].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                n = batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _repeated(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "key", 200_000):
        keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        if not len(keys):
            continue
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(n.astype(np.int64), at)
        each = np.repeat(total, np.diff(np.append(at, len(keys))))
        keep = each > 1
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(table.column("block").to_numpy()[keep]),
                "key": pa.array(keys[keep]),
                "frequent": pa.array(each[keep] > rule.frequent),
            }
        )


def _strings(rule: Rule, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's packed strings, each distinct one once, with all its places."""
    found: dict[tuple[int, bytes], list] = {}
    if left.num_rows and right.num_rows:
        block = Block(left.to_pylist()[0] | {"rest": b""}, rule)
        starts, counts, keys, place = block.runs()
        known = right.column("key").to_numpy()
        order = np.argsort(known)
        known, often = known[order], right.column("frequent").to_numpy(zero_copy_only=False)[order]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        single = hit & often[at]
        whole = hit & ~single
        # windows of frequent minimisers one by one
        of = np.repeat(np.flatnonzero(single), counts[single])
        inner = np.arange(len(of)) - np.repeat(np.cumsum(counts[single]) - counts[single], counts[single])
        alone = starts[of] + inner
        alone_keys = Rolling(block.values).slices(alone, alone + rule.window).view(np.int64)
        docs = block.docs[place]
        inside = starts - block.units[place]
        for start, n, key, doc, within in zip(
            np.concatenate([starts[whole], alone]).tolist(),
            np.concatenate([counts[whole], np.ones(len(alone), np.int64)]).tolist(),
            np.concatenate([keys[whole], alone_keys]).tolist(),
            np.concatenate([docs[whole], docs[of]]).tolist(),
            np.concatenate([inside[whole], inside[of] + inner]).tolist(),
        ):
            name = key, block.text(start, n + rule.window - 1)
            entry = found.get(name)
            if entry is None:
                found[name] = [doc, within, [start], n]
            else:
                entry[2].append(start)
                if (doc, within) < (entry[0], entry[1]):
                    entry[0], entry[1] = doc, within
    return pa.table(
        {
            "key": pa.array([key for key, _ in found], pa.int64()),
            "string": pa.array([string for _, string in found], pa.binary()),
            "first_doc": pa.array([x[0] for x in found.values()], pa.int64()),
            "first_start": pa.array([x[1] for x in found.values()], pa.int64()),
            "block": pa.array([left.column("block")[0].as_py() if left.num_rows else 0] * len(found), pa.int64()),
            "starts": pa.array([np.array(x[2], np.int64).tobytes() for x in found.values()], pa.binary()),
            "windows": pa.array([x[3] for x in found.values()], pa.int32()),
        }
    )


#: Distinct strings with key, first document, first start and number of windows -> per string, which windows
#: have an earlier one elsewhere than in the string's own first occurrence.
Match = Callable[[Rule, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _marks(rule: Rule, match: Match, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "key", rule.strings_at_once):
        if not table.num_rows:
            continue
        keys = table.column("key").to_numpy()
        strings = table.column("string").to_pylist()
        docs, starts = table.column("first_doc").to_numpy(), table.column("first_start").to_numpy()
        # the copies of a string from several blocks become one with the first occurrence of all
        number: dict[tuple[int, bytes], int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in zip(keys.tolist(), strings)], np.int64)
        order = np.lexsort((starts, docs, of))
        lead = order[np.flatnonzero(np.append(True, np.diff(of[order]) > 0))]
        windows = table.column("windows").to_numpy()[lead]
        again = [np.zeros(n, bool) for n in windows.tolist()]
        # windows of one string hold its minimiser at different places, so none equals another: a string that
        # is alone in its bucket has nothing to be compared with
        _, bucket, size = np.unique(keys[lead], return_inverse=True, return_counts=True)
        some = np.flatnonzero(size[bucket] > 1)
        if len(some):
            at = lead[some]
            matched = match(rule, [strings[i] for i in at], keys[at], docs[at], starts[at], windows[some])
            for i, mask in zip(some.tolist(), matched):
                again[i] = mask
        marked = np.array([x.any() for x in again])
        places = table.column("starts").to_pylist()
        single = np.bincount(of)[of] == 1
        several = np.array([len(x) > 8 for x in places])
        keep = np.flatnonzero(marked[of] | ~single | several).tolist()
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(table.column("block").to_numpy()[keep]),
                "starts": pa.array([places[i] for i in keep], pa.binary()),
                "first_doc": pa.array(docs[lead][of[keep]]),
                "first_start": pa.array(starts[lead][of[keep]]),
                "again": pa.array([again[of[i]].astype(np.uint8).tobytes() for i in keep], pa.binary()),
            }
        )


def _rewrite(rule: Rule, schema: pa.Schema, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents without the marked windows."""
    if not left.num_rows:
        return schema.empty_table()
    row = left.to_pylist()[0]
    block = Block(row, rule)
    n = len(block.values)
    cover = np.zeros(n + 1, np.int32)
    if right.num_rows:
        right = right.combine_chunks()
        data, bounds = bytes_of(right.column("starts").combine_chunks())
        places, row_of = data.view(np.int64), np.repeat(np.arange(right.num_rows), np.diff(bounds) // 8)
        again, bounds = bytes_of(right.column("again").combine_chunks())
        of = np.searchsorted(block.units, places, "right") - 1
        doc, start = right.column("first_doc").to_numpy()[row_of], right.column("first_start").to_numpy()[row_of]
        later = block.docs[of] > doc
        if not rule.other_document:
            later |= places - block.units[of] > start
        # in a later copy of a string all its windows have an earlier one
        np.add.at(cover, places[later], 1)
        np.add.at(cover, places[later] + np.diff(bounds)[row_of[later]] - 1 + rule.window, -1)
        # in a first one only the marked
        marked = np.flatnonzero(again)
        begin = np.searchsorted(marked, bounds)
        places, row_of = places[~later], row_of[~later]
        n_marked = np.diff(begin)[row_of]
        nth = np.arange(n_marked.sum()) - np.repeat(np.cumsum(n_marked) - n_marked, n_marked)
        at = np.repeat(places - bounds[row_of], n_marked) + marked[np.repeat(begin[row_of], n_marked) + nth]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + rule.window, -1)
    gone = np.cumsum(cover[:n], dtype=np.int32) > 0
    sums = np.append(np.int32(0), np.cumsum(gone, dtype=np.int32))
    removed = sums[block.units[1:]] - sums[block.units[:-1]]
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[block.units[:-1][block.units[:-1] < n]] = gone[block.units[:-1][block.units[:-1] < n]]
    sums = np.append(np.int32(0), np.cumsum(opens, dtype=np.int32))
    spans = sums[block.units[1:]] - sums[block.units[:-1]]
    kept = []
    for a, b, took in zip(block.units[:-1].tolist(), block.units[1:].tolist(), removed.tolist()):
        if rule.words:
            left_over = (a + np.flatnonzero(~gone[a:b])) if took else np.arange(a, b)
            words = zip(block.starts[left_over].tolist(), block.ends[left_over].tolist())
            kept.append(b" ".join([block.bytes[x:y] for x, y in words]))
        else:
            kept.append(block.values[a:b][~gone[a:b]].tobytes() if took else block.bytes[a:b])
    rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()
    out = {name: rest.column(name) for name in schema.names if name in rest.column_names}
    out |= {
        "kept": pa.array(kept, pa.binary()),
        "n_units": pa.array(np.diff(block.units)),
        "n_removed": pa.array(removed.astype(np.int64)),
        "n_spans": pa.array(spans.astype(np.int64)),
    }
    return pa.table({name: out[name] for name in schema.names}).cast(schema)


def remove_repeats(
    docs: DataFrame, rule: Rule, match: Match, name: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every document with what is left of it.

    Returns the input's columns but the text, and ``kept`` (binary), ``n_units``, ``n_removed`` and
    ``n_spans`` (maximal removed runs). Input columns of these four names give way. A missing text is
    empty; rows without an id rank behind all others and among themselves as one document would;
    the same holds for rows that share an id.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = {"kept", "n_units", "n_removed", "n_spans"}
    docs = docs.drop(*[c for c in docs.columns if c in made and c not in (id_column, text_column)])
    space = Workspace(docs.sparkSession, name)
    blocks = space.save(blocks_of(docs, id_column, text_column, rule), "blocks")
    bare = blocks.drop("rest")
    minimisers = bare.mapInArrow(partial(_minimisers, rule), "key long, block long, n int")
    repeated = (
        minimisers.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(partial(_repeated, rule), "block long, key long, frequent boolean")
    )
    repeated = space.save(repeated, "repeated")
    strings = bare.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(partial(_strings, rule), STRING_SCHEMA)
    marks = (
        strings.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_marks, rule, match), MARK_SCHEMA)
    )
    marks = space.save(marks, "marks")
    space.drop("repeated")
    schema = T.StructType(
        [x for x in docs.schema if x.name != text_column]
        + [T.StructField("kept", T.BinaryType())]
        + [T.StructField(x, T.LongType()) for x in ("n_units", "n_removed", "n_spans")]
    )
    return (
        blocks.groupBy("block")
        .cogroup(marks.groupBy("block"))
        .applyInArrow(partial(_rewrite, rule, to_arrow_schema(schema)), schema)
    )


__all__ = ["NO_DOC", "Rule", "remove_repeats"]
