"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Documents are cut into blocks of bounded size. A block's pair-document records (ids of two tokens that end at the same byte,
the document, how often) are partitioned by radix of the second side's id, sorted side-major, and written as zstd runs to a table in
the shared folder. Runs are merged with a heap, at most ``FAN`` at a time and level by level, each level adding up the counts of
equal pairs, so a pair that stands in every block is one entry per run. In the last merge all pairs of one id of the second side follow
one another, which yields its highest count. The counts then go back to the runs of each block, whose records become contributions
to the block's documents.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.tables import Workspace

TOKENIZERS = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and of those that are encoded at once.
BLOCK_BYTES, ENCODE_BYTES = 4 << 20, 1 << 19
RADIXES, FAN, CHUNK = 32, 64, 1 << 14
#: Parts of texts whose ids a process remembers at most, and their characters; both are forgotten together.
PARTS, PART_CHARS = 1 << 18, 1 << 22
#: Characters of parts that are encoded side by side.
LINE_CHARS = 1_000
SPILLED = (
    "block long, radix int, heads array<binary>, records binary, "
    "pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
)
HEADS = "radix int, part long, heads array<binary>"
COUNTED = "radix int, counts array<binary>"
GIVEN = "block long, given binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


# --- the two sides ----------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level entries: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Spelling:
    """Byte strings by number in one array, so that many of them are strung together at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the numbers' strings and the end of each."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.data[at], ends


def bounds_of(ends: np.ndarray, counts: np.ndarray) -> list[int]:
    """Where each text's share of strung-together strings begins, and the last one's end."""
    return np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()


#: One space between two characters that no tokenizer takes for white space.
CUT = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
#: What may stand on both sides of a ``CUT``.
ENDS = re.compile("[^\\s\u180e](?s:.*[^\\s\u180e])?\\Z")


def cut_alike(first: bytes, second: bytes) -> bool:
    """Whether both tokenizers give a text the ids of its parts one by one, cut in front of every ``CUT``.

    True if the first one splits by the byte-level expression, none of whose matches holds a space behind another character, and the
    second one merges pairs of text that it does not change into pieces none of which holds one either. Of any other kind nothing is known.
    """
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    a = json.loads(first)
    level, model = a.get("pre_tokenizer") or {}, a.get("model") or {}
    plain = level.get("type") == "ByteLevel" and level.get("use_regex") is True and level.get("add_prefix_space") is False
    plain = plain and model.get("type") == "BPE" and not model.get("dropout") and not a.get("normalizer") and not a.get("truncation")
    plain = plain and not a.get("padding") and all(x.get("special") for x in a.get("added_tokens") or [])
    b = sentencepiece_model_pb2.ModelProto.FromString(second)
    norm, kind = b.normalizer_spec, type(b).SentencePiece
    plain = plain and b.trainer_spec.model_type == type(b.trainer_spec).BPE and not b.trainer_spec.treat_whitespace_as_suffix
    plain = plain and not norm.precompiled_charsmap and not norm.normalization_rule_tsv and not norm.remove_extra_whitespaces
    plain = plain and norm.add_dummy_prefix and norm.escape_whitespaces
    return plain and not any(x.type in (kind.USER_DEFINED, kind.UNUSED) or re.search("[^▁]▁", x.piece) for x in b.pieces)


class Encoders:
    """Both tokenizers and the bytes of their entries.

    A text is encoded in parts, words mostly, and a part that is remembered is not encoded again; texts whose
    tokens do not give them back, and all texts if the tokenizers are not ``cut_alike``, are encoded whole.
    """

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters = _byte_letters()
        a_bytes = [b""] * self.first.get_vocab_size(with_added_tokens=True)
        for entry, i in self.first.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.a, self.b = Spelling(a_bytes), Spelling(b_bytes)
        # each id with each of the marks that may follow it, at 3 * id + mark
        self.marked = Spelling([b"%d%c" % (i, mark) for i in range(max(len(a_bytes), len(b_bytes))) for mark in b",|;"])
        self.cut_alike = cut_alike(first, second)
        self.forget()

    def forget(self) -> None:
        """Each part has a number, and per side ids and how many; a part of another spelling has none."""
        self.numbers: dict[str, int] = {}
        self.chars = 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def learn(self, parts: list[str]) -> None:
        """Parts that can stand side by side are encoded as lines of some, whose ids are told apart by the parts' bytes."""
        lines: list[list[str]] = [[]]
        alone, size = [], 0
        for part in parts:
            if not ENDS.match(part):
                alone.append(part)
                continue
            if size > LINE_CHARS:
                lines.append([])
                size = 0
            lines[-1].append(part)
            size += len(part)
        pairs = self.encode_whole([" ".join(x) for x in lines])
        told = [i for i, pair in enumerate(pairs) if len(pair[0])]
        alone += [part for line, pair in zip(lines, pairs) if not len(pair[0]) for part in line]
        known = [part for i in told for part in lines[i]]
        ends = np.cumsum(np.array([len(x.encode()) + 1 for x in known], np.int64))
        single = self.encode_whole(alone)
        self.numbers.update(zip(known + alone, range(len(self.numbers), len(self.numbers) + len(parts))))
        self.chars += sum(map(len, parts))
        for side, spelling in ((0, self.a), (1, self.b)):
            ids = np.concatenate([np.zeros(0, np.int32), *(pairs[i][side] for i in told)])
            upto = np.searchsorted(np.cumsum(spelling.sizes[ids]), ends, "right")
            self.ids[side] = np.concatenate([self.ids[side], ids, *(pair[side] for pair in single)])
            self.sizes[side] = np.concatenate([self.sizes[side], np.diff(upto, prepend=0), [len(pair[side]) for pair in single]]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none where a side's bytes are not those of a space and the text."""
        if not self.cut_alike:
            return self.encode_whole(texts)
        split = [CUT.split(text) for text in texts]
        parts = list(itertools.chain.from_iterable(split))
        new = [x for x in dict.fromkeys(parts) if x not in self.numbers]
        if len(self.numbers) + len(new) > PARTS or self.chars + sum(map(len, new)) > PART_CHARS:
            self.forget()
            new = list(dict.fromkeys(parts))
        if new:
            self.learn(new)
        numbers = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        counts = np.array([len(x) for x in split], np.int64)
        sides = []
        for ids, sizes in zip(self.ids, self.sizes):
            own = sizes[numbers]
            ends = np.cumsum(own)
            at = np.repeat((np.cumsum(sizes) - sizes)[numbers] - ends + own, own)
            at += np.arange(len(at))
            sides.append((ids[at], bounds_of(ends, counts)))
        unlike = np.bincount(np.repeat(np.arange(len(texts)), counts), self.sizes[0][numbers] == 0, len(texts))
        out = [tuple(ids[at[i] : at[i + 1]] for ids, at in sides) for i in range(len(texts))]
        for i in np.flatnonzero(unlike).tolist():
            out[i] = self.encode_whole([texts[i]])[0]
        return out

    def encode_whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        firsts = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        sides = [[np.array(x.ids, np.int32) for x in firsts]]
        del firsts
        sides.append([np.array(x, np.int32) for x in self.second.encode(texts, num_threads=1)])
        spelled = []
        for ids, spelling in zip(sides, (self.a, self.b)):
            data, ends = spelling.of(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            spelled.append((data, bounds_of(ends, np.array([len(x) for x in ids], np.int64))))
        none, out = (np.zeros(0, np.int32),) * 2, []
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            same = text and all(data[at[i] : at[i + 1]].tobytes() == whole for data, at in spelled)
            out.append((sides[0][i], sides[1][i]) if same else none)
        return out


@functools.lru_cache(maxsize=1)
def _encoders(first: bytes, second: bytes) -> Encoders:
    return Encoders(first, second)


# --- runs --------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, none below zero, as one zstd frame: each array in the fewest bytes a number, byte by byte."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        high = int(a.max(initial=0))
        size = 1 if high < 1 << 8 else 2 if high < 1 << 16 else 4 if high < 1 << 32 else 8
        parts.append(bytes([size]))
        parts.append(np.ascontiguousarray(a.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(frame: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n, 8).tolist(), 8 * (n + 1), []
    for size in sizes:
        width = data[at]
        planes = np.frombuffer(data, np.uint8, size * width, at + 1).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 1 + size * width
    return out


def head_run(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Sorted pairs and their counts in frames of ``CHUNK`` pairs."""
    return [
        pack(np.diff(keys[at : at + CHUNK], prepend=0), counts[at : at + CHUNK]) for at in range(0, len(keys), CHUNK)
    ]


def read_head(frames: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for frame in frames:
        gaps, counts = unpack(frame)
        yield np.cumsum(gaps), counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = keys.argsort(kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge: pairs in order with their counts over all runs.

    Of each run one frame is held. The heap's least last key tells up to where all frames are complete; that far
    they are taken and added up, and the frames that are used up are followed by the next ones.
    """
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ends: list[tuple[int, int]] = []

    def follow(i: int) -> None:
        for keys, counts in runs[i]:
            if len(keys):
                held[i] = keys, counts
                heapq.heappush(ends, (int(keys[-1]), i))
                return
        held.pop(i, None)

    for i in range(len(runs)):
        follow(i)
    while ends:
        bound, taken = ends[0][0], []
        for i, (keys, counts) in list(held.items()):
            cut = int(np.searchsorted(keys, bound, "right"))
            taken.append((keys[:cut], counts[:cut]))
            held[i] = keys[cut:], counts[cut:]
        while ends and ends[0][0] == bound:
            follow(heapq.heappop(ends)[1])
        yield summed(np.concatenate([k for k, _ in taken]), np.concatenate([c for _, c in taken]))


def with_best(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds to merged pairs whether a count is the highest of its second id; the last id waits until it is complete."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = keys >> 32
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        return keys, counts, (counts == most).astype(np.int64)

    for more, added in pairs:
        keys, counts = np.concatenate([keys, more]), np.concatenate([counts, added])
        cut = int(np.searchsorted(keys >> 32, keys[-1] >> 32)) if len(keys) else 0
        if cut:
            yield told(keys[:cut], counts[:cut])
            keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield told(keys, counts)


# --- documents to runs ----------------------------------------------------------------


def _block(encoders: Encoders, ids: list[int | None], texts: list[str], radixes: int, text: bool, block: int) -> pa.RecordBatch:
    """One block: a row per document and a row per radix."""
    encoded: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= ENCODE_BYTES):
            size += len(texts[to])
            to += 1
        encoded += encoders.encode(texts[at:to])
        at = to
    n_a, n_b = (np.array([len(pair[side]) for pair in encoded], np.int64) for side in (0, 1))
    a, b = (np.concatenate([pair[side] for pair in encoded]).astype(np.int64) for side in (0, 1))
    # both sides of a document have the same bytes, so ends may be counted through the whole block
    a_ends, b_ends = np.cumsum(encoders.a.sizes[a]), np.cumsum(encoders.b.sizes[b])
    total = int(a_ends[-1]) if len(a) else 0
    of_a, of_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    of_a[a_ends], of_b[b_ends] = True, True
    a_last, b_last = of_b[a_ends], of_a[b_ends]
    doc = np.repeat(np.arange(len(texts)), n_a)[a_last]
    links = np.bincount(doc, minlength=len(texts))
    keys = (b[b_last] << 32) | a[a_last]
    # groups as text: a group's first ids, then its second ones; a mark follows each id
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_before = np.cumsum(np.bincount(a_group, minlength=len(keys)))  # first ids up to the end of a group
    b_before = np.append(0, np.cumsum(np.bincount(b_group, minlength=len(keys))))  # second ids before a group
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + b_before[a_group]] = 3 * a + a_last
    code[np.arange(len(b)) + a_before[b_group]] = 3 * b + 2 * b_last
    data, ends = encoders.marked.of(code)
    at_ = bounds_of(ends, n_a + n_b)
    groups = []
    for start, end in zip(at_[:-1], at_[1:]):
        own = data[start : max(start, end - 1)].tobytes()  # without the last mark
        groups.append("" if start == end else own.decode() if text else hashlib.sha256(own).hexdigest())
    # records: pair, document, how often; pairs side-major
    order = keys.argsort(kind="stable")  # documents stay in order inside a pair
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else order
    times = np.diff(np.append(first, len(keys)))
    keys, doc = keys[first], doc[first]
    radix = (keys >> 32) % radixes
    heads, records = [], []
    for r in range(radixes):
        own = np.flatnonzero(radix == r)
        k, t = keys[own], times[own]
        at_ = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else own
        heads.append(head_run(k[at_], np.add.reduceat(t, at_) if len(at_) else t))
        records.append(pack(np.diff(np.append(at_, len(k))), doc[own], t))
    n = len(texts)
    empty: list[None] = [None] * radixes
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block] * (n + radixes), pa.int64()),
            "radix": pa.array([-1] * n + list(range(radixes)), pa.int32()),
            "heads": pa.array([None] * n + heads, pa.list_(pa.binary())),
            "records": pa.array([None] * n + records, pa.binary()),
            "pos": pa.array([*range(n), *empty], pa.int32()),
            "doc_id": pa.array([*ids, *empty], pa.int64()),
            "n_a": pa.array([*n_a.tolist(), *empty], pa.int64()),
            "n_b": pa.array([*n_b.tolist(), *empty], pa.int64()),
            "n_groups": pa.array([*links.tolist(), *empty], pa.int64()),
            "n_links": pa.array([*links.tolist(), *empty], pa.int64()),
            "groups": pa.array([*groups, *empty], pa.string()),
        }
    )


def _spiller(
    first: Broadcast, second: Broadcast, radixes: int, text: bool, block_bytes: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(first.value, second.value)
        block = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                t = t.as_py() or ""
                if texts and size + len(t) > block_bytes:
                    yield _block(encoders, ids, texts, radixes, text, block)
                    ids, texts, size, block = [], [], 0, block + 1
                ids.append(i.as_py())
                texts.append(t)
                size += len(t)
        if texts:
            yield _block(encoders, ids, texts, radixes, text, block)

    return run


# --- counting and giving back ------------------------------------------------------------


def _add_up(key: tuple, runs: pa.Table) -> pa.Table:
    frames = [
        frame for keys, counts in merged([read_head(x) for x in runs.column("heads").to_pylist()]) for frame in head_run(keys, counts)
    ]
    return pa.table(
        {"radix": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "heads": pa.array([frames], pa.list_(pa.binary()))}
    )


def _finish(key: tuple, runs: pa.Table) -> pa.Table:
    told = with_best(merged([read_head(x) for x in runs.column("heads").to_pylist()]))
    frames = [pack(np.diff(keys, prepend=0), counts, best) for keys, counts, best in told]
    return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([frames], pa.list_(pa.binary()))})


def _give(runs: pa.Table, counted: pa.Table) -> pa.Table:
    """Contributions of a radix's runs to their blocks' documents: links of the highest count, and counts."""
    blocks, given = [], []
    if runs.num_rows and counted.num_rows:
        parts = [unpack(frame) for frame in counted.column("counts")[0].as_py()]
        keys, counts, best = (
            (np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2)))
            if parts
            else (np.zeros(0, np.int64),) * 3
        )
        for block, heads, records in zip(*(runs.column(c) for c in ("block", "heads", "records"))):
            held = [k for k, _ in read_head(heads.as_py())]
            if not held:
                continue
            at = np.searchsorted(keys, np.concatenate(held))
            sizes, doc, times = unpack(records.as_py())
            at = np.repeat(at, sizes)
            n = int(doc.max()) + 1
            sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums, doc, counts[at] * times)
            np.add.at(bests, doc, best[at] * times)
            blocks.append(block.as_py())
            given.append(pack(bests, sums))
    return pa.table({"block": pa.array(blocks, pa.int64()), "given": pa.array(given, pa.binary())})


def _close(docs: pa.Table, given: pa.Table) -> pa.Table:
    """A block's documents with the sums of their contributions."""
    docs = docs.sort_by("pos")
    sums = np.zeros((2, docs.num_rows), np.int64)
    for frame in given.column("given"):
        for total, own in zip(sums, unpack(frame.as_py())):
            total[: len(own)] += own
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).append_column(
        "groups", docs.column("groups")
    )


def align(
    docs: DataFrame,
    folder: str = TOKENIZERS,
    first: str = FIRST,
    second: str = SECOND,
    groups_as_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
    radixes: int = RADIXES,
    fan: int = FAN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: one row per row of ``docs``.

    ``first`` is a file of the tokenizers library with byte-level entries, ``second`` a sentencepiece model that puts a space
    before a text; both are read by the driver and broadcast, a few MB whatever the corpus. ``groups`` is ``a1,a2|b1;a3|b2,b3``, ids of both sides between bytes at which
    both end; it takes several times a text's room, so ``groups_as_text=False`` keeps its sha256 in hex instead. A link joins the last tokens of a group's two sides.
    ``n_best`` counts the links whose pair is, over the corpus, the most frequent of its second id, ties included;
    ``count_sum`` adds up their pairs' counts. Missing and empty texts, and texts whose tokens do not give back
    a space and the text byte by byte, have zeros and an empty ``groups``. Missing and repeated ids are rows like
    others, repeated rows count each time, an empty table gives no rows, other columns are not looked at. One text is encoded whole, inside one task.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "alignment")
    models = []
    for name in (first, second):
        with open(os.path.join(folder, name), "rb") as file:
            models.append(spark.sparkContext.broadcast(file.read()))
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    spilled = space.save(texts.mapInArrow(_spiller(*models, radixes, groups_as_text, block_bytes), SPILLED), "spilled")
    runs = spilled.where("radix >= 0").select("block", "radix", "heads", "records")
    blocks = spilled.where("radix = 0").count()
    # merges of about `fan` runs, until one run of each radix is left
    heads, parts, level = runs.select("radix", F.col("block").alias("part"), "heads"), blocks, 0
    while parts > fan:
        parts, level = -(-parts // fan), level + 1
        dealt = heads.withColumn("part", F.pmod(F.xxhash64("part", F.lit(level)), F.lit(parts)).cast("long"))
        heads = space.save(dealt.groupBy("radix", "part").applyInArrow(_add_up, HEADS), f"heads-{level}")
        if level > 1:
            space.drop(f"heads-{level - 1}")
    counted = space.save(heads.groupBy("radix").applyInArrow(_finish, COUNTED), "counted")
    if level:
        space.drop(f"heads-{level}")
    # the counts of a radix meet its runs in groups of blocks
    groups = max(1, -(-blocks // fan))
    dealt = runs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    copied = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    given = (
        dealt.groupBy("radix", "part").cogroup(copied.groupBy("radix", "part")).applyInArrow(_give, GIVEN)
    )
    rows = spilled.where("radix = -1").select("block", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_close, ALIGNED)
