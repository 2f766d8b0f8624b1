import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from termloom.llm import alignment, queries
from termloom.llm.alignment import FIRST, SECOND, TOKENIZERS, align, head_run, merged, pack, read_head, unpack, with_best

A = Tokenizer.from_file(f"{TOKENIZERS}/{FIRST}")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{SECOND}")
SCHEMA = "doc_id long, text string, block string, radix int, groups long"


def _letters():
    """Byte-level letters the other way round, from the tokenizer's own pre-tokenizer."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=False)
    out = {}
    for point in [*range(128), *range(0xA0, 0x800, 1)]:
        raw = chr(point).encode()
        for letter, byte in zip(split.pre_tokenize_str(chr(point))[0][0], raw):
            out[letter] = byte
    for point in (0x1000, 0x2603, 0xE000, 0xFFFD, 0x10000, 0x50000, 0x90000, 0xD0000, 0x10FFFD, *range(0x3000, 0xD000, 4096)):
        for letter, byte in zip(split.pre_tokenize_str(chr(point))[0][0], chr(point).encode()):
            out[letter] = byte
    return out


LETTERS = _letters()


def _pieces(text):
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a.ids]
    b_bytes = []
    for i in b:
        piece = B.id_to_piece(i)
        hexed = len(piece) == 6 and piece.startswith("<0x")
        b_bytes.append(bytes([int(piece[3:5], 16)]) if hexed else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    return (a.ids, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else ([], [], [], [])


def _brute(texts):
    """Groups and links of each text, then the counts over all texts."""
    docs = []
    for text in texts:
        a, a_bytes, b, b_bytes = _pieces(text) if text else ([], [], [], [])
        a_ends = np.cumsum([len(x) for x in a_bytes]).tolist()
        b_ends = np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, low_a, low_b = [], [], 0, 0
        for i, end in enumerate(a_ends):
            if end in b_ends:
                j = b_ends.index(end)
                groups.append(",".join(map(str, a[low_a : i + 1])) + "|" + ",".join(map(str, b[low_b : j + 1])))
                links.append((a[i], b[j]))
                low_a, low_b = i + 1, j + 1
        docs.append((len(a), len(b), groups, links))
    counts = Counter(link for doc in docs for link in doc[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
        for n_a, n_b, groups, links in docs
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
ODD = [
    None, "", " ", "  two  spaces ", "▁ lower block", "tab\tand\nline\r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "café 中文 \U0001f600\U0001f468‍\U0001f469‍\U0001f467",
    "ﬁ Å ́ combining é", "nul\x00inside", "﻿mark", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "the the the the", "the the", " 　 ", "1234567890 12 3",
]


def _rows(texts):
    return [(i, t, "b", -1, 5) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 40, "radixes": 3, "fan": 2}])
def test_odd_texts_equal_brute_force(spark, sizes):
    texts = [*ODD, *ODD[4:9]]
    rows = align(spark.createDataFrame(_rows(texts), SCHEMA).repartition(3), **sizes).collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == _brute(texts)


def test_query_equals_brute_force_over_the_table(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").collect()
    want = _brute([r["text"] for r in table])
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_alignment"](spark, path).collect()}
    assert len(got) == len(table)
    for row, expected in zip(table, want):
        own = got[row["doc_id"]]
        assert tuple(own[c] for c in COLUMNS[:-1]) == expected[:-1]
        assert own["groups_sha256"] == (hashlib.sha256(expected[-1].encode()).hexdigest() if expected[0] else "")


def test_missing_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a word", "", 0, 0), (None, "a word", "", 0, 0), (3, None, "", 0, 0), (3, "word", "", 0, 0)]
    got = align(spark.createDataFrame(rows, SCHEMA)).collect()
    want = _brute([r[1] for r in rows])
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want))
    assert align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_merge_like_a_counter():
    rng = np.random.default_rng(0)
    total, runs = Counter(), []
    for size in (0, 1, 5, 4000, 40000):
        keys, counts = np.unique((rng.integers(0, 50, size) << 32) | rng.integers(0, 800, size), return_counts=True)
        total.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append(head_run(keys, counts))
    got = list(merged([read_head(x) for x in runs]))
    keys, counts = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), counts.tolist())) == dict(total)
    told = list(with_best(iter([(keys[i : i + 7], counts[i : i + 7]) for i in range(0, len(keys), 7)])))
    best = {}
    for k, n in total.items():
        best[k >> 32] = max(best.get(k >> 32, 0), n)
    assert [x for t in told for x in t[2].tolist()] == [int(total[k] == best[k >> 32]) for k in keys.tolist()]
    arrays = [np.array([], np.int64), np.array([255, 0]), np.array([1 << 40, 3]), np.arange(70000)]
    assert all((x == y).all() for x, y in zip(unpack(pack(*arrays)), arrays))


def test_parts_give_the_ids_of_whole_texts_and_are_encoded_once(monkeypatch):
    files = [open(f"{alignment.TOKENIZERS}/{name}", "rb").read() for name in (alignment.FIRST, alignment.SECOND)]
    encoders = alignment.Encoders(*files)
    assert encoders.cut_alike
    draw = random.Random(1)
    letters = list("aabe  ''  st.é中😀▁\u0085  ᠎​\t\n\r\x1c\x00́<>12　") + ["<|endoftext|>", "</s>", "<0x41>"]
    texts = ["", " ", "a ▁ b", "<|endoftext|> a", "a <s> b"] + ["".join(draw.choices(letters, k=draw.randint(1, 40))) for _ in range(2000)]
    for found, whole in zip(encoders.encode(texts), encoders.encode_whole(texts)):
        assert [x.tolist() for x in found] == [x.tolist() for x in whole]
    encoded = []
    plain = encoders.encode_whole
    monkeypatch.setattr(encoders, "encode_whole", lambda x: encoded.extend(x) or plain(x))
    for _ in range(50):
        assert len(encoders.encode(["some words, told again", "told again some words,"])) == 2
    assert sum(map(len, encoded)) < 50
    monkeypatch.setattr(alignment, "PARTS", 3)
    encoders.encode(["one two three", "four five"])
    encoders.encode(["six seven"])
    assert len(encoders.numbers) == 2


def test_other_tokenizers_encode_whole_texts():
    files = [open(f"{alignment.TOKENIZERS}/{name}", "rb").read() for name in (alignment.FIRST, alignment.SECOND)]
    other = json.loads(files[0])
    other["pre_tokenizer"]["use_regex"] = False  # pairs may be merged across words
    other = json.dumps(other).encode()
    assert not alignment.cut_alike(other, files[1])
    encoders = alignment.Encoders(other, files[1])
    assert [len(x) for x in encoders.encode(["a b", ""])[1]] == [0, 0] and not encoders.numbers
