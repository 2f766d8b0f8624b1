"""Both removers of repeated windows against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import repeats, suffixdedup
from termloom.llm.bytesview import super_kmers
from termloom.llm.suffixdedup import collection_order, suffix_dedup
from termloom.llm.superkmer import substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows, window, words):
    """rows: (id, text); the kept bytes and counts of each row by the definition."""
    units, first = [], {}
    for doc, text in rows:
        data = (text or "").encode()
        units.append(WORD.findall(data) if words else data)
    rank = [float("inf") if doc is None else doc for doc, _ in rows]
    for doc, u in zip(rank, units):
        for s in range(len(u) - window + 1):
            key = tuple(u[s : s + window]) if words else u[s : s + window]
            at = doc if words else (doc, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for doc, u in zip(rank, units):
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            key = tuple(u[s : s + window]) if words else u[s : s + window]
            if first[key] < (doc if words else (doc, s)):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(u, gone) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((b" ".join(kept) if words else bytes(kept), len(u), sum(gone), spans))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "é", "the", "of", "xyz", "日本", "q"])
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t ", "one", passage, passage, passage + " " + passage, "a" * 700, "ab" * 300, "x y " * 40]
    for _ in range(60):
        own = " ".join(word() for _ in range(r.randrange(1, 80)))
        cut = r.randrange(len(passage))
        texts.append(r.choice([own, own + passage[cut:], passage[:cut] + "\n" + own, own + " " + passage + " " + own]))
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return [*rows, (None, passage), (None, passage), (3, passage + " more"), rows[12]]


@pytest.mark.parametrize(("words", "frequent"), [(True, 50_000), (True, 5), (False, 50_000), (False, 5)])
def test_against_brute_force(spark, words, frequent):
    window, gram, run = (5, 2, substring_dedup) if words else (40, 9, suffix_dedup)
    rows = corpus(1)
    docs = spark.createDataFrame(
        [(i, *row, "kept?") for i, row in enumerate(rows)], "place int, doc_id long, text string, kept string"
    ).repartition(3)
    found = run(docs, window, gram, frequent=frequent)
    assert found.columns == ["place", "doc_id", "kept", "n_units", "n_removed", "n_spans"]
    found = sorted(found.collect())
    assert [row.doc_id for row in found] == [doc for doc, _ in rows]
    assert [(bytes(r.kept), r.n_units, r.n_removed, r.n_spans) for r in found] == brute(rows, window, words)


@pytest.mark.parametrize("run", [substring_dedup, suffix_dedup])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    text = "".join(random.Random(3).choices("abcdefg ", k=3_000_000))
    rows = suffix_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in rows} == {1: (0, 0), 2: (3_000_000, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=12))
def test_collection_order(texts):
    strings = [t.encode() for t in texts]
    number, length, prefix, bwt = collection_order(strings)
    wanted = sorted(
        ((i, n) for i, s in enumerate(strings) for n in range(len(s) + 1)),
        key=lambda x: ([*strings[x[0]][len(strings[x[0]]) - x[1] :]] + [x[0] - 1000],),
    )
    assert list(zip(number.tolist(), length.tolist())) == wanted
    text = lambda x: strings[x[0]][len(strings[x[0]]) - x[1] :]
    for k, x in enumerate(wanted):
        full = len(strings[x[0]]) == x[1]
        assert bwt[k] == (0 if full else strings[x[0]][len(strings[x[0]]) - x[1] - 1] + 1)
        if k:
            a, b = text(wanted[k - 1]), text(x)
            same = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert prefix[k] == same


def test_super_kmers_cover_every_window_once():
    values = np.random.default_rng(1).integers(0, 3, 500)
    bounds = np.array([0, 4, 4, 200, 210, 500])
    starts, counts, _ = super_kmers(values, bounds, 12, 4)
    covered = [s + i for s, n in zip(starts, counts) for i in range(n)]
    assert covered == [s for a, b in zip(bounds, bounds[1:]) for s in range(a, b - 11)]


def test_buckets_go_through_the_rounds_in_portions(monkeypatch):
    """A portion holds whole buckets, in which all equal windows stand."""
    draw = np.random.default_rng(3)
    rule = repeats.Rule(4, 2, words=False, other_document=False)
    keys = np.sort(draw.integers(0, 12, 60))
    strings = [bytes((2 * k + draw.integers(0, 2, n)).astype(np.uint8)) for k, n in zip(keys.tolist(), draw.integers(4, 9, 60))]
    docs, starts = np.arange(60), np.zeros(60, np.int64)
    windows = np.array([len(x) - 3 for x in strings])
    sizes = []
    plain = suffixdedup.collection_order
    monkeypatch.setattr(suffixdedup, "collection_order", lambda x: sizes.append(len(x)) or plain(x))
    monkeypatch.setattr(suffixdedup, "PORTION", 8)
    found = suffixdedup._by_common_prefix(rule, strings, keys, docs, starts, windows)
    assert len(sizes) > 3 and sum(sizes) == len(found) == 60
    for i, mask in enumerate(found):
        assert len(mask) == windows[i]
        for o, again in enumerate(mask.tolist()):
            same = [(j, p) for j in range(60) for p in range(windows[j]) if strings[j][p : p + 4] == strings[i][o : o + 4]]
            assert again == ((i, o) > min(same))


def test_super_kmers_are_the_same_in_portions():
    values = np.random.default_rng(2).integers(0, 3, 700)
    bounds = np.array([0, 0, 4, 90, 90, 300, 310, 311, 700, 700])
    whole = super_kmers(values, bounds, 12, 4, size=1_000)
    assert len(whole[0]) > 50
    for size in (1, 50, 200):
        for found, wanted in zip(super_kmers(values, bounds, 12, 4, size=size), whole):
            assert found.tolist() == wanted.tolist()


def test_a_round_inserts_several_bytes_of_a_string(monkeypatch):
    """As many sorts as a string has symbols, not bytes."""
    draw, sorts, plain = np.random.default_rng(4), [], np.argsort
    strings = [bytes(draw.integers(97, 100, 168).astype(np.uint8)) for _ in range(20)]
    monkeypatch.setattr(np, "argsort", lambda x, **how: sorts.append(len(x)) or plain(x, **how))
    collection_order(strings)
    assert 0 < len(sorts) <= 168 // suffixdedup.SYMBOL + 1


@pytest.mark.parametrize("n", [40, 800])
def test_collection_order_of_many_symbols(n):
    """Of more symbols, too, than 16 bits number; strings of any length, some equal from a place on."""
    draw = np.random.default_rng(n)
    strings = [bytes(draw.integers(1, 245, size).astype(np.uint8)) for size in draw.integers(0, 200, n)]
    strings += [a[: len(a) // 2] + b for a, b in zip(strings, strings[1:])][: n // 4] + [strings[0], b""]
    number, length, prefix, bwt = collection_order(strings)
    text = [strings[i][len(strings[i]) - m :] for i, m in zip(number.tolist(), length.tolist())]
    wanted = sorted((s[len(s) - m :], i) for i, s in enumerate(strings) for m in range(len(s) + 1))
    assert list(zip(text, number.tolist())) == wanted
    for a, b, same in zip(text, text[1:], prefix[1:].tolist()):
        assert a[:same] == b[:same] and len(a[:same]) == same and a[same : same + 1] != b[same : same + 1] or a == b
        assert a != b or same == len(a)
    before = [s[len(s) - m - 1] + 1 if m < len(s) else 0 for s, m in ((strings[i], m) for i, m in zip(number, length))]
    assert bwt.tolist() == before
