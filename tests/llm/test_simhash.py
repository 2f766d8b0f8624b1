"""SimHash linking against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from termloom.llm.components import components
from termloom.llm.simhash import _roots, near_duplicates, posting_positions
from termloom.llm.tables import Workspace

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint(text):
    words = WORD.findall((text or "").encode())
    words = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in words]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for g, (doc, _) in zip(group, rows):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(rows, prints, group)]


def test_every_enough_matches_contain_a_posting_key():
    for matches in range(1, 9):
        sets = posting_positions(matches)
        for some in combinations(range(8), matches):
            assert any(set(s) <= set(some) for s in sets)
    assert len(posting_positions(4)) == 20


def test_against_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choices(["Ab", "cÉ", "the", "of\t", "日本", "zz"], k=300)) for _ in range(12)]
    rows = [(None, base[0]), (900, None), (901, ""), (902, "\n \x0b"), (903, "One two"), (904, "one  two"), (904, "one two")]
    for i in range(250):
        words = r.choice(base).split(" ")
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = "new" + str(r.randrange(9))
        rows.append((i * 7 % 251, " ".join(words)))
    rows.append((2000, "Long words " * 200_000))
    found = near_duplicates(
        spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, component_id string").repartition(5)
    )
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    key = lambda x: [(v is None, v) for v in x]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 4000), (7, 7)]
    r.shuffle(pairs)
    found = components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t"))
    wanted = {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 4000: 4000, 5000: 4000}
    rows = found.collect()
    assert dict(map(tuple, rows)) == wanted and len(rows) == len(wanted)


def test_roots():
    assert _roots(6, np.array([5, 3, 1]), np.array([3, 4, 2])).tolist() == [0, 1, 1, 3, 3, 3]
