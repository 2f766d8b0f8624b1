"""The compiled rule tables against Python's own regular expressions, rule by rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termloom import fixed_values as fixed
from termloom.functions.rules import RuleTable, finite_texts, required_text
from termloom.functions.text import ignoring_case
from termloom.operators.diagnostics import CATEGORIES
from termloom.operators.intent import ALL_TIERS, CONFIDENT
from termloom.operators.language import MARKERS
from termloom.operators.noise import NOISE

TABLES = {"tiers": ALL_TIERS, "confident": CONFIDENT, "markers": MARKERS, "noise": NOISE}
ODD = RuleTable(
    [
        ("a", r"\bvisa\b"), ("a", r"\bvisa"), ("b", r"visa"), ("b", r"visa\b"), ("c", r"s"),
        ("c", r"\bé\b"), ("d", r"x+y"), ("d", r"^no"), ("e", r"\bvisa polic"), ("e", r"(a|b)?c-d"),
        ("f", r"\b foo"), ("f", r"foo \b"), ("g", r"end$"), ("g", r"o.+f"),
        ("h", r"vis*a|tour .+"), ("h", r"trips?.*z+"),
    ]
)


def made_up_keywords(count: int, seed: int) -> list[str]:
    """Texts from pieces of all rules, joined and bent in ways that matter at word borders."""
    rng = random.Random(seed)
    pieces = ["madagascar", "nosy be", "tuileries", "x", "9", "_", "ñ", "é", "é", "日本", ""]
    for table in (*TABLES.values(), ODD):
        for _, pattern in table.rules:
            texts = finite_texts(pattern.removeprefix(r"\b").removesuffix(r"\b"))
            pieces += texts or ["what does nosy be mean", "what do you mean", "travel to", "xxy", "no"]
    joins = [" ", " ", " ", "", "-", "_", "'", "\n", ".", "  ", "é", "s", "́", "\u0001"]
    texts = []
    for _ in range(count):
        text = "".join(
            rng.choice(pieces) + rng.choice(joins) for _ in range(rng.randint(1, 4))
        )
        bend = rng.random()
        text = text.upper() if bend < 0.1 else text.title() if bend < 0.2 else text
        texts.append(text.strip() if rng.random() < 0.5 else text)
    return texts


KEYWORDS = made_up_keywords(2500, seed=7)


def python_hits(table: RuleTable, text: str, flags: int = 0) -> list[int]:
    return [n for n, (_, p) in enumerate(table.rules) if re.search(p, text, flags)]


@pytest.mark.parametrize("table", [*TABLES.values(), ODD], ids=[*TABLES, "odd"])
def test_hits_equal_python_search(column, table):
    found = column(KEYWORDS, F.array_sort(table.hits(F.lower("v"))))
    for text, numbers in zip(KEYWORDS, found):
        assert numbers == python_hits(table, text.lower()), repr(text)


@pytest.mark.parametrize("table", [*TABLES.values(), ODD], ids=[*TABLES, "odd"])
def test_first_rule_is_first_in_list_order(column, table):
    found = column(KEYWORDS, table.first_hit(F.lower("v")))
    for text, number in zip(KEYWORDS, found):
        hits = python_hits(table, text.lower())
        assert number == (hits[0] if hits else None), repr(text)


def test_clear_winner_counts_distinct_rules(column):
    found = column(KEYWORDS, MARKERS.clear_winner(F.lower("v")))
    for text, winner in zip(KEYWORDS, found):
        counts = dict.fromkeys(MARKERS.categories, 0)
        for number in python_hits(MARKERS, text.lower()):
            counts[MARKERS.rules[number][0]] += 1
        top = max(counts.values())
        leaders = [lang for lang, n in counts.items() if n == top]
        assert winner == (leaders[0] if top and len(leaders) == 1 else None), repr(text)


def test_categories_ignore_case_like_python(column):
    texts = KEYWORDS[:800] + ["İTINERARY", "vıdeo", "ſafe", "KAYAK K", "TRIPADVISOR visa trip", "PRİX"]
    found = column(texts, CATEGORIES.categories_hit(ignoring_case(F.col("v"))))
    for text, names in zip(texts, found):
        hits = python_hits(CATEGORIES, text, re.IGNORECASE)
        expected = [c for c in CATEGORIES.categories if any(CATEGORIES.rules[n][0] == c for n in hits)]
        assert names == expected, repr(text)


def test_missing_text_has_no_hit(column):
    assert column([None], CONFIDENT.first_hit(F.lower("v"))) == [None]


def test_finite_texts():
    assert finite_texts("r[ée]server") == ["réserver", "reserver"]
    assert sorted(finite_texts("travel (in )?(may|june)")) == [
        "travel in june", "travel in may", "travel june", "travel may"
    ]
    assert finite_texts(r"booking\.com") == ["booking.com"]
    assert finite_texts("what .+ mean") is None and finite_texts("to$") is None


def test_required_text_is_in_every_match():
    cases = {
        r"what (does|do) .+ mean\b": "what ", r"\btravel to$": "travel to", "x+yz": "yz", "x+y": "x",
        "ab*c{2}": "", "a|b": "", r"\d+ km": "", "^no": "no", "ab?cd": "cd", "[xy]ab.c": "ab",
        "a.b*cd": "cd", "ab*": "a", "(a(b)c)d": "",
    }
    assert {pattern: required_text(pattern) for pattern in cases} == cases


def test_nearly_all_fixed_rules_are_searched_together():
    assert [p for _, p in ALL_TIERS.open_rules] == []
    assert [p for _, p in NOISE.open_rules] == [r"what (does|do) .+ mean\b", r"\btravel to$"]
    assert len(ALL_TIERS.searches) == 2
    assert len(fixed.INFORMATIONAL) == 117


def test_rules_of_a_table_hit_like_a_rule_table(spark):
    import random

    from pyspark.sql import functions as F

    from termloom.functions.rules import RuleTable
    from termloom.operators.rulebook import rule_hits

    r = random.Random(9)
    word = lambda: "".join(r.choices(["ab", "é", "x1", "_", "ñu", "o"], k=r.randrange(1, 3)))
    phrases = sorted({r.choice([" ", "-", "'", "  "]).join(word() for _ in range(r.randrange(1, 4))) for _ in range(300)})
    many = phrases + [f"term{i} of{i % 7}" for i in range(10_000)]
    texts = ["".join(word().upper() + r.choice([" ", "-", "'", "  ", "\n", ". "]) for _ in range(r.randrange(0, 25))) for _ in range(200)]
    texts += [None, "", " ", "...", "term9999 of3", "xterm9 of2", "(Term9 of2)", "-".join(["ab"] * 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, keyword string")
    rules = spark.createDataFrame([*enumerate(many), (20_000, None), (20_001, ""), (20_002, "-ab")], "number int, phrase string")
    found = {x.id: x.hits for x in rule_hits(docs, rules).collect()}
    table = RuleTable([("c", rf"\b{p}\b") for p in phrases])
    wanted = docs.select("id", F.array_sort(F.coalesce(table.hits(F.lower("keyword")), F.array())).alias("hits"))
    wanted = {x.id: x.hits for x in wanted.collect()}
    assert len(found) == len(texts)
    assert {i: [n for n in hits if n < len(phrases)] for i, hits in found.items()} == wanted
    assert [found[i][-1:] for i in (204, 206)] == [[len(phrases) + 9999], [len(phrases) + 9]] and found[205] == found[200] == []
    assert rule_hits(docs, rules.limit(0)).where(F.size("hits") > 0).count() == 0 and rule_hits(docs.limit(0), rules).count() == 0
