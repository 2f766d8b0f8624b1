r"""Ordered rule tables compiled to built-in Column expressions.

Evaluating a rule list as ``when(rlike(p1)) … when(rlike(pN))`` costs one regex
search per rule and row, and the generated method grows past what the JVM
compiles. Nearly all rules describe a finite set of words or phrases, so a table
is compiled to at most TWO searches instead: one for literals that begin at a word
start, one for literals that may begin anywhere. In each,

* all literals form one prefix-sharing pattern, behind a cheap test of two letters;
* ``regexp_extract_all`` with a lookahead reports the longest literal at every
  position, so that overlapping literals are all seen; a literal also stands for the
  shorter ones it begins with;
* the few distinct literals found are mapped to rule numbers.

Rules that are not finite (``.+``, ``$``) keep their own ``rlike``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-z0-9_\p{L}\p{N}]"  # the plain letters first: they are tested fastest
MAX_LITERALS_PER_RULE = 64

_PIECE = re.compile(
    r"\[(?P<set>[^\]\\^-]+)\](?P<set_opt>\??)"
    r"|\((?P<alts>[^()\[\]\\.*+?{}^$]+)\)(?P<alts_opt>\??)"
    r"|(?:\\(?P<escaped>[^\w\s])|(?P<plain>[^\\\[\](){}.*+?^$|]))(?P<char_opt>\??)"
)
_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_START, _END = f"(?<!{WORD})", f"(?!{WORD})"


def finite_texts(pattern: str) -> list[str] | None:
    r"""All texts a pattern can match between its outer ``\b``, or None when not finite."""
    choices, at = [], 0
    while at < len(pattern):
        piece = _PIECE.match(pattern, at)
        if piece is None:
            return None
        if piece["set"]:
            options, optional = list(piece["set"]), piece["set_opt"]
        elif piece["alts"]:
            options, optional = piece["alts"].split("|"), piece["alts_opt"]
        else:
            options, optional = [piece["escaped"] or piece["plain"]], piece["char_opt"]
        choices.append(options + [""] if optional else options)
        at = piece.end()
    size = 1
    for options in choices:
        size *= len(options)
    if size > MAX_LITERALS_PER_RULE:
        return None
    texts = ["".join(parts) for parts in itertools.product(*choices)]
    # the text is searched in lower case, so another spelling could never match
    return texts if all(text and text == text.lower() for text in texts) else None


def required_text(pattern: str) -> str:
    """The longest plain text that every match contains, '' where none is plain to see."""
    runs, at = [""], 0
    while at < len(pattern):
        piece = _PIECE.match(pattern, at)
        if piece is None and pattern.startswith(r"\b", at):
            at += 2
            runs.append("")
        elif piece is None:
            char = pattern[at]
            if char in "|([\\":
                return ""
            if char in "*{":
                runs[-1] = runs[-1][:-1]
            if char == "{":
                return ""
            at += 1
            runs.append("")
        elif (char := piece["escaped"] or piece["plain"]) and not piece["char_opt"]:
            runs[-1] += char
            at = piece.end()
        else:
            at = piece.end()
            runs.append("")
    return max(runs, key=len)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


class LiteralSearch:
    """One search for many literals, all beginning at a word start or all anywhere."""

    def __init__(self, at_word_start: bool):
        self.at_word_start = at_word_start
        self.ends_word: dict[str, bool] = {}
        self.rules: dict[str, set[int]] = {}

    def accepts(self, texts: list[str], ends_word: bool) -> bool:
        """A found text must tell whether its end is a word end, so it may be listed one way only."""
        outer = all(
            (not self.at_word_start or _is_word(text[0])) and (not ends_word or _is_word(text[-1]))
            for text in texts
        )
        return outer and all(self.ends_word.get(text, ends_word) == ends_word for text in texts)

    def add(self, texts: list[str], ends_word: bool, number: int) -> None:
        for text in texts:
            self.ends_word[text] = ends_word
            self.rules.setdefault(text, set()).add(number)

    def freeze(self) -> None:
        """Fix the literals, sorted by their first rule, with all rules each one stands for."""
        meaning = {
            text: sorted(set().union(*(self.rules[p] for p in self.rules if self._implies(text, p))))
            for text in self.rules
        }
        self.literals = sorted(meaning, key=lambda text: (meaning[text][0], text))
        self.numbers = [meaning[text] for text in self.literals]

    def _implies(self, text: str, shorter: str) -> bool:
        if text == shorter:
            return True
        return text.startswith(shorter) and not (
            self.ends_word[shorter] and _is_word(text[len(shorter)])
        )

    def pattern(self) -> str:
        tree: dict = {}
        for text in self.literals:
            node = tree
            for char in text:
                node = node.setdefault(char, {})
            node["end"] = _END if self.ends_word[text] else ""

        def chars(found: Iterable[str]) -> str:
            return "[" + "".join(re.escape(char) for char in sorted(set(found))) + "]"

        def render(node: dict) -> str:
            below = {char: child for char, child in node.items() if char != "end"}
            options = [re.escape(char) + render(child) for char, child in below.items()]
            if len(options) > 3:
                options = [f"(?={chars(below)})(?:{'|'.join(options)})"]
            if "end" in node:
                options.append(node["end"])
            return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

        test = chars(tree)
        if all(len(text) > 1 for text in self.literals):
            test += chars(text[1] for text in self.literals)
        start = _START if self.at_word_start else ""
        return f"{start}(?={test})(?=({render(tree)}))"

    def found(self, lowered: Column) -> Column:
        """Positions (1-based) in ``literals`` of the distinct literals found."""
        known = F.array(*[F.lit(text) for text in self.literals])
        texts = F.array_distinct(F.regexp_extract_all(lowered, F.lit(self.pattern()), F.lit(1)))
        return F.transform(texts, lambda text: F.array_position(known, text).cast("int"))

    def hits(self, lowered: Column) -> Column:
        table = F.array(*[F.array(*[F.lit(n) for n in numbers]) for numbers in self.numbers])
        return F.flatten(F.transform(self.found(lowered), lambda at: F.get(table, at - 1)))

    def first_hit(self, lowered: Column) -> Column:
        firsts = F.array(*[F.lit(numbers[0]) for numbers in self.numbers])
        return F.get(firsts, F.array_min(self.found(lowered)) - 1)


def as_java(pattern: str) -> str:
    r"""The same pattern for the JVM: Unicode classes, ``\n`` as only line end, word = letter, digit or _."""
    return "(?dU)" + pattern.replace(r"\b", _BOUNDARY)


class RuleTable:
    """Rules ``(category, pattern)`` in priority order; a rule's number is its position."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.rules = list(rules)
        self.categories = list(dict.fromkeys(category for category, _ in self.rules))
        self.open_rules: list[tuple[int, str]] = []
        starting, anywhere = LiteralSearch(True), LiteralSearch(False)
        for number, (_, pattern) in enumerate(self.rules):
            search = starting if pattern.startswith(r"\b") else anywhere
            ends_word = pattern.endswith(r"\b")
            texts = finite_texts(pattern.removeprefix(r"\b").removesuffix(r"\b"))
            if texts and search.accepts(texts, ends_word):
                search.add(texts, ends_word, number)
            else:
                self.open_rules.append((number, pattern))
        self.searches = [search for search in (starting, anywhere) if search.rules]
        for search in self.searches:
            search.freeze()

    @classmethod
    def of(cls, groups: dict[str, list[str]]) -> RuleTable:
        return cls((name, pattern) for name, patterns in groups.items() for pattern in patterns)

    def _open(self, lowered: Column) -> list[Column]:
        """Number of each open rule that matches; its plain text is looked for first."""
        return [
            F.when(
                lowered.contains(required_text(pattern)) & lowered.rlike(as_java(pattern)),
                F.lit(number),
            )
            for number, pattern in self.open_rules
        ]

    def hits(self, lowered: Column) -> Column:
        """Distinct numbers of all rules that match, as array<int>."""
        parts = [search.hits(lowered) for search in self.searches]
        if self.open_rules:
            parts.append(F.array_compact(F.array(*self._open(lowered))))
        return F.array_distinct(F.concat(*parts))

    def first_hit(self, lowered: Column) -> Column:
        """Number of the first rule in list order that matches, or null."""
        parts = [search.first_hit(lowered) for search in self.searches] + self._open(lowered)
        return F.least(*parts) if len(parts) > 1 else parts[0]

    def category_of(self, number: Column) -> Column:
        return F.get(F.array(*[F.lit(category) for category, _ in self.rules]), number)

    def pattern_of(self, number: Column) -> Column:
        return F.get(F.array(*[F.lit(pattern) for _, pattern in self.rules]), number)

    def first_category(self, lowered: Column) -> Column:
        return self.category_of(self.first_hit(lowered))

    def _category_numbers(self, lowered: Column) -> Column:
        """Category number of every distinct rule that matches (one item per rule)."""
        table = F.array(*[F.lit(self.categories.index(category)) for category, _ in self.rules])
        return F.transform(self.hits(lowered), lambda number: F.get(table, number))

    def categories_hit(self, lowered: Column) -> Column:
        """Names of all categories with a matching rule, in list order."""
        names = F.array(*[F.lit(name) for name in self.categories])
        numbers = F.array_sort(F.array_distinct(self._category_numbers(lowered)))
        return F.transform(numbers, lambda number: F.get(names, number))

    def clear_winner(self, lowered: Column) -> Column:
        """The category with most matching rules; null without a match and on a tie at the top."""
        empty = F.array(*[F.lit(0) for _ in self.categories])

        def add(counts: Column, number: Column) -> Column:
            return F.transform(counts, lambda n, at: F.when(at == number, n + 1).otherwise(n))

        def decide(counts: Column) -> Column:
            top = F.array_max(counts)
            alone = F.size(F.filter(counts, lambda n: n == top)) == 1
            names = F.array(*[F.lit(name) for name in self.categories])
            at = (F.array_position(counts, top) - 1).cast("int")
            return F.when((top > 0) & alone, F.get(names, at))

        return F.aggregate(self._category_numbers(lowered), empty, add, decide)
