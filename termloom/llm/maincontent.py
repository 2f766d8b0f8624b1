"""Main text of web pages: the maximum-scoring subsequence of a page's tokens.

Words score by where they stand, mostly above zero, and tags below; the weights are log-odds counted on labelled
pages, those that mark their article themselves. One linear scan finds the contiguous region with the greatest
sum, on any page, marked or not. Elements within it whose own words score below zero, because of the names they
bear, are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are counted on at most.
FIT_PAGES = 2000
LIMIT, PRIOR = 3.0, 5.0
#: Least and greatest cost of a tag, so that one word inside an element can outweigh its tags.
TAG_COST, TAG_LIMIT = 0.05, 1.0
#: What a left out element costs a region that spans it, at most, in words that score one.
FENCE = 5.0
#: Blocks of this many words are seldom page furniture: each of their words scores one more.
LONG_BLOCK = 30
#: Names of elements, classes, ids and roles have to stand on this many labelled pages to be learned.
SEEN = 3

#: Opening and closing tags up to the next < outside of quotes; what does not end in > is text.
TAG = re.compile(
    r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)"
    r"(?P<attributes>(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?P<end>>?)"
)
#: Elements whose content is no markup, and elements that are left out if they are closed.
RAW = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("noscript template select svg math object canvas button".split())
ENDS = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*+>?", re.I) for name in RAW | HIDDEN}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+", re.I)
#: Scores of a word below elements and names of page furniture, before anything is learned; names that articles bear
#: as well score little, so that prose outweighs them.
FURNITURE = frozenset("nav aside footer header form menu head dialog".split())
STRONG, WEAK = -4.0, -1.0
FURNITURE_NAMES = {name: STRONG for name in (
    "ad ads advert advertisement sponsor sponsored cookie cookies consent newsletter subscribe popup modal sidebar nav"
    " navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments respond disqus replies contentinfo"
    " complementary"
).split()} | {name: WEAK for name in (
    "promo promotion banner notice notices related widget header share sharing social login search alert"
).split()}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is open in the same container.
CLOSES = {name: frozenset(("p",)) for name in BLOCKS} | {
    "li": frozenset(("li", "p")),
    "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")),
    "th": frozenset(("td", "th", "p")),
}
ARTICLE = frozenset(("article", "main"))


@dataclass
class Piece:
    """Text or a tag; ``place`` is what its weight depends on, besides the lowest-scoring names around it."""

    place: str
    text: str | None
    block: int
    inside: bool  # an element that marks the article
    words: int


@dataclass
class Named:
    """An element with names, or one that is furniture by its kind, and the pieces it holds."""

    names: tuple[str, ...]
    first: int
    last: int
    odd: bool


def tokens_of(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Starts and ends of what is no text, with the match of tags that count. No part of a page is read twice."""
    at, unclosed = 0, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, None
        elif tag := TAG.match(page, start):
            at = tag.end()
            name = tag["name"].lower()
            if not tag["end"]:
                continue
            if tag["close"] or name not in ENDS or name in unclosed:
                yield start, at, tag
            elif end := ENDS[name].search(page, at):
                at = end.end()
                yield start, at, None
            else:
                unclosed.add(name)
                at = len(page) if name in RAW else at
                yield start, at, None
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, None
        else:
            at = start + 1


def pieces_of(page: str) -> tuple[list[Piece], list[Named]]:
    """A page's text runs and tags in order, and its elements with names. Elements left open end with their container."""
    out: list[Piece] = []
    named: list[Named] = []
    stack: list[tuple[str, Named | None]] = []  # block elements and links that are open
    opened: Counter[str] = Counter()
    block = marked = 0
    at = 0

    def pop() -> str:
        nonlocal marked
        name, element = stack.pop()
        opened[name] -= 1
        if element:
            element.last = len(out)
        marked -= name in ARTICLE
        return name

    def text(to: int) -> None:
        run = page[at:to]
        if run and not run.isspace():
            out.append(Piece("in " + (stack[-1][0] if stack else ""), run, block, marked > 0, len(run.split())))
        elif run:
            space()

    def space() -> None:
        if out and out[-1].text is not None:
            out.append(Piece(out[-1].place, " ", block, marked > 0, 0))

    for start, end, token in tokens_of(page):
        text(start)
        at = end
        name = token["name"].lower() if token else ""
        if name == "br":
            space()
        elif name in BLOCKS and name in VOID:
            block += 1
        if name in VOID or name not in BLOCKS and name != "a":
            continue
        if token["close"]:
            if opened[name]:
                while pop() != name:
                    pass
        else:
            while stack and stack[-1][0] in CLOSES.get(name, ()):
                pop()
            values = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(token["attributes"]))
            names = tuple(dict.fromkeys(x.lower() for x in NAME.findall(values)))
            odd = name in FURNITURE and not (name == "header" and marked)
            element = None
            if (names or odd) and name not in ("body", "html", *ARTICLE):
                element = Named(names, len(out), len(out), odd)
                named.append(element)
            stack.append((name, element))
            opened[name] += 1
            marked += name in ARTICLE
        if name in BLOCKS:
            block += 1
            out.append(Piece(("close " if token["close"] else "open ") + name, None, block, marked > 0, 1))
    text(len(page))
    while stack:
        pop()
    return out, named


def counts_of(pages: list[str]) -> Counter[tuple[str, bool]]:
    """How many words and tags of each place, and words below each name, stand inside and outside the marked article.
    Words below a name say nothing about their place."""
    found: Counter[tuple[str, bool]] = Counter()
    for page in pages:
        pieces, named = pieces_of(page)
        if not any(p.inside for p in pieces):
            continue
        sums = {}
        for side in (True, False):
            sums[side] = [0, *accumulate(p.words if p.text is not None and p.inside == side else 0 for p in pieces)]
        below = [0] * (len(pieces) + 1)
        for element in named:
            below[element.first] += 1
            below[element.last] -= 1
            for name in (*element.names, "*") if element.odd else element.names:
                for side, total in sums.items():
                    found["name " + name, side] += total[element.last] - total[element.first]
        for p, depth in zip(pieces, accumulate(below)):
            if p.text is None or not depth:
                found[p.place, p.inside] += p.words
    return found


def weights_of(found: Counter[tuple[str, bool]]) -> dict[str, float]:
    """Log-odds with a prior: words lie inside, those below furniture outside; tags cost something anywhere. A name never
    speaks for an element, and no evidence makes a furniture name better than it was."""
    sides = {side: PRIOR + sum(n for (place, inside), n in found.items() if inside == side and place[:5] != "name ") for side in (True, False)}
    words = {side: PRIOR + sum(n for (place, inside), n in found.items() if inside == side and place[:3] == "in ") for side in (True, False)}
    out = {}
    for place in {place for place, _ in found}:
        kind, _, name = place.partition(" ")
        total = words if kind == "name" else sides
        inside, outside = found[place, True], found[place, False]
        odds = math.log((inside + 0.5) / total[True]) - math.log((outside + 0.5) / total[False])
        n = inside + outside
        prior = prior_of(place)
        weight = max(-LIMIT, min(LIMIT, (odds * n + prior * PRIOR) / (n + PRIOR)))
        if kind != "in":
            weight = min(prior, weight if kind == "name" else max(-TAG_LIMIT, weight))
        out[place] = weight
    return out


def prior_of(place: str) -> float:
    kind, _, name = place.partition(" ")
    if kind == "name":
        return STRONG if name == "*" else FURNITURE_NAMES.get(name, 0.0)
    if kind == "in":
        return -1.0 if name == "a" else 1.0
    return -TAG_COST


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place, the latter not included, of the contiguous region with the greatest sum; nothing unless
    that is above zero."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best[0]:
            best = total, start, i + 1
    return best[1], best[2]


def _left_out(pieces: list[Piece], named: list[Named], weight) -> list[bool]:
    """Pieces of elements that score no better than zero: the mean score of an element's names, or that of the worst
    element around, on each of its words, against at most one for the word's place and one for a long block."""
    low = {}
    for number, element in enumerate(named):
        score = sum(weight("name " + name) for name in element.names) / max(1, len(element.names))
        low[number] = min(score, weight("name *")) if element.odd else score
    # the worst element around each piece: elements nest, so a stack of running minima follows them
    worst, around, following = [0.0] * len(pieces), [], 0
    for i in range(len(pieces)):
        while around and around[-1][0] <= i:
            around.pop()
        while following < len(named) and named[following].first <= i:
            if named[following].last > i:
                around.append((named[following].last, min(low[following], around[-1][1] if around else 0.0)))
            following += 1
        worst[i] = around[-1][1] if around else 0.0
    sums, size = [0.0], Counter()
    for p in pieces:
        size[p.block] += p.words if p.text is not None else 0
    for p, score in zip(pieces, worst):
        own = 0.0 if p.text is None else p.words * (score + min(1.0, weight(p.place)) + (size[p.block] >= LONG_BLOCK))
        sums.append(sums[-1] + own)
    change = [0] * (len(pieces) + 1)
    for number, element in enumerate(named):
        if low[number] < 0 and sums[element.last] - sums[element.first] <= 0:
            change[element.first] += 1
            change[element.last] -= 1
    return [n > 0 for n in accumulate(change[:-1])]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by an empty line."""
    weight = lambda place: weights[place] if place in weights else prior_of(place)
    pieces, named = pieces_of(page or "")
    out = _left_out(pieces, named, weight)
    scores, spent = [], 0.0
    for p, left_out in zip(pieces, out):
        if not left_out:
            spent = 0.0 if p.text is not None else spent
            scores.append(p.words * weight(p.place))
        else:
            cost = min(FENCE - spent, float(p.words))
            spent += cost
            scores.append(-cost)
    first, last = best_region(scores)
    blocks: list[list[str]] = []
    number = None
    for p, left_out in zip(pieces[first:last], out[first:last]):
        if p.text is not None and not left_out:
            if p.block != number:
                blocks.append([])
                number = p.block
            blocks[-1].append(p.text)
    texts = (" ".join(html.unescape("".join(block)).split()) for block in blocks)
    return "\n\n".join(text for text in texts if text)


def _extract(weights: dict[str, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, weights) for page in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            [*batch.schema.names[:-1], "text", "n_chars"],
        )


def main_content(
    pages: DataFrame, id_column: str = "page_id", html_column: str = "html", fit_pages: int = FIT_PAGES
) -> DataFrame:
    """The input's columns but the html, with ``text`` (empty if none) and ``n_chars`` (code points).

    Weights are counted on at most ``fit_pages`` pages that mark an article, those of smallest hashed id; without
    any, the scores given for furniture alone decide. Every whole page is read, in time that grows with its length; a missing
    one is empty. A tag that does not end before the next one begins is text; an end tag without its element and elements that
    are never closed lose nothing. Rows with equal ids are pages of their own. Input columns named like the two new ones give way.
    """
    pages = pages.drop(*[c for c in ("text", "n_chars") if c in pages.columns and c != html_column])
    page = F.col(html_column).cast("string")
    keyed = pages.select(
        page.alias("html"), F.xxhash64(F.col(id_column).cast("string")).alias("o"), F.xxhash64(page).alias("h")
    ).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    # the pages are chosen by their numbers alone, so that no task gathers pages; at most ``fit_pages`` numbers are broadcast
    chosen = keyed.select("o", "h").distinct().orderBy("o", "h").limit(fit_pages)
    sample = keyed.join(F.broadcast(chosen), ["o", "h"], "left_semi").dropDuplicates(["o", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, seen = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                own = counts_of([page])
                found.update(own)
                seen.update(own.keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "place": pa.array([place for place, _ in found], pa.string()),
                    "inside": pa.array([inside for _, inside in found], pa.bool_()),
                    "n": pa.array(list(found.values()), pa.int64()),
                    "pages": pa.array([seen[key] for key in found], pa.int64()),
                }
            )

    # places are made of a fixed set of element names; names come from a bounded sample, and those of a few pages stay away
    counted = sample.select("html").mapInArrow(count, "place string, inside boolean, n long, pages long")
    rows = counted.groupBy("place", "inside").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    rows = rows.where(~F.startswith("place", F.lit("name ")) | (F.col("pages") >= SEEN)).select("place", "inside", "n").collect()
    weights = weights_of(Counter({(place, inside): n for place, inside, n in rows}))
    kept = [c for c in pages.columns if c != html_column]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pages.schema if x.name != html_column)
    given = pages.select(*[F.col(f"`{c}`") for c in kept], page.alias("__html_to_read"))
    return given.mapInArrow(partial(_extract, weights), f"{schema}, text string, n_chars long")
