"""Substring dedup over words: super-k-mer partitioning.

Windows of consecutive words that share a minimiser travel as one packed string to the minimiser's
bucket, where the windows are sorted and equal neighbours counted as whole strings of words, so a
hash never decides that two windows are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from termloom.llm.repeats import Rule, remove_repeats

#: Words of a window and of a minimiser; changes of ``gram`` change no result.
WINDOW, GRAM = 13, 4


def _sorted_windows(
    rule: Rule, strings: list[bytes], keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, windows: np.ndarray
) -> list[np.ndarray]:
    entries = []
    for i, string in enumerate(strings):
        ends = [j for j, c in enumerate(string) if c == 32] + [len(string)]
        begins = [0] + [x + 1 for x in ends[:-1]]
        entries += [(string[begins[o] : ends[o + rule.window - 1]], i, o) for o in range(windows[i])]
    entries.sort()
    again = [np.zeros(n, bool) for n in windows.tolist()]
    docs = docs.tolist()
    at = 0
    while at < len(entries):
        to = at + 1
        while to < len(entries) and entries[to][0] == entries[at][0]:
            to += 1
        if to - at > 1:
            first = min(docs[i] for _, i, _ in entries[at:to])
            for _, i, o in entries[at:to]:
                again[i][o] = docs[i] > first
        at = to
    return again


def substring_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
    frequent: int = 50_000,
) -> DataFrame:
    """Removes each word covered by a ``window``-word sequence that also starts in a document of a smaller id.

    All windows are judged on the input. Returns the input's columns but the text, and ``kept``
    (UTF-8 bytes: the words left, joined by a space), ``n_units`` (words), ``n_removed``, ``n_spans``.
    See ``repeats.remove_repeats`` for missing texts and ids. Words are runs without the characters
    U+0020 and U+0009 to U+000D.
    """
    if not 0 < gram <= window:
        raise ValueError("a minimiser has at least one word and at most the window's")
    rule = Rule(window, gram, words=True, other_document=True, frequent=frequent)
    return remove_repeats(docs, rule, _sorted_windows, "superkmer", id_column, text_column)
