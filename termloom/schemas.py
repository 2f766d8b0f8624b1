"""Schemas of the stored tables and landed files."""

from __future__ import annotations

# one landed answer: `seed` is the query that was asked, `root_seed` the phrase it grew
# from, `ord` the number of the request
PAYLOADS = "lang string, root_seed string, seed string, ord bigint, payload string"

KEYWORDS = (
    "id bigint, keyword string, source string, seed string, collected_at timestamp, lang string"
)
KEYWORD_KEY = ["keyword", "lang", "source"]
# the stored rows have one more column: `slot`, a hash of the key, by which they are bucketed
STORED_KEYWORDS = (
    "id bigint, keyword string, source string, seed string, collected_at timestamp, slot int, lang string"
)
# the partition of the rows that each append adds to count the ids given so far
HIGH_WATER = "__high_water__"

# `market` is the partition folder; it holds the label of the worldwide market where geo is ''
SCORES = (
    "keyword string, geo string, month int, interest_score double, "
    "ord bigint, collected_at timestamp, market string"
)

SHEET_COLUMNS = ["keyword", "seed", "lang", "intent", "notes"]
