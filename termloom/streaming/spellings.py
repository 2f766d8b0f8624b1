"""Keyed state of the append stream: which spelling of a keyword each expansion found first, and what is stored.

Keywords are dealt to slots by a hash, and a slot's state is read and written whole, because one call to the state store costs as much as
working through hundreds of keywords. ``slots`` should leave a slot some hundred keywords.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from termloom.plans.expand import EXPANSION

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
DECIDED = "keyword string, source string, seed string, lang string, ord decimal(38,0)"
SLOTS = 1024


class FirstSpellings(StatefulProcessor):
    """State of one slot's keywords; files may come in any order until a keyword's timer ends.

    ``open`` holds, per language and lower-cased keyword, when its first undecided row landed and, per expansion, the
    spelling of the smallest ``ord``. ``closed`` holds the expansions that are decided and the spellings that are
    stored. When the watermark passes the landing, the spellings of all expansions are decided together, and each that
    is not stored comes out once, with its smallest ``ord``, as the batch would store it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "keywords string")
        self.closed = handle.getValueState("closed", "decided string, stored string")

    def _open(self) -> dict[str, dict]:
        held = self.open.get()
        return json.loads(held[0]) if held else {}

    def _closed(self) -> tuple[dict[str, list[str]], dict[str, list[list[str]]]]:
        held = self.closed.get()
        return (json.loads(held[0]), json.loads(held[1])) if held else ({}, {})

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803 - Spark's names
        stored: dict[str, list[list[str]]] = {}
        for row in initialState.rows:
            stored.setdefault(row["name"], []).append([row["keyword"], row["source"]])
        self.closed.update(("{}", json.dumps(stored)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        keywords, (decided, _) = self._open(), self._closed()
        before = {name: held["landed"] for name, held in keywords.items()}
        for row in rows:
            if row.expansion in decided.get(row.name, ()):
                continue
            landed = int(row.landed_at.timestamp() * 1000)
            held = keywords.setdefault(row.name, {"lang": row.lang, "landed": landed, "best": {}})
            held["landed"] = min(held["landed"], landed)
            best = held["best"].get(row.expansion)
            if best is None or int(row.ord) < best[0]:
                held["best"][row.expansion] = [int(row.ord), row.keyword, row.source, row.seed]
        added = [held["landed"] for name, held in keywords.items() if before.get(name) != held["landed"]]
        if keywords:
            self.open.update((json.dumps(keywords),))
        if added:
            self.handle.registerTimer(min(added))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        keywords, (decided, stored) = self._open(), self._closed()
        ready = {name: held for name, held in keywords.items() if held["landed"] <= now}
        left = {name: held for name, held in keywords.items() if held["landed"] > now}
        out = []
        for name, held in ready.items():
            decided.setdefault(name, []).extend(held["best"])
            known = {tuple(x) for x in stored.get(name, ())}
            first: dict[tuple[str, str], tuple[int, str]] = {}
            for ord_, keyword, source, seed in held["best"].values():
                if (keyword, source) not in known and ((keyword, source) not in first or ord_ < first[keyword, source][0]):
                    first[keyword, source] = ord_, seed
            for (keyword, source), (ord_, seed) in first.items():
                stored.setdefault(name, []).append([keyword, source])
                out.append(Row(keyword=keyword, source=source, seed=seed, lang=held["lang"], ord=Decimal(ord_)))
        if ready:
            self.open.update((json.dumps(left),))
            self.closed.update((json.dumps(decided), json.dumps(stored)))
        if left:
            self.handle.registerTimer(min(held["landed"] for held in left.values()))
        return iter(out)

    def close(self) -> None:
        pass


def _named(slots: int) -> tuple[Column, Column]:
    """A keyword's slot and its name there: language and lower-cased keyword."""
    lang, lower = F.coalesce("lang", F.lit("")), F.lower("keyword")
    return F.pmod(F.xxhash64(lang, lower), F.lit(slots)).alias("_slot"), F.to_json(F.array(lang, lower)).alias("name")


def first_spellings(suggestions: DataFrame, stored: DataFrame, slots: int = SLOTS) -> DataFrame:
    """New keywords of a stream of decoded suggestions with a watermark on ``landed_at``.

    ``stored`` is the table's rows when the stream begins; they are the initial state, and the table is not read again. State
    grows with the different keywords per expansion. A stream keeps the number of slots it began with.
    """
    keyed = suggestions.select(
        *_named(slots), F.coalesce("lang", F.lit("")).alias("lang"), F.to_json(F.struct(*EXPANSION)).alias("expansion"),
        "keyword", F.coalesce("source", F.lit("")).alias("source"), "seed", "ord", "landed_at",
    )
    known = (
        stored.select(*_named(slots), "keyword", "source")
        .groupBy("_slot").agg(F.collect_list(F.struct("name", "keyword", "source")).alias("rows"))
    )
    return keyed.groupBy("_slot").transformWithState(
        FirstSpellings(), DECIDED, "Append", "EventTime", initialState=known.groupBy("_slot")
    )
