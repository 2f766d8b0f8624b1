"""Landed payloads, stored tables, keyed operators and the append stream."""

import json

import pytest
from pyspark.sql import functions as F

from termloom import catalog, schemas
from termloom.operators.frontier import query_frontier
from termloom.operators.keyed import first_per_key, first_spelling, last_value, marked_new, new_keys, only_new
from termloom.operators.summaries import ingest_counters
from termloom.plans.expand import expand, expand_into
from termloom.sinks.tables import add_rows, append_keywords
from termloom.sources.dimensions import markets, seed_phrases
from termloom.session import settings
from termloom.sources.bucketed import BY_SLOT, bucketed, has_batch, high_water, slot_of
from termloom.sources.suggestions import arrival, decode_suggestions, read_payloads
from termloom.sources.tables import first_keywords, read_keywords
from termloom.streaming.append import append_recent, append_spellings, end_round, stream_payloads

PAYLOADS = [
    '["q", ["nosy be prix", "nosy be avis"]]', '["q", []]', '["q"]', "not json", '{"a": 1}', "",
    '["q", ["  padded\\u00a0", "", "   ", "\\u001f\\n"]]', '["q", [3, null, "text", true, ["x"], "3"]]',
    '["q", ["a", "b"', '["q", 5]', '["q", null, ["late"]]', None,
]


@pytest.fixture
def payloads(spark):
    rows = [("fr", "r", "q", n, p) for n, p in enumerate(PAYLOADS)]
    return spark.createDataFrame(rows, schemas.PAYLOADS)


def test_decode_keeps_only_texts(payloads):
    rows = decode_suggestions(payloads).orderBy("ord").collect()
    assert [(r.keyword, r.request, r.place) for r in rows] == [
        ("nosy be prix", 0, 0), ("nosy be avis", 0, 1), ("padded", 6, 0), ("text", 7, 0), ("3", 7, 1)
    ]
    assert {(r.source, r.lang, r.root_seed, r.seed) for r in rows} == {
        ("google_autocomplete", "fr", "r", "q")
    }


def test_frontier_asks_bare_seed_first(spark):
    seeds = spark.createDataFrame([("fr", "safari", 0), ("en", "trip", 1)], "lang string, seed string, ord long")
    rows = query_frontier(seeds, "ab").orderBy("ord").collect()
    assert [(r.lang, r.root_seed, r.seed, r.ord) for r in rows] == [
        ("fr", "safari", "safari", 0), ("fr", "safari", "safari a", 1), ("fr", "safari", "safari b", 2),
        ("en", "trip", "trip", 3), ("en", "trip", "trip a", 4), ("en", "trip", "trip b", 5),
    ]


def test_seeds_and_markets(spark):
    seeds = seed_phrases(spark)
    assert {r.lang: r["count"] for r in seeds.groupBy("lang").count().collect()} == {
        "fr": 10, "en": 8, "de": 5, "it": 9
    }
    assert query_frontier(seeds).count() == 32 * 27
    assert [r.geo for r in markets(spark).collect()] == ["", "FR", "DE", "US", "IT"]
    with pytest.raises(KeyError):
        seed_phrases(spark, "es")


def test_first_spelling_ignores_case_inside_one_expansion(spark):
    rows = spark.createDataFrame(
        [("Nosy Be", "fr", "a", 3), ("nosy be", "fr", "a", 2), ("NOSY BE", "fr", "b", 1), ("é", "fr", "a", 5),
         ("É", "fr", "a", 4), ("nosy be", "en", "a", 9)],
        "keyword string, lang string, root_seed string, ord long",
    )
    kept = first_spelling(rows, ["lang", "root_seed"]).orderBy("ord").collect()
    assert [(r.keyword, r.ord) for r in kept] == [("NOSY BE", 1), ("nosy be", 2), ("É", 4), ("nosy be", 9)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    rows = spark.range(100_000, numPartitions=4).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("keyword"),
        F.col("id").alias("ord"),
    )
    first = first_per_key(rows, ["keyword"])
    assert first.where("keyword = 'hot'").collect() == [("hot", 1)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_last_value_per_key(spark):
    rows = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 3), ("a", "", 9), ("b", "", 1), ("a", "z", 2)],
        "keyword string, intent string, ord long",
    )
    assert last_value(rows, "keyword", "intent").collect() == [("a", "y")]


KEY = ["keyword", "lang", "source"]


def suggestions(spark, rows):
    return spark.createDataFrame(
        [(k, lang, "s", seed, n) for n, (k, lang, seed) in enumerate(rows)],
        "keyword string, lang string, source string, seed string, ord long",
    )


def test_only_new_is_case_sensitive_and_first_wins(spark):
    stored = suggestions(spark, [("a", "fr", "old"), ("b", "en", "old")])
    incoming = suggestions(
        spark, [("c", "fr", "1"), ("a", "fr", "2"), ("A", "fr", "3"), ("c", "fr", "4"), ("b", "fr", "5")]
    )
    new = only_new(incoming, stored, KEY).orderBy("ord").collect()
    assert [(r.keyword, r.lang, r.seed) for r in new] == [("c", "fr", "1"), ("A", "fr", "3"), ("b", "fr", "5")]


def test_append_twice_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "keywords")
    assert read_keywords(spark, table).count() == 0
    rows = suggestions(spark, [("x", "fr", "1"), ("x", "en", "2"), ("y", "", "3"), ("x", "fr", "4")])
    assert append_keywords(rows, table, F.lit("2026-01-01").cast("timestamp")) == 3
    assert append_keywords(rows, table) == 0
    more = suggestions(spark, [("y", "", "1"), ("z", "07", "2")])
    assert append_keywords(more, table) == 1
    stored = read_keywords(spark, table).orderBy("id").collect()
    assert [(r.keyword, r.lang, r.seed) for r in stored] == [
        ("x", "fr", "1"), ("x", "en", "2"), ("y", "", "3"), ("z", "07", "2")
    ]
    assert [r.id for r in stored] == [0, 1, 2, 3] and stored[0].collected_at.year == 2026
    assert [r.keyword for r in read_keywords(spark, table, "en").collect()] == ["x"]
    assert read_keywords(spark, table, "").count() == 4
    assert [r.keyword for r in first_keywords(read_keywords(spark, table), 2).collect()] == ["x", "x"]


def test_stored_side_is_read_by_bucket_and_not_shuffled(spark, tmp_path):
    table = str(tmp_path / "keywords")
    rows = spark.range(5000).select(
        F.concat(F.lit("k"), "id").alias("keyword"), F.lit("fr").alias("lang"), F.lit("s").alias("source"),
        F.lit("seed").alias("seed"), F.col("id").alias("ord"),
    )
    assert append_keywords(rows, table, buckets=16) == 5000
    given, buckets = high_water(spark, table)
    assert (given, buckets) == (5000, 16)
    incoming = rows.where("ord < 3").withColumn("slot", slot_of(buckets))
    slots = [r.slot for r in incoming.select("slot").collect()]
    with settings(spark, {**BY_SLOT, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        known = bucketed(spark, table, buckets).where(F.col("slot").isin(slots))
        plan = new_keys(incoming, known, ["slot", *KEY])
        assert plan.count() == 0
        text = plan._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in text.splitlines() if "FileScan parquet" in line][0]
    assert "SelectedBucketsCount" in scan and "out of 16" in scan
    above = text[: text.index(scan)].splitlines()
    depth = len(scan) - len(scan.lstrip(" :+-*(0123456789)"))
    while above:  # from the stored scan up to the first join there is no exchange
        line = above.pop()
        if "Join" in line:
            break
        assert "Exchange" not in line
    assert depth > 0


def test_ids_grow_by_inserted_rows_whatever_the_requests(spark, tmp_path):
    table = str(tmp_path / "keywords")
    items = json.dumps(["q", [f"w{i}" for i in range(30)]])
    payloads = spark.createDataFrame([("fr", "r", "q", (1 << 62) + n, items) for n in range(2)], schemas.PAYLOADS)
    assert expand_into(payloads, table) == 30
    more = spark.createDataFrame([("fr", "r", "q", 0, '["q", ["w3", "new"]]')], schemas.PAYLOADS)
    assert expand_into(more, table) == 1 and expand_into(more, table) == 0
    rows = read_keywords(spark, table).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(31))
    assert [r.keyword for r in rows] == [f"w{i}" for i in range(30)] + ["new"]


def test_places_beyond_a_long_answer_stay_unique(spark):
    rows = spark.range(1).select(
        arrival(F.lit(1), F.lit((1 << 31) - 1)).alias("a"), arrival(F.lit(2), F.lit(0)).alias("b"),
        arrival(F.lit((1 << 63) - 1), F.lit(5)).alias("c"),
    ).first()
    assert int(rows.a) + 1 == int(rows.b) and int(rows.c) == ((1 << 63) - 1) * (1 << 31) + 5


@pytest.mark.parametrize("name", ["dedupe_first", "expand_payloads", "tag_map", "append_new"])
def test_first_and_last_rows_need_no_sort(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    if name == "append_new":
        assert plan.count("documents.parquet") <= 1  # the stored half; the incoming rows are a table


def test_missing_key_parts_are_stored_once(spark, tmp_path):
    table = str(tmp_path / "keywords")
    rows = suggestions(spark, [("x", None, "1"), ("x", "", "2"), ("y", None, "3")])
    assert append_keywords(rows, table) == 2 and append_keywords(rows, table) == 0


def test_language_filter_prunes_to_one_folder(spark, tmp_path):
    table = str(tmp_path / "keywords")
    append_keywords(suggestions(spark, [("x", "fr", "1"), ("x", "en", "2")]), table)
    plan = read_keywords(spark, table, "fr")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(dict(zip(["lang", "root_seed", "seed", "ord", "payload"], row))) for row in rows]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_expand_from_landed_files(spark, tmp_path):
    landed, table = tmp_path / "landed", str(tmp_path / "keywords")
    land(landed, "a.json", [
        ("fr", "safari", "safari", 0, '["safari", ["Safari Prix", "safari avis"]]'),
        ("fr", "safari", "safari a", 1, '["safari a", ["safari prix", "safari avion"]]'),
        ("fr", "voyage", "voyage", 2, '["voyage", ["safari prix", "broken'),
    ])
    read = read_payloads(spark, str(landed))
    assert [(r.keyword, r.seed) for r in expand(read).orderBy("ord").collect()] == [
        ("Safari Prix", "safari"), ("safari avis", "safari"), ("safari avion", "safari a")
    ]
    assert expand_into(read, table) == 3 and expand_into(read, table) == 0


def test_ingest_counters(spark):
    seen = suggestions(spark, [("a", "fr", "1"), ("b", "fr", "1"), ("c", "fr", "2")])
    stored = suggestions(spark, [("a", "fr", "old"), ("c", "fr", "old")])
    rows = ingest_counters(marked_new(seen, stored, KEY), ["seed"]).orderBy("seed").collect()
    assert [tuple(r) for r in rows] == [("1", 2, 1), ("2", 1, 0)]


def test_stream_adds_what_is_new_and_survives_replay(spark, tmp_path):
    landed, table = tmp_path / "landed", str(tmp_path / "keywords")

    def run(checkpoint):
        end_round(spark, str(landed))
        append_spellings(stream_payloads(spark, str(landed), 1), table, str(tmp_path / checkpoint)).awaitTermination()
        return {(r.keyword, r.seed) for r in read_keywords(spark, table).collect()}

    land(landed, "a.json", [("fr", "r", "r", 0, '["r", ["one", "two", "one"]]')])
    assert run("c1") == {("one", "r"), ("two", "r")}
    land(landed, "b.json", [("fr", "r", "r b", 1, '["r b", ["two", "three"]]')])
    expected = {("one", "r"), ("two", "r"), ("three", "r b")}
    assert run("c1") == expected
    assert run("c2") == expected  # everything once more from the start, with the table as initial state
    rows = read_keywords(spark, table).collect()
    assert len(rows) == 3 and {r.id for r in rows} == {0, 1, 2}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_files_in_any_order_store_what_the_batch_does(spark, tmp_path, order):
    landed, streamed, batched = tmp_path / "landed", str(tmp_path / "streamed"), str(tmp_path / "batched")
    files = [
        [("fr", "r", "r", 0, '["r", ["Nosy Be", "nosy be"]]'), ("fr", None, "n", 9, '["n", ["Avis"]]')],
        [("fr", "r", "r a", 1, '["r a", ["NOSY BE", "avis"]]'), ("fr", "s", "s", 2, '["s", ["nosy be", "Avis"]]')],
        [("fr", "s", "s a", 3, '["s a", ["Nosy Be", "AVIS"]]'), (None, "r", "r", 4, '["r", ["avis"]]')],
    ]
    for n in order:
        land(landed, f"{n}.json", files[n])
        stream = append_spellings(stream_payloads(spark, str(landed), 1), streamed, str(tmp_path / "state"))
        stream.awaitTermination()
    assert read_keywords(spark, streamed).count() == 0  # the round is not over
    end_round(spark, str(landed))
    append_spellings(stream_payloads(spark, str(landed), 1), streamed, str(tmp_path / "state")).awaitTermination()
    expand_into(read_payloads(spark, str(landed)), batched)
    rows = [
        sorted((r.keyword, r.lang, r.seed, r.id) for r in read_keywords(spark, table).collect()) for table in (streamed, batched)
    ]
    assert rows[0] == rows[1]
    assert {row[:3] for row in rows[0]} == {
        ("Nosy Be", "fr", "r"), ("avis", "fr", "r a"), ("nosy be", "fr", "s"), ("Avis", "fr", "s"), ("avis", "", "r")
    }


def test_stream_begins_with_the_stored_table_and_reads_it_once(spark, tmp_path):
    landed, table = tmp_path / "landed", str(tmp_path / "keywords")
    append_keywords(suggestions(spark, [("old", "fr", "before")]).withColumn("source", F.lit("google_autocomplete")), table)
    land(landed, "a.json", [("fr", "r", "r", 0, '["r", ["old", "Old", "new"]]')])
    end_round(spark, str(landed))
    query = append_spellings(stream_payloads(spark, str(landed)), table, str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted((r.keyword, r.seed) for r in read_keywords(spark, table).collect()) == [("new", "r"), ("old", "before")]
    plan = query._jsq.explainInternal(True)
    assert "keywords" not in plan.split("== Physical Plan ==")[1].replace("landed", "")


def test_a_replayed_micro_batch_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "keywords")
    append_keywords(suggestions(spark, [("a", "fr", "1")]), table)
    rows = suggestions(spark, [("b", "fr", "1"), ("c", "fr", "2")])
    given, buckets = high_water(spark, table)
    assert not has_batch(spark, table, "stream", 4)
    assert add_rows(rows, rows, table, given, buckets, writer="stream", batch=4) == 2
    assert has_batch(spark, table, "stream", 4) and not has_batch(spark, table, "stream", 5)
    assert high_water(spark, table) == (3, buckets) and read_keywords(spark, table).count() == 3


def test_recent_keys_pass_once_and_late_rows_are_dropped(spark, tmp_path):
    folder, table = tmp_path / "rows", str(tmp_path / "keywords")
    schema = "keyword string, lang string, source string, seed string, ord long, landed_at timestamp"

    def run(*rows):
        folder.mkdir(exist_ok=True)
        names = ("keyword", "lang", "source", "seed", "ord", "landed_at")
        lines = [json.dumps(dict(zip(names, (k, lang, "s", "x", n, at)))) for k, lang, n, at in rows]
        (folder / f"{rows[0][2]}.json").write_text("\n".join(lines) + "\n")
        stream = spark.readStream.schema(schema).json(str(folder))
        counts = append_recent(stream, table, "1 hour", str(tmp_path / "state"))
        counts.awaitTermination()
        passed = [p["stateOperators"][0]["numRowsTotal"] for p in counts.recentProgress if p["stateOperators"]]
        return {r.keyword for r in read_keywords(spark, table).collect()}, passed[-1]

    assert run(("a", "fr", 1, "2026-01-01 10:00:00"), ("a", "fr", 2, "2026-01-01 10:10:00"), ("b", None, 3, "2026-01-01 10:00:00"))[0] == {"a", "b"}
    found, held = run(("c", "fr", 4, "2026-01-01 13:00:00"), ("a", "fr", 5, "2026-01-01 10:30:00"))
    assert found == {"a", "b", "c"} and held == 1  # the first keys are forgotten
    assert run(("late", "fr", 6, "2026-01-01 11:00:00"), ("a", "fr", 7, "2026-01-01 13:30:00"))[0] == {"a", "b", "c"}
    assert read_keywords(spark, table).count() == 3


def test_rows_of_keys_are_never_broadcast(spark, payloads, tmp_path):
    # the estimate of what is exploded from payloads is far below its size
    payloads.write.parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    plan = first_spelling(decode_suggestions(landed), ["lang", "root_seed"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = marked_new(payloads, payloads.limit(1), ["seed"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
