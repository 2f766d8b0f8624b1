"""Sheets, ordered reports, diagnostics, and the end-to-end steps that write them."""

import csv
import pathlib

import pytest
from pyspark.sql import functions as F

from termloom.operators.diagnostics import matched_categories, route_counts, word_frequency
from termloom.operators.intent import auto_classify
from termloom.plans.classify import write_classification, write_clusters, write_diagnosis
from termloom.plans.curate import curate, write_curation
from termloom.sinks import reports
from termloom.sources.sheets import read_sheet


SCHEMA = "keyword string, seed string, lang string, ord long"


def lines(folder) -> list[list[str]]:
    """All rows of a report in file order, header once, read by a plain CSV reader."""
    rows = []
    for part in sorted(pathlib.Path(folder).glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as file:
            found = list(csv.reader(file))
        rows += found if not rows else found[1:]
    return rows


def sheet_file(path, rows, header=("keyword", "seed", "lang", "intent", "notes")):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file).writerows([header, *rows])
    return str(path)


def test_sheet_reads_quotes_breaks_and_gaps(spark, tmp_path):
    path = sheet_file(tmp_path / "s.csv", [
        ['say "hi", twice', "s", "fr", "", "line one\nline two"], [" padded ", "s", "FR", "x", ""],
        ["short", "s", "en"], ["back\\slash", "s", "en", "", '\\"'],
    ])
    rows = read_sheet(spark, path).orderBy("ord").collect()
    assert [tuple(r)[:5] for r in rows] == [
        ('say "hi", twice', "s", "fr", "", "line one\nline two"), (" padded ", "s", "FR", "x", ""),
        ("short", "s", "en", "", ""), ("back\\slash", "s", "en", "", '\\"'),
    ]


def test_sheet_columns_go_by_name(spark, tmp_path):
    path = sheet_file(tmp_path / "s.csv", [["fr", "k", "s"]], ("lang", "keyword", "seed"))
    assert tuple(read_sheet(spark, path).first())[:5] == ("k", "s", "fr", "", "")
    with pytest.raises(ValueError):
        read_sheet(spark, sheet_file(tmp_path / "t.csv", [["k"]], ("keyword",)))


def test_report_is_in_order_over_all_files_and_reads_back(spark, tmp_path):
    texts = [f'k{n % 50} "q", é\n {n}' for n in range(400)] + ["", " "]
    rows = spark.createDataFrame([(t, "s", "fr", n) for n, t in enumerate(texts)], SCHEMA)
    out = str(tmp_path / "out")
    reports.TAGGING_SHEET.write(rows, out, files=3)
    written = lines(out)
    assert written[0] == ["keyword", "seed", "lang", "intent", "notes"]
    assert [r[0] for r in written[1:]] == sorted(texts)
    assert sorted(r.keyword for r in read_sheet(spark, out).collect()) == sorted(texts)


def test_equal_keys_keep_input_order(spark):
    rows = spark.createDataFrame([("a", str(n), "fr", n) for n in (5, 1, 3)], SCHEMA)
    assert [r.seed for r in reports.TAGGING_SHEET.of(rows).collect()] == ["1", "3", "5"]


def test_curation_reports(spark, tmp_path):
    words = ["hotel nosy be", "hotel tui", "bateau depuis nosy be", "apk", "avion"]
    rows = spark.createDataFrame([(w, "s", "en", n) for n, w in enumerate(words)], SCHEMA)
    write_curation(curate(rows, "en"), str(tmp_path), "en", tie="ord")
    assert [r[0] for r in lines(tmp_path / "to_tag_en")[1:]] == ["avion", "hotel nosy be"]
    assert lines(tmp_path / "foreign_language_from_en")[1:] == [["fr", "bateau depuis nosy be", "s", "en"]]


def test_classify_then_cluster(spark, tmp_path):
    path = sheet_file(tmp_path / "s.csv", [
        ["safari prix", "safari madagascar", "fr", "", ""], ["croisiere avis", "croisiere nosy be e", "fr", "", ""],
        ["red island", "x", "fr", "", "keep"], ["tour", "tour operateur madagascar", "fr", "", "EN"],
        ["best tour", "tour operateur madagascar", "fr", "transactionnel", "EN"],
    ])
    sheet = read_sheet(spark, path)
    result = write_classification(sheet, str(tmp_path), "fr")
    assert lines(tmp_path / "classified_fr") == [
        ["keyword", "seed", "lang", "intent", "matched_rule"],
        ["croisiere avis", "croisiere nosy be e", "fr", "informationnel", r"\bavis\b"],
        ["best tour", "tour operateur madagascar", "fr", "transactionnel", "manuel"],
        ["safari prix", "safari madagascar", "fr", "transactionnel", r"\bprix\b"],
    ]
    assert lines(tmp_path / "needs_review_fr")[1:] == [
        ["red island", "x", "fr", "", ""], ["tour", "tour operateur madagascar", "fr", "", ""]
    ]
    write_clusters(result, str(tmp_path), "fr")
    assert lines(tmp_path / "clustered_fr")[1:] == [
        ["excursions_mer", "croisiere avis", "croisiere nosy be e", "fr", "informationnel", ""],
        ["safari", "safari prix", "safari madagascar", "fr", "transactionnel", ""],
    ]
    assert lines(tmp_path / "cross_language_from_fr") == [
        ["resolved_lang", "keyword", "seed", "cluster", "intent"],
        ["en", "best tour", "tour operateur madagascar", "agences_prestataires", "transactionnel"],
    ]
    review = read_sheet(spark, str(tmp_path / "needs_review_fr"))
    write_diagnosis(review, str(tmp_path), "fr")
    assert [r[0] for r in lines(tmp_path / "diagnostic_no_match_fr")[1:]] == ["red island"]
    assert not (tmp_path / "diagnostic_conflict_fr").exists()


def test_commercial_tier_is_opt_in(spark, tmp_path):
    path = sheet_file(tmp_path / "s.csv", [["diving trip", "s", "en", "", ""]])
    sheet = read_sheet(spark, path)
    assert auto_classify(sheet).first().intent is None
    write_classification(sheet, str(tmp_path), "en", include_commercial=True)
    assert lines(tmp_path / "classified_en")[1][3:] == ["commercial", r"commercial:\btrips?\b"]


@pytest.fixture
def review(spark):
    words = ["red island Red", "island e Nosy", "BOOK a trip", "guide visa", "booking tour prix guide", "la  x\ty"]
    return spark.createDataFrame(list(enumerate(words)), "ord long, keyword string")


def test_matched_categories(review):
    rows = matched_categories(review).orderBy("ord").collect()
    assert [(r.route, r.matched_categories) for r in rows] == [
        ("no_match", None), ("no_match", None),
        ("conflict", "TRANSACTIONAL_PATTERNS + COMMERCIAL_PATTERNS"), ("single", "INFORMATIONAL_PATTERNS"),
        ("conflict", "NAVIGATIONAL_PATTERNS + TRANSACTIONAL_PATTERNS + INFORMATIONAL_PATTERNS + COMMERCIAL_PATTERNS"),
        ("no_match", None),
    ]
    assert tuple(route_counts(matched_categories(review)).first()) == (6, 3, 2, 1)


def test_word_frequency_ties_keep_first_appearance(review):
    rows = word_frequency(matched_categories(review).where("route = 'no_match'"))
    assert [tuple(r) for r in rows.collect()] == [("red", 2), ("island", 2), ("x", 1), ("y", 1)]
    assert [r.word for r in word_frequency(review.where("ord = 0"), stopwords=["red"], top=1).collect()] == ["island"]


def test_conflict_report_has_its_categories(spark, tmp_path):
    path = sheet_file(tmp_path / "s.csv", [["book a trip", "s", "en", "", ""]])
    write_diagnosis(read_sheet(spark, path), str(tmp_path), "en")
    assert lines(tmp_path / "diagnostic_conflict_en") == [
        ["keyword", "seed", "lang", "intent", "notes", "matched_categories"],
        ["book a trip", "s", "en", "", "", "TRANSACTIONAL_PATTERNS + COMMERCIAL_PATTERNS"],
    ]


def test_routes_are_complete_and_disjoint(review):
    counts = route_counts(matched_categories(review)).first()
    assert counts.total == counts.no_match + counts.conflict + counts.single == review.count()
    assert matched_categories(review).select(F.count("route")).first()[0] == review.count()


def test_frequent_words_equal_the_whole_count(spark):
    import random

    from termloom.operators.diagnostics import frequent_words, word_frequency

    r = random.Random(31)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(r.randrange(0, 12))) + " de") for i in range(600)]
    rows += [(700 + i, f"tie{i % 9} tie{(i + 3) % 9}") for i in range(90)] + [(900, None), (901, ""), (902, "  ")]
    frame = spark.createDataFrame(rows, "ord long, keyword string")
    for top in (1, 15, 40, 1000):
        wanted = [tuple(x) for x in word_frequency(frame, top=top).collect()]
        for slots in (1, 7, 256, 1 << 20):
            assert [tuple(x) for x in frequent_words(frame, top=top, slots=slots).collect()] == wanted
    assert frequent_words(frame.limit(0)).count() == 0
