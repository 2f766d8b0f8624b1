"""Noise, language, intent and theme operators on domain keywords."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import intent, language, noise, themes
from termloom.operators.summaries import classification_rate, count_by, curation_counts
from termloom.plans.curate import curate


@pytest.mark.parametrize(
    "bucket, keywords",
    [
        ("competitor", ["voyage madagascar TUI", "hotel kuoni", "club med nosy be", "jardin des tuileries",
                        "jangaria safari", "madagascar jet2 deals"]),
        ("off_topic", ["madagascar movie 2", "automobile club", "telecharger apk", "travel kit bag",
                       "vanilla travel spray", "national holiday 2027", "what does nosy be mean",
                       "where to travel to", "where to travel to\n"]),
        ("keeper", ["nosy be tarif", "vanilla travel", "holidays in may", "what does nosy\nbe mean",
                    "travel to nosy be", "safari", ""]),
    ],
)
def test_noise_bucket(column, bucket, keywords):
    assert column(keywords, noise.noise_bucket(F.col("v"))) == [bucket] * len(keywords)


def test_competitor_wins_over_off_topic(column):
    assert column(["tui movie"], noise.noise_bucket(F.col("v"))) == ["competitor"]


def test_detected_language(column):
    cases = {
        "bateau depuis nosy be": "fr", "aller où": "fr", "qu'est-ce que nosy be": "fr",
        "reise und hotel": "de", "wann nach nosy be": "de", "quanto costa nosy be": "it",
        "perché madagascar": "it", "safari madagascar": None, "cheap trip": None,
        "avec und": None, "avec und sans": "fr", "de de de und mit": "de", "": None,
    }
    assert column(list(cases), language.detected_language(F.col("v"))) == list(cases.values())


def test_foreign_needs_a_clear_other_language(spark):
    rows = spark.createDataFrame(
        [("hotel avec piscine", "en"), ("hotel avec piscine", "fr"), ("nice hotel", "en"),
         ("hotel avec piscine", "FR"), ("avec und", "en")],
        "keyword string, lang string",
    )
    split = language.split_by_language(rows, F.col("lang")).collect()
    assert [(r.detected_lang, r.is_foreign) for r in split] == [
        ("fr", True), ("fr", False), (None, False), ("fr", True), (None, False)
    ]


INTENTS = {
    "transactionnel": ["hotel nosy be prix", "combien coûte", "CHEAP flights", "günstig reisen",
                       "voli economici", "hotel deal", "hotel deals", "prenotare hotel"],
    "informationnel": ["que faire a tulear", "is it safe", "reiseführer afrika", "travel in may",
                       "june travel", "things to see", "perche andare", "visa policy", "zoo"],
    "navigationnel": ["nosy be tripadvisor", "hotel booking.com", "book on booking", "wiki travel"],
    None: ["red island", "diving trip", "guides", "isla", "ñcan", ""],
}


@pytest.mark.parametrize("expected", INTENTS)
def test_confident_intent(spark, expected):
    rows = spark.createDataFrame([(k,) for k in INTENTS[expected]], "keyword string")
    assert {r.intent for r in intent.classify(rows).collect()} == {expected}


def test_rule_is_reported_in_list_order_not_text_order(spark):
    rows = spark.createDataFrame([("budget or prix",)], "keyword string")
    assert tuple(intent.classify(rows).first()) == ("budget or prix", "transactionnel", r"\bprix\b")


def test_commercial_is_apart_and_marked(spark):
    rows = spark.createDataFrame(
        [("diving trips",), ("luxusurlaub",), ("trip price",), ("red island",)], "keyword string"
    )
    confident = [r.intent for r in intent.classify(rows).collect()]
    assert confident == [None, None, "transactionnel", None]
    only = intent.classify(rows, intent.COMMERCIAL).collect()
    assert [(r.intent, r.matched_rule) for r in only] == [
        ("commercial", r"commercial:\btrips?\b"), ("commercial", r"commercial:luxusurlaub"),
        ("commercial", r"commercial:\btrips?\b"), (None, None),
    ]
    both = intent.classify(rows, intent.ALL_TIERS).collect()
    assert [r.intent for r in both] == ["commercial", "commercial", "transactionnel", None]


@pytest.fixture
def sheet(spark):
    return spark.createDataFrame(
        [
            (1, "hotel tarif", "circuit madagascar c", "fr", " Informationnel ", "by hand"),
            (2, "hotel tarif", "circuit madagascar", "fr", "", "x"),
            (3, "red island", "Safari Madagascar", "en", None, ""),
            (4, "diving trip", "nosy be day trip", "en", "  ", "EN"),
            (5, "hotel kuoni", "excursion nosy be b", "fr", "exclure", ""),
            (6, "diving trip", "x", "en", "commercial", ""),
        ],
        "ord long, keyword string, seed string, lang string, intent string, notes string",
    )


def test_auto_classify_keeps_tags_and_loses_no_row(sheet):
    got = {r.ord: (r.intent, r.matched_rule) for r in intent.auto_classify(sheet).collect()}
    assert got == {
        1: ("informationnel", "manuel"), 2: ("transactionnel", r"\btarif"), 3: (None, None),
        4: (None, None), 5: ("exclure", "manuel"), 6: ("commercial", "manuel"),
    }
    full = {r.ord: (r.intent, r.matched_rule) for r in intent.auto_classify(sheet, intent.ALL_TIERS).collect()}
    assert full == got | {4: ("commercial", r"commercial:\btrips?\b")}


def test_needs_review_is_blank_again(sheet):
    rows = intent.needs_review(intent.auto_classify(sheet)).orderBy("ord").collect()
    assert [(r.ord, r.intent, r.notes) for r in rows] == [(3, "", ""), (4, "", "")]


def test_tag_map_takes_the_last_filled_row(sheet):
    found = {r.keyword: r.intent for r in intent.tag_map(sheet).collect()}
    assert found == {"hotel tarif": "informationnel", "hotel kuoni": "exclure", "diving trip": "commercial"}


def test_rate_and_summary(sheet):
    done = intent.auto_classify(sheet, intent.ALL_TIERS)
    rate = classification_rate(done).first()
    assert (rate.total, rate.classified, rate.needs_review, rate.commercial) == (6, 5, 1, 2)
    assert rate.auto_rate == 5 / 6 * 100
    assert classification_rate(done.where("false")).first().auto_rate == 0
    tied = count_by(done.where("intent is not null"), "intent").collect()
    assert [(r.intent, r.n) for r in tied] == [
        ("commercial", 2), ("informationnel", 1), ("transactionnel", 1), ("exclure", 1)
    ]


def test_theme_of_seed(column):
    cases = {
        "excursion nosy be": "excursions_mer", "Circuit Madagascar z": "circuits_multijours",
        "agence de voyage madagascar": "agences_prestataires", "voyage madagascar": "voyage_generique",
        "le voyage madagascar": "autre", "": "autre",
    }
    assert column(list(cases), themes.theme_of_seed(F.col("v"))) == list(cases.values())


def test_resolved_language(spark):
    rows = spark.createDataFrame(
        [("fr", "EN"), ("fr", " it "), ("fr", "es"), ("FR", ""), ("fr", None), ("fr", "see en")],
        "d string, n string",
    )
    found = rows.select(language.resolved_language(F.col("d"), F.col("n"))).collect()
    assert [r[0] for r in found] == ["en", "it", "fr", "FR", "fr", "fr"]


def test_route_tagged(spark):
    rows = spark.createDataFrame(
        [
            (1, "a", "safari madagascar", "fr", "transactionnel", ""),
            (2, "b", "x", "fr", "transactionnel", "IT"),
            (3, "c", "x", "FR", "informationnel", ""),
            (4, "d", "x", "FR", "informationnel", "fr"),
            (5, "e", "x", "en", "informationnel", "note"),
            (6, "f", "x", "fr", "", ""),
            (7, "g", "x", "fr", " EXCLURE", ""),
            (8, "h", "x", "fr", None, None),
        ],
        "ord long, keyword string, seed string, lang string, intent string, notes string",
    )
    to = lambda target: {r.ord: (r.route, r.lang) for r in themes.route_tagged(rows, target).collect()}
    cross = {2: ("cross_language", "it"), 3: ("cross_language", "FR")}
    french = {1: ("matching", "fr"), 4: ("matching", "fr")}
    assert to(None) == cross | french | {5: ("matching", "en")}
    assert to("FR ") == cross | french
    assert to("") == cross
    [first] = themes.route_tagged(rows).where("ord = 1").collect()
    assert first.cluster == "safari" and first.intent == "transactionnel"


def test_curation_has_every_row_in_one_bucket(spark):
    words = ["hotel tui", "movie", "hotel avec piscine", "nosy be", "tui avec piscine"]
    rows = spark.createDataFrame([(w,) for w in words], "keyword string")
    curated = curate(rows, "en")
    assert [r.bucket for r in curated.collect()] == [
        "competitor", "off_topic", "foreign", "keeper", "competitor"
    ]
    counts = curation_counts(curated).first()
    assert tuple(counts) == (5, 1, 2, 1, 1)
