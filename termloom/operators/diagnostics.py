"""Why keywords stay unclassified: matching categories and frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom import fixed_values as fixed
from termloom.functions.evaluate import with_evaluated
from termloom.functions.rules import RuleTable
from termloom.functions.text import ignoring_case, words
from termloom.session import stored

CATEGORIES = RuleTable.of(
    dict(
        zip(
            fixed.CATEGORY_NAMES,
            [fixed.NAVIGATIONAL, fixed.TRANSACTIONAL, fixed.INFORMATIONAL, fixed.COMMERCIAL],
            strict=True,
        )
    )
)


def matched_categories(keywords: DataFrame, table: RuleTable = CATEGORIES) -> DataFrame:
    """Add ``matched_categories`` (joined in list order) and ``route`` by their number.

    Case is ignored; the patterns of the table are written in lower case.
    """
    hit = table.categories_hit(ignoring_case(F.col("keyword")))
    number = F.size("_hit")
    return (
        with_evaluated(keywords, "_hit", hit)
        .withColumns(
            {
                "matched_categories": F.when(
                    number > 0, F.array_join("_hit", fixed.CATEGORY_JOINER)
                ),
                "route": F.when(number > 1, "conflict")
                .when(number == 1, "single")
                .otherwise("no_match"),
            }
        )
        .drop("_hit")
    )


def route_counts(routed: DataFrame) -> DataFrame:
    route = F.col("route")
    return routed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(route == "no_match").alias("no_match"),
        F.count_if(route == "conflict").alias("conflict"),
        F.count_if(route == "single").alias("single"),
    )


def _place(keywords: DataFrame, order: str) -> Column:
    """A word's row and its place in there."""
    if isinstance(keywords.schema[order].dataType, T.IntegralType):
        # one number instead of a pair, because Spark aggregates numbers by hash, without a sort
        return F.col("_row").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    return F.struct("_row", "pos")


def word_frequency(
    keywords: DataFrame,
    order: str = "ord",
    stopwords: list[str] | None = None,
    top: int | None = fixed.TOP_WORDS,
) -> DataFrame:
    """Most frequent words; ties keep the order of first appearance (row, then place in row)."""
    stopwords = fixed.STOPWORDS if stopwords is None else stopwords
    found = (
        keywords.select(F.col(order).alias("_row"), F.posexplode(words(F.col("keyword"))))
        .where(~F.col("col").isin(stopwords))
        .groupBy(F.col("col").alias("word"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(_place(keywords, order)).alias("_first"),
        )
        .orderBy(F.desc("n"), "_first")
    )
    return (found if top is None else found.limit(top)).select("word", "n")


def frequent_words(
    keywords: DataFrame,
    order: str = "ord",
    stopwords: list[str] | None = None,
    top: int = fixed.TOP_WORDS,
    slots: int = 1 << 20,
) -> DataFrame:
    """The rows of ``word_frequency``, without shuffling the vocabulary.

    Words are counted in ``slots`` hashed slots first; a slot's count bounds that of each of its words from above. The words of
    the ``top`` fullest slots are then counted one by one, and the last of their ``top`` greatest counts bounds the
    result from below. Only words of slots that reach it can be among the most frequent, ties included, and are counted
    whole. With fewer than ``top`` words there every word is. The driver sees ``top`` slots and counts; at most ``slots``
    numbers of eight bytes are broadcast.
    """
    stopwords = fixed.STOPWORDS if stopwords is None else stopwords
    split = F.filter(words(F.col("keyword")), lambda w: ~w.isin(stopwords))
    found = keywords.select(F.explode(split).alias("word"))
    slot = F.pmod(F.xxhash64("word"), F.lit(slots)).alias("slot")
    sums = stored(found.groupBy(slot).agg(F.count(F.lit(1)).alias("n")), "slots")
    fullest = [row["slot"] for row in sums.orderBy(F.desc("n")).limit(top).collect()]
    counts = found.where(slot.isin(fullest)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    greatest = [row["n"] for row in counts.orderBy(F.desc("n")).limit(top).collect()]
    floor = greatest[-1] if len(greatest) == top else 0
    within = sums.where(F.col("n") >= floor).select("slot")
    places = keywords.select(F.col(order).alias("_row"), F.posexplode(words(F.col("keyword"))).alias("pos", "word"))
    places = places.where(~F.col("word").isin(stopwords)).withColumn("slot", slot)
    chosen = places.join(F.broadcast(within), "slot", "left_semi")
    return (
        chosen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(_place(keywords, order)).alias("_first"))
        .orderBy(F.desc("n"), "_first").limit(top).select("word", "n")
    )
