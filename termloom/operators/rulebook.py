"""Rules kept as a table: phrases looked up by word n-grams, for lists too long for one pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.evaluate import with_evaluated
from termloom.functions.rules import WORD

PIECE = rf"({WORD}+|[^{WORD[1:]}+)"


def _pieces(text: Column) -> Column:
    """Words and what stands between them, by turns, as they are."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))


def _grams(pieces: Column, sizes: list[int]) -> Column:
    """Distinct stretches of a text from the start of a word to the end of a word, of these numbers of pieces."""
    # a text that begins with a word has its words at odd places
    lead = F.when(F.get(pieces, F.lit(0)).rlike(f"^{WORD}"), 1).otherwise(2)

    def of(size: int) -> Column:
        last = F.size(pieces) - size + 1
        starts = F.when(last >= lead, F.sequence(lead, last, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice(pieces, at, size), ""))

    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def rule_hits(keywords: DataFrame, rules: DataFrame, key: str = "id", text: str = "keyword") -> DataFrame:
    """``key, hits``: the numbers, in order, of the rules whose phrase stands in the lower-cased text as whole words.

    ``rules`` has ``number, phrase``; a phrase is what ``\\bphrase\\b`` would find in a ``RuleTable``, so it begins and ends
    with a letter, digit or underscore, and one that does not, or is missing, never hits. Each row's distinct n-grams
    meet the rules in one equi-join, which Spark broadcasts if the rules are small enough; a task holds one row's
    n-grams at a time, however many rules there are. Only lengths that some phrase has are cut. ``key`` is unique; a missing
    text has no hits.
    """
    phrase = F.col("phrase")
    usable = rules.select("number", "phrase").where(phrase.rlike(f"^{WORD}") & phrase.rlike(f"{WORD}$"))
    sized = usable.withColumn("_size", F.size(_pieces(phrase)))
    sizes = sorted(row["_size"] for row in sized.select("_size").distinct().collect())  # one row a length
    rows = keywords.select(key)
    if not sizes:
        return rows.select(key, F.array().cast("array<int>").alias("hits"))
    # the stretches refer to the pieces once each, so these have to be there already
    cut = with_evaluated(keywords.select(key, text), "_pieces", _pieces(F.lower(F.col(text))))
    grams = cut.select(key, F.explode(_grams(F.col("_pieces"), sizes)).alias("phrase"))
    found = grams.join(usable, "phrase").groupBy(key).agg(
        F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("hits")
    )
    none = F.array().cast("array<int>")
    return rows.join(found, key, "left").select(key, F.coalesce("hits", none).alias("hits"))
