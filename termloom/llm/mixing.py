"""Mixing sources to target weights: temperature mixing.

A source's weight is its share of the tokens to the power of an exponent between one (as it comes) and zero
(all sources alike). The exponent is found by repeated section: the largest one whose weights reach the
wanted entropy, and no smaller than the smallest whose weights repeat no source more often than allowed.
The weights become token budgets, which each source fills by whole permutations of its blocks and
a part of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.tables import Workspace

#: Sections of an interval in one pass over the sources, and passes: 64**4 steps of the exponent.
SECTIONS, PASSES = 64, 4
#: Blocks that a source is dealt to; a block is ordered in one task.
BLOCKS = 4096
ENTROPY, REPEATS, SEED = 0.9, 4.0, 17
WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text_column: str = "text"):
    """Words of a whole text; none of a missing one. A text of separators only has none."""
    trimmed = F.regexp_replace(F.col(text_column).cast("string"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(
        F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def exponent(shares: DataFrame, entropy: float, repeats: float, budget: float) -> float:
    """shares: ``share`` and ``tokens`` per source. The driver sees one row per tried exponent."""
    n, total = shares.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2:
        return 1.0
    least_entropy = entropy * math.log(n)

    def tried(low: float, high: float) -> list[tuple[float, bool, bool]]:
        steps = F.explode(F.array(*[F.lit(low + (high - low) * i / SECTIONS) for i in range(SECTIONS + 1)]))
        powers = shares.select(steps.alias("a"), "share").withColumn("p", F.pow("share", "a"))
        rows = powers.groupBy("a").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("l"), F.max(F.col("p") / F.col("share")).alias("r")
        )
        # entropy of p / z; how often the most repeated source is drawn for the budget
        return sorted((a, math.log(z) - l / z >= least_entropy - 1e-12, r / z * budget / total <= repeats) for a, z, l, r in rows.collect())

    def section(place: int) -> float:
        """The end of the exponents for which the test holds: the largest even enough, or the smallest unrepeated."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            rows = tried(low, high)
            good = [row[0] for row in rows if row[place]]
            if not good:
                return 0.0 if place == 1 else 1.0
            width = (high - low) / SECTIONS
            low, high = (max(good), min(1.0, max(good) + width)) if place == 1 else (max(0.0, min(good) - width), min(good))
        return low if place == 1 else high

    return max(section(1), section(2))


def mixture(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Draws documents so that the sources' tokens follow the weights: one row per draw.

    Returns the input's columns and ``n_tokens`` (words), ``weight`` (of the source), ``epoch`` (from 0) and ``place``
    (tokens of its source drawn before it). ``budget`` is in tokens, by default those of the input. Each whole
    epoch draws every document of a source once, in a block order and an order within blocks of its own; the
    last one stops with the document that fills the budget. ``entropy`` is a share of the greatest possible.
    The wish for few repeats goes before that for entropy. A missing source is a source of its own; documents
    without words are drawn with every epoch begun before the budget is full. Input columns named like new ones give way.
    """
    made = ("n_tokens", "weight", "epoch", "place")
    space = Workspace(docs.sparkSession, "mixing")
    docs = docs.drop(*[c for c in made if c in docs.columns])
    given = docs.withColumns(
        {
            "n_tokens": n_tokens(text_column),
            "__source": F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("")),
            "__block": F.pmod(F.xxhash64(id_column, text_column), F.lit(BLOCKS)).cast("int"),
        }
    ).withColumn("__row", F.monotonically_increasing_id())
    given = space.save(given, "documents")
    # tokens per source and block: partial sums, so a source with a third of all rows is no hot key
    blocks = space.save(given.groupBy("__source", "__block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = blocks.groupBy("__source").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = space.save(sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), "shares")
    alpha = exponent(shares, entropy, repeats, budget)
    powers = shares.withColumn("p", F.pow("share", F.lit(alpha)))
    z = powers.agg(F.sum("p")).first()[0] or 1.0
    wanted = powers.select(
        "__source",
        F.col("tokens").alias("__all"),
        (F.col("p") / z).alias("weight"),
        F.round(F.col("p") / z * budget).cast("long").alias("__wanted"),
    )
    # blocks of each epoch in an order of their own, with the tokens before them
    epochs = blocks.join(wanted, "__source").select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("__wanted"), F.lit(1)) / F.col("__all")).cast("int") - 1)).alias("epoch")
    )
    order = Window.partitionBy("__source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "__source", "__block"), "__block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = epochs.withColumn("__before", F.col("epoch") * F.col("__all") + before)
    epochs = epochs.where(F.col("__before") < F.col("__wanted")).drop("tokens", "__all")
    # documents of a block likewise; only ids and lengths are ordered
    light = given.select("__row", "__source", "__block", "n_tokens", F.col(id_column).alias("__id"))
    drawn = light.join(epochs, ["__source", "__block"])
    within = Window.partitionBy("__source", "__block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "__id"), "__id", "__row")
    ahead = F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("place", F.col("__before") + ahead).where(F.col("place") < F.col("__wanted"))
    drawn = drawn.select("__row", "weight", "epoch", "place")
    return given.join(drawn, "__row").select(*[F.col(f"`{c}`") for c in docs.columns], *made)
