"""Documents to a training mixture in five stages, each an operator of termloom.llm over all that is left.

Every stage is written as Parquet below the shared folder and read again for the next one. All but the last keep
the columns of documents, also those named like an operator's own; ``n_chars``, where there is one, follows the text.
An empty document is clean in every stage. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, mixing, simhash, suffixdedup, toxicity
from termloom.llm.tables import Workspace, table


def _set_aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """The documents with columns named like the operator's ``made`` ones renamed, and what names them back."""
    other = {c: f"__own_{c}" for c in docs.columns if c.lower() in made}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def _decoded(kept: Column) -> Column:
    """Bytes as text without those that decode to nothing. What the text itself holds of the mark that stands for such
    bytes is written in another way meanwhile."""
    mark, escape = F.lit("\ufffd"), F.lit("\ufffe")
    text = F.replace(F.replace(kept.cast("string"), escape, F.lit("\ufffe0")), mark, F.lit("\ufffe1"))
    text = F.replace(F.make_valid_utf8(text), mark, F.lit(""))
    return F.replace(F.replace(text, F.lit("\ufffe1"), mark), F.lit("\ufffe0"), escape)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut."""
    docs, columns = _set_aside(docs, "score", "offending")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return scored.where(F.col("score") < toxicity.CUT).select(columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row: that of the smallest id, a missing one last, and of several
    with that id the one whose text hashes lowest. Groups are told by their root, so ids may be missing or repeated."""
    docs, columns = _set_aside(docs, "_a", "_b")
    keyed = docs.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit("b"), "text")})
    found = simhash.near_groups(keyed, keys=("_a", "_b"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), "_a", "_b"))
    first = found.groupBy("root").agg(first.alias("first")).select("first._id", "first._a", "first._b")
    kept = keyed.join(
        first, keyed["doc_id"].eqNullSafe(first["_id"]) & (keyed["_a"] == first["_a"]) & (keyed["_b"] == first["_b"]), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", "_a", "_b"]).select(columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier string of 100; a character that is cut through goes as a
    whole, and a document of which nothing is left goes too unless it was empty before."""
    docs, columns = _set_aside(docs, "n_units", "n_removed", "n_spans", "kept")
    left = suffixdedup.suffix_dedup(docs)
    left = left.where((F.length("kept") > 0) | (F.col("n_units") == 0)).withColumn("text", _decoded(left["kept"]))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs, columns = _set_aside(docs, "leaks")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of documents by source weights, with the columns that the mixture adds."""
    return mixing.mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]

#: Learned scores and byte-wise hashes are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            space.drop(f"stage-{number - 1}")
    return docs
