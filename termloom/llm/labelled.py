"""Bounded samples of labelled documents, and the logistic function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a missing id."""
    return F.crc32(F.col(id_column).cast("string")) % folds


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label``: the larger label of repeated rows; rows without id or label are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return rows.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled(rows: DataFrame, per_label: int, *keys: str) -> DataFrame:
    """At most ``per_label`` rows of each label, those of smallest hashed id (or hashed ``keys``): a bounded sample for fitting.

    The rows of a label are first cut down within salted groups, so no window holds a whole label.
    """
    keys = keys or ("doc_id",)
    dealt = rows.withColumn("_order", F.xxhash64(F.lit("sample"), *keys)).withColumn("_salt", F.pmod("_order", F.lit(64)))
    for group in (["label", "_salt"], ["label"]):
        within = Window.partitionBy(*group).orderBy("_order", *keys)
        dealt = dealt.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_label)
    return dealt.drop("_order", "_salt", "_n")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))
