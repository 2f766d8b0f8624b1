"""Norm-bucketed retrieval against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm.topk import top_k


def brute(rows, k):
    whole = [
        (i, [math.floor(64 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {i: v for i, v in whole if i % 20 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["unit", "mixed", "near", "large"])
def test_against_all_products(spark, shape):
    r = np.random.default_rng(4)
    n, dim = 700, 8
    if shape == "near":  # high cosines: the coordinate lists prune
        data = np.repeat(r.normal(size=(20, dim)), 35, axis=0) + r.normal(size=(n, dim)) * 0.02
    else:
        data = r.normal(size=(n, dim))
    if shape != "unit":
        data *= np.exp(r.normal(size=(n, 1)) * 2)
    else:
        data /= np.linalg.norm(data, axis=1, keepdims=True)
    if shape == "large":
        data *= 1e4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(n + i, rows[5][1]) for i in range(200)]  # copies: ties
    found = top_k(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
        F.col("vec_id") % 20 == 0,
        k=7,
        bucket_rows=50,
        query_rows=9,
    )
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (100, [inf, 0.0]),
        (120, []), (121, []), (140, [1.0]), (3, [-1.0, -1.0]), (4, [0.5, 0.1]), (None, [9.0, 9.0]), (160, [0.25, 0.5]),
    ]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>").withColumn("rank", F.lit("x"))
    found = top_k(frame, F.col("vec_id") % 20 == 0, k=3)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3)
    assert top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_random_small(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for i in range(90)]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, bucket_rows=7)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20)


def test_query_rows_of_one_id_are_ranked_together(spark):
    rows = [(20, [1.0, 0.0]), (20, [-1.0, 0.0]), (2, [0.5, 0.25]), (3, [0.25, 1.0])]
    out = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, k=3)
    found = [(x.query_id, x.rank, x.vec_id, x.score) for x in out.orderBy("rank").collect()]
    assert found == [(20, 1, 2, 2048), (20, 2, 3, 1024), (20, 3, 3, -1024)]
