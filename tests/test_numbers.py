import math
import random
import statistics

from pyspark.sql import functions as F

from termloom.functions.numbers import exact_mean, round_exact, rounded_mean


def test_round_is_pythons_round(column):
    rng = random.Random(3)
    values = [2.675, 1.115, 1.005, 50.125, 0.125, 0.375, 0.005, -2.675, -0.125, 0.0, 2.5, 1e12 + 0.125]
    values += [rng.uniform(-1000, 1000) for _ in range(5000)]
    values += [rng.randrange(0, 10**7) / 1000 for _ in range(5000)]
    values += [rng.randrange(0, 2**40) / 2**rng.randrange(1, 12) for _ in range(3000)]
    values += [math.nextafter(k / 200, d) for k in range(1, 2000, 2) for d in (0, 1e9)]
    values += [rng.uniform(2**44, 2**48) for _ in range(500)] + [1e300]
    found = column(values, round_exact(F.col("v")), "double")
    assert [f for f in zip(values, found) if round(f[0], 2) != f[1]] == []


def test_round_keeps_nan_and_null(column):
    nan, null = column([float("nan"), None], round_exact(F.col("v")), "double")
    assert math.isnan(nan) and null is None


def test_mean_does_not_depend_on_order(spark):
    rng = random.Random(5)
    values = [rng.randrange(0, 10**6) / 100 for _ in range(5000)]
    expected = statistics.fmean(values)
    for shuffled in (sorted(values), sorted(values, reverse=True)):
        rows = spark.createDataFrame([(v,) for v in shuffled], "v double").repartition(7)
        assert rows.agg(exact_mean(F.col("v"))).first()[0] == expected


def test_mean_of_values_off_the_grid_is_whole(spark):
    values = [0.123456, 7.000001, 2.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert math.isclose(rows.agg(exact_mean(F.col("v"))).first()[0], sum(values) / 3, rel_tol=1e-15)


def test_mean_skips_missing_and_nan(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "v double")
    assert rows.agg(rounded_mean(F.col("v"))).first()[0] == 1.5
    assert rows.where("v is null").agg(rounded_mean(F.col("v"))).first()[0] is None


def test_means_of_large_and_infinite_values(spark):
    mean = lambda *values: spark.createDataFrame([(v,) for v in values], "v double").agg(exact_mean(F.col("v"))).first()[0]
    assert mean(1e17, 3e17) == 2e17
    assert mean(float("inf"), 1.0) == float("inf")
    assert mean(1e10, 2.5, float("nan"), None) == (1e10 + 2.5) / 2
    assert mean(-0.05, -0.1) == -0.075
