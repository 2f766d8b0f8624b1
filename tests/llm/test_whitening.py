import numpy as np
import pytest

from termloom.llm import queries
from termloom.llm.whitening import below, leading, whiten

SCHEMA = "vec_id long, embedding array<float>, whitened string, id int"


def _brute(vectors, count):
    x = np.floor(1024 * np.array(vectors, dtype=float)) + 100000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    exact = [[int(v) for v in row] for row in x]
    sums = [sum(column) for column in zip(*exact)]
    deviations = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in exact]
    return centred @ parts[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviations


def _check(rows, ids, vectors, count):
    whitened, explained, deviations = _brute(vectors, count)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * count
    for c in range(count):
        own = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(own - whitened[:, c]).max(), np.abs(own + whitened[:, c]).max()) < 1e-7
        for i, d in zip(ids, deviations):
            row = got[i, c + 1]
            assert int(row["deviation"]) == d and row["n"] == len(ids)
            assert row["explained"] == pytest.approx(explained[c], rel=1e-9)
            assert row["identity_error"] < 1e-9


def test_equals_a_dense_eigensolver(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((200, 12)) @ np.diag(np.geomspace(1, 0.05, 12))
    rows = [(i, [float(np.float32(c)) for c in v], "x", i) for i, v in enumerate(vectors)]
    got = whiten(spark.createDataFrame(rows, SCHEMA), 8).collect()
    _check(got, range(200), [r[1] for r in rows], 8)


def test_query_equals_brute_force_over_the_table(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    got = queries.QUERIES["op13_whitening"](spark, path).collect()
    _check(got, [r["vec_id"] for r in table], [r["embedding"] for r in table], 8)
    assert dict(queries.QUERIES["op13_whitening"](spark, path).dtypes)["deviation"] == "bigint"


def test_odd_rows(spark):
    bad = [
        (1, None, "", 0), (2, [1.0, None], "", 0), (3, [float("nan"), 1.0], "", 0), (4, [float("inf"), 1.0], "", 0),
    ]
    good = [(5, [0.0, 0.0], "", 0), (5, [1.0, 2.0], "", 0), (None, [3.0, 1.0], "", 0), (7, [1.0, 2.0], "", 0), (9, [], "", 0)]
    got = whiten(spark.createDataFrame(bad + good, SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == sorted((i, c) for i in (5, 5, -1, 7) for c in (1, 2))
    assert {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], "", 0)], [(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], [(1, None, "", 0)]])
def test_no_variance_gives_no_rows(spark, rows):
    assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_dimensions_are_fitted_apart_and_large_entries_stay_exact(spark):
    rng = np.random.default_rng(5)
    two, three = rng.standard_normal((20, 2)) * 2.0**38, rng.standard_normal((30, 3))
    rows = [(i, [float(np.float32(c)) for c in v], "", 0) for i, v in enumerate([*two, *three])]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    first = [r for r in got if r["vec_id"] < 20]
    assert {r["n"] for r in first} == {20} and {r["n"] for r in got if r["vec_id"] >= 20} == {30}
    exact = _brute([r[1] for r in rows[:20]], 2)[2]
    assert all(int(r["deviation"]) == exact[r["vec_id"]] for r in first if exact[r["vec_id"]] < 10**38)


def test_beyond_the_largest_float_is_held(spark):
    rows = [(1, [3.0e38, 1.0], "", 0), (2, [-3.0e38, 2.0], "", 0), (3, [0.0, 4.0], "", 0)]
    assert len(whiten(spark.createDataFrame(rows, SCHEMA)).collect()) >= 3


def test_counts_and_ties_of_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    values = np.array([9, 9, 9, 5, 5 - 1e-9, 1, 0.5, 1e-6] + [0.0] * 22)
    m = (q * values) @ q.T
    m = (m + m.T) / 2
    for shift in (-1, 0.2, 0.7, 3, 6, 10):
        assert below(m, shift) == (values < shift).sum()
    got, vectors = leading(m, 8)
    assert np.allclose(got, values[:8], rtol=1e-8, atol=1e-13)
    assert np.allclose(vectors @ vectors.T, np.eye(8), atol=1e-9)
    assert np.abs(m @ vectors.T - vectors.T * got).max() < 1e-12
    indefinite = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert below(indefinite, 0.0) == 1
