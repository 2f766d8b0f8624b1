import numpy as np
import pytest

from termloom.llm import queries
from termloom.llm.quantised import likely_reach, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, node int, kept string, list string"


def _brute(ids, vectors, cosine=0.95):
    """Links and smallest reachable ids by all pairs."""
    n = len(ids)
    links = [set() for _ in range(n)]
    usable = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()] - seen:
                seen.add(j)
                open_.append(j)
        least = min((ids[j] for j in seen if ids[j] is not None), default=None)
        out.append((ids[i], len(links[i]), least, ids[i] is not None and ids[i] == least))
    return sorted(out, key=str)


def _got(rows):
    return sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows.collect()], key=str)


def _frame(spark, ids, vectors):
    return spark.createDataFrame(
        [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, "x", "y") for i, v in zip(ids, vectors)], SCHEMA
    )


def _planted(rng, n, dim=64):
    """Unstructured vectors, some with near copies at cosines around the threshold, some with exact or longer copies."""
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    out = list(base)
    for i in range(0, n, 4):
        for size in (0.1, 0.3, 0.33, 0.36):
            noise = rng.standard_normal(dim)
            out.append(base[i] + size * noise / np.linalg.norm(noise))
    out += [base[0]] * 5 + [base[1] * 3.0] * 2
    return [np.float32(v) for v in out]


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    want = _brute([r["vec_id"] for r in table], [r["embedding"] for r in table])
    assert _got(queries.QUERIES["op12_near_embeddings"](spark, path)) == want


@pytest.mark.parametrize("reach", [None, 1.0])
def test_many_lists_and_small_tiles_lose_no_link(spark, reach):
    vectors = _planted(np.random.default_rng(11), 300)
    ids = list(range(len(vectors)))
    got = near_duplicates(_frame(spark, ids, vectors), reach=reach, list_rows=25, tile_members=16, tile_queries=24, words=32)
    assert _got(got) == _brute(ids, vectors)


def test_one_dense_group_and_a_chain(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    dense = [centre + 0.01 * rng.standard_normal(8) for _ in range(150)]
    turns = np.arange(60) * 0.25  # neighbours are linked, others not
    chain = [np.array([np.cos(t), np.sin(t), 0, 0, 0, 0, 0, 0]) for t in turns[:12]]
    vectors = [np.float32(v) for v in dense + [dense[0]] * 50 + chain]
    ids = [7 * i for i in range(len(vectors))][::-1]
    got = near_duplicates(_frame(spark, ids, vectors), list_rows=20, tile_members=16, tile_queries=32)
    assert _got(got) == _brute(ids, vectors)


def test_odd_rows(spark):
    ids = [1, 2, 3, 4, 5, 6, 6, None, None, 9, 10, 11, None]
    vectors = [
        None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [-5.0, 1.0],
        [float("inf"), 1.0], [1.0, 2.0, 3.0], [2.0e38, 4.0e38], None,
    ]
    vectors[-2] = [1.0e38, 2.0e38]
    assert _got(near_duplicates(_frame(spark, ids, vectors))) == _brute(ids, vectors)


def test_doubles_beyond_their_squares(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [-1e200, 2e200])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert _got(got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_reach_follows_the_dimensions_in_use():
    rng = np.random.default_rng(4)
    assert likely_reach(rng.standard_normal((2000, 64))) == pytest.approx(0.5, abs=0.02)
    assert likely_reach(np.pad(rng.standard_normal((100, 3)), ((0, 0), (0, 61)))) == 1.0
    assert likely_reach(np.ones((1, 64))) == 1.0


def test_empty_table(spark):
    assert near_duplicates(_frame(spark, [], [])).collect() == []
