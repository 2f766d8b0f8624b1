"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are sorted by length and cut to buckets of bounded size. A first pass takes for each query
the k best of its starting bucket, which bounds its result from below. In every other bucket the
bound divided by the query's and the bucket's largest length is a local cosine threshold: above one
the bucket is skipped; if high, candidates must lie in the feasible interval of the query's largest
coordinate, found in a sorted coordinate list; otherwise only the prefix of long enough vectors is kept.
What is left is verified by whole products. The queries are a stated set, dealt in blocks to every bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.repeats import whole_groups
from termloom.llm.tables import Workspace

BUCKET_ROWS, QUERY_ROWS = 8192, 1024
#: Local cosine thresholds from which a coordinate's interval prunes enough to be looked up.
COORDINATE_FROM = 0.9
PACKED = "dim int, bucket long, ids binary, data binary, lengths binary"
FOUND = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``id, v, dim, norm2``: each component x as floor(scale * x); vectors with a missing or
    non-finite component, missing vectors and rows without an id are left out."""
    floored = F.transform(vector_column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(
        vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    kept = rows.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite)
    return kept.select(F.col(id_column).cast("long").alias("id"), floored.alias("v")).select(
        "id",
        "v",
        F.size("v").alias("dim"),
        F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("norm2"),
    )


def _packed(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's vectors, longest first, in runs of one dimension and at most ``rows`` rows."""
    for table in whole_groups(batches, "dim", rows):
        dims = table.column("dim").to_numpy()
        edges = np.flatnonzero(np.append(True, np.diff(dims) != 0)).tolist() + [len(dims)]
        for low, high in zip(edges[:-1], edges[1:]):
            for at in range(low, high, rows):
                part = table.slice(at, min(rows, high - at)).combine_chunks()
                vectors = part.column("v").combine_chunks().flatten().to_numpy()
                norm2 = part.column("norm2").to_numpy()
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array([int(dims[at])], pa.int32()),
                        "bucket": pa.array([0], pa.int64()),
                        "ids": [part.column("id").to_numpy().tobytes()],
                        "data": [np.ascontiguousarray(vectors).tobytes()],
                        # a little more, so that rounding never prunes what belongs
                        "lengths": [(np.sqrt(norm2) * (1 + 1e-9)).tobytes()],
                    }
                )


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Buckets of vectors of like length; equal lengths are split by id, so copies fill several buckets."""
    return (
        vectors.repartitionByRange("dim", F.col("norm2").desc(), "id")
        .sortWithinPartitions("dim", F.col("norm2").desc(), "id")
        .mapInArrow(partial(_packed, rows), PACKED)
        .withColumn("bucket", F.monotonically_increasing_id())
    )


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact products: in doubles where every sum stays below 2**53, else in integers."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores without the query's own row, ties to smaller ids."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        floor = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= floor]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _search(k: int, first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, dim = np.frombuffer(row["ids"], np.int64), row["dim"]
            data = np.frombuffer(row["data"], np.int64).reshape(len(ids), dim)
            lengths = np.frombuffer(row["lengths"], np.float64)
            q_ids = np.frombuffer(row["q_ids"], np.int64)
            q = np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), dim)
            q_lengths = np.frombuffer(row["q_lengths"], np.float64)
            bound = np.full(len(q_ids), -np.inf) if first else np.frombuffer(row["bounds"], np.float64)
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            # the local threshold: what cosine would reach the bound with the bucket's longest vector
            top = q_lengths * lengths[0]
            local = np.where(top > 0, bound / np.where(top > 0, top, 1), np.where(bound > 0, np.inf, -np.inf))
            open_ = np.flatnonzero(local <= 1)
            by_coordinate = open_[local[open_] >= COORDINATE_FROM]
            by_length = open_[local[open_] < COORDINATE_FROM]
            # length pruning: a prefix of the bucket, one product for all queries of like prefixes
            for at in range(0, len(by_length), 256):
                some = by_length[at : at + 256]
                least = np.where(bound[some] > 0, bound[some] / np.maximum(q_lengths[some], 1e-300), -1.0)
                prefix = int(np.searchsorted(-lengths, -least.min(), "right"))
                scores = _products(q[some], data[:prefix])
                for i, own in zip(some.tolist(), scores):
                    keep = np.flatnonzero(own >= bound[i])
                    best = keep[_best(own[keep], ids[keep], q_ids[i], k)]
                    found.append((i, best, own[best]))
            if len(by_coordinate):
                unit = data / np.maximum(lengths, 1e-300)[:, None]
                lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for i in by_coordinate.tolist():
                    f = int(np.abs(q[i]).argmax())
                    if f not in lists:
                        order = unit[:, f].argsort()
                        lists[f] = order, unit[order, f]
                    order, sorted_f = lists[f]
                    # cosine >= t needs |angle to axis f of p - that of q| <= arccos t
                    angle = np.arccos(np.clip(q[i, f] / q_lengths[i], -1, 1))
                    reach = np.arccos(np.clip(local[i], -1, 1)) + 1e-7
                    low = np.cos(min(np.pi, angle + reach)) - 1e-7
                    high = np.cos(max(0.0, angle - reach)) + 1e-7
                    some = order[np.searchsorted(sorted_f, low) : np.searchsorted(sorted_f, high, "right")]
                    own = _products(q[i : i + 1], data[some])[0]
                    keep = np.flatnonzero(own >= bound[i])
                    best = keep[_best(own[keep], ids[some][keep], q_ids[i], k)]
                    found.append((i, some[best], own[best]))
            sizes = [len(places) for _, places, _ in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(np.repeat(q_ids[[i for i, _, _ in found]], sizes).astype(np.int64)),
                    "vec_id": pa.array(np.concatenate([ids[x] for _, x, _ in found] or [ids[:0]])),
                    "score": pa.array(np.concatenate([s for _, _, s in found] or [ids[:0]]).astype(np.int64)),
                }
            )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    bucket_rows: int = BUCKET_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer products over all other rows.

    Components are floor(scale * x); ties go to smaller ids; fewer rows give fewer results. Vectors
    are compared within their dimension. Rows that share an id are separate candidates, but none for
    a query of that id. Query rows that share an id are one query: the products of all of them are ranked together, so a candidate
    can come once for each. Products have to fit into a long.
    """
    if k < 1:
        raise ValueError("k is at least one")
    space = Workspace(rows.sparkSession, "topk")
    vectors = space.save(whole_vectors(rows, id_column, vector_column, scale), "vectors")
    chosen = rows.where(is_query & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id")).distinct()
    buckets = space.save(packed(vectors, bucket_rows), "buckets")
    blocks = space.save(
        packed(vectors.join(chosen, "id", "left_semi"), query_rows).select(
            "dim", F.col("bucket").alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
            F.col("lengths").alias("q_lengths"),
        ),
        "blocks",
    )
    # every block meets every bucket of its dimension, as the query set is against all rows
    starting = buckets.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    opening = blocks.join(starting, "dim").join(buckets, ["dim", "bucket"]).repartition("block")
    opened = space.save(_ranked(opening.mapInArrow(partial(_search, k, True), FOUND), k), "opened")
    bounds = (
        opened.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound"))
    )
    bounded = space.save(_with_bounds(blocks, bounds), "bounded")
    pairs = (
        bounded.join(buckets.join(starting, ["dim", "bucket"], "left_anti"), "dim")
        .repartition("block", "bucket")
        .mapInArrow(partial(_search, k, False), FOUND)
    )
    return _ranked(pairs.unionByName(opened.drop("rank")), k).select("query_id", "rank", "vec_id", "score")


def _with_bounds(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Blocks with each query's lower bound; a query with fewer than k results so far has none."""

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("id").to_pylist(), right.column("bound").to_pylist()))
        packed_bounds = [
            np.array([known.get(i, -np.inf) for i in np.frombuffer(x, np.int64).tolist()]).tobytes()
            for x in left.column("q_ids").to_pylist()
        ]
        return left.append_column("bounds", pa.array(packed_bounds, pa.binary()))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(np.frombuffer(x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block)), pa.array(own)], ["block", "id"]
                )

    of_block = blocks.select("block", "q_ids").mapInArrow(ids, "block long, id long").join(bounds, "id")
    return (
        blocks.groupBy("block")
        .cogroup(of_block.groupBy("block"))
        .applyInArrow(attach, "dim int, block long, q_ids binary, q_data binary, q_lengths binary, bounds binary")
    )
