"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, exact cosine rerank.

Unit vectors are dealt to the coarse list of their nearest centre; what is left of them is coded by one word per
subspace. A query goes to every list whose bisecting plane with its own list lies within a share (``reach``) of the
largest distance two linked unit vectors can have; a share of 1 loses nothing whatever the data, and the default follows from
the number of dimensions that the vectors really spread over. There its distances to all codes come from tables of its distances to
the words. A vector's distance to its code is stored with it, so the triangle inequality bounds its true distance from
below and no candidate is lost to the codes. What is left is verified by the cosine in doubles.

Exact copies are one node with a count, so they are never compared. Lists are cut into tiles of bounded size, and a tile
gives a count per query and one link per linked vector to the root of its tree, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import components
from termloom.llm.tables import Workspace
from termloom.llm.whitening import finite, matrices

#: Rows of the sample that centres and words are fitted on, by the order of a hash.
FIT_ROWS = 8192
SUBSPACES, WORDS = 8, 256
#: Vectors a list should hold; there is one list per 8 rows of the sample at most.
LIST_ROWS = 1024
#: Standard deviations of a random direction's part along a given one, up to which bisecting planes count as near.
DEVIATIONS = 4.0
TILE_MEMBERS, TILE_QUERIES = 4096, 8192
CODED = "node long, copies long, list int, v binary, code binary, off double, probes array<int>"
FOUND = "node long, n long, root long"


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; the rows come in the order of a hash."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        order = near.argsort(kind="stable")
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        centres[full] = np.add.reduceat(x[order], starts, axis=0) / counts[full, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def likely_reach(sample: np.ndarray, deviations: float = DEVIATIONS) -> float:
    """Share of a difference's length that its part along one direction exceeds only beyond ``deviations``.

    That part has the standard deviation 1 / sqrt(n) in n dimensions; n is the participation ratio of the sample's
    variances, so vectors in few real dimensions are searched without loss.
    """
    centred = sample - sample.mean(axis=0)
    spread = centred.T @ centred
    total = float((spread * spread).sum())
    return min(1.0, deviations / max(1.0, float(np.trace(spread)) ** 2 / total) ** 0.5) if total > 0 else 1.0


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors in doubles, each times a power of two, so that squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


class Index:
    """Centres of the coarse lists and, per subspace, the words of what is left; ``first`` numbers the lists."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, words: int, first: int, reach: float | None):
        dim = sample.shape[1]
        self.first = first
        self.reach = likely_reach(sample) if reach is None else reach
        self.centres = _centres(sample, lists)
        left = sample - self.centres[_nearest(sample, self.centres)]
        edges = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int).tolist()
        self.slices = list(zip(edges[:-1], edges[1:]))
        self.books = [_centres(left[:, a:b], min(words, len(sample))) for a, b in self.slices]

    def coded(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes and the vectors' distances to their codes."""
        near = _nearest(u, self.centres)
        left = u - self.centres[near]
        codes = np.stack([_nearest(left[:, a:b], book) for (a, b), book in zip(self.slices, self.books)], axis=1)
        kept = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return near, codes.astype(np.uint8), np.sqrt(((left - kept) ** 2).sum(axis=1))

    def probes(self, u: np.ndarray, near: np.ndarray, largest: float) -> list[np.ndarray]:
        """Per vector the lists whose bisecting plane with its own list is no farther than the reach of ``largest``."""
        c, within = self.centres, self.reach * largest
        far = (c * c).sum(axis=1) - 2 * u @ c.T
        apart = np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c @ c.T, 0))
        margin = (far - far[np.arange(len(u)), near][:, None]) / 2 <= within * apart[near] + 1e-12
        margin[np.arange(len(u)), near] = True
        return [np.flatnonzero(row) + self.first for row in margin]

    def distances(self, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries, less the centre, to codes: sums over tables of distances to the words."""
        out = np.zeros((len(left), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.slices, self.books)):
            part = left[:, a:b]
            table = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * part @ book.T
            out += np.take(table.astype(np.float32), codes[:, m], axis=1)
        return out


def _coder(model: Broadcast, largest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in matrices(batch, "v"):
                index, at_ = model.value[dim], pa.array(at)
                u = unit(v)
                near, codes, off = index.coded(u)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": batch.column("node").take(at_),
                        "copies": batch.column("copies").take(at_),
                        "list": pa.array((near + index.first).astype(np.int32)),
                        "v": pa.array([row.tobytes() for row in np.ascontiguousarray(v)], pa.binary()),
                        "code": pa.array([row.tobytes() for row in np.ascontiguousarray(codes)], pa.binary()),
                        "off": pa.array(off),
                        "probes": pa.array(index.probes(u, near, largest), pa.list_(pa.int32())),
                    }
                )

    return run


def _cosines(v: np.ndarray, norm2: np.ndarray, w: np.ndarray, other2: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, w) / np.sqrt(norm2 * other2)


class _Trees:
    """Trees over a tile's members, joined by the queries that link to several of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, queries: np.ndarray, members: np.ndarray) -> None:
        """Links sorted by query: all members of a query get one root."""
        starts = np.flatnonzero(np.append(True, queries[1:] != queries[:-1]))
        sizes = np.diff(np.append(starts, len(queries)))
        while True:
            own = self.root[members]
            least = np.repeat(np.minimum.reduceat(own, starts), sizes)
            if (own == least).all():
                return
            np.minimum.at(self.root, own, least)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _tiler(model: Broadcast, cosine: float, dtype: str) -> Callable[[pa.Table], pa.Table]:
    largest = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(tile: pa.Table) -> pa.Table:
        asks = tile.column("query").to_numpy()
        number = tile.column("list")[0].as_py()
        node = tile.column("node").to_numpy()
        q_node, x_node = node[asks], node[~asks]
        none = pa.table({name: pa.array([], pa.int64()) for name in ("node", "n", "root")})
        if not len(q_node) or not len(x_node):
            return none
        vectors = tile.column("v").combine_chunks()
        raw = np.frombuffer(b"".join(vectors.to_pylist()), dtype).reshape(len(node), -1)
        index: Index = model.value[raw.shape[1]]
        held = scaled(raw)
        norm2 = (held * held).sum(axis=1)
        q, x, q2, x2 = held[asks], held[~asks], norm2[asks], norm2[~asks]
        mine = tile.filter(pa.array(~asks))
        codes = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        copies = mine.column("copies").to_numpy()
        bound = ((largest + mine.column("off").to_numpy() + 1e-4) ** 2).astype(np.float32)
        left = q / np.sqrt(q2)[:, None] - index.centres[number - index.first]
        trees, counts, some, linked = _Trees(len(x)), np.zeros(len(q), np.int64), np.full(len(q), -1), np.zeros(len(x), bool)
        step = max(1, (1 << 20) // len(x))
        for at in range(0, len(q), step):
            rows, cols = np.nonzero(index.distances(left[at : at + step], codes) <= bound)
            rows += at
            keep = q_node[rows] != x_node[cols]
            rows, cols = rows[keep], cols[keep]
            near = [
                _cosines(q[r], q2[r], x[c], x2[c]) >= cosine
                for r, c in ((rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]) for i in range(0, len(rows), 1 << 16))
            ]
            if near:
                keep = np.concatenate(near)
                rows, cols = rows[keep], cols[keep]
            if len(rows):
                np.add.at(counts, rows, copies[cols])
                some[rows], linked[cols] = cols, True
                trees.join(rows, cols)
        asked, members = some >= 0, np.flatnonzero(linked & (trees.root != np.arange(len(x))))
        return pa.table(
            {
                "node": np.concatenate([q_node[asked], x_node[members]]),
                "n": np.concatenate([counts[asked], np.zeros(len(members), np.int64)]),
                "root": np.concatenate([x_node[trees.root[some[asked]]], x_node[trees.root[members]]]),
            }
        )

    return run


def _fitted(
    nodes: DataFrame, reach: float | None, fit_rows: int, list_rows: int, subspaces: int, words: int
) -> dict[int, Index]:
    """One index per dimension, fitted on at most ``fit_rows`` vectors of it."""
    models: dict[int, Index] = {}
    first = 0
    for row in nodes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        picked = nodes.where(F.size("v") == row["dim"]).orderBy(F.xxhash64("h1", "h2")).limit(fit_rows).select("v").toArrow()
        sample = unit(picked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, row["dim"]))
        lists = max(1, min(round(row["count"] / list_rows), len(sample) // 8))
        models[row["dim"]] = Index(sample, lists, subspaces, words, first, reach)
        first += lists
    return models


def near_duplicates(
    rows: DataFrame,
    cosine: float = 0.95,
    reach: float | None = None,
    fit_rows: int = FIT_ROWS,
    list_rows: int = LIST_ROWS,
    subspaces: int = SUBSPACES,
    words: int = WORDS,
    tile_members: int = TILE_MEMBERS,
    tile_queries: int = TILE_QUERIES,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of the table.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest id reachable by
    links. Vectors that are missing, empty, all zero, or hold missing or non-finite components link with nothing, and
    vectors of different dimensions not with each other. Repeated ids are rows of their own, each with its result. A row with a missing
    id takes part like any other but names no component: ``component_id`` is the smallest id that is there, missing
    if there is none, and ``kept`` is false for a missing id. Equal vectors are told by 128 bits of hash. An empty table gives no rows. Other columns are not looked at.
    Above 256 ``words`` no longer fit a code's byte.
    """
    if not 0 < cosine <= 1 or not 1 <= words <= 256:
        raise ValueError("a cosine above 0 and up to 1, and 1 to 256 words")
    spark = rows.sparkSession
    space = Workspace(spark, "quantised")
    vector = F.col(f"`{vector_column}`")
    dtype, kind = ("float32", "array<float>") if dict(rows.dtypes)[vector_column] == "array<float>" else ("float64", "array<double>")
    usable = finite(vector) & F.exists(vector, lambda c: c != 0)
    v = F.when(usable, vector.cast(kind))
    numbered = space.save(
        rows.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v"),
            F.when(usable, F.xxhash64(v)).alias("h1"), F.when(usable, F.xxhash64(F.lit("second"), v)).alias("h2"),
        ),
        "rows",
    )
    copies = (
        numbered.where("h1 is not null").groupBy("h1", "h2")
        .agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    )
    nodes = space.save(copies.join(numbered.select(F.col("row").alias("node"), "v"), "node"), "nodes")
    model = spark.sparkContext.broadcast(_fitted(nodes, reach, fit_rows, list_rows, subspaces, words))
    largest = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    coded = space.save(nodes.select("node", "copies", "v").mapInArrow(_coder(model, largest), CODED), "coded")
    # a list is cut into tiles by the numbers of its members and its queries, both as many as there are lists
    members = coded.groupBy("list").agg(F.count(F.lit(1)).alias("members"))
    queries = coded.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
    sizes = members.join(queries, "list").select(
        "list", F.ceil(F.col("members") / tile_members).cast("int").alias("parts"), F.ceil(F.col("queries") / tile_queries).cast("int").alias("asking")
    )
    spread = F.xxhash64("node")
    held = coded.join(sizes, "list").select(
        "list", F.pmod(spread, "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("ask"),
        F.lit(False).alias("query"), "node", "copies", "v", "code", "off",
    )
    asked = coded.select(F.explode("probes").alias("list"), "node", "v").join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(spread, "asking").cast("int").alias("ask"),
        F.lit(True).alias("query"), "node", F.lit(0).cast("long").alias("copies"), "v", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("off"),
    )
    tiles = held.unionByName(asked).groupBy("list", "part", "ask")
    found = space.save(tiles.applyInArrow(_tiler(model, cosine, dtype), FOUND), "found")
    space.drop("coded")
    links = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    joined = components(links, space)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    told = (
        nodes.select("node", "copies", "least", "h1", "h2").join(counts, "node", "left").join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    told = space.save(told, "told")
    space.drop("found", "nodes")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = told.join(least, "component").select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    return (
        numbered.select("vec_id", "h1", "h2").join(of_node, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
