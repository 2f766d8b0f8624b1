"""Whitening on the leading components of the covariance, found by spectrum slicing.

Counts, sums and centred products are sums over Spark tasks; what reaches the driver is one number per pair of
dimensions. There the leading eigenvalues are isolated one by one: the LDL' factors of the covariance less a shift have as
many negative pivots as eigenvalues lie below the shift. Rayleigh quotient iteration then converges cubically inside the
interval that holds one eigenvalue, and two more counts certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.tables import Workspace

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Scaled entries are held inside this range, beyond which doubles are no longer dense in the whole numbers.
WIDEST = 1 << 53
EPS = float(np.finfo(float).eps)
PARTS = "dim int, pos int, n long, total decimal(38,0)"
PRODUCTS = "dim int, pos int, products array<double>"
PROJECTED = "id long, dim int, n long, deviation decimal(38,0), whitened array<double>"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def entries(rows: DataFrame, id_column: str, vector_column: str, scale: float, shift: int) -> DataFrame:
    """``id, x``: whole entries floor(scale * c) + shift of the vectors that are there and finite."""
    vector = F.col(f"`{vector_column}`")

    def whole(c: Column) -> Column:
        scaled = F.lit(float(scale)) * c.cast("double")
        return F.floor(F.least(F.greatest(scaled, F.lit(float(-WIDEST))), F.lit(float(WIDEST)))).cast("long") + F.lit(shift).cast("long")

    return rows.where(finite(vector)).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.transform(vector, whole).alias("x")
    )


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A batch's vectors by dimension: dimension, places of the rows, matrix."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, values[starts[at][:, None] + np.arange(dim)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, at, x in matrices(batch, "x"):
            counts[dim] = counts.get(dim, 0) + len(at)
            whole = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            own = (x if whole else x.astype(object)).sum(axis=0).astype(object)
            totals[dim] = totals[dim] + own if dim in totals else own
    for dim, n in counts.items():
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim] * max(dim, 1), pa.int32()),
                "pos": pa.array(range(max(dim, 1)), pa.int32()),
                "n": pa.array([n] * max(dim, 1), pa.int64()),
                "total": pa.array([str(int(t)) for t in totals[dim]] or ["0"]).cast(pa.decimal128(38, 0)),
            }
        )


class Center:
    """Count and sums of the vectors of one dimension; entries less the mean with one rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.near = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) ** 2, exactly."""
        y, n = x - self.near, self.n
        high = max(int(np.abs(y).max(initial=0)), int(self.rest.max(initial=0)), 1)
        if high * high * max(1, x.shape[1]) >= 1 << 62:
            y = y.astype(object)
            return [int(t) for t in ((n * y - self.rest.astype(object)) ** 2).sum(axis=1)] if x.shape[1] else [0] * len(x)
        squares, mixed = (y * y).sum(axis=1).tolist(), (y * self.rest).sum(axis=1).tolist()
        rests = int((self.rest.astype(object) ** 2).sum()) if x.shape[1] else 0
        return [n * n * a - 2 * n * b + rests for a, b in zip(squares, mixed)]


def _products(centers: dict[int, Center], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in matrices(batch, "x"):
            d = centers[dim].centred(x)
            sums[dim] = sums.get(dim, 0) + d.T @ d
    for dim, total in sums.items():
        if dim:
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim] * dim, pa.int32()),
                    "pos": pa.array(range(dim), pa.int32()),
                    "products": pa.array(list(total), pa.list_(pa.float64())),
                }
            )


def covariance(products: DataFrame, dim: int, n: int) -> np.ndarray:
    """The tasks' centred products added up by pair of dimensions; the driver gets dim * dim numbers."""
    cells = products.where(F.col("dim") == dim).select("pos", F.posexplode("products").alias("other", "product"))
    out = np.zeros((dim, dim))
    summed = cells.where("other >= pos").groupBy("pos", "other").agg(F.sum("product").alias("product")).toPandas()
    out[summed["pos"], summed["other"]] = summed["product"] / n
    return np.triu(out) + np.triu(out, 1).T


# --- spectrum slicing ----------------------------------------------------------


def below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below a shift: the negative pivots of LDL' of the shifted matrix.

    Pivots are chosen by Bunch and Kaufman's rule, so that the factors stay bounded: single ones, or pairs.
    """
    m = matrix - shift * np.eye(len(matrix))
    n, at, negative = len(m), 0, 0
    alpha = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while at < n:
        size = 1
        if at < n - 1:
            under = np.abs(m[at + 1 :, at])
            r = at + 1 + int(under.argmax())
            most = under[r - at - 1]
            if abs(m[at, at]) < alpha * most:
                others = np.abs(m[at:, r])
                others[r - at] = 0
                widest = others.max()
                if abs(m[at, at]) * widest < alpha * most * most:
                    if abs(m[r, r]) >= alpha * widest:
                        swap(at, r)
                    else:
                        swap(at + 1, r)
                        size = 2
        pivot, rest = m[at : at + size, at : at + size], m[at + size :, at : at + size]
        if size == 1:
            negative += bool(pivot[0, 0] < 0)
        else:
            product, total = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] * pivot[1, 0], pivot[0, 0] + pivot[1, 1]
            negative += 1 if product < 0 else 2 * bool(total < 0)
        if len(rest) and rest.any():
            m[at + size :, at + size :] -= np.linalg.solve(pivot, rest.T).T @ rest.T
        at += size
    return negative


def _vector(a: np.ndarray, low: float, high: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from the middle of an interval, orthogonal to what was found before."""
    n, eye = len(a), np.eye(len(a))

    def across(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    v, shift, best = across(np.random.default_rng(seed).standard_normal(n)), (low + high) / 2, (0.0, None, np.inf)
    for step in range(24):
        try:
            w = np.linalg.solve(a - shift * eye, v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (shift + 4 * EPS) * eye, v)
        if not np.isfinite(w).all():
            break
        v = across(w / np.linalg.norm(w))
        value = float(v @ a @ v)
        off = float(np.linalg.norm(a @ v - value * v))
        if off < best[2]:
            best = value, v, off
        elif best[2] <= 16 * n * EPS:
            break
        if step:  # the first two solutions are taken at the middle, which lies next to the wanted eigenvalue
            shift = value
    return best


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as rows.

    Eigenvalues that are zero to double precision are left out. Inside a group of equal ones the vectors are any
    orthogonal ones of their space.
    """
    n, scale = len(matrix), float(np.trace(matrix))
    found = np.zeros((0, n))
    if not n or not scale > 0:
        return np.zeros(0), found
    a = matrix / scale
    nothing, narrow = 4 * n * EPS, 4 * n * EPS
    above = {1 + nothing: 0}  # shift -> eigenvalues above it

    def count_above(shift: float) -> int:
        if shift not in above:
            above[shift] = n - below(a, shift)
        return above[shift]

    values: list[float] = []
    for number in range(1, min(count, count_above(nothing)) + 1):
        for attempt in range(80):
            low = max(s for s, k in above.items() if k >= number)
            high = min(s for s, k in above.items() if k < number)
            alone = above[low] == number and above[high] == number - 1
            if alone or high - low <= narrow:
                value, vector, off = _vector(a, low, high, found, number)
                slack = max(off, narrow)
                # the counts beside the value certify its number
                if vector is not None and off <= 64 * n * EPS and count_above(value - slack) >= number and count_above(value + slack) < number:
                    values.append(value)
                    found = np.vstack([found, vector])
                    break
                if high - low <= narrow:
                    raise ArithmeticError(f"eigenvalue {number} did not converge")
                low = max(s for s, k in above.items() if k >= number)
                high = min(s for s, k in above.items() if k < number)
            count_above((low + high) / 2)
        else:
            raise ArithmeticError(f"eigenvalue {number} was not isolated")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale, found[order]


# --- whitening -------------------------------------------------------------------


def _projected(
    centers: dict[int, Center], spectra: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, at, x in matrices(batch, "x"):
            values, vectors = spectra[dim]
            center = centers[dim]
            whitened = center.centred(x) @ (vectors / np.sqrt(values)[:, None]).T if len(values) else np.zeros((len(at), 0))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(pa.array(at)),
                    "dim": pa.array(np.full(len(at), dim, np.int32)),
                    "n": pa.array(np.full(len(at), center.n)),
                    "deviation": pa.array([str(t) if t < 10**38 else None for t in center.deviations(x)], pa.string()).cast(pa.decimal128(38, 0)),
                    "whitened": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(values)), pa.array(whitened.ravel())
                    ),
                }
            )


def _identity_error(projected: DataFrame, count: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all dimensions."""
    w = [F.get("whitened", F.lit(i)) for i in range(count)]
    entries_ = [
        F.abs(F.covar_pop(w[i], w[j]) - F.lit(1.0 if i == j else 0.0)) for i in range(count) for j in range(i, count)
    ]
    by_dim = projected.groupBy("dim").agg(F.greatest(*entries_, F.lit(0.0)).alias("error"))
    return by_dim.agg(F.max("error")).first()[0]


def whiten(
    rows: DataFrame,
    count: int = COMPONENTS,
    scale: float = SCALE,
    shift: int = SHIFT,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component.

    Rows whose vector is missing or holds missing or non-finite entries are left out; all others are the fit list, copies
    and rows with a missing or repeated id included, and each of them has its own result rows. Scaled entries are held
    within 2**53. Vectors of different dimensions are fitted apart, each among those of its dimension, while
    ``identity_error`` is the largest of all. Components whose variance is zero have no rows, so a single vector, equal
    vectors and an empty table give none. ``deviation`` is a decimal(38,0), missing
    where it has more digits. Other columns are not looked at.
    """
    if count < 1:
        raise ValueError("at least one component")
    space = Workspace(rows.sparkSession, "whitening")
    x = entries(rows, id_column, vector_column, scale, shift)
    parts = x.mapInArrow(_sums, PARTS).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    counts = {row["dim"]: row["n"] for row in parts}
    sums: dict[int, list[int]] = {dim: [0] * dim for dim in counts}
    for row in parts:
        if row["dim"]:
            sums[row["dim"]][row["pos"]] = int(row["total"])
    centers = {dim: Center(n, sums[dim]) for dim, n in counts.items()}
    products = space.save(x.mapInArrow(partial(_products, centers), PRODUCTS), "products")
    spectra, explained = {}, {}
    for dim, n in counts.items():
        matrix = covariance(products, dim, n)
        spectra[dim] = leading(matrix, count)
        explained[dim] = (spectra[dim][0] / np.trace(matrix)).tolist() if len(spectra[dim][0]) else []
    space.drop("products")
    projected = space.save(x.mapInArrow(partial(_projected, centers, spectra), PROJECTED), "projected")
    shares = F.lit(None).cast("array<double>")
    for dim, share in explained.items():
        shares = F.when(F.col("dim") == dim, F.array(*[F.lit(float(s)) for s in share]).cast("array<double>")).otherwise(shares)
    error = _identity_error(projected, count)
    return projected.select(
        "id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("at", "w")
    ).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("w.whitened").alias("whitened"),
        F.col("w.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
