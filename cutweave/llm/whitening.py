"""Embedding whitening by shifted CholeskyQR. Each pass takes, in Spark, the Gram matrix of the centred rows after the
triangular solves of the passes before, and factors it; the first factor is shifted, so that it exists for rows of any
condition. The composed factors R have the rows' singular values and right vectors, which one SVD of R gives.

Only matrices of dimensions squared come to the driver. Rows are never written: a pass solves with the factors so far
while it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import carried, released, values, with_fields

COMPONENTS, PASSES = 32, 3
#: x = floor(SCALE * c) + OFFSET. Entries of LARGEST or more have no x that fits a long.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**56
_EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """What ``fit_whitening`` has found. ``sums``: Python ints. ``factors``: R of each pass. ``components``: columns."""

    dim: int
    n: int
    sums: list[int]
    factors: list[np.ndarray]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def _entries(batch: pa.RecordBatch, path: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch have a usable vector, and their x as longs."""
    lists = values(batch, path)
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    rows = np.flatnonzero(length == dim)
    c = flat[begin[rows, None] + np.arange(dim)]
    fine = (np.abs(c) < LARGEST).all(axis=1)  # false for what isn't finite, too
    return rows[fine], np.floor(SCALE * c[fine]).astype(np.int64) + OFFSET


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python ints."""
    if x.size and (int(np.abs(x).max()) + 1) * n >= 2**61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y R^-1, a column at a time."""
    q = np.empty_like(y)
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _counts(rows: DataFrame, path: str) -> tuple[int, int, list[int]]:
    """Dimensions, usable rows and exact sums. Vectors have as many dimensions as most have (ties: more)."""
    lengths = rows.where(f"{path} is not null").groupBy(F.size(path).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    if not dim:
        return 0, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dim, object)
        for batch in batches:
            _, x = _entries(batch, path, dim)
            n += len(x)
            for lo in range(0, len(x), 64):  # so few of the largest fit a long
                s += x[lo : lo + 64].sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(v) for v in s])], names=["i", "n", "s"])

    found = rows.mapInArrow(run, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return dim, found[0]["n"] or 0, [int(r["s"]) for r in found]


def _gram(rows: DataFrame, path: str, dim: int, made: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the rows of the outer products of what ``made`` makes of their x. A task adds up its own rows; Spark adds
    the tasks' entries up."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for batch in batches:
            _, x = _entries(batch, path, dim)
            y = made(x)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(g[upper])], names=["i", "j", "g"])

    found = rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    g = np.zeros((width, width))
    g[found["i"], found["j"]] = g[found["j"], found["i"]] = found["g"]
    return g


def _factor(g: np.ndarray, shift: float) -> np.ndarray:
    """R of the Gram matrix, shifted by ``shift``; by more where rounding leaves it indefinite."""
    eye, least = np.eye(len(g)), 11 * len(g) * (len(g) + 1) * _EPS * max(np.trace(g), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(g + shift * eye).T.copy()
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def _centred(x: np.ndarray, n: int, sums: list[int], factors: list[np.ndarray]) -> np.ndarray:
    y = _deviations(x, n, sums).astype(float) / n
    for r in factors:
        y = _solve(y, r)
    return y


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The principal components of the vectors of all rows of ``rows``, and how far from the identity the covariance of
    what they whiten is.

    The rows that take part are those whose vector is not null, has no null, NaN, infinite or too large entry (LARGEST),
    and has as many dimensions as most vectors have. An eigenvalue that is 0 to double precision has a component, but
    nothing can be whitened by it. Without rows there are no components.
    """
    only = rows.select(F.col(vector).alias("v"))
    dim, n, sums = _counts(only, "v")
    if not n:
        return Whitening(dim, 0, sums, [], np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        g = _gram(only, "v", dim, lambda x, done=tuple(factors): _centred(x, n, sums, done), dim)
        factors.append(_factor(g, 0.0 if k else 11 * (n * dim + dim * (dim + 1)) * _EPS * float(np.linalg.norm(g, 2))))
    r = np.eye(dim)
    for f in factors:
        r = f @ r
    _, sigma, vt = np.linalg.svd(r)
    sigma = np.where(sigma > 10 * dim * _EPS * sigma[0], sigma, 0.0)
    e = sigma**2 / n
    total = e.sum()
    m = min(components, dim)
    model = Whitening(dim, n, sums, factors, e[:m], vt[:m].T.copy(), e[:m] / total if total else e[:m])
    used = int((model.eigenvalues > 0).sum())
    if used:
        covariance = _gram(only, "v", dim, lambda x: whitened(x, model)[:, :used], used) / n
        model.identity_error = float(np.abs(covariance - np.eye(used)).max())
    return model


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Centred x, projected on the components, over the eigenvalues' roots; NaN where an eigenvalue is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.eigenvalues > 0, 1 / np.sqrt(model.eigenvalues), np.nan)
    return _centred(x, model.n, model.sums, []) @ model.components * scale


def whiten(rows: DataFrame, model: Whitening, keep: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """The kept columns (default vec_id), deviation and whitened (an array, one entry a component) of every usable row.

    Usable are the rows that ``fit_whitening`` uses; the others are left out. ``deviation`` is the sum over dimensions of
    (n * x - S)^2, exact, and null where that doesn't fit a long. An entry of ``whitened`` is null where the component's
    eigenvalue is 0 (constant rows, or fewer rows than components). Repeated rows and null ids give a row each; an empty
    table gives none. A kept column that is named like a result gives way to it.
    """
    held, path = carried(rows, keep or ["vec_id"], vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _entries(batch, path, model.dim)
            dev = _deviations(x, model.n, model.sums)
            if dev.size and dev.dtype != object and int(np.abs(dev).max()) ** 2 * model.dim < 2**63:
                square = (dev * dev).sum(axis=1).tolist()
            else:
                square = [v if v < 2**63 else None for v in (sum(int(a) ** 2 for a in r) for r in dev)]
            y = whitened(x, model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch["kept"].take(pa.array(at)), pa.array(square, pa.int64()), lists], names=["kept", "deviation", "whitened"])

    if not model.n:
        held = held.limit(0)
    found = held.mapInArrow(run, with_fields(held, ("deviation", "long"), ("whitened", "array<double>")))
    return released(found, {"deviation": F.col("deviation"), "whitened": F.col("whitened")})


def whitening_table(rows: DataFrame) -> DataFrame:
    """The columns of op12: a row for each usable vector and component."""
    model = fit_whitening(rows)
    made = whiten(rows, model, keep=["vec_id"])
    explained = F.array(*(F.lit(float(v)) for v in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    long = made.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
