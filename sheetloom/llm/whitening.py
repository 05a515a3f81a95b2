"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are put on a lattice of 1/256; each distinct one counts once in the fit. The centred
matrix X of these stays in blocks of rows over the cluster. A step multiplies a vector v by X,
and the result u by the transpose of X, in one pass; after the recurrence, both are
orthogonalised against all vectors before them. As every u is X w for a short w, the long vectors
are made anew from blocks in each pass and never stored. The singular values of the small bidiagonal matrix are the
components' deviations (times the root of n), its right vectors combine the v to components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import checkpointed

SCALE = 256
BLOCK_ROWS = 4096
#: Bytes of centred vectors in a task of a pass.
TASK_BYTES = 16 << 20
#: Against the largest singular value: residuals of converged components, and values that count as zero.
CONVERGED, ZERO = 1e-16, 1e-10


@dataclass(frozen=True)
class Fit:
    """n distinct vectors with sums S, unit components as rows, their eigenvalues, the trace of the covariance and the identity's largest error."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def on_lattice(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and has finite entries only, with x = floor(256 c) as longs; shorter vectors are filled with zeros."""
    entry = lambda c: c.cast("double")
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")), F.lit(False)))
    kept = df.where(F.col(vector).isNotNull() & finite)
    dims = kept.agg(F.max(F.size(vector))).first()[0] or 0
    x: Column = F.transform(vector, lambda c: F.floor(entry(c) * SCALE).cast("long"))
    return kept.withColumn(vector, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector))))


def _blocks(fit: DataFrame, means: np.ndarray, parts: int) -> DataFrame:
    """Centred vectors as rows of float64 blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([(x[i : i + BLOCK_ROWS] - means).tobytes() for i in range(0, len(x), BLOCK_ROWS)], pa.binary())], ["rows"])

    return checkpointed(fit.coalesce(parts).mapInArrow(pack, "rows binary"))


def _pass(blocks: DataFrame, dims: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of what ``work`` returns for each block; tasks add up their blocks, Spark adds up tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows in batch.column(0):
                got = work(np.frombuffer(rows.as_buffer(), dtype=np.float64).reshape(-1, dims))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

    got = blocks.mapInArrow(each, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one number per dimension and step
    return np.array([r["s"] for r in sorted(got, key=lambda r: r["i"])])


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - b * (b @ v)
    return v


def bidiagonalise(blocks: DataFrame, dims: int, want: int, known: list[np.ndarray], tolerance: float | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Right singular vectors (rows) and values of X across the vectors ``known``, falling, and whether all dimensions were used.

    Ends when the first ``want`` have residuals of at most ``tolerance`` times the largest value (never
    before the end without one). Where a product vanishes, the space met so far is invariant,
    and a new start across it finds what is left, repeated singular values included.
    """
    rng = np.random.default_rng(dims)
    vs: list[np.ndarray] = []
    ws, ys = np.zeros((dims, 0)), np.zeros((dims, 0))  # u = X w and its product with the transpose
    alphas: list[float] = []
    betas: list[float] = []
    largest = 0.0
    v = None
    while True:
        if v is None:
            v = _against(rng.standard_normal(dims), known + vs)
            v /= np.linalg.norm(v)
        k = ws.shape[1]
        w = v - betas[-1] * ws[:, -1] if k else v  # across the u before it, by the recurrence
        before, now = ws, w
        got = _pass(blocks, dims, lambda x: np.concatenate([(x @ before).T @ (x @ now), [(x @ now) @ (x @ now)], x.T @ (x @ now)]))
        c, square, y = got[:k], got[k], got[k + 1 :]
        alpha = float(np.sqrt(max(0.0, square - c @ c)))
        largest = max(largest, alpha)
        vs.append(v)
        if alpha <= ZERO * largest or alpha == 0:
            alpha, w, y = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, y = (w - ws @ c) / alpha, (y - ys @ c) / alpha
        ws, ys = np.column_stack([ws, w]), np.column_stack([ys, y])
        alphas.append(alpha)
        rest = _against(y - alpha * v, known + vs)
        beta = float(np.linalg.norm(rest))
        left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        largest = max(largest, float(values[0]))
        whole = len(known) + len(vs) == dims
        near = tolerance is not None and len(vs) >= want and np.all(beta * np.abs(left[-1, :want]) <= tolerance * largest)
        if whole or (near and beta > ZERO * largest):
            return right @ np.array(vs), values, whole
        if beta <= ZERO * largest:
            beta, v = 0.0, None
        else:
            v = rest / beta
        betas.append(beta)


def fit_whitening(x: DataFrame, vector: str, want: int = 4) -> Fit | None:
    """Components of the distinct vectors of ``x``; None where all are alike or none exist.

    Components that converge early are held against a second run across them: if that
    meets a larger value, one was repeated, and all dimensions are gone through.
    """
    distinct = checkpointed(x.select(F.col(vector).alias("x")).distinct())
    n = distinct.count()
    sums = [int(r["s"]) for r in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()]  # one number per dimension
    dims = len(sums)
    if not dims:
        return None
    parts = max(1, -(-n * dims * 8 // TASK_BYTES))
    blocks = _blocks(distinct, np.array([s / n for s in sums]), parts)
    trace = float(_pass(blocks, dims, lambda b: np.array([np.sum(b * b)]))[0]) / n
    if trace == 0:
        return None
    components, values, whole = bidiagonalise(blocks, dims, min(want, dims), [], CONVERGED)
    if not whole:
        components, values = components[:want], values[:want]
        _, others, _ = bidiagonalise(blocks, dims, 1, list(components), 1e-6)
        if others[0] > values[-1] * (1 + 1e-9):
            components, values, _ = bidiagonalise(blocks, dims, want, [], None)
    some = [i for i in range(min(want, len(values))) if values[i] > ZERO * values[0]]
    components, values = components[some], values[some]
    scaled = (components / (values / np.sqrt(n))[:, None]).T
    c = len(some)
    got = _pass(blocks, dims, lambda b: np.concatenate([np.sum(b @ scaled, axis=0), ((b @ scaled).T @ (b @ scaled)).ravel()]))
    mean = got[:c] / n
    off = got[c:].reshape(c, c) / n - np.outer(mean, mean) - np.eye(c)
    return Fit(n, sums, components, values**2 / n, trace, float(np.abs(off).max()))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", want: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, for every vector without null or non-finite entries.

    Rows whose vector is null or holds null or non-finite entries are dropped; equal vectors count once in the
    fit and get equal values; vectors shorter than the longest are filled with zeros. Components without
    variance are left out, so a table whose vectors are all alike, or an empty one, gives no rows.
    ``deviation`` is exact, and null where it passes 64 bits. No other column is looked at.
    """
    x = on_lattice(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x")), "x")
    fit = fit_whitening(x, "x", want)
    id_type = x.schema["vec_id"].dataType.simpleString()
    if fit is None:
        return x.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums = fit.n, fit.sums
    scaled = (fit.components / np.sqrt(fit.eigenvalues)[:, None]).T

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            far = np.abs(rows * float(n) - np.array(sums, dtype=np.float64)).max(axis=1) if len(rows) else np.zeros(0)
            small = (far < 2.0**31) & (far * far * len(sums) < 2.0**62) & (np.abs(rows).max(axis=1) < 2.0**62 / n if len(rows) else True) & (max(map(abs, sums)) < 2**62)
            deviation: list[int | None] = [None] * len(rows)
            for i in np.flatnonzero(~small):
                exact = sum((n * int(v) - s) ** 2 for v, s in zip(rows[i], sums))
                deviation[i] = exact if exact < 2**63 else None
            if small.any():
                offset = rows[small] * n - np.array(sums, dtype=np.int64)
                for i, d in zip(np.flatnonzero(small), (offset * offset).sum(axis=1)):
                    deviation[i] = int(d)
            whitened = (rows - np.array([s / n for s in sums])) @ scaled
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * scaled.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(whitened.ravel()))], ["vec_id", "deviation", "values"])

    schema = T.StructType([x.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    scored = x.mapInArrow(score, schema).select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / fit.trace)) for e in fit.eigenvalues]), F.col("at") + 1)
    return scored.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(fit.identity_error).alias("identity_error"))
