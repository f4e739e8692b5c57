"""Embedding whitening: the covariance of all dimension pairs in one aggregation, then LAPACK.

Vectors become integers, ``x = floor(scale * entry) + shift``; the fit list has each distinct one
once. A first aggregation takes the rows n and the exact sums S of all dimensions. A second one has a
generated SQL expression for every pair i <= j of dimensions, the sum of (x_i - m_i) * (x_j - m_j)
with m the mean rounded to an integer: products of small integers, which doubles add without error
whatever the order of tasks, up to 2^53. The covariance is assembled from the upper triangle on the
driver, where the rest of each mean (below one half) is taken out, and LAPACK (``numpy.linalg.eigh``)
decomposes it. The driver holds d * d numbers, whatever the rows; d is limited to ``MOST``, beyond which
one aggregation is not the way. A third aggregation, over the whitened fit list, measures how
far their covariance is from the identity.

Defined results: a vector that is null or holds null or non-finite entries takes no part, nor does one
whose number of entries is not the commonest (of several the largest), or with an entry beyond
2^52 after scaling. ``deviation`` is null where it exceeds 64 bits. Where the covariance has no full
rank, ``whitened`` is null for components without variance (below d * 2^-52 of the largest). Repeated
rows and rows without an id get an answer each, other columns are ignored, an empty table (or one
without a usable vector) gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import written

MOST = 512
_LIMIT = float(1 << 52)


def integers(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, int]:
    """(vec_id, x: array of long of the rows that take part, their number of entries)."""
    entry = lambda c: F.floor(scale * c.cast("double"))
    usable = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(scale * c.cast("double")) < _LIMIT)
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.forall("v", usable))
    sizes = rows.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: entry(c) + shift).alias("x")), d


def _totals(columns: list[str], fit: DataFrame) -> tuple[int, list[int]]:
    found = fit.selectExpr("count(*) AS n", *(f"sum(CAST({c} AS DECIMAL(20, 0))) AS s{k}" for k, c in enumerate(columns))).first()
    return found["n"], [int(s or 0) for s in found[1:]]


def upper_triangle(fit: DataFrame, columns: list[str], centre: list[float]) -> np.ndarray:
    """Sums of products of the centred columns for all pairs, as a symmetric matrix, from one aggregation.

    The centred columns are projected first, so that each expression is one product of two of them.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centred = fit.selectExpr(*(f"CAST({c} - ({m!r}{'D' if isinstance(m, float) else ''}) AS DOUBLE) AS c{k}" for k, (c, m) in enumerate(zip(columns, centre, strict=True))))
    found = centred.selectExpr(*(f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in pairs)).first()
    out = np.zeros((d, d))
    for (i, j), v in zip(pairs, found, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


class Whitening:
    """n, sums, eigenvalues (falling), components (columns), which of them have variance, and the error measured."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])
        self.ranked = values > max(values[0], 0.0) * len(sums) * 2.0**-52
        self.identity_error = float("nan")

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers to whitened rows; NaN where a component has no variance."""
        centred = (x - self.whole).astype(np.float64) - self.rest
        scale = np.where(self.ranked, 1 / np.sqrt(np.where(self.ranked, self.values, 1.0)), np.nan)
        return centred @ self.vectors * scale


def learn_whitening(rows: DataFrame, d: int, components: int = 16) -> Whitening | None:
    """From rows (x) of d integers each, over the distinct ones; None where there is no row."""
    if d > MOST:
        raise ValueError(f"an aggregation of all pairs is meant for at most {MOST} dimensions")
    if not d:
        return None
    fit = written(rows.select("x").distinct(), "fit")
    columns = [f"x[{k}]" for k in range(d)]
    n, sums = _totals(columns, fit)
    if not n:
        return None
    centre = [round(s / n) for s in sums]
    products = upper_triangle(fit, columns, centre)
    off = np.array([(s - n * m) / n for s, m in zip(sums, centre, strict=True)])
    covariance = products / n - np.outer(off, off)
    values, vectors = np.linalg.eigh(covariance)
    model = Whitening(n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], float(np.trace(covariance)))
    kept = np.flatnonzero(model.ranked)
    if len(kept):
        whitened = fit.mapInArrow(lambda it: _whitened(it, model), "w array<double>")
        own = [f"w[{k}]" for k in kept.tolist()]
        means = whitened.selectExpr(*(f"avg({c}) AS m{k}" for k, c in enumerate(own))).first()
        found = upper_triangle(whitened, own, [float(m) for m in means]) / n
        model.identity_error = float(np.abs(found - np.eye(len(kept))).max())
    return model


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _whitened(batches: Iterable[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = model.project(_matrix(batch.column(batch.schema.get_field_index("x")), len(model.sums)))
        offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))], names=["w"])


def _answers(batches: Iterable[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    shares = model.values / model.trace if model.trace > 0 else np.full(len(model.values), np.nan)
    of = lambda a: pa.array(a, from_pandas=True)
    for batch in batches:
        w = model.project(_matrix(batch.column(2), len(model.sums)))
        rows, k = w.shape
        each = pa.array(np.repeat(np.arange(rows), k))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), batch.column(1).take(each), of(w.ravel()), of(np.tile(shares, rows)), of(np.full(rows * k, model.identity_error))],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def deviation(n: int, sums: list[int]) -> str:
    """SQL for the exact sum of (n * x - S)^2 of a row; null beyond 64 bits."""
    terms = (f"try_subtract(try_multiply({n}L, x[{k}]), CAST('{s}' AS BIGINT))" for k, s in enumerate(sums))
    return "aggregate(array(" + ", ".join(terms) + "), 0L, (a, t) -> try_add(a, try_multiply(t, t)))"


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row that takes part and each component."""
    rows, d = integers(table, vec_id, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = learn_whitening(rows, d, components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    own = rows.selectExpr("vec_id", f"{deviation(model.n, model.sums)} AS deviation", "x")
    return own.mapInArrow(lambda it: _answers(it, model), schema)
