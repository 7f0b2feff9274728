"""Embedding whitening from a polarisation covariance.

Entries become integers x = floor(256 * c). Over the fit list (each distinct vector once) squares are added up exactly for every
dimension and for the sum of every two dimensions. Since Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), differences of these variances give all
covariances, as exact fractions, and eigh of the assembled matrix gives the components.

Values are centred by the whole number nearest to their mean before they are squared; what is left of the mean (under 1) is corrected in
exact integers: n * sum((x - S/n)**2) = n * sum(y**2) - sum(y)**2 for y = x - c. Sums leave the tasks as 40-bit limbs, so Spark adds
them as longs without rounding. The driver gets one row a pair of dimensions, whatever the number of vectors.

Distinct vectors are found on packed rows of 2, 4 or 8 bytes an entry; each task drops its own repeats before the shuffle, so a vector
that a third of all rows share is no hot spot. The fit list is written once.

Edge cases: null vectors and vectors with a null, NaN or infinite entry drop out, as do vectors shorter than the longest that remains (entries they lack
are null). Entries beyond a long stop at its ends. Repeated rows are returned each. Components without variance (an eigenvalue of at most
1e-12 of the largest: one distinct vector, constant or dependent dimensions) have a null ``whitened`` and do not count for ``identity_error``, which is null
if no component counts. ``explained`` is null if nothing varies. A ``deviation`` beyond a long is null. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.session import bounded_batches
from tidewater.sources.scratch import discard, materialize

COMPONENTS = 4
SCALE = 256
LIMB, LIMBS = 40, 5
LEAST = 1e-12
MOST = (1 << 63) - 1


def scaled(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of x) for each length of vector in the batch, without the rows that drop out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries: NaN
    at = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = (size >= 0) & (bad[at[1:]] == bad[at[:-1]])
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        with np.errstate(over="ignore"):
            f = np.floor(SCALE * flat[at[rows][:, None] + np.arange(n)])
        x = np.clip(f, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
        x[f >= 2.0**63] = MOST
        yield rows, x


def packed(x: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, bytes an entry, their bytes): the fewest bytes that hold a vector, so equal vectors are packed alike."""
    high, low = x.max(1, initial=0), x.min(1, initial=0)
    width = np.select([(high < 1 << 15) & (low >= -(1 << 15)), (high < 1 << 31) & (low >= -(1 << 31))], [2, 4], 8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        yield rows, w, np.ascontiguousarray(x[rows].astype(f"<i{w}"))


def _binary(rows: np.ndarray) -> pa.Array:
    n = len(rows)
    step = rows.nbytes // n if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * step).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, x in scaled(b.column(0)):
            for rows, _, data in packed(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), _binary(data)], ["dim", "packed"])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The matrix of x of packed vectors of one length."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    x = np.empty((len(column), dim), np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        x[rows] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), f"<i{n // dim}").reshape(-1, dim) if dim else 0
    return x


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x - c as int64 where the squares of sums of two stay far from overflow, else as Python's integers."""
    if not x.size or (int(x.max()) < 1 << 40 and int(x.min()) > -(1 << 40) and max(map(abs, c.tolist())) < 1 << 40):
        y = x - c.astype(np.int64)
        if not y.size or max(int(y.max()), -int(y.min())) < 1 << 24:
            return y
    return x.astype(object) - c


def _chunks(y: np.ndarray) -> Iterator[np.ndarray]:
    """Rows whose squared sums of two cannot overflow when added up."""
    step = 1 << 12  # 2**12 * (2 * 2**24)**2 = 2**62
    for i in range(0, len(y), step):
        yield y[i : i + step]


def sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact sums of x - c by dimension."""
    y = _exact(x, c)
    return sum((part.sum(0).astype(object) for part in _chunks(y)), np.zeros(x.shape[1], object))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact sums of squares: at (i, i) of dimension i, at (i, j), i < j, of the sum of both."""
    y = _exact(x, c)
    d = x.shape[1]
    out = np.zeros((d, d), object)
    for part in _chunks(y):
        for i in range(d):
            both = part[:, i : i + 1] + part[:, i:]
            both[:, 0] = part[:, i]
            out[i, i:] += (both * both).sum(0).astype(object)
    return out


def _limbs(values: list[int]) -> list[list[int]]:
    """Each value in LIMBS places of LIMB bits; the last has the sign."""
    return [[v >> LIMB * k if k == LIMBS - 1 else (v >> LIMB * k) & ((1 << LIMB) - 1) for v in values] for k in range(LIMBS)]


def _added(fit: DataFrame, dim: int, of: Callable[[np.ndarray], list[int]], size: int) -> list[int]:
    """Exact sums over the fit list of the ``size`` numbers that ``of`` makes of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for b in batches:
            total = [s + v for s, v in zip(total, of(unpacked(b.column(0), dim)), strict=True)]
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), *(pa.array(x, pa.int64()) for x in _limbs(total))], ["at", *(f"l{k}" for k in range(LIMBS))])

    parts = fit.select("packed").mapInArrow(run, "at int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    table = parts.groupBy("at").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).toArrow()
    out = [0] * size
    for at, *limbs in zip(*(table[c].to_pylist() for c in ("at", *(f"l{k}" for k in range(LIMBS)))), strict=True):
        out[at] = sum(v << LIMB * k for k, v in enumerate(limbs))
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: exact moments and the components by falling eigenvalue."""

    n: int
    sums: list[int]  # S by dimension
    values: np.ndarray  # eigenvalues of the covariance
    vectors: np.ndarray  # a row a component
    trace: float
    identity_error: float | None = None

    @property
    def counts(self) -> np.ndarray:
        """Which components have a variance."""
        return self.values > LEAST * max(float(self.values.max(initial=0.0)), 0.0)

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], object)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """x on the first k components, each over the root of its eigenvalue (NaN where that is none)."""
        c = self.centre
        rest = np.array([(s - self.n * v) / self.n for s, v in zip(self.sums, c.tolist(), strict=True)])
        y = _exact(x, c).astype(np.float64) - rest
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.counts[:k], 1 / np.sqrt(np.maximum(self.values[:k], 0)), np.nan)
        return np.stack([(y * v).sum(1) for v in self.vectors[:k]], 1) * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)**2, exact."""
        c = self.centre
        y = _exact(x, c)
        rest = [s - self.n * v for s, v in zip(self.sums, c.tolist(), strict=True)]
        most = self.n * (int(abs(y).max()) + 1) if y.size else 0
        if y.dtype != object and most * most * max(x.shape[1], 1) <= MOST:
            u = self.n * y - np.array(rest, np.int64)
            return (u * u).sum(1).tolist()
        u = self.n * y.astype(object) - np.array(rest, object)
        return [v if v <= MOST else None for v in (u * u).sum(1)]


def fit(vectors: DataFrame, col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of a column; None if there is none."""
    bounded_batches(vectors.sparkSession)
    every = materialize(vectors.select(col).mapInArrow(_pack, "dim int, packed binary").distinct(), "whitening-fit")
    dim = every.agg(F.max("dim").alias("d")).first().d
    if not dim:
        discard(every)
        return None
    rows = every.where(F.col("dim") == dim)
    zero = np.zeros(dim, object)
    n, *total = _added(rows, dim, lambda x: [len(x), *sums(x, zero)], dim + 1)
    c = np.array([(2 * s + n) // (2 * n) for s in total], object)  # the nearest whole number to each mean
    upper = np.triu_indices(dim)
    q = np.zeros((dim, dim), object)
    q[upper] = _added(rows, dim, lambda x: squares(x, c)[upper].tolist(), len(upper[0]))
    own = [s - n * v for s, v in zip(total, c.tolist(), strict=True)]
    variance = lambda i, j: n * q[i, j] - (own[i] if i == j else own[i] + own[j]) ** 2  # noqa: E731  times n * n, exact
    v = np.zeros((dim, dim))
    for i, j in zip(*upper, strict=True):
        v[i, j] = v[j, i] = variance(i, i) / (n * n) if i == j else (variance(i, j) - variance(i, i) - variance(j, j)) / (2 * n * n)
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value, kind="stable")
    vector = vector[:, order].T
    vector = vector * np.where(np.take_along_axis(vector, abs(vector).argmax(1)[:, None], 1) < 0, -1.0, 1.0)  # the largest entry is positive
    model = Whitening(n, total, np.maximum(value[order], 0), vector, sum(variance(i, i) for i in range(dim)) / (n * n))
    model = Whitening(model.n, model.sums, model.values, model.vectors, model.trace, _identity_error(rows, dim, model, min(components, dim)))
    discard(every)
    return model


def _identity_error(rows: DataFrame, dim: int, model: Whitening, k: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    keep = np.flatnonzero(model.counts[:k])
    if not len(keep):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(keep), len(keep)))
        for b in batches:
            w = model.project(unpacked(b.column(0), dim), k)[:, keep]  # centred
            total += np.einsum("ri,rj->ij", w, w)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    got = rows.select("packed").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(len(keep) ** 2)
    for r in got:
        cov[r["at"]] = r.v / model.n
    return round(float(abs(cov.reshape(len(keep), -1) - np.eye(len(keep))).max()), 9)  # sums of doubles differ in the last places from run to run


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component up to ``components``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[id_col].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    dim = len(model.sums)
    k = min(components, dim)
    share = [float(e) / model.trace if model.trace else None for e in model.values[:k]]
    names, id_type = [c.split()[0] for c in schema.split(", ")], to_arrow_type(kind)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for rows, x in scaled(b.column(1)):
                if x.shape[1] != dim:
                    continue
                m = len(rows)
                w = model.project(x, k).ravel()
                far = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                constant = lambda v, t: pa.array([v] * (m * k), t)
                ids = b.column(0).take(pa.array(np.repeat(rows, k))).cast(id_type)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), constant(model.n, pa.int64()), far, pa.array(w, mask=np.isnan(w)), pa.array(share * m, pa.float64()), constant(model.identity_error, pa.float64())],
                    names,
                )

    return vectors.select(id_col, col).mapInArrow(run, schema)
