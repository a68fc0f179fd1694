"""Embedding whitening by shifted CholeskyQR.

Whole vectors become integer rows x. The centred distinct rows A are
orthogonalised in passes over the cluster: each pass sums the Gram matrix of
the rows as they are now, factors it on the driver (d x d, with a small shift on
the diagonal in the first pass and wherever the matrix is not positive
definite), and the next pass divides the rows by the factor with a triangular
solve. The factors are composed, A = Q R, and the singular value decomposition
of R gives the components and their variances; no covariance of the raw rows is
decomposed, so small components keep their digits.

What leaves the tasks is d (d + 1) / 2 sums per task, added up by Spark, and
what reaches the driver is one d x d matrix per pass, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import arrow_map, slices, stored

#: Gram passes at most; rows count as orthogonal when their Gram matrix is this close to the identity.
PASSES, ORTHOGONAL = 6, 1e-13
#: Components whose deviation is below this share of the largest are rounding and not returned.
LEAST = 1e-10
_UNIT = 2.0**-53
_LONG = 2**63


def integer_rows(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as int64; values beyond it stop at its ends."""
    x = np.floor(scale * vectors.astype(np.float64))
    return np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """A row in the narrowest width that holds it (so equal rows are equal bytes), with the width in front."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1) or w == 8)
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpack(rows: list[bytes], d: int) -> np.ndarray:
    """A matrix of rows; shorter rows have zeros at the end."""
    out = np.zeros((len(rows), d), np.int64)
    for i, b in enumerate(rows):
        x = np.frombuffer(b, f"<i{b[0]}", offset=1)
        out[i, : len(x)] = x
    return out


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, x binary`` of the rows of ``vectors (vec_id, embedding)`` without null or non-finite entries."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = row.values
            if values is None or values.null_count:
                continue
            c = values.to_numpy(zero_copy_only=False)
            if np.isfinite(c).all():
                ids.append(i)
                out.append(_pack(integer_rows(c, scale)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "x"])

    return arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")), rows, "vec_id long, x binary")


@dataclass
class Centre:
    """Rows, exact sums per dimension, and the largest absolute entry of the fit list."""

    n: int
    sums: list[int]
    most: int

    @property
    def exact(self) -> bool:
        """Whether n * x - S, and the squares of a row summed, fit a long."""
        deviation = self.n * self.most + max([0, *map(abs, self.sums)])
        return max(1, len(self.sums)) * deviation * deviation < _LONG

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in int64 or, where that is too narrow, as Python integers."""
        if self.exact:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)


@dataclass
class Whitener:
    """What ``fit`` finds; ``components`` has one unit column per component, by falling variance."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0


def _task_sums(rows: DataFrame, of_batch, d_out: int) -> np.ndarray:
    """The sum over all rows of the matrices ``of_batch`` gives per slice; added per task, then by Spark.

    ``of_batch`` gets the packed rows of a slice and returns an array of ``d_out`` numbers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d_out)
        for batch in slices(batches):
            total += of_batch(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d_out), pa.int64()), pa.array(total)], ["k", "v"])

    found = rows.mapInArrow(task, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(d_out)
    for r in found:
        out[r["k"]] = r["v"]
    return out


def centre(fit_list: DataFrame) -> Centre:
    """One pass: the number of rows, the exact sums and the largest entry."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums = 0, 0, []
        for batch in slices(batches):
            packed = batch.column(0).to_pylist()
            n += len(packed)
            d = max([0, *((len(b) - 1) // b[0] for b in packed)])
            x = _unpack(packed, d)
            most = max([most, *(abs(int(v)) for v in (x.min(), x.max()))]) if x.size else most
            part = x.sum(0) if most < 1 << 40 else x.astype(object).sum(0)
            sums += [0] * (d - len(sums))
            for k, v in enumerate(part.tolist()):
                sums[k] += int(v)
        total = [Decimal(v) for v in [n, *sums]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.decimal128(38, 0)), pa.array([Decimal(most)] * len(total), pa.decimal128(38, 0))], ["k", "v", "most"])

    found = fit_list.mapInArrow(task, "k long, v decimal(38,0), most decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v"), F.max("most").alias("most")).orderBy("k").collect()
    return Centre(int(found[0]["v"]) if found else 0, [int(r["v"]) for r in found[1:]], max([0, *(int(r["most"]) for r in found)]))


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular matrix, by forward substitution over the columns."""
    q = np.empty_like(a)
    for j in range(r.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(fit_list: DataFrame, middle: Centre, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows divided by ``factors``, one after the other."""
    d = len(middle.sums)
    upper = np.triu_indices(d)

    def of_batch(packed: list[bytes]) -> np.ndarray:
        q = middle.centred(_unpack(packed, d))
        for r in factors:
            q = solve_rows(q, r)
        return (q.T @ q)[upper]

    out = np.zeros((d, d))
    out[upper] = _task_sums(fit_list, of_batch, len(upper[0]))
    return out + np.triu(out, 1).T


def triangular(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper factor of a Gram matrix, shifted in the first pass and where it is not positive definite."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * np.trace(gram)
    if not first:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(vectors: DataFrame, scale: float = 256.0) -> Whitener:
    """Components of the distinct integer rows of ``vectors``; one whole pass per Gram matrix.

    No rows, one row, or rows that are all alike have no component. Directions
    in which the rows do not vary have none either. The fit list is written to
    the shared folder once and read by each pass.
    """
    rows = integer_vectors(vectors, scale).select("x").distinct()
    fit_list = stored(rows, vectors.sparkSession, "whitening-fit")
    middle = centre(fit_list)
    d = len(middle.sums)
    if not middle.n or not d:
        return Whitener(middle, np.zeros((d, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    gram = _gram(fit_list, middle, factors)
    if not np.trace(gram) > 0:
        return Whitener(middle, np.zeros((d, 0)), np.zeros(0), 0.0)
    while len(factors) < PASSES and np.abs(gram - np.eye(d)).max() > ORTHOGONAL * d:
        factors.append(triangular(gram, middle.n, not factors))
        composed = factors[-1] @ composed
        gram = _gram(fit_list, middle, factors)
    value, vector = np.linalg.eigh(gram)  # what is left, the identity but for directions without variance
    left = vector * np.sqrt(np.maximum(value, 0.0)) @ vector.T
    _, sigma, components = np.linalg.svd(left @ composed)
    keep = sigma > LEAST * sigma[0]
    found = Whitener(middle, components[keep].T, sigma[keep] ** 2 / middle.n, float((sigma**2).sum() / middle.n))
    found.identity_error = identity_error(fit_list, found, 4)
    return found


def _projection(found: Whitener, k: int) -> np.ndarray:
    return found.components[:, :k] / np.sqrt(found.variances[:k])


def identity_error(fit_list: DataFrame, found: Whitener, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity; two passes."""
    to, middle, d = _projection(found, k), found.centre, len(found.centre.sums)
    k = to.shape[1]
    if not k:
        return 0.0

    def whitened(packed: list[bytes]) -> np.ndarray:
        return middle.centred(_unpack(packed, d)) @ to

    mean = _task_sums(fit_list, lambda packed: whitened(packed).sum(0), k) / middle.n

    def products(packed: list[bytes]) -> np.ndarray:
        w = whitened(packed) - mean
        return (w.T @ w).ravel()

    covariance = _task_sums(fit_list, products, k * k).reshape(k, k) / middle.n
    return float(np.abs(covariance - np.eye(k)).max())


def transform(vectors: DataFrame, found: Whitener, k: int = 4, scale: float = 256.0) -> DataFrame:
    """``vec_id, deviation, whitened array<double>``: the first ``k`` components of every row of ``vectors``.

    Rows whose vector is null, or holds null or non-finite entries, take no
    part. Equal rows, and rows with a null or repeated vec_id, each give their
    row; an empty vector, like any that is shorter than the longest, counts as
    having zeros at the end. Entries of which ``scale * c`` is beyond a long stop
    at its ends. ``deviation`` is the exact sum of (n * x - S)^2, null where it
    does not fit a long. Fewer than ``k`` components give shorter arrays; an
    empty table gives no rows; other columns are ignored.
    """
    to, middle, d = _projection(found, k), found.centre, len(found.centre.sums)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _unpack(batch.column(1).to_pylist(), d)
        away = middle.deviations(x)
        squares = [int(v) if abs(int(v)) < _LONG else None for v in (away * away).sum(1)] if d else [0] * len(x)
        w = (away / max(1, middle.n)).astype(np.float64) @ to
        offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(offsets, w.ravel())], ["vec_id", "deviation", "whitened"])

    return arrow_map(integer_vectors(vectors, scale), rows, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, k: int = 4, scale: float = 256.0) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``fit`` and ``transform`` over the same rows; see there for the odd cases.
    """
    found = fit(vectors, scale)
    share = F.array(*[F.lit(float(v / found.total)) for v in found.variances[:k]], F.lit(0.0))
    rows = transform(vectors, found, k, scale).select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select("vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(found.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(found.identity_error).alias("identity_error"))
