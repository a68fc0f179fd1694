"""Item weights without the inverse matrix: conjugate gradients over the stored interactions.

``B_ij = -P_ij / P_jj`` needs the columns of ``P = (X^T X + lambda I)^-1``. Here
each column is solved on its own, and no Gram matrix, inverse or dense weight
table is ever formed:

- X is packed once into row blocks (some users with all their items each).
- A panel of columns is solved together. ``X^T (X V)`` is the only use of X;
  the panel's width follows from a bound in bytes, so memory does not grow with
  the number of items.
- One lambda: conjugate gradients preconditioned by the diagonal of the Gram
  matrix. Several: the multi-shift form first, whose one Krylov space serves
  every lambda, then the preconditioned form from its result, which takes a step
  or two to the last digits.
- While the packed X is under ``LOCAL_BYTES``, it is broadcast and every task
  solves whole panels, so all columns are solved in one job. Beyond that a panel
  is solved by the cluster together: each multiplication is one job over the row
  blocks that returns the panel-sized product.
- Only entries that can reach the percentile are written. Their lower bound is
  read from a few spread columns, and widened if it proves too high, so the
  percentile over all n^2 entries stays exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators import ease
from cinelake.session import cut_lineage, shared_path

#: Interactions in a row block; bytes of packed X that are broadcast; bytes of one panel of columns.
BLOCK_ROWS = 500_000
LOCAL_BYTES = 256 << 20
PANEL_BYTES = 32 << 20
#: A column counts as solved at this residual (of a unit vector); steps at most.
RESIDUAL, STEPS = 1e-13, 2000
#: Columns from which the lower bound of the percentile is read, and rows of the product handed on together.
SPREAD, SLAB = 128, 4096
#: Cells per interaction up to which a block is multiplied as a dense matrix (the sparse kernel costs about so many times more per number).
DENSE = 32
#: Cells of a block that is multiplied as a dense matrix, at most.
_WORK = 4 << 20
#: Entries of a sparse row that are multiplied together, and numbers gathered for that at a time.
LONG, GATHERED = 512, 1 << 17
ENTRY = "lam int, i long, j long, b double"


@dataclass
class Packed:
    """X in row blocks (``ptr, col, val`` as bytes), its width, Gram diagonal and size."""

    blocks: DataFrame
    n: int
    diagonal: np.ndarray
    size: int


def pack(x: DataFrame, n: int, scale: float = 1.0) -> Packed:
    """Row blocks of ``x (user_id, idx, v)``, one row per user and item, with values over ``scale``.

    A user's items stay together, at most ``n`` of them, so the largest block
    exceeds ``BLOCK_ROWS`` by little even if one user has rated everything. The
    blocks are checkpointed.
    """
    count = x.count()
    n_blocks = max(1, -(-count // BLOCK_ROWS))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["user_id", "idx"], kind="stable")
        user = rows["user_id"].to_numpy()
        ptr = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
        return pd.DataFrame({"ptr": [ptr.astype(np.int64).tobytes()], "col": [rows["idx"].to_numpy(np.int64).tobytes()], "val": [(rows["v"].to_numpy(np.float64) / scale).tobytes()]})

    spread = x.select("user_id", "idx", "v", F.pmod(F.xxhash64("user_id"), F.lit(n_blocks)).alias("_block"))
    blocks = cut_lineage(spread.groupBy("_block").applyInPandas(lambda rows: block(rows), "ptr binary, col binary, val binary"))
    v = F.col("v") / F.lit(float(scale))
    diagonal = np.zeros(n)
    for r in x.groupBy("idx").agg(F.sum(v * v).alias("g")).collect():  # one row per item
        diagonal[r["idx"]] = r["g"]
    size = blocks.agg(F.sum(F.octet_length("ptr") + F.octet_length("col") + F.octet_length("val"))).first()[0] or 0
    return Packed(blocks, n, diagonal, size)


class _Rows:
    """One row block, ready to multiply."""

    def __init__(self, ptr: bytes, col: bytes, val: bytes) -> None:
        ptr, col, val = np.frombuffer(ptr, np.int64), np.frombuffer(col, np.int64), np.frombuffer(val, np.float64)
        self.rows, self.dense = len(ptr), None
        row = np.repeat(np.arange(len(ptr)), np.diff(np.r_[ptr, len(col)]))
        items, place = np.unique(col, return_inverse=True)
        cells = len(ptr) * len(items)
        if cells <= min(DENSE * len(col), _WORK):  # filled well enough to multiply as a matrix
            self.items, self.dense = items, np.zeros((len(ptr), len(items)))
            self.dense[row, place] = val
        else:
            by_item = np.argsort(place, kind="stable")
            begins = np.searchsorted(place[by_item], np.arange(len(items)))
            self.by_row, self.by_item = _by_length(ptr, col, val, np.arange(len(ptr))), _by_length(begins, row[by_item], val[by_item], items)

    def add_product(self, v: np.ndarray, out: np.ndarray) -> None:
        """``out += X^T (X v)`` for the rows of this block."""
        if self.dense is not None:
            out[self.items] += self.dense.T @ (self.dense @ v[self.items])
            return
        u = np.zeros((self.rows, v.shape[1]))
        _add_rows(self.by_row, np.ascontiguousarray(v), u)
        _add_rows(self.by_item, u, out)


def _by_length(ptr: np.ndarray, at: np.ndarray, val: np.ndarray, names: np.ndarray) -> list[tuple]:
    """Sparse rows by their number of entries, as (names, places (rows, entries), values (rows, 1, entries)); rows over ``LONG`` entries in pieces."""
    size = np.diff(np.r_[ptr, len(at)])
    pieces = -(-size // LONG)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, whole = np.repeat(ptr, pieces) + k * LONG, np.repeat(names, pieces)
    size = np.minimum(np.repeat(size, pieces) - k * LONG, LONG)
    out = []
    for turn in range(2):  # the first pieces, each of another row, and the others
        for many in np.unique(size[(k > 0) == bool(turn)]):
            mine = np.flatnonzero((size == many) & ((k > 0) == bool(turn)))
            place = start[mine][:, None] + np.arange(many)
            out.append((whole[mine], at[place], val[place][:, None, :], bool(turn)))
    return out


def _add_rows(groups: list[tuple], v: np.ndarray, out: np.ndarray) -> None:
    """``out[names] += values @ v[places]``, rows of one length together and ``GATHERED`` numbers of ``v`` at a time, so that they stay in the cache."""
    width = v.shape[1]
    for names, at, val, repeated in groups:
        many = at.shape[1]
        some = max(1, GATHERED // (many * width))
        for a in range(0, len(names), some):
            near = v.take(at[a : a + some].ravel(), axis=0).reshape(-1, many, width)
            product = np.matmul(val[a : a + some], near)[:, 0]
            if repeated:
                np.add.at(out, names[a : a + some], product)
            else:
                out[names[a : a + some]] += product


Apply = Callable[[np.ndarray], np.ndarray]


def _local(rows: list[_Rows]) -> Apply:
    def apply(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for block in rows:
            block.add_product(v, out)
        return out

    return apply


def _spread(spark: SparkSession, packed: Packed) -> Apply:
    """X^T X v as a job: partial products per task, summed by slab of rows in two steps."""
    n = packed.n

    def apply(v: np.ndarray) -> np.ndarray:
        shipped, width = spark.sparkContext.broadcast(v), v.shape[1]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for ptr, col, val in zip(*(c.to_pylist() for c in batch.columns)):
                    total = np.zeros((n, width)) if total is None else total
                    _Rows(ptr, col, val).add_product(shipped.value, total)
            for k in range(0, n if total is not None else 0, SLAB):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k : k + SLAB].tobytes()])], ["slab", "data"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(rows["data"].iloc[0], np.float64).copy()
            for data in rows["data"].iloc[1:]:
                total += np.frombuffer(data, np.float64)
            return pd.DataFrame({"slab": [rows["slab"].iloc[0]], "data": [total.tobytes()]})

        partial = packed.blocks.mapInArrow(task, "slab long, data binary").withColumn("_part", F.spark_partition_id() % 16)
        halfway = partial.groupBy("slab", "_part").applyInPandas(lambda rows: add(rows), "slab long, data binary")
        out = np.zeros((n, width))
        for r in halfway.groupBy("slab").applyInPandas(lambda rows: add(rows), "slab long, data binary").toLocalIterator():
            part = np.frombuffer(r["data"], np.float64).reshape(-1, width)
            out[r["slab"] : r["slab"] + len(part)] = part
        shipped.destroy()
        return out

    return apply


def multi_shift(apply: Apply, b: np.ndarray, lams: list[float]) -> list[np.ndarray]:
    """Solutions of (A + lam) y = b for every lam, from the Krylov space of the smallest one.

    All residuals are multiples of the one that is iterated, so each step
    multiplies by A once, whatever the number of lambdas. Every column has its
    own step lengths; a solved column stands still.
    """
    seed = min(lams)
    shift = [lam - seed for lam in lams]
    r, p = b.copy(), b.copy()
    ys, ps = [np.zeros_like(b) for _ in lams], [b.copy() for _ in lams]
    now, before = [np.ones(b.shape[1]) for _ in lams], [np.ones(b.shape[1]) for _ in lams]
    last_step, last_turn = np.ones(b.shape[1]), np.zeros(b.shape[1])
    rr = (r * r).sum(0)
    goal = RESIDUAL**2 * rr
    for _ in range(STEPS):
        live = rr > goal
        if not live.any():
            break
        ap = apply(p) + seed * p
        step = np.where(live, rr / np.where(live, (p * ap).sum(0), 1.0), 0.0)
        r -= step * ap
        fresh = (r * r).sum(0)
        turn = np.where(live, fresh / np.where(live, rr, 1.0), 0.0)
        for k, s in enumerate(shift):
            below = step * last_turn * (before[k] - now[k]) + before[k] * last_step * (1 + s * step)
            new = np.where(live, now[k] * before[k] * last_step / np.where(live, below, 1.0), now[k])
            share = np.where(live, new / np.where(now[k] != 0, now[k], 1.0), 0.0)
            ys[k] += step * share * ps[k]
            ps[k] = np.where(live, new * r + turn * share**2 * ps[k], ps[k])
            before[k], now[k] = np.where(live, now[k], before[k]), new
        p = np.where(live, r + turn * p, p)
        last_step, last_turn, rr = np.where(live, step, last_step), np.where(live, turn, last_turn), np.where(live, fresh, rr)
    return ys


def preconditioned(apply: Apply, diagonal: np.ndarray, b: np.ndarray, lam: float, y: np.ndarray) -> np.ndarray:
    """Solution of (A + lam) y = b from the start ``y``, by conjugate gradients preconditioned with the diagonal."""
    scale = 1.0 / (diagonal + lam)[:, None]
    y = y.copy()
    r = b - apply(y) - lam * y
    z = scale * r
    p, rz = z.copy(), (r * z).sum(0)
    goal = RESIDUAL**2 * (b * b).sum(0)
    best, stale = np.inf, 0
    for _ in range(STEPS):
        size = (r * r).sum(0)
        live = size > goal
        if not live.any() or stale > 20:  # rounding keeps the rest from getting smaller
            break
        best, stale = (size[live].max(), 0) if size[live].max() < best else (best, stale + 1)
        ap = apply(p) + lam * p
        step = np.where(live, rz / np.where(live, (p * ap).sum(0), 1.0), 0.0)
        y += step * p
        r -= step * ap
        z = scale * r
        fresh = (r * z).sum(0)
        p = z + np.where(live, fresh / np.where(live, rz, 1.0), 0.0) * p
        rz = fresh
    return y


def inverse_columns(apply: Apply, diagonal: np.ndarray, columns: np.ndarray, lams: list[float]) -> list[np.ndarray]:
    """Those columns of (A + lam I)^-1, one (n, columns) array per lambda."""
    b = np.zeros((len(diagonal), len(columns)))
    b[columns, np.arange(len(columns))] = 1.0
    start = multi_shift(apply, b, lams) if len(lams) > 1 else [b / (diagonal + lams[0])[:, None]]
    return [preconditioned(apply, diagonal, b, lam, y) for lam, y in zip(lams, start)]


def _weights(y: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Columns of B from columns of P: over the own diagonal entry, which becomes 0."""
    at = np.arange(len(columns))
    b = -y / y[columns, at]
    b[columns, at] = 0.0
    return b


def _entries(ys: list[np.ndarray], columns: np.ndarray, bounds: list[float]) -> Iterator[pa.RecordBatch]:
    """Non-zero entries of B of at least the bound of their lambda."""
    for k, (y, bound) in enumerate(zip(ys, bounds)):
        b = _weights(y, columns)
        i, at = np.nonzero((np.abs(b) >= bound) & (b != 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int64()), pa.array(columns[at], pa.int64()), pa.array(b[i, at])], ["lam", "i", "j", "b"])


def panel_width(n: int, n_lams: int) -> int:
    """Columns of a panel: its arrays (six, and two more per lambda) stay under ``PANEL_BYTES`` each together."""
    return int(max(1, min(n, PANEL_BYTES // (8 * max(1, n) * (6 + 2 * n_lams)))))


class Solver:
    """Columns of B for a list of lambdas; see the module text for its two ways."""

    def __init__(self, spark: SparkSession, packed: Packed, lams: list[float]) -> None:
        self.spark, self.packed, self.lams = spark, packed, [float(x) for x in lams]
        self.width = min(panel_width(packed.n, len(self.lams)), max(32, -(-packed.n // (2 * spark.sparkContext.defaultParallelism))))
        self.shipped = None
        if packed.size <= LOCAL_BYTES:
            self.shipped = spark.sparkContext.broadcast([tuple(bytes(c) for c in r) for r in packed.blocks.toLocalIterator()])

    def _panels(self, columns: np.ndarray) -> list[np.ndarray]:
        width = self.width
        if self.shipped is not None:  # a panel is a task: a few columns are dealt over all of them
            width = max(1, min(width, -(-len(columns) // self.spark.sparkContext.defaultParallelism)))
        return [columns[k : k + width] for k in range(0, len(columns), width)]

    def entries(self, columns: np.ndarray, bounds: list[float]) -> DataFrame:
        """``lam, i, j, b`` (lam: place in the list) of those columns; written to the shared folder, then read."""
        path = shared_path(self.spark, "ridge")
        lams, diagonal, shipped = self.lams, self.packed.diagonal, self.shipped
        panels = self._panels(columns)
        if shipped is not None:
            first, width = columns, len(panels[0])

            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                apply = None
                for batch in batches:
                    for k in batch.column(0).to_pylist():
                        apply = apply or _local([_Rows(*r) for r in shipped.value])
                        mine = first[k * width : (k + 1) * width]
                        yield from _entries(inverse_columns(apply, diagonal, mine, lams), mine, bounds)

            self.spark.range(0, len(panels), 1, max(1, len(panels))).mapInArrow(task, ENTRY).write.parquet(path)
        else:
            apply = _spread(self.spark, self.packed)
            for mine in panels:
                ys = inverse_columns(apply, diagonal, mine, lams)
                solved = self.spark.sparkContext.broadcast((ys, mine))

                def emit(batches: Iterator[pa.RecordBatch], solved=solved) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        for k in batch.column(0).to_pylist():
                            all_y, columns = solved.value
                            yield from _entries([y[:, k : k + 1] for y in all_y], columns[k : k + 1], bounds)

                self.spark.range(0, len(mine), 1, min(len(mine), 16)).mapInArrow(emit, ENTRY).write.mode("append").parquet(path)
                solved.destroy()
        return self.spark.read.schema(ENTRY).parquet(path)

    def kept(self, share: float) -> tuple[DataFrame, list[float]]:
        """Entries that can be among the largest ``share`` of all n^2, and the lower bound of each lambda.

        The bounds are read from spread columns, where twice the share is kept;
        an entry below its bound is known to be smaller than every kept one.
        """
        n = self.packed.n
        columns = np.unique(np.linspace(0, n - 1, min(n, SPREAD)).astype(np.int64))
        seen = self.entries(columns, [0.0] * len(self.lams))
        rank = int(np.ceil(min(1.0, 2 * share) * n * len(columns)))
        bounds = []
        for k in range(len(self.lams)):
            mine = seen.where(F.col("lam") == k).select(F.abs("b").alias("ab"))
            count = mine.count()
            bounds.append(ease.values_at(mine, "ab", [count - rank], count)[0] if rank < count else 0.0)
        if len(columns) == n:
            return seen, bounds
        return self.entries(np.arange(n), bounds), bounds


def sparse_weights(solver: Solver, sparsity: float) -> DataFrame:
    """``lam, i, j, b``: entries of at least the percentile of |B| over all n^2 entries (zeros included), per lambda."""
    n, q = solver.packed.n, sparsity / 100.0
    share = 1.0 - q
    total = n * n
    position = q * (total - 1)
    low, high = int(np.floor(position)), int(np.ceil(position))
    while True:
        kept, bounds = solver.kept(share)
        thresholds = []
        for k, bound in enumerate(bounds):
            values = kept.where((F.col("lam") == k) & (F.abs("b") >= bound)).select(F.abs("b").alias("ab"))
            count = values.count()
            below = total - count
            if low < below and bound > 0:  # the spread columns held larger weights than the others
                break
            placed = [r - below for r in (low, high) if r >= below]
            at = [0.0] * (2 - len(placed)) + (ease.values_at(values, "ab", placed, count) if placed else [])
            thresholds.append(at[0] + (position - low) * (at[1] - at[0]))
        else:
            limit = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("lam") + 1)
            return kept.where(F.abs("b") >= limit)
        share *= 4


def fit(ratings: DataFrame, lams: list[float], sparsity: float = ease.DEFAULT_SPARSITY, implicit: bool = False, packed: tuple[DataFrame, Packed] | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, weights) with weights ``lam, src_item, dst_item, w`` for every lambda of ``lams``.

    The same weights as ``ease.fit`` gives for each lambda (all must be above
    zero). No ratings give no weights; repeated ratings add up. ``packed`` takes
    what ``prepare`` returned.
    """
    index, x = packed or prepare(ratings, implicit)
    spark = ratings.sparkSession
    if min(lams) <= 0:
        raise ValueError("every lambda must be above zero")
    if not x.n:
        return index, spark.createDataFrame([], "lam double, src_item long, dst_item long, w double")
    w = sparse_weights(Solver(spark, x, lams), sparsity)
    lam = F.element_at(F.array(*[F.lit(float(v)) for v in lams]), F.col("lam") + 1)
    named = ease.with_item_ids(w.select(F.struct(lam.alias("lam"), F.col("b")).alias("_w"), "i", "j"), index, "_w", "_w")
    return index, named.select("_w.lam", "src_item", "dst_item", F.col("_w.b").alias("w"))


def prepare(ratings: DataFrame, implicit: bool = False) -> tuple[DataFrame, Packed]:
    """(item index, packed X): the lambda-independent part of a fit."""
    index = cut_lineage(ease.item_index(ratings))
    n = index.count()
    x = ease.interactions(ratings, index, implicit)
    return index, pack(x, n, ease.rating_scale(ratings, implicit))
