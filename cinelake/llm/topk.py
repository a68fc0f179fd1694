"""Exact top-k inner products by distributed histogram selection.

Scores are integers. For a block of queries every candidate is scored in its
partition; each task adds up a histogram of its scores per query, and the
histograms are summed. The bin that holds the k-th score becomes the next range
of that query; the bins narrow until one value is left, so the k-th score is
exact without any sort. A last pass keeps what lies above it and, among those
equal to it, the smallest ids that fill the k places: at most 2k rows for each
query and task.

Queries are taken in blocks of a fixed number of rows (they are shared with the
tasks), so memory does not depend on the number of queries; candidates are
never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import cut_lineage, share

BLOCK = 4096
BINS = 1024
#: Scores computed at once in a task.
_CELLS = 1 << 20


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, x array<long>``: floor(scale * component) of the vectors that take part.

    Rows with a null id, a null vector, or a null or non-finite component take
    no part. Vectors of other lengths are padded with zeros when they are scored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("x"))


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(n), dim), kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class _Block:
    """Queries of one block, with the score range that is left for each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind: type) -> None:
        self.ids, self.x, self.kind = ids, x.astype(kind), kind

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate ids and the scores of all queries; a query's own rows are masked out."""
        step = max(1, _CELLS // max(1, len(self.ids)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = part.column(0).to_numpy()
                s = (self.x @ _matrix(part.column(1), self.x.shape[1], self.kind).T).astype(np.int64)
                yield ids, np.where(self.ids[:, None] == ids[None, :], np.iinfo(np.int64).min, s)


def _histograms(candidates: DataFrame, block, low: np.ndarray, span: np.ndarray, width: np.ndarray, bins: int) -> DataFrame:
    """``q, bin, n``: counts of the scores in each query's range of ``span`` values from ``low``, in bins of ``width``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block()
        total, n = np.zeros(len(b.ids) * bins, np.int64), len(b.ids)
        base = np.arange(n)[:, None] * bins
        for _, s in b.scores(batches):
            inside = (s >= low[:, None]) & (s < (low + span)[:, None])
            slot = (s - low[:, None]) // width[:, None] + base
            total += np.bincount(slot[inside], minlength=n * bins)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // bins, pa.int32()), pa.array(at % bins, pa.int32()), pa.array(total[at], pa.int64())], ["q", "bin", "n"])

    parts = candidates.mapInArrow(task, "q int, bin int, n long")
    return parts.groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth(candidates: DataFrame, block, k: int, limit: np.ndarray, bins: int) -> np.ndarray:
    """The k-th highest score of each query (the lowest score, where there are fewer)."""
    low, high = -limit, limit + 1  # the score lies in [low, high)
    need = np.full(len(low), k, np.int64)
    while True:
        span = high - low
        width = np.maximum(1, -(-span // bins))
        w = Window.partitionBy("q").orderBy(F.desc("bin"))
        counted = _histograms(candidates, block, low.copy(), span, width, bins).withColumn("above", F.sum("n").over(w) - F.col("n")).withColumn("last", F.row_number().over(Window.partitionBy("q").orderBy("bin")) == 1)
        needs = candidates.sparkSession.createDataFrame([(int(i), int(n)) for i, n in enumerate(need)], "q int, need long")
        # one row for each query of the block: the bin in which the count reaches what is needed, or the lowest that has scores
        found = counted.join(F.broadcast(needs), "q").filter((F.col("above") < F.col("need")) & ((F.col("above") + F.col("n") >= F.col("need")) | F.col("last"))).select("q", "bin", "above").collect()
        for r in found:
            q = r["q"]
            low[q] += r["bin"] * width[q]
            need[q] -= r["above"]
        high = np.minimum(high, low + width)  # also for queries without candidates, whose range is never counted
        if (width == 1).all():
            return low


def _winners(candidates: DataFrame, block, kth: np.ndarray, k: int) -> DataFrame:
    """``query_id, vec_id, score``: of each task, what lies above the k-th score and the k smallest ids equal to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ties = [np.zeros(0, np.int64)] * len(b.ids)
        for ids, s in b.scores(batches):
            q, c = np.nonzero(s > kth[:, None])
            found.append((b.ids[q], ids[c], s[q, c]))
            equal = s == kth[:, None]
            for q in np.flatnonzero(equal.any(1)).tolist():
                ties[q] = np.sort(np.concatenate([ties[q], ids[equal[q]]]))[:k]
        found += [(np.full(len(t), b.ids[q]), t, np.full(len(t), kth[q])) for q, t in enumerate(ties) if len(t)]
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(task, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query over all other vectors.

    ``vectors`` and ``queries`` have ``vec_id, embedding``. Scores are inner
    products of the floors of ``scale`` times the components; ties go to the
    smaller vec_id, and a query's own id is no candidate. With fewer than k
    candidates all are returned. Rows that repeat a vec_id are candidates of
    their own; a query id that is repeated is one query (its smallest vector).
    Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    candidates = cut_lineage(quantised(vectors, scale))
    asked = cut_lineage(quantised(queries, scale).groupBy("vec_id").agg(F.min("x").alias("x")))
    size = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: F.greatest(s, F.abs(v)))
    facts = candidates.select(F.size("x").alias("d"), size.alias("m")).union(asked.select(F.size("x"), size)).agg(F.max("d"), F.max("m")).first()
    schema = "query_id long, vec_id long, score long"
    out = spark.createDataFrame([], schema)
    if facts[0] is not None:
        dim, most = max(1, facts[0]), int(facts[1] or 0)
        kind = np.float32 if dim * most * most < 1 << 24 else np.float64 if dim * most * most < 1 << 53 else np.int64
        n = asked.count()
        blocks = max(1, -(-n // block))
        for b in range(blocks):
            part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked
            rows = part.orderBy("vec_id").collect()  # about ``block`` queries
            if not rows:
                continue
            x = np.zeros((len(rows), dim), np.int64)
            for i, r in enumerate(rows):
                x[i, : len(r["x"])] = r["x"]
            shared = share(spark, _Block(np.array([r["vec_id"] for r in rows], np.int64), x, kind))
            limit = np.abs(x).sum(1) * max(1, most)
            kth = _kth(candidates, shared, k, limit, bins)
            out = out.union(cut_lineage(_winners(candidates, shared, kth, k)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
