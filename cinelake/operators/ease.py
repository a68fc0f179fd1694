"""EASE item-item model on Spark.

G = X^T X (+ lambda on the diagonal), P = G^-1, B_ij = -P_ij / P_jj with a zero
diagonal, sparsified to the entries with |B| >= the q-th percentile of all n^2
values, and requests scored as sum(rating * B) over the sparse weights.

Scale notes
- Gram: packed user rows go to cells of items that begin about as many pairs each,
  and are multiplied there a few rows of G at a time (``cells.py``). No pair of
  items is shuffled, except for items that alone begin too many pairs for a task,
  which several tasks share; the lower triangle is mirrored in the same pass.
- Inverse: blocked Gauss-Jordan over (bi, bj) blocks of a b x b float64 array,
  one round per block row; every round is joins plus a numpy kernel per block in
  ``mapInPandas``, stored in the shared folder, over the same number of partitions.  Neither the driver nor a single
  task ever holds G.
- Weights and percentile: taken inside the blocks. Each pass counts the values of
  the blocks by the leading bits of their numbers, so the rank is located in a
  few small histograms; only the entries that stay become (i, j, b) rows.
- Beyond ``MAX_DENSE_ITEMS`` items ``operators/ridge.py`` solves the columns
  without forming the Gram matrix or its inverse.
- Scoring: see ``recommend`` (one weights join, one aggregate, one shuffle by
  request, zero-fill only where fewer than k scores are positive).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinelake.operators import cells
from cinelake.operators.indexing import dense_index, running_sum
from cinelake.session import broadcast_if_small, cut_lineage, dealt, shared_path, stored
from cinelake.sources import once

# Fixed values of the model as published: default lambda 0.5, 98th percentile sparsity.
DEFAULT_LAMBDA = 0.5
DEFAULT_SPARSITY = 98
# A user's items in a step of the Gram product: its square bounds the pairs multiplied at once.
SALT_CHUNK = 2048
# Gram entries of the upper triangle that are stored (about 12 bytes each).
MAX_STORED_GRAM = 100_000_000
BLOCK = 512
# Blocks that one task holds (a batch of them, with their two panel blocks, is about 100 MB).
TASK_BLOCKS = 16
# Largest item dictionary shipped whole to every task (about 16 bytes per item); beyond it, shuffle joins.
MAX_BROADCAST_ITEMS = 2_000_000
# Largest sparse weight table broadcast to the scoring join (about 24 bytes per entry); beyond it, shuffle join.
MAX_BROADCAST_WEIGHTS = 2_000_000
# Numbers in a block of scores that a task holds at once (8 bytes each, and a few arrays like it).
CELLS = 1 << 20
# Largest panel of blocks (bytes) broadcast in a round of the inverse.
MAX_BROADCAST_PANEL = 64 << 20
# Part of a saved model's name: raised when a fit of the same input may give other weights.
MODEL_VERSION = 3
# Items up to which the blocked inverse is used; beyond it the columns are solved one panel at a time.
MAX_DENSE_ITEMS = 100_000
# Values of one bin of the percentile's histogram that are counted one by one.
FEW_VALUES = 1 << 17
_SELF_SALT = 4096
# Rank accuracy of the approximate bracket around the exact percentile.
_BRACKET_ACCURACY = 10_000

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("bi", T.IntegerType()),
        T.StructField("bj", T.IntegerType()),
        T.StructField("nr", T.IntegerType()),
        T.StructField("nc", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def item_index(ratings: DataFrame) -> DataFrame:
    """Sorted distinct item ids -> idx 0..n-1."""
    return dense_index(ratings, "item_id", "idx", 0)


def interactions(ratings: DataFrame, index: DataFrame, implicit: bool = False) -> DataFrame:
    """X as stored rows (user_id, idx, v), one per user and item; repeated ratings add up, unscaled."""
    dictionary = broadcast_if_small(index.select("item_id", "idx"), MAX_BROADCAST_ITEMS)
    value = F.count(F.lit(1)).cast("double") if implicit else F.sum("rating")
    return stored(ratings.join(dictionary, "item_id").groupBy("user_id", "idx").agg(value.alias("v")), "interactions")


def rating_scale(ratings: DataFrame, implicit: bool = False) -> float:
    """The largest rating, by which explicit values are divided (no ratings: 1)."""
    return 1.0 if implicit else float(ratings.agg(F.max("rating")).first()[0] or 1.0)


def gram(ratings: DataFrame, index: DataFrame, implicit: bool = False) -> DataFrame:
    """Sparse G as (i, j, g) over item indices, both triangles, zero entries absent.

    Explicit values are the ratings over the largest rating, implicit ones are 1
    per rating; repeated (user, item) ratings add up in both modes. Sums of
    products are taken over the unscaled ratings and divided once at the end.

    Null ratings count for nothing beside others, and a user's null entry makes
    its pairs null, which count for nothing either.

    The user rows are packed and stored before anything reads them, go to cells of
    items, and are multiplied there (``cells.py``), so pairs of items are not shuffled.
    The lower triangle is mirrored from the upper one in the same pass.
    """
    return mirrored(_upper(ratings, index, implicit)[0])


def _upper(ratings: DataFrame, index: DataFrame, implicit: bool) -> tuple[DataFrame, int]:
    """(the upper triangle of G as (i, j, g), a bound of its rows)."""
    dictionary = broadcast_if_small(index.select("item_id", "idx"), MAX_BROADCAST_ITEMS)
    value = F.lit(1.0) if implicit else F.col("rating")
    n = (index.agg(F.max("idx")).first()[0] or 0) + 1
    packed = cells.pack(ratings.join(dictionary, "item_id").select("user_id", "idx", value.alias("v")), n)
    rows, most = cells.upper(packed, n, min(SALT_CHUNK * SALT_CHUNK, CELLS))
    top = rating_scale(ratings, implicit)
    return rows.select("i", "j", (F.col("gi") / F.lit(top * top)).alias("g")), most


def mirrored(upper: DataFrame) -> DataFrame:
    """Both triangles from the upper one."""
    i, j, g = F.col("i"), F.col("j"), F.col("g")
    both = F.when(i < j, F.array(F.struct(i, j, g), F.struct(j.alias("i"), i.alias("j"), g))).otherwise(F.array(F.struct(i, j, g)))
    return upper.select(F.inline(both))


# ------------------------------------------------------------------ blocks


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.float64).tobytes()


def _unpack(b: bytes, nr: int) -> np.ndarray:
    a = np.frombuffer(b, dtype=np.float64)
    return a.reshape(nr, a.size // nr if nr else 0)


def to_blocks(entries: DataFrame, n: int, lam: float, block: int = BLOCK) -> DataFrame:
    """(i, j, g) -> dense blocks of G + lam*I; every block of the grid exists."""
    m = (n + block - 1) // block
    spark = entries.sparkSession
    grid = spark.range(m * m).select(
        (F.col("id") / m).cast("int").alias("bi"), (F.col("id") % m).cast("int").alias("bj"),
        F.lit(-1).alias("li"), F.lit(-1).alias("lj"), F.lit(0.0).alias("g"),
    )
    e = entries.select(
        (F.col("i") / block).cast("int").alias("bi"), (F.col("j") / block).cast("int").alias("bj"),
        (F.col("i") % block).cast("int").alias("li"), (F.col("j") % block).cast("int").alias("lj"), "g",
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        nr, nc = min(block, n - bi * block), min(block, n - bj * block)
        a = np.zeros((nr, nc))
        real = pdf[pdf["li"] >= 0]
        a[real["li"].to_numpy(), real["lj"].to_numpy()] = real["g"].to_numpy()
        if bi == bj:
            a[np.diag_indices(nr)] += lam
        return pd.DataFrame({"bi": [bi], "bj": [bj], "nr": [nr], "nc": [nc], "data": [_pack(a)]})

    tasks = max(spark.sparkContext.defaultParallelism, -(-m * m // TASK_BLOCKS))
    return grid.unionByName(e).repartition(tasks, "bi", "bj").groupBy("bi", "bj").applyInPandas(build, BLOCK_SCHEMA)


def _solve(it):
    """Blocks of the pivot's row: A_pp^-1 A_pj, and A_pp^-1 in the place of the pivot."""
    for pdf in it:
        for row in pdf.itertuples(index=False):
            pivot = _unpack(row.pivot, row.nr)
            new = np.linalg.inv(pivot) if row.bi == row.bj else np.linalg.solve(pivot, _unpack(row.data, row.nr))
            yield pd.DataFrame({"bj": [row.bj], "r": [_pack(new)]})


def _update(p: int):
    """Every block of the matrix after the round of pivot ``p``, from the old column block ``l`` and the solved row block ``r``."""

    def update(it):
        for pdf in it:
            for row in pdf.itertuples(index=False):
                if row.bi == p:
                    new = row.r
                else:
                    left = _unpack(row.l, row.nr)
                    product = left @ _unpack(row.r, left.shape[1])
                    new = _pack(-product if row.bj == p else _unpack(row.data, row.nr) - product)
                yield pd.DataFrame({"bi": [row.bi], "bj": [row.bj], "nr": [row.nr], "nc": [row.nc], "data": [new]})

    return update


def _panel(df: DataFrame, m: int, block: int) -> DataFrame:
    """A row or column of ``m`` blocks, broadcast while m * block^2 doubles stay under the bound."""
    return F.broadcast(df) if m * block * block * 8 <= MAX_BROADCAST_PANEL else df


def invert_blocks(blocks: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """In-place blocked Gauss-Jordan: for each pivot p,
    A_pp <- A_pp^-1, A_pj <- A_pp^-1 A_pj, A_ip <- -A_ip A_pp^-1, A_ij <- A_ij - A_ip A_pp^-1 A_pj.
    No pivoting is needed: G + lambda*I is symmetric positive definite.

    The pivot is one block (2 MB at the default size) and is always broadcast,
    so its row is solved where it lies. The solved row and the old column are
    broadcast to the matrix while they are small by arithmetic; beyond that they
    meet it in shuffle joins on the block row and column. One pass updates all
    blocks where they lie, so a round leaves as many partitions as it found. It
    is stored as files, of which the next round knows the size: a checkpoint
    carries the size its plan was estimated at, a product over the joins whose
    digits multiply with every round. The files of the round before are deleted."""
    spark = blocks.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "blocks")
        df.write.parquet(path)
        return spark.read.schema(BLOCK_SCHEMA).parquet(path), path

    cur, path = stored(blocks)
    for p in range(m):
        bi, bj = F.col("bi"), F.col("bj")
        pivot = cur.where((bi == p) & (bj == p)).select("bi", F.col("data").alias("pivot"))
        solved = cut_lineage(cur.where(bi == p).join(F.broadcast(pivot), "bi").mapInPandas(_solve, "bj int, r binary"))
        column = cur.where((bj == p) & (bi != p)).select("bi", F.col("data").alias("l"))
        whole = cur.join(_panel(column, m, block), "bi", "left").join(_panel(solved, m, block), "bj")
        before = path
        cur, path = stored(whole.select("bi", "bj", "nr", "nc", "data", "l", "r").mapInPandas(_update(p), BLOCK_SCHEMA))
        once.delete(spark, before)
    return cur


def from_blocks(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Dense blocks -> long (i, j, p) rows."""

    def explode(it):
        for pdf in it:
            for row in pdf.itertuples(index=False):
                a = _unpack(row.data, row.nr)
                ii, jj = np.indices(a.shape)
                yield pd.DataFrame(
                    {
                        "i": (ii.ravel() + row.bi * block).astype("int64"),
                        "j": (jj.ravel() + row.bj * block).astype("int64"),
                        "p": a.ravel(),
                    }
                )

    return blocks.mapInPandas(explode, "i long, j long, p double")


def inverse(entries: DataFrame, n: int, lam: float, block: int = BLOCK) -> DataFrame:
    """(G + lam*I)^-1 as long (i, j, p)."""
    m = (n + block - 1) // block
    return from_blocks(invert_blocks(to_blocks(entries, n, lam, block), m, block), block)


def _weight_blocks(p_blocks: DataFrame, n: int) -> DataFrame:
    """Blocks of P beside the part of P's diagonal that their columns need (as ``diag``).

    The diagonal is n numbers: broadcast while they fit the bound, joined by a shuffle beyond.
    """

    def diagonal(it):
        for pdf in it:
            yield pd.DataFrame({"bj": pdf["bj"], "diag": [_pack(np.diag(_unpack(r.data, r.nr))) for r in pdf.itertuples(index=False)]})

    diag = p_blocks.where(F.col("bi") == F.col("bj")).mapInPandas(diagonal, "bj int, diag binary")
    return p_blocks.join(F.broadcast(diag) if 8 * n <= MAX_BROADCAST_PANEL else diag, "bj")


def _weights_of(row) -> np.ndarray:
    """B_ij = -P_ij / P_jj of a block, with zeros on the diagonal of the matrix."""
    b = -_unpack(row.data, row.nr) / np.frombuffer(row.diag, np.float64)
    if row.bi == row.bj:
        np.fill_diagonal(b, 0.0)
    return b


def _bit_counts(blocks: DataFrame, shift: int, parent: int, parent_shift: int) -> list[tuple[int, int]]:
    """Sorted (leading bits, count) of |B| over all blocks, within the bin ``parent`` of a coarser count.

    Numbers that are not negative are ordered as their bit patterns, so bins of
    leading bits are ranges of values. At most 2^20 bins per call, summed in the
    tasks before the shuffle.
    """

    def count(it):
        total: dict[int, int] = {}
        for pdf in it:
            for row in pdf.itertuples(index=False):
                bits = np.abs(_weights_of(row)).ravel().view(np.uint64)
                if parent_shift < 64:
                    bits = bits[bits >> np.uint64(parent_shift) == parent]
                for k, c in zip(*(x.tolist() for x in np.unique(bits >> np.uint64(shift), return_counts=True))):
                    total[k] = total.get(k, 0) + c
        yield pd.DataFrame({"k": np.array(list(total), np.int64), "c": np.array(list(total.values()), np.int64)})

    found = blocks.mapInPandas(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    return sorted((r["k"], r["c"]) for r in found)


def block_percentile(weight_blocks: DataFrame, n: int, q: float) -> float:
    """numpy-style linear-interpolated percentile of |B| over all n^2 entries, exact.

    Counts by the leading 20 bits locate the bin of the rank; a crowded bin is
    counted again by its next bits, a small one value by value. Last, one pass
    looks up the next larger value where the rank lies between two.
    """
    total = n * n
    pos = q * (total - 1)
    low, high = int(np.floor(pos)), int(np.ceil(pos))
    below, parent, parent_shift, shift = 0, 0, 64, 44
    while True:
        for k, c in _bit_counts(weight_blocks, shift, parent, parent_shift):
            if low < below + c:
                break
            below += c
        if shift == 0:
            break
        parent, parent_shift = k, shift
        shift = 0 if c <= FEW_VALUES else max(0, shift - 20)
    value = float(np.array([k], np.uint64).view(np.float64)[0])
    if high < below + c:
        return value

    def larger(it):
        best = np.inf
        for pdf in it:
            for row in pdf.itertuples(index=False):
                b = np.abs(_weights_of(row))
                best = min(best, b[b > value].min(initial=np.inf))
        yield pd.DataFrame({"v": [best]})

    after = weight_blocks.mapInPandas(larger, "v double").agg(F.min("v")).first()[0]
    return value + (pos - low) * (float(after) - value)


def block_sparsify(p_blocks: DataFrame, n: int, sparsity: float = DEFAULT_SPARSITY, block: int = BLOCK) -> DataFrame:
    """Rows (i, j, b) of the weights with |b| >= percentile(|B|, sparsity) over all n^2 entries; zeros are dropped."""
    blocks = _weight_blocks(p_blocks, n)
    limit = block_percentile(blocks, n, sparsity / 100.0)

    def keep(it):
        for pdf in it:
            for row in pdf.itertuples(index=False):
                b = _weights_of(row)
                i, j = np.nonzero((np.abs(b) >= limit) & (b != 0))
                yield pd.DataFrame({"i": i + row.bi * block, "j": j + row.bj * block, "b": b[i, j]})

    return blocks.mapInPandas(keep, "i long, j long, b double")


def values_at(values: DataFrame, col: str, ranks: list[int], n: int) -> list[float]:
    """The values at 0-based ``ranks`` of ``n`` rows in ascending order, exact, without sorting all values.

    An approximate quantile pass brackets the ranks (which lie close together);
    one counting pass finds how many values lie below the bracket and in it. The
    values inside are counted per distinct value, so a value that most rows
    share (such as zero) is one row. Few of them are placed on the driver;
    beyond ``FEW_VALUES`` running counts over range partitions place the ranks.
    If the bracket misses (it should not, given the accuracy), all values are
    inside.
    """
    v = F.col(col)
    eps = 2.0 / _BRACKET_ACCURACY
    ends = [max(0.0, min(ranks) / max(1, n - 1) - eps), min(1.0, max(ranks) / max(1, n - 1) + eps)]
    lo_v, hi_v = values.agg(F.percentile_approx(v, ends, _BRACKET_ACCURACY)).first()[0]
    c = values.agg(F.count(F.when(v < lo_v, 1)).alias("below"), F.count(F.when(v <= hi_v, 1)).alias("upto")).first()
    inside, offset, size = values.where((v >= lo_v) & (v <= hi_v)), c["below"], c["upto"] - c["below"]
    if not (c["below"] <= min(ranks) and max(ranks) < c["upto"]):
        inside, offset, size = values, 0, n
    elif lo_v == hi_v:
        return [float(lo_v)] * len(ranks)
    counts = inside.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if size > FEW_VALUES:
        upto = running_sum(counts, [F.col("_v")], "_n", "_upto")
        first = F.col("_upto") + offset - F.col("_n")
        holds = [(first <= r) & (F.lit(r) < F.col("_upto") + offset) for r in ranks]
        rows = [(r["_v"], r["_first"], r["_n"]) for r in upto.select("_v", first.alias("_first"), "_n").where(reduce(or_, holds)).collect()]
    else:
        found = sorted((r["_v"], r["_n"]) for r in counts.collect())
        past = np.cumsum([k for _, k in found]) + offset
        rows = [(x, int(end) - k, k) for (x, k), end in zip(found, past)]
    return [float(next(x for x, begin, k in rows if begin <= r < begin + k)) for r in ranks]


def exact_percentile(values: DataFrame, col: str, q: float) -> float:
    """numpy-style linear-interpolated percentile, exact; 0 for no values."""
    n = values.count()
    if n == 0:
        return 0.0
    pos = q * (n - 1)
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    low, high = values_at(values, col, [lo, hi], n)
    return low + (pos - lo) * (high - low)


def prepare(ratings: DataFrame, implicit: bool = False) -> tuple[DataFrame, int, DataFrame]:
    """(item index, n, Gram entries): the lambda-independent part of a fit.

    The upper triangle is stored while it cannot have more than ``MAX_STORED_GRAM``
    rows. Beyond, every reader multiplies the stored user rows anew, as the
    triangle would take more disk than they and their way to the cells.
    """
    idx = cut_lineage(item_index(ratings))
    upper, most = _upper(ratings, idx, implicit)
    return idx, idx.count(), mirrored(stored(upper, "gram") if most <= MAX_STORED_GRAM else upper)


def fit(
    ratings: DataFrame,
    lam: float,
    sparsity: float = DEFAULT_SPARSITY,
    implicit: bool = False,
    block: int = BLOCK,
    prepared: tuple[DataFrame, int, DataFrame] | None = None,
):
    """Returns (index, weights) with weights as (src_item, dst_item, w).

    ``prepared`` (from ``prepare``) lets a lambda sweep invert the same stored
    Gram matrix for every lambda instead of rebuilding it.
    """
    if prepared is None:
        idx = cut_lineage(item_index(ratings))
        if idx.count() > MAX_DENSE_ITEMS:
            from cinelake.operators import ridge

            index, w = ridge.fit(ratings, [lam], sparsity, implicit)
            return index, w.drop("lam")
    idx, n, g = prepared or prepare(ratings, implicit)
    if not n:
        return idx, ratings.sparkSession.createDataFrame([], "src_item long, dst_item long, w double")
    m = (n + block - 1) // block
    p = invert_blocks(to_blocks(g, n, lam, block), m, block)
    return idx, with_item_ids(block_sparsify(p, n, sparsity, block), idx, "b", "w")


def save_model(index: DataFrame, weights: DataFrame, path: str) -> str:
    """Write a fitted model (item index, sparse weights) as Parquet; an existing model is not overwritten."""
    index.write.mode("errorifexists").parquet(f"{path}/index")
    weights.write.mode("errorifexists").parquet(f"{path}/weights")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved model as (item index, weights); no ratings are needed to recommend with it."""
    index = spark.read.schema("item_id long, idx long").parquet(f"{path}/index")
    return index, spark.read.schema("src_item long, dst_item long, w double").parquet(f"{path}/weights")


def with_item_ids(df: DataFrame, idx: DataFrame, val: str, name: str) -> DataFrame:
    a = broadcast_if_small(idx.select(F.col("idx").alias("i"), F.col("item_id").alias("src_item")), MAX_BROADCAST_ITEMS)
    b = broadcast_if_small(idx.select(F.col("idx").alias("j"), F.col("item_id").alias("dst_item")), MAX_BROADCAST_ITEMS)
    return df.join(a, "i").join(b, "j").select("src_item", "dst_item", F.col(val).alias(name))


def _touched(req: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(request_id, item_id, _s, _rated): per request the items that its ratings reach and those it rates.

    Of a request with ``k`` positive scores among the items it has not rated only
    those from the k-th on are given. The weights are arrays by source item; a
    task sums a few requests at a time in a block of ``CELLS`` numbers.
    """
    table = weights.where("src_item is not null and dst_item is not null and w is not null").toArrow()
    src, dst, w = (table.column(c).to_numpy() for c in ("src_item", "dst_item", "w"))
    order = np.argsort(src, kind="stable")
    sources, begins = np.unique(src[order], return_index=True)
    items, places = np.unique(dst, return_inverse=True)
    shared = weights.sparkSession.sparkContext.broadcast((sources, np.append(begins, len(src)), places[order], w[order], items))
    least = np.iinfo(np.int64).min  # stands for a null request

    def score(ids, item, rating):
        """One batch of requests (sorted, whole) as rows."""
        sources, begins, places, w, items = shared.value
        n = max(1, len(items))
        requests, row = np.unique(ids, return_inverse=True)
        at = np.minimum(np.searchsorted(sources, item), max(0, len(sources) - 1))
        known = np.flatnonzero(sources[at] == item) if len(sources) else np.zeros(0, np.int64)
        begin, size = begins[at[known]], begins[at[known] + 1] - begins[at[known]]
        entry = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        cell = np.repeat(row[known], size) * n + places[entry]
        part = np.repeat(rating[known], size) * w[entry]
        number = ~np.isnan(part)
        cells = len(requests) * n
        total = np.bincount(cell[number], part[number], cells).round(9).reshape(-1, n)
        reached = np.zeros(cells, bool)
        reached[cell] = True
        unknown = reached.copy()  # reached by null ratings only
        unknown[cell[number]] = False
        reached, unknown = reached.reshape(-1, n), unknown.reshape(-1, n)
        rated = np.zeros((len(requests), n), bool)
        if len(items):
            seen = np.minimum(np.searchsorted(items, item), len(items) - 1)
            mine = items[seen] == item
            rated[row[mine], seen[mine]] = True
        good = np.where(reached & ~rated & (total > 0), total, 0.0)
        short = (good > 0).sum(1) < k
        bar = np.full(len(requests), np.inf)
        if not short.all():
            bar[~short] = np.partition(good[~short], n - k, axis=1)[:, n - k]
        r, c = np.nonzero(np.where(short[:, None], reached & ~rated, good >= bar[:, None]))
        marks = np.unique(np.stack([row[short[row]], item[short[row]]]), axis=1)
        out = np.concatenate([requests[r], requests[marks[0]]])
        sums = pa.array(np.concatenate([total[r, c], np.zeros(marks.shape[1])]), mask=np.concatenate([unknown[r, c], np.zeros(marks.shape[1], bool)]))
        columns = [pa.array(out, mask=out == least), pa.array(np.concatenate([items[c], marks[1]])), sums, pa.array(np.arange(len(out)) >= len(r))]
        return pa.RecordBatch.from_arrays(columns, ["request_id", "item_id", "_s", "_rated"])

    def task(batches):
        some = max(1, CELLS // max(1, len(shared.value[4])))
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            kept = [np.concatenate([a, b]) for a, b in zip(kept, (batch.column(0).fill_null(least).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))]
            starts = np.flatnonzero(np.diff(kept[0], prepend=kept[0][:1] - 1))  # the last request may go on in the next batch
            ends = starts[some::some]
            for a, b in zip(np.append(0, ends), ends):
                yield score(*(x[a:b] for x in kept))
            if len(ends):
                kept = [x[ends[-1] :] for x in kept]
        if len(kept[0]):
            yield score(*kept)

    rows = req.where("item_id is not null").select(F.col("request_id").cast("long"), F.col("item_id").cast("long"), F.col("rating").cast("double"))
    return dealt(rows, "request_id").sortWithinPartitions("request_id").mapInArrow(task, "request_id long, item_id long, _s double, _rated boolean")


def recommend(req: DataFrame, index: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Top-k per request: (request_id, item_id, score, rank).

    req: request_id, item_id, rating (already one row per item). Unknown items
    are ignored, rated items never return, every other item is a candidate with
    score 0 if no weight reaches it (zero-fill in item-id order), ties by item_id.

    Plan: while the weights are few enough to ship, the rows are dealt by request
    and a numpy kernel sums the contributions of some requests at a time, so
    only rows that can matter become rows again (``_touched``). Beyond that, one
    aggregate over (request, item) sums the weight contributions and
    marks the rated items (map-side partial aggregation, so a request with many
    ratings is combined before the shuffle). One window per request counts the
    touched items and the positive scores. A request with at least k positive
    scores keeps only those. Any other request needs zero-score items: its first
    ``k - positives + touched`` item slots hold enough untouched ones, so those
    slots are exploded from one of its rows and mapped to item ids through the
    item dictionary (broadcast when its checked size allows, so the rows stay
    partitioned by request and the last aggregate and the top-k window need no
    further shuffle).
    """
    weights = weights.select("src_item", "dst_item", "w")
    # the sparse weights are shipped whole while their counted size allows
    if weights.limit(MAX_BROADCAST_WEIGHTS + 1).count() <= MAX_BROADCAST_WEIGHTS:
        touched = _touched(req, weights, k)
    else:
        contrib = req.join(weights, req.item_id == weights.src_item).select(
            "request_id", F.col("dst_item").alias("item_id"), (F.col("rating") * F.col("w")).alias("_s"), F.lit(False).alias("_rated")
        )
        marks = req.select("request_id", "item_id", F.lit(0.0).alias("_s"), F.lit(True).alias("_rated"))
        touched = contrib.unionByName(marks).groupBy("request_id", "item_id").agg(
            F.bround(F.sum("_s"), 9).alias("_s"), F.max("_rated").alias("_rated")
        )
    per_req = Window.partitionBy("request_id")
    positive = ~F.col("_rated") & (F.col("_s") > 0)
    t = touched.select(
        "*",
        F.count(F.lit(1)).over(per_req).alias("_n"),
        F.count(F.when(positive, 1)).over(per_req).alias("_pos"),
        (F.min("item_id").over(per_req) == F.col("item_id")).alias("_first"),
    )
    short = F.col("_pos") < k
    # a request with k positives drops everything else here; a short one keeps all rows (rated ones too,
    # so that a slot landing on a rated item is removed by the aggregate below)
    t = t.where(short | positive)
    # self rows carry a negative (never matching) key, salted so a shuffle join would stay balanced
    self_key = -1 - F.pmod(F.xxhash64("request_id", "item_id"), F.lit(_SELF_SALT))
    slot_keys = F.when(
        F.col("_first") & short, F.sequence(F.lit(0).cast("long"), F.lit(k) - F.col("_pos") + F.col("_n") - 1)
    ).otherwise(F.array().cast("array<long>"))
    rows = t.select("request_id", "item_id", "_s", "_rated", F.explode(F.concat(F.array(self_key), slot_keys)).alias("_slot"))
    dictionary = broadcast_if_small(index.select(F.col("idx").alias("_slot"), F.col("item_id").alias("_slot_item")), MAX_BROADCAST_ITEMS)
    is_slot = F.col("_slot") >= 0
    cand = (
        rows.join(dictionary, "_slot", "left")
        .where(~is_slot | F.col("_slot_item").isNotNull())
        .select(
            "request_id",
            F.when(is_slot, F.col("_slot_item")).otherwise(F.col("item_id")).alias("item_id"),
            F.when(is_slot, F.lit(0.0)).otherwise(F.col("_s")).alias("_s"),
            F.when(is_slot, F.lit(False)).otherwise(F.col("_rated")).alias("_rated"),
        )
        .groupBy("request_id", "item_id")
        .agg(F.sum("_s").alias("score"), F.max("_rated").alias("_rated"))
        .where(~F.col("_rated"))
        .select("request_id", "item_id", "score")
    )
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
