"""X^T X from packed user rows, without a row per pair of a user's items.

- The rows of X are packed: a record holds whole users, sorted by item, with
  differences between items and codes of values.
- One pass counts the pairs each item begins (itself and the user's later
  items). Ranges of items with about the same number of pairs are the cells.
- The user rows go to the cells: a cell gets of each user that has one of its
  items all items from the first such one on, once, however many pairs they make.
- A cell sums its rows of the upper triangle, some rows at a time, and gives
  finished numbers. Items that begin more pairs than a task should sum are dealt
  over several tasks, and only their rows are added up by another shuffle.

So a pair of items is never shuffled, but for those few items. What a task holds
is bounded by ``PAIRS``, ``ENTRIES`` and ``NUMBERS``, not by the number of items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.session import dealt, stored

#: Bins of the count of pairs by item; pairs of a cell; entries of a packed record; numbers of G that a task holds at once.
BINS = 1 << 16
PAIRS = 1 << 24
ENTRIES = 1 << 20
NUMBERS = 1 << 20
#: Numbers per pair up to which a cell is summed in dense rows (beyond, by sorting); items up to which they are marked in one array.
SPARSE, MARKED = 64, 1 << 24

PACKED = "size binary, col binary, code binary, value binary, gone binary"
ROWS = "i long, j long, gi double"


# ------------------------------------------------------------ packed rows


def _width(n: int) -> int:
    return 4 if n <= 1 << 32 else 8


def _squeeze(size: np.ndarray, col: np.ndarray, n: int) -> tuple[bytes, bytes]:
    """Lengths of rows, and their sorted columns as differences, by byte planes (compressors like them better)."""
    step = np.diff(col, prepend=0)
    start = np.cumsum(size) - size
    step[start] = col[start]
    planes = step.astype(f"<u{_width(n)}").view(np.uint8).reshape(len(step), _width(n)).T
    return size.astype(np.int64).tobytes(), np.ascontiguousarray(planes).tobytes()


def _columns(size: np.ndarray, col: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(col, np.uint8).reshape(_width(n), -1).T
    step = np.ascontiguousarray(planes).view(f"<u{_width(n)}").ravel().astype(np.int64)
    start = np.cumsum(size) - size
    total = np.cumsum(step)
    return total - np.repeat(total[start] - step[start], size)


def _coded(val: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(one code per value, the values they stand for); the values themselves if there are too many different ones."""
    values, code = np.unique(val, return_inverse=True)
    for kind in (np.uint8, np.uint16):
        if len(values) <= np.iinfo(kind).max + 1:
            return code.astype(kind), values.tobytes()
    return val, b""


def _codes(code: bytes, value: bytes, entries: int) -> np.ndarray:
    return np.frombuffer(code, {1: np.uint8, 2: np.uint16, 8: np.float64}[len(code) // max(1, entries) if entries else 8])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), arrow[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _collapsed(user, idx, val, gone) -> tuple:
    """Sorted entries with repeated (user, item) added up; gone ones count only if all are."""
    if not len(idx):
        return user, idx, val, gone
    start = np.flatnonzero(np.append(True, (user[1:] != user[:-1]) | (idx[1:] != idx[:-1])))
    if len(start) == len(idx):
        return user, idx, val, gone
    return user[start], idx[start], np.add.reduceat(np.where(gone, 0.0, val), start), np.logical_and.reduceat(gone, start)


def pack(rows: DataFrame, n: int) -> DataFrame:
    """Packed rows of ``rows (user_id, idx, v)`` as a stored table (``PACKED``).

    Repeated (user, item) add up, null values only among themselves. Rows without
    a user take no part. A user's rows meet in one task and are added up as they
    are read, so a record ends with whole users and holds ``ENTRIES`` and one user at most.
    """

    def record(idx, val, gone, size) -> tuple:
        code, value = _coded(np.where(gone, 0.0, val))
        return (*_squeeze(size, idx, n), code.tobytes(), value, np.packbits(gone).tobytes() if gone.any() else b"")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def full(upto: int) -> pa.RecordBatch:
            user, idx, val, gone = (x[:upto] for x in kept)
            start = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
            return _batch([record(idx, val, gone, np.diff(np.append(start, upto)))], PACKED)

        for batch in batches:
            v = batch.column(2)
            new = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), v.fill_null(0.0).to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False))
            kept = _collapsed(*(new if kept is None else (np.concatenate(x) for x in zip(kept, new))))
            if len(kept[1]) >= ENTRIES:
                whole = int(np.searchsorted(kept[0], kept[0][-1])) if kept[0].dtype != object else int(np.flatnonzero(kept[0] == kept[0][-1])[0])
                if whole:
                    yield full(whole)
                    kept = tuple(x[whole:] for x in kept)
        if kept is not None and len(kept[1]):
            yield full(len(kept[1]))

    placed = dealt(rows.where("user_id is not null").select("user_id", F.col("idx").cast("long"), F.col("v").cast("double")), "user_id")
    return stored(placed.sortWithinPartitions("user_id", "idx").mapInArrow(task, PACKED), "rows")


# ------------------------------------------------------------ cells


def _counted(packed: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(pairs that the items of each bin begin, items of a bin)."""
    per = -(-n // BINS)
    bins = -(-n // per)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for size, col in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = np.frombuffer(size, np.int64)
                item = _columns(size, col, n)
                later = np.repeat(np.cumsum(size), size) - np.arange(len(item))
                total += np.bincount(item // per, later, bins).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bin", "c"])

    out = np.zeros(bins, np.int64)
    for r in packed.select("size", "col").mapInArrow(task, "bin long, c long").groupBy("bin").agg(F.sum("c").alias("c")).collect():  # BINS rows at most
        out[r["bin"]] = r["c"]
    return out, per


def _bounds(pairs: np.ndarray, per: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(first item of each cell, tasks that share it)."""
    total = int(pairs.sum())
    wanted = max(tasks, -(-total // PAIRS))
    done = np.cumsum(pairs) - pairs  # before each bin
    cell = done * wanted // max(1, total)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    work = np.add.reduceat(pairs, first)
    return first * per, np.where(work > 2 * PAIRS, -(-work // PAIRS), 1)


def _keys(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers whose hashes fall into n different partitions of n (where one is not found, two cells share a partition)."""
    out = np.arange(n)
    for r in spark.range(n * (12 + n.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect():
        out[r["p"]] = r["id"]
    return out


def _cut(packed: DataFrame, n: int, bounds: np.ndarray, cells: list[tuple[int, int]], keys: np.ndarray) -> DataFrame:
    """For each cell (first number, tasks) of ``cells`` (by block) the user rows from its first item on; a block without tasks gets none."""
    schema = f"key long, cell int, left binary, {PACKED}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, col, code, value, gone in zip(*(c.to_pylist() for c in batch.columns)):
                size = np.frombuffer(size, np.int64)
                item = _columns(size, col, n)
                code = _codes(code, value, len(item))
                lost = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(item)).astype(bool) if gone else None
                end = np.cumsum(size)
                block = np.searchsorted(bounds, item, side="right") - 1
                first = np.append(True, block[1:] != block[:-1])
                first[end[:-1]] = True
                start = np.flatnonzero(first)
                left = np.diff(np.append(start, len(item)))
                length = np.repeat(end, size)[start] - start
                order = np.argsort(block[start], kind="stable")
                which = block[start][order]
                edges = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
                for a, b in zip(edges[:-1], edges[1:]):
                    cell, shared = cells[which[a]]
                    for k, runs in enumerate(np.array_split(order[a:b], shared) if shared else []):
                        if len(runs):
                            many = length[runs]
                            at = np.repeat(start[runs] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                            missing = np.packbits(lost[at]).tobytes() if lost is not None and lost[at].any() else b""
                            yield _batch([(int(keys[cell + k]), cell + k, left[runs].tobytes(), *_squeeze(many, item[at], n), code[at].tobytes(), value, missing)], schema)

    return packed.mapInArrow(task, schema)


def _compressed(col: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct columns, the place of each column among them)."""
    if n > MARKED:
        return np.unique(col, return_inverse=True)
    mark = np.zeros(n, bool)
    mark[col] = True
    return np.flatnonzero(mark), (np.cumsum(mark) - 1)[col]


def _summed(records: list[tuple], n: int, step: int) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, gi) of the items that a cell's rows begin with, some at a time; ``step`` pairs are multiplied at once."""
    parts = []
    for left, size, col, code, value, gone in records:
        size = np.frombuffer(size, np.int64)
        item = _columns(size, col, n)
        code = _codes(code, value, len(item))
        lost = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(item)).astype(bool) if gone else np.zeros(len(item), bool)
        parts.append((np.frombuffer(left, np.int64), size, item, np.frombuffer(value, np.float64)[code] if value else code, lost))
    left, size, col, val, lost = (np.concatenate(x) for x in zip(*parts))
    del parts
    begin = np.cumsum(size) - size
    at = np.repeat(begin - (np.cumsum(left) - left), left) + np.arange(int(left.sum()))
    stop = np.repeat(begin + size, left)
    order = np.argsort(col[at], kind="stable")
    at, stop = at[order], stop[order]
    first = np.flatnonzero(np.append(True, np.diff(col[at]) != 0))
    rows, ends = col[at[first]], np.append(first[1:], len(at))
    row = np.repeat(np.arange(len(rows)), ends - first)
    items, place = _compressed(col, n)
    width = len(items)
    upto = np.append(0, np.cumsum(stop - at))  # pairs before each entry
    plain = not lost.any() and bool((val > 0).all())  # then a sum is above zero where there is a pair

    def pairs(a: int, b: int, base: int):
        """(number in rows from ``base`` on, product, whether it counts) of the pairs of entries a to b."""
        many = stop[a:b] - at[a:b]
        right = np.repeat(at[a:b] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        key = np.repeat((row[a:b] - base) * width, many) + place[right]
        return key, np.repeat(val[at[a:b]], many) * val[right], None if plain else ~(np.repeat(lost[at[a:b]], many) | lost[right])

    def batch(i, j, g, none) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g, mask=none)], ["i", "j", "gi"])

    dense = len(rows) * width <= SPARSE * int(upto[-1])
    k = 0
    while k < len(rows):
        if dense:
            q = min(len(rows), k + max(1, NUMBERS // width))
        else:
            q = max(k + 1, int(np.searchsorted(upto[ends], upto[first[k]] + step, side="right")))
        a, b = int(first[k]), int(ends[q - 1])
        if not dense and upto[b] - upto[a] <= step:
            key, product, counts = pairs(a, b, k)
            found, at_found = np.unique(key, return_inverse=True)
            ok = slice(None) if counts is None else counts
            g = np.bincount(at_found[ok], product[ok], len(found))
            none = None if counts is None else np.bincount(at_found[ok], minlength=len(found)) == 0
        else:
            cells = (q - k) * width
            total, seen, known = np.zeros(cells), np.zeros(cells, bool), np.zeros(cells, bool)
            while a < b:  # a row that everybody has takes several steps
                c = min(b, max(a + 1, int(np.searchsorted(upto, upto[a] + step, side="right")) - 1))
                key, product, counts = pairs(a, c, k)
                if counts is None:
                    total += np.bincount(key, product, cells)
                else:
                    seen[key] = True
                    known[key[counts]] = True
                    total += np.bincount(key[counts], product[counts], cells)
                a = c
            found = np.flatnonzero(total if plain else seen)
            g, none = total[found], None if plain else ~known[found]
        yield batch(rows[k + found // width], items[found % width], g, none)
        k = q


def upper(packed: DataFrame, n: int, step: int) -> tuple[DataFrame, int]:
    """(rows ``i, j, gi`` of the upper triangle of X^T X, a bound of their number).

    There is a row for every pair of items that a user has (an item with itself as
    well); it is null if no such pair has both values. No users give no rows. Users
    of ``step`` pairs and more are multiplied in steps.
    """
    spark = packed.sparkSession
    counts, per = _counted(packed, n) if n else (np.zeros(1, np.int64), 1)
    if not counts.sum():
        return spark.createDataFrame([], ROWS), 0
    bounds, tasks = _bounds(counts, per, spark.sparkContext.defaultParallelism)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                held[r[0]].append(r[1:])
        while held:
            yield from _summed(held.popitem()[1], n, step)

    def part(chosen: np.ndarray) -> DataFrame:
        shared = np.where(chosen, tasks, 0)
        cells = list(zip((np.cumsum(shared) - shared).tolist(), shared.tolist()))
        total = int(shared.sum())
        keys = _keys(spark, total)
        rows = _cut(packed, n, bounds, cells, keys).repartition(total, "key").drop("key")
        return rows.mapInArrow(product, ROWS)

    alone = tasks == 1
    out = part(alone) if alone.any() else None
    if not alone.all():
        more = part(~alone).groupBy("i", "j").agg(F.sum("gi").alias("gi"))
        out = more if out is None else out.unionByName(more)
    return out, min(int(counts.sum()), n * (n + 1) // 2)
