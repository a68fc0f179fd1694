"""SimHash near-duplicates through a segment-popcount embedding.

Every document gets a 64-bit SimHash of its word shingles. Equal fingerprints
are collapsed first. A fingerprint is embedded as the bit counts of its 32
two-bit segments; the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so links are found by a range join in the
embedded space and verified on the fingerprints.

The range join works on a grid. The embedding is split into two halves of 16
counts: two fingerprints within 3 bits lie within Manhattan distance 1 in at
least one half. The count vector of a half is a grid cell; a fingerprint is
stored in its own cell of each half and probes that cell and the (at most 16)
cells one count above, which meets every pair once from one side or the other.
The full Manhattan bound and the exact distance are part of the join condition,
so only true links leave the join.

Cells that hold more than ``hot_cell`` distinct fingerprints would compare all
their pairs. They are linked by balls instead: a fingerprint visits every value
within 1 bit and every value within 2 bits; two fingerprints within 3 bits meet
in a value that is within 1 bit of one and within 2 bits of the other. All that
meet in a value are linked to one fingerprint that is within 1 bit of it, which
is at most 3 bits from each: no pair is missed, no wrong link is made, and the
rows are linear in the number of fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import arrow_map, cut_lineage
from cinelake.llm.graph import components

SHINGLE = 3
MAX_DISTANCE = 3
HOT_CELL = 2000
_ODD = 0x5555555555555555
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text (null or wordless: 0)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower-cases A-Z, splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, 42)], "<u8")
    else:
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        spans = zip(begins[:-shingle].tolist(), (begins[shingle:] - 1).tolist())
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (the unsigned fingerprint in a signed long) and the long columns ``row`` for every row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *row])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row), rows, "doc_id long, fp long" + "".join(f", {c} long" for c in row))


def _counts(fp: Column) -> Column:
    """The 32 segment bit counts, each as two unary bits, so that Manhattan distance is a bit count of an XOR."""
    shifted = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(F.lit(_ODD))
    both = fp.bitwiseAND(shifted).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(fps: DataFrame) -> DataFrame:
    """Grid cells of both halves: ``fp, cell`` with the half's number above bit 32."""
    unary = _counts(F.col("fp"))
    halves = F.array(unary.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(unary, 32).bitwiseOR(F.lit(1 << 32)))
    return fps.select("fp", F.explode(halves).alias("cell"))


def _probes(cells: DataFrame, radius: int) -> DataFrame:
    """Own cell and, for radius 1, the cells one count above; ``up`` tells them apart."""
    cell = F.col("cell")
    to = [F.struct(cell.alias("cell"), F.lit(False).alias("up"))]
    if radius:
        for i in range(16):
            low, high = 1 << (2 * i), 2 << (2 * i)
            above = F.when(cell.bitwiseAND(F.lit(low)) == 0, cell.bitwiseOR(F.lit(low))).when(cell.bitwiseAND(F.lit(high)) == 0, cell.bitwiseOR(F.lit(high)))
            to.append(F.struct(above.alias("cell"), F.lit(True).alias("up")))
    return cells.select("fp", F.explode(F.array(*to)).alias("to")).select("fp", "to.cell", "to.up").filter("cell is not null")


def _ball_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links that connect all of ``members (fp)`` within ``max_distance`` bits, by shared values."""
    near, far = max_distance // 2, max_distance - max_distance // 2
    masks = [(sum(1 << b for b in bits), n <= near) for n in range(far + 1) for bits in combinations(range(64), n)]
    signed = [(m - (1 << 64) if m >> 63 else m, close) for m, close in masks]
    spark = members.sparkSession
    ball = spark.createDataFrame(signed, "mask long, close boolean")  # 2,081 rows for 3 bits, whatever the input
    visits = members.join(F.broadcast(ball)).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), "close")
    centres = visits.filter("close").groupBy("at").agg(F.min("fp").alias("centre"))
    return visits.select("fp", "at").join(centres, "at").filter("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, hot_cell: int = HOT_CELL) -> DataFrame:
    """``(a, b)`` links over distinct fingerprints ``(fp)``.

    Outside hot cells every pair within ``max_distance`` (0 to 3) bits is
    listed; members of a hot cell are connected by a linear number of links
    with the same components.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two halves of the embedding serve distances from 0 to 3")
    cells = cut_lineage(_cells(fps))
    probes = _probes(cells, max_distance // 2)
    hot = cut_lineage(cells.groupBy("cell").count().filter(F.col("count") > hot_cell).select("cell"))
    extra = None
    if hot.take(1):
        members = cut_lineage(probes.join(hot, "cell", "left_semi").select("fp").distinct())
        extra = _ball_links(members, max_distance)
        cells, probes = cells.join(hot, "cell", "left_anti"), probes.join(hot, "cell", "left_anti")
    a, b = cells.select("cell", F.col("fp").alias("a")), probes.select(F.col("cell").alias("_cell"), F.col("fp").alias("b"), "up")
    bound = F.bit_count(_counts(F.col("a")).bitwiseXOR(_counts(F.col("b")))) <= max_distance
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    found = a.join(b, (F.col("cell") == F.col("_cell")) & (F.col("up") | (F.col("a") < F.col("b"))) & bound & exact)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found if extra is None else found.union(extra).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, hot_cell: int = HOT_CELL, row: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits. Null, empty and wordless texts have
    fingerprint 0 and are linked like any other. Repeated rows give repeated
    results. A null doc_id is never the smallest; where a component has no
    other, its id is null. Other columns are ignored. An empty table gives no rows.

    With ``row``, long columns that tell rows apart, these are passed through
    and ``is_first`` says whether the row is the smallest of its component by
    (doc_id with null last, ``row``).
    """
    prints = cut_lineage(fingerprints(docs, shingle, row))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *row)
    least = [F.min(place).alias("least")] if row else []
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), *least))
    roots = components(links(classes.select("fp"), max_distance, hot_cell)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), *([F.min("least").alias("least")] if row else []))
    found = prints.join(rooted.select("fp", "root").join(smallest, "root").drop("root"), "fp")
    return found.select("doc_id", "fp", "component_id", *row, *([(place == F.col("least")).alias("is_first")] if row else []))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
