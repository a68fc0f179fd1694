"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id,
level 1 the next chunk of the ids that need one, and so on; a bitmap beside
each level marks the ids that continue, and a rank directory holds the number
of marks before every 512th bit. Token i of a block is read by following its
position through the levels (``access``): its position in the next level is
the rank of its mark, so nothing else is decoded.

A block is the bytes

    "DAC1", u32 levels, u64 ids, then for each level:
    u64 entries, the chunks (u8 each), the bitmap (bit i of the level at bit
    i % 8 of byte i / 8), the directory (u32 each)

with little-endian numbers. The file format is Parquet rows ``part, first,
doc_ids, sizes, n_tokens, codes``: a block of whole documents in ascending
doc_id order, the position of its first token within its part, and its codes.
Parts are ranges of documents in ascending order, so a token's position in the
corpus is its part's offset (a sum over one number per part) plus its position
in the part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.llm import bpe
from cinelake.llm.common import arrow_map, cut_lineage, slices, worker_memo

END_ID = 0
#: Ids of a block, and bits between entries of the rank directory.
BLOCK, STRIDE = 1 << 18, 512
_FILE = "part int, first long, doc_ids array<long>, sizes array<long>, n_tokens long, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """One block of non-negative ids."""
    rest, levels = np.asarray(ids, np.uint64), []
    while True:
        more = rest > 255
        marks = np.packbits(more, bitorder="little")
        per_stride = np.add.reduceat(more, np.arange(0, len(more), STRIDE), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_stride)])[:-1].astype("<u4") if len(more) else per_stride
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint64(255)).astype(np.uint8).tobytes() + marks.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            return struct.pack("<4sIQ", b"DAC1", len(levels), len(ids)) + b"".join(levels)


def _levels(codes: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap bytes and directory of each level, without copies."""
    magic, levels, _ = struct.unpack_from("<4sIQ", codes)
    if magic != b"DAC1":
        raise ValueError("not a block of directly addressable codes")
    at = 16
    for _ in range(levels):
        (n,) = struct.unpack_from("<Q", codes, at)
        chunks = np.frombuffer(codes, np.uint8, n, at + 8)
        marks = np.frombuffer(codes, np.uint8, -(-n // 8), at + 8 + n)
        ranks = np.frombuffer(codes, "<u4", -(-n // STRIDE), at + 8 + n + len(marks))
        at += 8 + n + len(marks) + 4 * len(ranks)
        yield chunks, marks, ranks


def access(codes: bytes, i: int) -> int:
    """Id number ``i`` of a block, from one chunk, bit and directory entry of each level."""
    if not 0 <= i < struct.unpack_from("<4sIQ", codes)[2]:
        raise IndexError(i)
    value = shift = 0
    for chunks, marks, ranks in _levels(codes):
        value |= int(chunks[i]) << shift
        if not marks[i >> 3] >> (i & 7) & 1:
            break
        begin = i // STRIDE * STRIDE
        before = np.bitwise_count(marks[begin >> 3 : i >> 3]).sum(dtype=np.int64) + (int(marks[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        i, shift = int(ranks[begin // STRIDE] + before), shift + 8
    return value


def unpack(codes: bytes) -> np.ndarray:
    """All ids of a block."""
    out: np.ndarray | None = None
    where = np.zeros(0, np.int64)
    for level, (chunks, marks, _) in enumerate(_levels(codes)):
        if out is None:
            out, where = chunks.astype(np.uint64), np.arange(len(chunks))
        else:
            out[where] |= chunks.astype(np.uint64) << np.uint64(8 * level)
        where = where[np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)]
    return out


class _Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    The same vocabulary runs in tiktoken, which is several times faster; texts
    with characters on whose class Unicode versions differ, or with the string
    of an added token, go to the tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        model = bpe.load(path)
        ranks = {b: i for i, b in model.bytes_of.items() if i not in set(model.added.values())}
        self.fast = tiktoken.Encoding("file", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={}) if model.made == sorted(model.made) else None
        self.slow = regex.compile("|".join([bpe._ODD.pattern, *map(regex.escape, model.added)]))

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.slow.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def write(docs: DataFrame, path: str, tokenizer: str, block: int = BLOCK) -> None:
    """Write the ids of ``docs (doc_id, text)`` as code blocks into the folder ``path``.

    Documents follow in ascending doc_id (null first; rows of one doc_id in the
    order of a hash of their text), each with id 0 appended. Null and empty
    texts have the end id only; very long ones are encoded whole and a document is
    never split over blocks. Other columns are ignored; an empty table gives a
    folder without blocks.

    The ranges are cut on the id, the hash and a number of the row, so an id that
    many rows share, or equal rows, spread over as many tasks as any others.
    """
    name = bpe.shipped(docs, tokenizer)
    text = F.col("text").cast("string")
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("number"))
    ordered = key.repartitionByRange("doc_id", "hash", "number").sortWithinPartitions("doc_id", "hash", "number").select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memo(f"dac.{name}", lambda: _Encoder(SparkFiles.get(name)))
        part, first, ids, parts, sizes = TaskContext.get().partitionId(), 0, [], [], []

        def row() -> pa.RecordBatch:
            codes = pack(np.concatenate(parts))
            values = [[part], [first], [ids], [sizes], [sum(sizes)], [codes]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "first", "doc_ids", "sizes", "n_tokens", "codes"])

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = encode(text or "")
                ids.append(doc)
                parts += [tokens, np.array([END_ID], np.uint32)]
                sizes.append(len(tokens) + 1)
                if sum(sizes[-1:]) >= block or len(ids) % 64 == 0 and sum(sizes) >= block:
                    yield row()
                    first += sum(sizes)
                    ids, parts, sizes = [], [], []
        if ids:
            yield row()

    ordered.mapInArrow(blocks, _FILE).write.option("compression", "zstd").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """``first, n_tokens, doc_ids, sizes, codes`` of every block; ``first`` counts the ids of all blocks before it."""
    files = spark.read.schema(_FILE).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row for each part
    offsets = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), F.col("part") == F.col("_part")).select((F.col("first") + F.col("offset")).alias("first"), "n_tokens", "doc_ids", "sizes", "codes")


#: Positions of a block that meet its codes in one row.
TOGETHER = 4096


def lookup(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``position, token`` for every row of ``positions (position)``: single ids of the corpus, read without decoding their blocks.

    The blocks' first positions and sizes are read without their codes, a
    position finds its block by its rank among them, and the codes of the
    blocks that are asked for go to their positions, which are gathered in
    bounded groups. Null positions and those outside the corpus give a null
    token; repeated positions give repeated rows; an empty table, or an empty
    corpus, gives what those rules say.
    """
    asked = positions.select(F.col("position").cast("long").alias("position"))
    heads = _placed(spark, path).select("first", "n_tokens").filter("n_tokens > 0")
    # heads and positions in one order: the last head at or before a position is its block's
    marks = heads.select(F.col("first").alias("at"), F.lit(0).alias("kind"), (F.col("first") + F.col("n_tokens")).alias("past"))
    inside = asked.filter("position is not null").select(F.col("position").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("past"))
    ordered = cut_lineage(marks.unionByName(inside).repartitionByRange("at", "kind", F.rand(8)).sortWithinPartitions("at", "kind").withColumn("task", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id()))
    here = Window.partitionBy("task").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    carried = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(F.col("kind") == 0, F.struct(F.col("at").alias("first"), "past"))
    last = ordered.groupBy("task").agg(F.max(head).alias("head"))  # one row for each task
    earlier = last.select("task", F.max("head").over(carried).alias("earlier"))
    found = ordered.withColumn("head", F.max(head).over(here)).join(F.broadcast(earlier), "task").filter("kind = 1")
    found = found.select(F.col("at").alias("position"), F.coalesce("head", "earlier").alias("head"), "no")
    found = cut_lineage(found.select("position", "no", F.when(F.col("position") < F.col("head.past"), F.col("head.first")).alias("first")))
    groups = found.filter("first is not null").withColumn("share", F.pmod(F.xxhash64("no"), F.lit(1 << 20)))
    crowd = groups.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("shares"))
    groups = groups.join(crowd, "first").groupBy("first", F.pmod("share", "shares").alias("share")).agg(F.collect_list("position").alias("positions"))
    met = _placed(spark, path).select("first", "codes").join(groups, "first").select("first", "positions", "codes")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            first, wanted, codes = (batch.column(c)[i].as_py() for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([access(codes, p - first) for p in wanted], pa.int64())], ["position", "token"])

    nowhere = found.filter("first is null").select("position").unionByName(asked.filter("position is null"))
    return arrow_map(met, rows, "position long, token long").unionByName(nowhere.select("position", F.lit(None).cast("long").alias("token")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` counts the ids of all documents before it, ``n_tokens`` the ids
    with the end id, ``ids_crc32`` is the CRC of the ids as little-endian
    unsigned 32-bit integers. A folder without blocks gives no rows.
    """
    placed = _placed(spark, path).select("first", "doc_ids", "sizes", "codes")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            first, doc_ids, sizes, codes = (batch.column(c)[i].as_py() for c in range(4))
            data = unpack(codes).astype("<u4")
            past = np.cumsum(sizes)
            crc = [zlib.crc32(data[b - n : b].tobytes()) for b, n in zip(past.tolist(), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + past - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(placed, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
