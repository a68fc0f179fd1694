"""Corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and gives the reread table to the next
stage. All but the last keep the columns of ``documents``.

1. toxicity: documents that the lexicon scores at 0.7 or more go.
2. line_dedup: lines that have an equal or close line earlier go; a document
   that loses more than half of its characters so, and has no line left that is
   long enough to be compared, was a copy and goes with them.
3. simhash: of each group of near duplicates the row with the smallest doc_id
   stays (null ids last, then by a hash of the row).
4. decontaminate: documents that share a window of 10 words with a benchmark
   item (or hold a whole shorter item) go.
5. bpe: the remaining texts as token ids, checked by decoding them again.

Every row is decided by what it holds: rows with a null doc_id, or with the
doc_id of another row, go like any other. Rows that are equal in all columns and
have a doc_id are one document and stay or go together; of equal rows without
one, one stays. Null and empty
texts count as empty documents: near duplicates of each other in stage 3, and
without tokens in stage 5. Extra columns are carried up to stage 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import bpe, decontaminate, linededup, simhash, toxicity
from cinelake.llm.common import fresh, shared_path, table
from cinelake.llm.queries import byte_bpe, fold
from cinelake.session import broadcast_if_small

#: Rows of a list of ids that may be broadcast.
SMALL = 2_000_000


def _marked(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two hashes of the whole row, and their names."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # Spark hashes no others
    empty = [c.isNull() for c in columns]  # a hash passes over nulls
    one, two = fresh(docs, "_row1"), fresh(docs, "_row2")
    return docs.withColumns({one: F.xxhash64(*columns, *empty), two: F.xxhash64(F.lit("second"), *empty, *columns)}), (one, two)


def _without(docs: DataFrame, rows: DataFrame, row: tuple[str, str]) -> DataFrame:
    """Rows of ``docs`` whose columns ``row`` are not in ``rows``."""
    gone = rows.select(*row).distinct()
    return docs.join(broadcast_if_small(gone.checkpoint(), SMALL), list(row), "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = fold(F.col("doc_id"), 3) != 1
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), train)
    marked, row = _marked(docs)
    return _without(marked, toxicity.scores(marked, lexicon, more=row).filter("predicted = 1"), row).drop(*row)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = fresh(docs, "_before")
    cut = linededup.dedupe(docs.withColumn(before, F.length("text")))
    lost = F.exists("line_classes", lambda x: x["dropped"])
    whole = F.exists(F.split("text", "\n"), lambda line: F.length(line) >= linededup.MIN_CHARS)
    kept = cut.filter(~lost | whole | (2 * F.length("text") >= F.col(before)))
    return kept.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked, row = _marked(docs)
    found = simhash.near_duplicates(marked, shingle=3, max_distance=3, row=row)
    kept = _without(marked, found.filter("not is_first"), row)
    if docs.filter("doc_id is null").take(1):
        kept = kept.filter("doc_id is not null").unionByName(kept.filter("doc_id is null").dropDuplicates(list(row)))
    return kept.drop(*row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked, row = _marked(docs)
    found = decontaminate.overlaps(marked, table(spark, sf_dir, "benchmark"), more=row)
    return _without(marked, found.filter(F.size("spans") > 0), row).drop(*row)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedupe_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Fitting, XXH64 and BPE can't be written in SQL; tests/llm holds the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "llm", f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
