"""Readers and writers with explicit schemas (no inference pass over the data)."""

from __future__ import annotations

import os
import pathlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinelake.sources import once

# Subfolders of the per-user files, and files read into one batch.
USER_FOLDERS = 1024
FILES_PER_BATCH = 1000

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
    ]
)

# imdbId is forced to STRING: ids carry leading zeros.
MOVIES_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("popularity", T.LongType()),
        T.StructField("directedBy", T.StringType()),
        T.StructField("starring", T.StringType()),
        T.StructField("avgRating", T.DoubleType()),
        T.StructField("imdbId", T.StringType()),
        T.StructField("item_id", T.LongType()),
    ]
)

TAG_COUNT_SCHEMA = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("tag_id", T.LongType()), T.StructField("num", T.LongType())]
)
TAGS_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("tag", T.StringType())])

# Plot CSV header as published with the plots corpus.
PLOTS_CSV_SCHEMA = T.StructType(
    [
        T.StructField("Release Year", T.IntegerType()),
        T.StructField("Title", T.StringType()),
        T.StructField("Origin/Ethnicity", T.StringType()),
        T.StructField("Director", T.StringType()),
        T.StructField("Cast", T.StringType()),
        T.StructField("Genre", T.StringType()),
        T.StructField("Wiki Page", T.StringType()),
        T.StructField("Plot", T.StringType()),
    ]
)
PLOTS_RENAME = {
    "Release Year": "year",
    "Title": "title",
    "Origin/Ethnicity": "origin",
    "Director": "directedBy",
    "Cast": "starring",
    "Genre": "genre",
    "Wiki Page": "wikiPage",
    "Plot": "plot",
}

LINKS_SCHEMA = T.StructType([T.StructField("imdbId", T.StringType()), T.StructField("tmdbId", T.StringType())])

POSTERS_SCHEMA = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField(
            "posters",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("iso_639_1", T.StringType()),
                        T.StructField("vote_count", T.LongType()),
                        T.StructField("vote_average", T.DoubleType()),
                        T.StructField("file_path", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines ratings pruned to (user_id, item_id, rating)."""
    return read_json(spark, path, RATINGS_SCHEMA).select("user_id", "item_id", "rating")


def read_movie_names(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines catalogue pruned to (item_id, title, popularity, imdbId), imdbId kept as text."""
    return read_json(spark, path, MOVIES_SCHEMA).select("item_id", "title", "popularity", "imdbId")


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, RFC-4180 quoting (doubled quotes), text kept byte for byte (no whitespace trimming)."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def read_plots_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted multi-line plot text, columns renamed to the catalogue's names."""
    df = (
        spark.read.schema(PLOTS_CSV_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return df.withColumnsRenamed(PLOTS_RENAME)


def read_links_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of id links with ``line``, a number that rises with the position in the files.

    Files are taken in name order; inside a file the split offset and then the
    row order decide, so "the last duplicate wins" does not depend on which
    task read what.
    """
    df = spark.read.schema(LINKS_SCHEMA).option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return df.select("imdbId", "tmdbId", place.alias("line"))


def write_posters(df: DataFrame, path: str) -> str:
    """Nested poster documents: one JSON object per item with its ``posters`` array."""
    return write_json(df.select("item", "posters"), path)


def read_posters(spark: SparkSession, path: str) -> DataFrame:
    """Poster documents as rows (item, pos, iso_639_1, vote_count, vote_average, file_path), pos from 0."""
    docs = read_json(spark, path, POSTERS_SCHEMA)
    return docs.select("item", F.posexplode("posters").alias("pos", "p")).select("item", "pos", "p.*")


def _shared_disk(spark: SparkSession, folder: str) -> str | None:
    """The folder's plain path if the session's file system for it is a mounted disk, else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _user_folder(root: str, number: int) -> str:
    return f"{root}/users={number:04d}"


def write_user_files(df: DataFrame, folder: str, suffix: str, key: str = "user_id", col: str = "content") -> str:
    """Per-user text files ``<user_id>_<suffix>`` under ``folder``, the text written as is.

    One small file per user by definition; ``write_user_table`` is the form for
    many users.
    """
    return write_user_kinds(df, folder, {suffix: col}, key)


def write_user_kinds(df: DataFrame, folder: str, kinds: dict[str, str], key: str = "user_id") -> str:
    """Per-user text files of several kinds (suffix -> column) in one pass over the rows.

    On a mounted disk the tasks write the files themselves, spread over
    ``USER_FOLDERS`` subfolders: Hadoop's local file system starts a ``chmod``
    process per folder and file and adds a checksum file, and the commit moves every file on
    the driver. Elsewhere Spark's text writer puts each into a folder of its own.
    Texts of a repeated user are lines of one file.
    """
    root = _shared_disk(df.sparkSession, folder)
    if root is None:
        for suffix, col in kinds.items():
            named = df.select(F.concat(F.col(key).cast("string"), F.lit(f"_{suffix}")).alias("file"), col)
            named.repartition("file").write.mode("append").partitionBy("file").text(folder)
        return folder
    suffixes = list(kinds)
    texts = [F.array_join(F.collect_list(F.coalesce(F.col(c), F.lit(""))), "\n").alias(f"_{i}") for i, c in enumerate(kinds.values())]
    rows = df.groupBy(key).agg(*texts).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_user"), *[f"_{i}" for i in range(len(suffixes))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        mark = uuid.uuid4().hex  # of this attempt: a file gets its name when it is whole
        for batch in batches:
            users, *cols = (c.cast(pa.binary()).to_pylist() for c in batch.columns)
            for user, *values in zip(users, *cols):
                at = _user_folder(root, zlib.crc32(user) % USER_FOLDERS)
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                for suffix, value in zip(suffixes, values):
                    name = f"{quote(user, safe='')}_{suffix}"
                    with open(f"{at}/.{mark}", "wb") as f:
                        f.write(value)
                    os.replace(f"{at}/.{mark}", f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(users)], pa.int64())], names=["n"])

    rows.mapInArrow(task, "n long").agg(F.sum("n")).collect()
    return folder


def read_user_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """The files of one suffix: (user_id, content), read whole, sorted by user.

    The suffix selects the names before anything is read, and the id comes from
    the name. On a mounted disk each task lists and reads subfolders of its own.
    """
    root = _shared_disk(spark, folder)
    if root is None:
        df = spark.read.text(f"{folder}/file=*_{suffix}", wholetext=True)
        user = F.regexp_extract(F.col("_metadata.file_path"), rf"file=(\d+)_{re.escape(suffix)}/[^/]*$", 1)
        # the text writer ends a file with a newline; it is removed again
        rows = df.select(user.alias("user_id"), F.expr("substring(value, 1, length(value) - 1)").alias("content"))
        return rows.where("user_id <> ''").withColumn("user_id", F.col("user_id").cast("long")).orderBy("user_id")
    named = re.compile(rf"([0-9]+)_{re.escape(suffix)}", re.ASCII)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            at = _user_folder(root, number)
            found = [m for m in map(named.fullmatch, os.listdir(at)) if m] if os.path.isdir(at) else []
            for i in range(0, len(found), FILES_PER_BATCH):
                part = found[i : i + FILES_PER_BATCH]
                texts = [pathlib.Path(at, m.group()).read_bytes() for m in part]
                yield pa.RecordBatch.from_arrays([pa.array([m.group(1) for m in part]), pa.array(texts, pa.binary()).cast(pa.string())], names=["user_id", "content"])

    tasks = min(USER_FOLDERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.range(0, USER_FOLDERS, 1, tasks).mapInArrow(task, "user_id string, content string")
    return rows.withColumn("user_id", F.col("user_id").cast("long")).orderBy("user_id")


def write_user_table(df: DataFrame, path: str, key: str = "user_id") -> str:
    """Per-user texts as Parquet, clustered by user: the sink for many users."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    return path


def write_per_user_text(df: DataFrame, folder: str, key: str = "user_id", col: str = "content") -> str:
    """Per-entity text sink: one directory per key (``key=<id>``), the text written as is."""
    df.select(key, col).repartition(key).write.mode("errorifexists").partitionBy(key).text(folder)
    return folder


def read_per_user_text(spark: SparkSession, folder: str, key: str = "user_id") -> DataFrame:
    """Inverse of ``write_per_user_text``: whole files, key parsed from the directory name.

    The text writer ends every row with a newline; it is removed again.
    """
    df = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    v = F.col("value")
    return df.select(
        F.regexp_extract(path, key + r"=(\d+)/", 1).cast("long").alias(key),
        F.expr("substring(value, 1, length(value) - 1)").alias("content"),
    ).where(F.length(v) > 0)


ID_SCHEMA = T.StructType([T.StructField("user_id", T.LongType())])


def write_id_list(ids: DataFrame, path: str) -> str:
    """User ids as JSON lines, one id per row, over as many files as there are partitions."""
    ids.select(F.col("user_id").cast("long")).write.mode("errorifexists").json(path)
    return path


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ID_SCHEMA).json(path)


def chosen_once(spark: SparkSession, choose: Callable[[], DataFrame], path: str) -> DataFrame:
    """The ids committed under ``path``; only if there are none, ``choose()`` draws them and they are committed.

    A folder without a commit mark, as a writer leaves that died, is no cohort;
    of two sessions that draw at once the first to commit wins for both.
    """
    found, _ = once.write_once(spark, path, lambda data: write_id_list(choose(), data))
    return read_id_list(spark, found)
