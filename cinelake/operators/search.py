"""Ranked title and tag search for a whole table of search terms at once.

Titles have a stored inverted index: for every lower-case gram of one to three
characters the titles that hold it, sorted by gram, and a table of how many do.
A term looks up the frequencies of the grams of its literal chunks (the parts
between LIKE wildcards), probes with its rarest ones, and the exact ILIKE test
runs on the titles that all of them name. Tags have a sorted dictionary of their
words: the words that start with a term are a range of it, found by one sort of
words and terms together, and joined by buckets of consecutive words. No product
of terms and titles or tags is formed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.functions import text as T
from cinelake.operators.indexing import running_sum
from cinelake.session import cut_lineage, shared_path

# Fixed value: number of titles returned per search.
TITLE_K = 15
# Longest gram; grams of a term that are probed; words in a bucket of the dictionary.
GRAM, PROBES, BUCKET = 3, 3, 256
# Tasks over which the answers to blank terms are spread.
SPREAD = 32


def _is_blank(term: str = "term") -> F.Column:
    return T.py_strip(term) == ""


def _windows(text: F.Column, sizes: range) -> F.Column:
    """Distinct substrings of ``text`` of the given sizes."""

    def of_size(n: int) -> F.Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda at: F.substring(text, at, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


@dataclass
class TitleIndex:
    """``postings (gram, item_id)`` sorted by gram, and ``frequencies (gram, n)``, as stored tables."""

    postings: DataFrame
    frequencies: DataFrame


def build_title_index(movies: DataFrame, path: str | None = None) -> TitleIndex:
    """The index of ``movies (item_id, title)``, written to ``path`` (a fresh shared folder by default)."""
    spark = movies.sparkSession
    path = path or shared_path(spark, "title_index")
    title = F.lower(F.col("title"))
    grams = movies.select("item_id", F.explode(_windows(title, range(1, GRAM + 1))).alias("gram")).distinct()
    grams.select("gram", "item_id").repartitionByRange("gram", "item_id").sortWithinPartitions("gram", "item_id").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/frequencies")
    return open_title_index(spark, path)


def open_title_index(spark: SparkSession, path: str) -> TitleIndex:
    """A stored index; any process that knows the path can search with it."""
    return TitleIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"))


def relevance(title: F.Column, term: F.Column) -> F.Column:
    """First word (whitespace split of the lower-cased title) containing the term:
    1/(i+1) if it starts with the term, 0.1/(i+1) otherwise; 0 if none."""
    words = F.split(F.lower(title), r"\s+")
    t = F.lower(term)
    pos = F.array_position(F.transform(words, lambda w: w.contains(t)), True)
    word = F.element_at(words, F.greatest(pos, F.lit(1)).cast("int"))
    return (
        F.when(pos == 0, F.lit(0.0))
        .when(word.startswith(t), F.lit(1.0) / pos)
        .otherwise(F.lit(0.1) / pos)
    )


def _named(asked: DataFrame, index: TitleIndex) -> DataFrame:
    """``t, item_id``: titles that hold the rarest grams of ``asked (t, grams)``.

    A gram that no title holds comes first and finds nothing. What is read is
    the postings of the rarest grams, whatever common grams a term has besides.
    """
    grams = asked.select("t", F.explode("grams").alias("gram")).join(index.frequencies, "gram", "left").na.fill(0, ["n"])
    rarest = grams.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy("n", "gram"))).where(F.col("_r") <= PROBES)
    probes = rarest.join(asked.select("t", F.least(F.size("grams"), F.lit(PROBES)).alias("_all")), "t").select("t", "gram", "_all")
    found = probes.join(index.postings, "gram").groupBy("t", "item_id").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    return found.where(F.col("_n") == F.col("_all")).select("t", "item_id")


def _first_long_enough(asked: DataFrame, movies: DataFrame, k: int) -> DataFrame:
    """``t, item_id``: for terms of wildcards only, the ``k`` most popular titles with as many characters as it has ``_``.

    Such a term matches titles by their length alone. Costs one pass over the
    titles, which keeps ``k`` of each length, and the lengths from a term's on.
    """
    size = F.length("title")
    per_length = movies.select("item_id", "pop_rank", size.alias("_len")).withColumn("_r", F.row_number().over(Window.partitionBy("_len").orderBy("pop_rank"))).where(F.col("_r") <= k).drop("_r")
    longest = per_length.agg(F.max("_len").alias("_longest"))
    least = asked.select("t", (F.length("t") - F.length(F.replace("t", F.lit("_"), F.lit("")))).alias("_least"))
    wanted = least.select("_least").distinct().join(F.broadcast(longest))  # one row
    lengths = wanted.where(F.col("_least") <= F.col("_longest")).select("_least", F.explode(F.sequence("_least", "_longest")).alias("_len"))
    first = lengths.join(per_length, "_len").withColumn("_r", F.row_number().over(Window.partitionBy("_least").orderBy("pop_rank"))).where(F.col("_r") <= k)
    return least.join(first.select("_least", "item_id"), "_least").select("t", "item_id")


def title_search(terms: DataFrame, movies: DataFrame, k: int = TITLE_K, index: TitleIndex | None = None) -> DataFrame:
    """terms: (term_id, term); movies: (item_id, title, popularity, pop_rank) -> (term_id, rank, item_id, title).

    Terms that differ in case only are searched once. ``index`` takes a stored
    index of the same titles; without one it is built first.
    """
    blank = terms.where(_is_blank())
    # blank term: the first k titles in popularity order. pop_rank is unique, so ``top`` has at most
    # k rows (a proven bound) and each blank term joins it on the rank it asks for.
    top = movies.where(F.col("pop_rank") <= k).select("item_id", "title", F.col("pop_rank").alias("rank"))
    first = blank.select("term_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank")).join(
        F.broadcast(top), "rank"
    )

    index = index or build_title_index(movies)
    lowered = terms.where(~_is_blank()).select("term_id", F.lower("term").alias("t"))
    distinct = cut_lineage(lowered.select("t").distinct())
    chunks = F.filter(F.split("t", "[%_]", -1), lambda c: F.length(c) > 0)
    chunk_grams = F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) < GRAM, F.array(c)).otherwise(_windows(c, range(GRAM, GRAM + 1)))))
    literal = distinct.where(F.size(chunks) > 0).select("t", F.array_distinct(chunk_grams).alias("grams"))
    wild = distinct.where(F.size(chunks) == 0)
    # a title that holds the wildcards as they stand is relevant; all others of a wildcard term score 0 and rank by popularity
    as_text = wild.select("t", F.when(F.length("t") < GRAM, F.array("t")).otherwise(_windows(F.col("t"), range(GRAM, GRAM + 1))).alias("grams"))
    cand = _named(literal.unionByName(as_text), index).unionByName(_first_long_enough(wild, movies, k)).distinct()
    cand = cand.join(movies.select("item_id", "title", "popularity", "pop_rank"), "item_id")
    # only % and _ are wildcards: a backslash of the term stands for itself
    hit = cand.where(F.expr(r"""title ILIKE concat('%', replace(t, '\\', '\\\\'), '%')"""))
    scored = hit.withColumn("_score", F.col("popularity") * relevance(F.col("title"), F.col("t")))
    w = Window.partitionBy("t").orderBy(F.col("_score").desc(), F.col("pop_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ranked = lowered.join(ranked, "t")
    return ranked.select("term_id", "rank", "item_id", "title").unionByName(first.select("term_id", "rank", "item_id", "title"))


def prefix_ranges(words: DataFrame, prefixes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``p, w``: the words of ``words (w)`` that start with a prefix of ``prefixes (p)``; both distinct, no nulls, p not empty.

    Words and prefixes are sorted together once: the number of words before a
    prefix, and before the first text that no longer starts with it, are the ends
    of its range of word numbers. Ranges meet words by buckets of consecutive
    numbers, so the join reads what it returns and at most two buckets more per
    prefix, however many words share a beginning.
    """
    p = F.col("p").cast("binary")
    past = F.concat(p, F.unhex(F.lit("FF")))  # a byte that no text holds: behind every text that goes on from p
    marks = words.select(F.col("w").cast("binary").alias("key"), F.lit(1).alias("kind"), F.lit(1).alias("one"))
    marks = marks.unionByName(prefixes.select(p.alias("key"), F.lit(0).alias("kind"), F.lit(0).alias("one")))
    marks = marks.unionByName(prefixes.select(past.alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("one")))
    numbered = cut_lineage(running_sum(marks, ["key", "kind"], "one", "n"))
    begin = numbered.where("kind = 0").select(F.col("key").cast("string").alias("p"), F.col("n").alias("_lo"))
    end = numbered.where("kind = 2").select(F.expr("cast(substring(key, 1, length(key) - 1) as string)").alias("p"), F.col("n").alias("_hi"))
    ranges = begin.join(end, "p").where("_hi > _lo").select("p", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {bucket}, (_hi - 1) div {bucket})")).alias("_bucket"))
    entries = numbered.where("kind = 1").select(F.col("key").cast("string").alias("w"), "n", F.expr(f"(n - 1) div {bucket}").alias("_bucket"))
    return ranges.join(entries, "_bucket").where("n > _lo and n <= _hi").select("p", "w")


def tag_search(terms: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags having a word that starts with the lower-cased term; a blank term returns every tag.

    The dictionary has one row per different word. The answers to blank terms
    are terms times tags by definition; they are spread over ``SPREAD`` keys.
    """
    words = tags.select("id", "tag", F.explode(F.split(F.lower("tag"), r"\s+")).alias("w")).where("w <> ''").distinct()
    asked = terms.where(~_is_blank()).select("term_id", F.lower("term").alias("p"))
    found = prefix_ranges(words.select("w").distinct(), asked.select("p").distinct()).join(words, "w")
    hits = asked.join(found, "p").select("term_id", F.col("id").alias("tag_id"), "tag").distinct()
    every = tags.select(F.col("id").alias("tag_id"), "tag", F.pmod(F.xxhash64("id", "tag"), F.lit(SPREAD)).cast("int").alias("_s")).distinct()
    blank = terms.where(_is_blank()).select("term_id", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_s")).distinct()
    return hits.unionByName(blank.join(every, "_s").select("term_id", "tag_id", "tag"))
