"""Corpus curation: dedupe, title cleaning, activity and support filters, split.

Every step is a DataFrame transformation; membership filters are semi/anti
joins so Catalyst can pick broadcast or shuffle joins from the real sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import text as T
from cinelake.operators.indexing import global_row_number
from cinelake.session import broadcast_if_small, stored

# Largest user table broadcast to the ratings.
MAX_BROADCAST_USERS = 2_000_000
# Largest item table broadcast to the ratings.
MAX_BROADCAST_ITEMS = 2_000_000


def dedup_first(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Keep, per key, the values of the first row in ``order`` (pandas ``drop_duplicates`` keep='first').

    ``min_by`` over a struct runs as a hash aggregate with a map-side partial
    step, so a key repeated millions of times is reduced before the shuffle.
    """
    if len(values) == 1 and len(order) == 1:
        # numeric value and order: the aggregate buffer is fixed-width, so Spark hash-aggregates
        return df.groupBy(*keys).agg(F.min_by(values[0], order[0]).alias(values[0]))
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])


def clean_titles(titles: DataFrame) -> DataFrame:
    """strip -> year from ``(YYYY)`` at the end (rows without are dropped) -> article moved -> ``tt`` id."""
    t = T.py_strip("title")
    out = titles.select("item_id", t.alias("title"), T.title_year(t).alias("year"), "imdb_raw").where(F.col("year").isNotNull())
    name = T.title_without_year("title")
    year_text = F.substring(F.col("title"), -6, 6)
    return out.select(
        "item_id",
        F.concat(T.move_article(name), F.lit(" "), year_text).alias("title"),
        "year",
        T.imdb_id("imdb_raw").alias("imdb_id"),
    )


def popularity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))


def catalogue(clean: DataFrame, train: DataFrame) -> DataFrame:
    """Curated catalogue: titled items with ratings in the train split (inner join), with their number as popularity and its rank."""
    movies = clean.join(popularity(train), "item_id")
    return global_row_number(movies, [F.col("popularity").desc(), F.col("item_id")], "pop_rank")


def active_users(ratings: DataFrame, movies: DataFrame, min_year: int = 2015) -> DataFrame:
    """Ratings of titled items by users who rated at least one item from ``min_year`` on."""
    # of a catalogue of any size only the rated items are looked up, so the ratings need no shuffle by item
    rated = broadcast_if_small(ratings.select("item_id").distinct(), MAX_BROADCAST_ITEMS)
    rated = stored(movies.join(rated, "item_id", "left_semi").groupBy("item_id").agg(F.max(F.col("year") >= min_year).alias("_recent")), "rated-items")
    titled = ratings.join(broadcast_if_small(rated, MAX_BROADCAST_ITEMS), "item_id")
    users = stored(titled.where("_recent").select("user_id").distinct(), "active-users")
    return titled.select(*ratings.columns).join(broadcast_if_small(users, MAX_BROADCAST_USERS), "user_id", "left_semi")


def popular_items(ratings: DataFrame, min_ratings: int = 20) -> DataFrame:
    keep = stored(popularity(ratings).where(F.col("popularity") >= min_ratings).select("item_id"), "popular-items")
    return ratings.join(broadcast_if_small(keep, MAX_BROADCAST_ITEMS), "item_id", "left_semi")


def restrict_items(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rows of a table with ``item_id`` (catalogue, tag counts) whose item is still rated in ``ratings``."""
    return df.join(ratings.select("item_id"), "item_id", "left_semi")


def seeded_order(key: Column | str, seed: int) -> Column:
    """Reproducible, partition-independent random order: md5 of ``key:seed``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(":"), F.lit(str(seed))))


def choose_test_users(ratings: DataFrame, n_users: int = 1000, min_ratings: int = 25, seed: int = 42) -> DataFrame:
    """Random choice of ``n_users`` users having at least ``min_ratings`` ratings (a sampling operator)."""
    counts = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    eligible = counts.where(F.col("n") >= min_ratings).select("user_id")
    return eligible.orderBy(seeded_order("user_id", seed), "user_id").limit(n_users)


def train_test_split(ratings: DataFrame, n_users: int = 1000, min_ratings: int = 25, seed: int = 42) -> DataFrame:
    """User-disjoint split: a ``split`` column, 'test' for the chosen users."""
    test = stored(choose_test_users(ratings, n_users, min_ratings, seed).withColumn("_test", F.lit(True)), "test-users")
    return (
        ratings.join(broadcast_if_small(test, MAX_BROADCAST_USERS), "user_id", "left")
        .select("user_id", "item_id", "rating", F.when(F.col("_test"), "test").otherwise("train").alias("split"))
    )


def split_checks(split: DataFrame) -> DataFrame:
    """One row of booleans: train covers every item, and no user is on both sides."""
    is_train = F.col("split") == "train"
    per_user = split.groupBy("user_id").agg(
        F.max(is_train.cast("int")).alias("_in_train"), F.max((~is_train).cast("int")).alias("_in_test")
    )
    per_item = split.groupBy("item_id").agg(F.max(is_train.cast("int")).alias("_in_train"))
    # both summaries in one global aggregate over the union (no join of two one-row tables)
    nul = F.lit(None).cast("long")
    users = per_user.select(
        (F.col("_in_train") * F.col("_in_test")).cast("long").alias("_shared"),
        F.col("_in_train").cast("long").alias("_tr_u"),
        F.col("_in_test").cast("long").alias("_te_u"),
        nul.alias("_item"),
        nul.alias("_tr_i"),
    )
    items = per_item.select(nul.alias("_shared"), nul.alias("_tr_u"), nul.alias("_te_u"), F.lit(1).cast("long").alias("_item"), F.col("_in_train").cast("long").alias("_tr_i"))
    both = users.unionByName(items).agg(
        F.coalesce(F.sum("_shared"), F.lit(0)).alias("n_shared_users"),
        F.coalesce(F.sum("_tr_u"), F.lit(0)).alias("n_train_users"),
        F.coalesce(F.sum("_te_u"), F.lit(0)).alias("n_test_users"),
        F.count("_item").alias("n_items"),
        F.coalesce(F.sum("_tr_i"), F.lit(0)).alias("n_train_items"),
    )
    return both.select(
        (F.col("n_train_items") == F.col("n_items")).alias("train_covers_all_items"),
        (F.col("n_shared_users") == 0).alias("users_disjoint"),
        "n_items",
        "n_train_users",
        "n_test_users",
    )


def corpus_stats(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows, distinct users and distinct items per curation stage."""
    out = None
    for i, (name, df) in enumerate(stages):
        s = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct("user_id").alias("n_users"),
            F.countDistinct("item_id").alias("n_items"),
        ).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n_rows", "n_users", "n_items")
        out = s if out is None else out.unionByName(s)
    return out


def tag_usage(tags: DataFrame, tag_count: DataFrame) -> DataFrame:
    """Tags with their total count, ranked by usage (tags never used disappear)."""
    totals = tag_count.groupBy("tag_id").agg(F.sum("num").cast("long").alias("total"))
    joined = tags.join(totals, tags.id == totals.tag_id).select(F.col("id").alias("tag_id"), "tag", "total")
    return global_row_number(joined, [F.col("total").desc(), F.col("tag_id")], "usage_rank")
