"""Composed pipelines over the fixture views (shared by several queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.operators import curate
from cinelake.operators.requests import valid_importance
from cinelake.plans import views as V
from cinelake.session import session_key, stored

SEED = 42
MIN_YEAR = 2015
MIN_ITEM_RATINGS = 20
TEST_USERS = 1000
TEST_MIN_RATINGS = 25


@V._memo
def titled_ratings(spark: SparkSession, d: str) -> DataFrame:
    return V.ratings(spark, d).join(V.clean_titles(spark, d).select("item_id"), "item_id", "left_semi")


@V._stored
def active(spark: SparkSession, d: str) -> DataFrame:
    return curate.active_users(V.ratings(spark, d), V.clean_titles(spark, d), MIN_YEAR)


@V._memo
def popular(spark: SparkSession, d: str) -> DataFrame:
    return curate.popular_items(active(spark, d), MIN_ITEM_RATINGS)


@V._memo
def split(spark: SparkSession, d: str) -> DataFrame:
    """The curated corpus with its split, written once to the shared folder (as the curation step
    writes its train/test files) so every later stage reads it instead of re-deriving it."""
    return stored(curate.train_test_split(popular(spark, d), TEST_USERS, TEST_MIN_RATINGS, SEED), "split")


@V._memo
def active_movies(spark: SparkSession, d: str) -> DataFrame:
    return curate.restrict_items(V.clean_titles(spark, d), active(spark, d))


@V._memo
def active_tag_count(spark: SparkSession, d: str) -> DataFrame:
    return curate.restrict_items(V.tag_count(spark, d), active(spark, d))


@V._memo
def popular_movies(spark: SparkSession, d: str) -> DataFrame:
    return curate.restrict_items(active_movies(spark, d), popular(spark, d))


@V._memo
def scored_requests(spark: SparkSession, d: str) -> DataFrame:
    """request_id, rs_importance (validated), user_id."""
    q = V.requests(spark, d)
    return q.select("request_id", "user_id", valid_importance("importance").alias("rs_importance"))


def corpus_stages(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    s = split(spark, d)
    return [
        ("raw", V.ratings_raw(spark, d)),
        ("dedup", V.ratings(spark, d)),
        ("titled", titled_ratings(spark, d)),
        ("active", active(spark, d)),
        ("popular", popular(spark, d)),
        ("train", s.where(F.col("split") == "train")),
        ("test", s.where(F.col("split") == "test")),
    ]


def observed_corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(split, sketches per stage): the corpus written stage by stage, its statistics observed by the
    writing jobs, so that no stage is scanned again to be counted (``operators/sketches.py``)."""
    from cinelake.operators import sketches as SK
    from cinelake.session import cut_lineage

    seen = []

    def watch(name: str, df: DataFrame, only=None) -> DataFrame:
        df, found = SK.observed(df, only)
        seen.append((name, found))
        return df

    movies = V.clean_titles(spark, d)
    raw = watch("raw", V.ratings_raw(spark, d))
    dedup = cut_lineage(watch("dedup", V.first_ratings(spark, d, raw)))
    titled = cut_lineage(watch("titled", dedup.join(movies.select("item_id"), "item_id", "left_semi")))
    recent = cut_lineage(watch("active", curate.active_users(titled, movies, MIN_YEAR)))
    kept = cut_lineage(watch("popular", curate.popular_items(recent, MIN_ITEM_RATINGS)))
    parts = curate.train_test_split(kept, TEST_USERS, TEST_MIN_RATINGS, SEED)
    for part in ("train", "test"):
        parts = watch(part, parts, F.col("split") == part)
    return cut_lineage(parts), SK.collected(spark, seen)


# ---------------------------------------------------------------- model

LAMBDA = 50.0
SPARSITY = 98
TOP_K = 10
_MODELS: dict[tuple, tuple] = {}  # fitted models and their shared (index, n, Gram) per session


@V._memo
def train_ratings(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).where(F.col("split") == "train").select("user_id", "item_id", "rating")


def model(spark: SparkSession, d: str, lam: float = LAMBDA, implicit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(item_index, weights) of the train split: the saved model if there is one, else fitted and saved.

    Looked up by the input files and the parameters, so another session with the
    same shared folder loads it without fitting, and changed files are fitted anew."""
    from cinelake.operators import ease
    from cinelake.sources import once

    key = (session_key(spark), d, lam, implicit)
    if key not in _MODELS:

        def fit_and_save(path: str) -> None:
            idx, w = ease.fit(train_ratings(spark, d), lam, SPARSITY, implicit, prepared=gram_parts(spark, d, implicit))
            ease.save_model(idx.select("item_id", F.col("idx").cast("long")), w, path)

        name = once.fingerprint(spark, [d], "ease", ease.MODEL_VERSION, lam, SPARSITY, implicit, MIN_YEAR, MIN_ITEM_RATINGS, TEST_USERS, TEST_MIN_RATINGS, SEED)
        path, _ = once.write_once(spark, once.place(spark, "model", name), fit_and_save)
        _MODELS[key] = ease.load_model(spark, path)
    return _MODELS[key]


def model_lists(spark: SparkSession, d: str) -> str:
    """Folder with the model's weight lists by level (``operators/early.py``), written once per session."""
    from cinelake.operators import early
    from cinelake.session import shared_path

    key = (session_key(spark), d, "lists")
    if key not in _MODELS:
        _MODELS[key] = early.write_lists(model(spark, d)[1], shared_path(spark, "lists"))
    return _MODELS[key]


def gram_parts(spark: SparkSession, d: str, implicit: bool = False) -> tuple[DataFrame, int, DataFrame]:
    """(item index, n, Gram entries) of the train split; they do not depend on lambda, so they are
    built and stored once per session and shared by every fit and by the Gram queries."""
    from cinelake.operators import ease

    key = (session_key(spark), d, "gram", implicit)
    if key not in _MODELS:
        _MODELS[key] = ease.prepare(train_ratings(spark, d), implicit)
    return _MODELS[key]


def packed_interactions(spark: SparkSession, d: str) -> tuple:
    """(item index, packed X) of the train split, stored once per session for the matrix-free fits."""
    from cinelake.operators import ridge

    key = (session_key(spark), d, "packed")
    if key not in _MODELS:
        _MODELS[key] = ridge.prepare(train_ratings(spark, d))
    return _MODELS[key]


def grid_models(spark: SparkSession, d: str, lams: list[float]) -> tuple[DataFrame, DataFrame]:
    """(item index, weights with a ``lam`` column) of every lambda, solved together and stored."""
    from cinelake.operators import ridge
    from cinelake.session import cut_lineage

    key = (session_key(spark), d, tuple(lams), "grid")
    if key not in _MODELS:
        idx, w = ridge.fit(train_ratings(spark, d), lams, SPARSITY, packed=packed_interactions(spark, d))
        _MODELS[key] = idx, cut_lineage(w)
    return _MODELS[key]


@V._memo
def title_index(spark: SparkSession, d: str):
    """The stored gram index of the catalogue's titles."""
    from cinelake.operators.search import build_title_index

    return build_title_index(V.movies(spark, d))


# ---------------------------------------------------------------- requests and profile


@V._stored
def profile_state(spark: SparkSession, d: str) -> DataFrame:
    """Live profile ratings from the change feed: (user_id, item_key, rating)."""
    from cinelake.streaming.state import rating_state

    return rating_state(V.rating_events(spark, d))


@V._memo
def form_valid_ratings(spark: SparkSession, d: str) -> DataFrame:
    from cinelake.operators.requests import valid_ratings

    return valid_ratings(V.form_ratings(spark, d), V.movies(spark, d))


@V._stored
def form_valid_tags(spark: SparkSession, d: str) -> DataFrame:
    from cinelake.operators.requests import valid_tags

    return valid_tags(V.form_tags(spark, d), V.tags(spark, d))


@V._memo
def past_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Profile ratings of the requesting user for requests with 'use past ratings' on (every 20th)."""
    q = V.requests(spark, d).where(F.col("request_id") % 20 == 0)
    st = profile_state(spark, d)
    return q.join(st, "user_id").select("request_id", F.col("item_key").alias("item_id"), F.col("rating").cast("double"))


@V._stored
def lite_ratings(spark: SparkSession, d: str) -> DataFrame:
    from cinelake.operators.requests import request_ratings

    return request_ratings(form_valid_ratings(spark, d), past_ratings(spark, d))


# ---------------------------------------------------------------- text and matching


@V._stored
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    from cinelake.functions.answers import parse_answers

    return parse_answers(V.answers(spark, d), "answer_id", "answer")


@V._stored
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    from cinelake.operators.resolve import resolve_titles

    names = parsed_answers(spark, d).where(F.col("name").isNotNull()).select("answer_id", "pos", "name", "rating")
    return resolve_titles(names, V.movies(spark, d))


@V._memo
def matched_plots(spark: SparkSession, d: str) -> DataFrame:
    from cinelake.operators.resolve import match_plots

    return match_plots(V.plots(spark, d), V.clean_titles(spark, d))


@V._stored
def plot_texts(spark: SparkSession, d: str) -> DataFrame:
    """item_id -> 'Plot of "<title>": <plot>' for matched plots."""
    from cinelake.functions.answers import plot_text

    pl = V.plots(spark, d).select("plot_id", "plot")
    return matched_plots(spark, d).join(pl, "plot_id").select("item_id", plot_text(F.col("title"), F.col("plot")).alias("plot_text"))
