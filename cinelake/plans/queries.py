"""Registered queries: key -> f(spark, sf_dir) -> DataFrame.

Each key has a DuckDB oracle in ``oracle_sql.py`` unless noted there.
Floating outputs are rounded half-even to 6 digits so that summation order
cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.operators import blend, curate, early, ease, sketches
from cinelake.plans import pipelines as P
from cinelake.plans import views as V
from cinelake.session import cut_lineage, dealt, session_key, shared_path, table
from cinelake.sources import io, once
from cinelake.streaming import state as S
from cinelake.functions import answers as A
from cinelake.functions import ledger
from cinelake.functions import text as TX
from cinelake.operators import resolve as R
from cinelake.operators import search as SE
from cinelake.operators import evaluate as EV
from cinelake.operators.requests import valid_importance as _valid_importance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.bround(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- step 1: scans, dedupe, popularity, tags


@query
def scan_ratings(spark: SparkSession, d: str) -> DataFrame:
    """JSON-lines ratings written from the corpus and read back with an explicit schema."""
    path = io.write_json(V.ratings(spark, d).select("item_id", "user_id", "rating"), shared_path(spark, "ratings_json"))
    return io.read_ratings(spark, path)


@query
def scan_movies(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue JSON with imdbId as text (leading zeros kept), pruned to four columns."""
    m = V.movies(spark, d).select(
        "title",
        "year",
        "popularity",
        F.lit(None).cast("string").alias("directedBy"),
        F.lit(None).cast("string").alias("starring"),
        F.lit(None).cast("double").alias("avgRating"),
        F.expr("substring(imdb_id, 3)").alias("imdbId"),
        "item_id",
    )
    path = io.write_json(m, shared_path(spark, "movies_json"))
    return io.read_movie_names(spark, path)


@query
def dedup_ratings(spark: SparkSession, d: str) -> DataFrame:
    return V.ratings(spark, d)


@query
def popularity(spark: SparkSession, d: str) -> DataFrame:
    return V.movies(spark, d)


@query
def tag_affinity(spark: SparkSession, d: str) -> DataFrame:
    cand = V.request_ratings(spark, d).select("request_id", "item_id")
    return blend.tag_affinity(cand, V.request_tags(spark, d), V.tag_count(spark, d))


@query
def geo_blend(spark: SparkSession, d: str) -> DataFrame:
    rr = V.request_ratings(spark, d)
    q = P.scored_requests(spark, d)
    w = blend.importance_weight("rs_importance")
    b = (F.col("item_id") % 7 - 1).cast("double")
    return rr.join(q, "request_id").select(
        "request_id", "item_id", r6(blend.geo_blend("rating", b, w, F.lit(1.0) - w)).alias("blended")
    )


POPULAR_K = 10
LITE_K = 60


def popular_sample(movies: DataFrame, k: int, seed: int = P.SEED) -> DataFrame:
    """k items drawn (seeded) from the 10*k most popular; score = popularity / max of the drawn.

    A sampling operator: the limit is the feature, and the result has at most k
    rows, so the un-keyed window below only ever sees k rows.
    """
    top = movies.where(F.col("pop_rank") <= 10 * k)
    drawn = top.orderBy(curate.seeded_order("item_id", seed), "item_id").limit(k)
    return drawn.select(
        "item_id",
        "title",
        "popularity",
        "imdb_id",
        (F.col("popularity") / F.max("popularity").over(Window.partitionBy())).alias("score"),
    )


def for_every_request(requests: DataFrame, rows: DataFrame, bound: int, order: str = "item_id") -> DataFrame:
    """Attach a small table of at most ``bound`` rows to every request.

    Each request is exploded into ``bound`` numbered slots and joined to the
    rows on their slot number: an equi-join against a table whose size the
    limit proves (so it is broadcast), not a nested-loop product.
    """
    small = rows.limit(bound)
    small = small.withColumn("_slot", F.row_number().over(Window.orderBy(order)))  # at most ``bound`` rows
    slots = requests.withColumn("_slot", F.explode(F.sequence(F.lit(1), F.lit(bound))))
    return slots.join(F.broadcast(small), "_slot").drop("_slot")


@query
def tag_recommend_popular(spark: SparkSession, d: str) -> DataFrame:
    """Minimum slice: popular items per request re-ranked by tag affinity, blended, normalised."""
    q = P.scored_requests(spark, d)
    sample = popular_sample(V.movies(spark, d), LITE_K)
    popular = sample.select("item_id", "title", "popularity", "imdb_id", F.bround("score", 3).alias("primary_score"))
    asked = dealt(q.select("request_id"), "request_id")  # the requests are dealt before they become candidates
    counts = V.tag_count(spark, d).join(F.broadcast(sample.select("item_id")), "item_id", "left_semi")  # of the candidates alone
    return blend.blend_tags(asked, q, V.request_tags(spark, d), counts, every=popular)


# ---------------------------------------------------------------- step 2: curation


@query
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return V.clean_titles(spark, d)


@query
def active_users(spark: SparkSession, d: str) -> DataFrame:
    return P.active(spark, d)


@query
def popular_items(spark: SparkSession, d: str) -> DataFrame:
    return P.popular(spark, d)


@query
def active_movies(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after the activity filter: items that still have ratings."""
    return P.active_movies(spark, d)


@query
def active_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tag counts after the activity filter."""
    return P.active_tag_count(spark, d)


@query
def popular_movies(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after the minimum support."""
    return P.popular_movies(spark, d)


@query
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return P.split(spark, d)


@query
def split_checks(spark: SparkSession, d: str) -> DataFrame:
    return curate.split_checks(P.split(spark, d))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return curate.corpus_stats(P.corpus_stages(spark, d))


@query
def corpus_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The same statistics from sketches that the jobs writing the corpus observe (users and items estimated)."""
    return sketches.estimates(P.observed_corpus(spark, d)[1])


@query
def tag_usage(spark: SparkSession, d: str) -> DataFrame:
    return curate.tag_usage(V.tags(spark, d), V.tag_count(spark, d))


# ---------------------------------------------------------------- step 3: model


def _names(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Inner join with the catalogue (ids without a title drop out, as in the reference)."""
    return df.join(V.movies(spark, d).select("item_id", "title", "popularity", "imdb_id"), "item_id")


@query
def item_index(spark: SparkSession, d: str) -> DataFrame:
    return ease.item_index(P.train_ratings(spark, d))


def _gram(spark: SparkSession, d: str, implicit: bool) -> DataFrame:
    idx, _, g = P.gram_parts(spark, d, implicit)
    return ease.with_item_ids(g.withColumn("g", F.bround("g", 9)), idx, "g", "g").withColumnsRenamed(
        {"src_item": "item_i", "dst_item": "item_j"}
    )


@query
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _gram(spark, d, False)


@query
def gram_implicit(spark: SparkSession, d: str) -> DataFrame:
    return _gram(spark, d, True)


@query
def gram_inverse(spark: SparkSession, d: str) -> DataFrame:
    idx, n, g = P.gram_parts(spark, d)
    p = ease.inverse(g, n, P.LAMBDA)
    return ease.with_item_ids(p.withColumn("p", F.bround("p", 9)), idx, "p", "p").withColumnsRenamed(
        {"src_item": "item_i", "dst_item": "item_j"}
    )


@query
def ease_weights(spark: SparkSession, d: str) -> DataFrame:
    _, w = P.model(spark, d)
    return w.withColumn("w", F.bround("w", 9))


@query
def ease_weights_solved(spark: SparkSession, d: str) -> DataFrame:
    """The same weights from the matrix-free solver: no Gram matrix and no inverse."""
    _, w = P.grid_models(spark, d, [P.LAMBDA])
    return w.select("src_item", "dst_item", F.bround("w", 9).alias("w"))


def _ease_top(spark: SparkSession, d: str, req: DataFrame, k: int) -> DataFrame:
    idx, w = P.model(spark, d)
    return ease.recommend(req, idx, w, k)


@query
def ease_recommend(spark: SparkSession, d: str) -> DataFrame:
    req = V.request_ratings(spark, d).select("request_id", "item_id", "rating")
    return _names(_ease_top(spark, d, req, P.TOP_K), spark, d)


@query
def ease_recommend_early(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from weight lists sorted by size, read only until a bound closes each request."""
    req = V.request_ratings(spark, d).select("request_id", "item_id", "rating")
    idx, w = P.model(spark, d)
    return _names(early.recommend(req, idx, w, P.model_lists(spark, d), P.TOP_K), spark, d)


@query
def popular_fallback(spark: SparkSession, d: str) -> DataFrame:
    return popular_sample(V.movies(spark, d), POPULAR_K)


@query
def recommend(spark: SparkSession, d: str) -> DataFrame:
    """Per request: EASE top-k with names when it has ratings, else the popular draw."""
    req = V.request_ratings(spark, d).select("request_id", "item_id", "rating")
    rated = _names(_ease_top(spark, d, req, P.TOP_K), spark, d).select(
        "request_id", "item_id", "score", "title", "popularity", "imdb_id", F.lit("ease").alias("source")
    )
    empty = V.requests(spark, d).select("request_id").join(req.select("request_id"), "request_id", "left_anti")
    pop = for_every_request(empty, popular_sample(V.movies(spark, d), POPULAR_K), POPULAR_K).select(
        "request_id", "item_id", "score", "title", "popularity", "imdb_id", F.lit("popular").alias("source")
    )
    return rated.unionByName(pop)


# ---------------------------------------------------------------- step 4: requests, profile, blending


@query
def valid_ratings(spark: SparkSession, d: str) -> DataFrame:
    return P.form_valid_ratings(spark, d)


@query
def valid_tags(spark: SparkSession, d: str) -> DataFrame:
    return P.form_valid_tags(spark, d)


@query
def valid_importance(spark: SparkSession, d: str) -> DataFrame:
    return V.requests(spark, d).select("request_id", "importance", _valid_importance("importance").alias("rs_importance"))


@query
def request_ratings(spark: SparkSession, d: str) -> DataFrame:
    return P.lite_ratings(spark, d)


@query
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Names for every request's ratings and tags in one job (no per-id lookups)."""
    m = V.movies(spark, d).select("item_id", F.col("title").alias("name"))
    movies = P.lite_ratings(spark, d).join(m, "item_id").select(
        "request_id", F.lit("movie").alias("kind"), F.col("item_id").alias("id"), "name", "rating"
    )
    tg = V.tags(spark, d).select(F.col("id").alias("tag_id"), F.col("tag").alias("name"))
    tags = P.form_valid_tags(spark, d).join(tg, "tag_id").select(
        "request_id", F.lit("tag").alias("kind"), F.col("tag_id").alias("id"), "name", F.lit(None).cast("double").alias("rating")
    )
    return movies.unionByName(tags)


@query
def rating_state(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_state(spark, d)


@query
def delete_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return S.delete_outcomes(V.rating_events(spark, d))


@query
def first_registration(spark: SparkSession, d: str) -> DataFrame:
    signups = (
        table(spark, d, "events")
        .where(F.col("event_type") == "signup")
        .select("event_id", "ts", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    )
    return S.first_registration(signups)


@query
def rating_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same state, driven through Structured Streaming over the change feed files."""
    feed = shared_path(spark, "rating_feed")
    ev = V.rating_events(spark, d)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # grows with the cluster's setting
    ev.repartitionByRange(files, "ts", "event_id").write.parquet(feed)
    return S.run_stream(spark, feed, ev.schema, lambda b: b, max_files=max(1, files // 4))


@query
def user_profile(spark: SparkSession, d: str) -> DataFrame:
    m = V.movies(spark, d).select(F.col("item_id").alias("item_key"), "imdb_id", "title", "year")
    return P.profile_state(spark, d).join(m, "item_key").select("user_id", "imdb_id", "title", "year", "rating")


def _rs_candidates(spark: SparkSession, d: str, ratings: DataFrame, importance: DataFrame, k: int) -> DataFrame:
    """Per request: EASE top-k with names, or the popular draw when RS is ignored
    (no ratings, or importance 0)."""
    use_rs = importance.where(F.col("rs_importance") != 0).select("request_id")
    req = ratings.join(use_rs, "request_id", "left_semi")
    ease_part = _names(_ease_top(spark, d, req, k), spark, d).select(
        "request_id", "item_id", "title", "popularity", "imdb_id", "score"
    )
    rest = importance.select("request_id").join(req.select("request_id"), "request_id", "left_anti")
    pop = for_every_request(rest, popular_sample(V.movies(spark, d), k), k).select(
        "request_id", "item_id", "title", "popularity", "imdb_id", "score"
    )
    return ease_part.unionByName(pop)


@query
def blend_tag(spark: SparkSession, d: str) -> DataFrame:
    """The tag route end to end: validated form -> RS or popular -> tag affinity blend -> normalise."""
    q = P.scored_requests(spark, d)
    cand = _rs_candidates(spark, d, P.lite_ratings(spark, d), q, LITE_K)
    primary = cand.select("request_id", "item_id", "title", "popularity", "imdb_id", F.bround("score", 3).alias("primary_score"))
    primary = dealt(primary, "request_id")
    return blend.blend_tags(primary, q, P.form_valid_tags(spark, d), V.tag_count(spark, d))


# ---------------------------------------------------------------- step 5: fuzzy matching


@query
def title_distance(spark: SparkSession, d: str) -> DataFrame:
    return R.title_edges(V.plots(spark, d), V.clean_titles(spark, d)).select("plot_id", "item_id", "year", "distance")


@query
def match_plots(spark: SparkSession, d: str) -> DataFrame:
    return P.matched_plots(spark, d)


@query
def resolve_titles(spark: SparkSession, d: str) -> DataFrame:
    return P.resolved_names(spark, d)


@query
def plot_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Plot text per catalogue item, NULL when no plot matched (left join, not per-id lookups)."""
    return V.movies(spark, d).select("item_id").join(P.plot_texts(spark, d), "item_id", "left")


# ---------------------------------------------------------------- step 7: text batch jobs


@query
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    return P.parsed_answers(spark, d)


def _fitness_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    t = (F.col("turn") % 5 + 1).cast("string")
    txt = (
        F.when(F.col("conv_id") % 5 == 0, F.lit("x --- bad"))
        .when(F.col("conv_id") % 5 == 1, t)
        .otherwise(F.concat(t, F.lit(" --- Because "), F.col("text")))
    )
    return c.select("conv_id", "turn", txt.alias("text"))


@query
def parse_fitness(spark: SparkSession, d: str) -> DataFrame:
    f = _fitness_texts(spark, d).select("conv_id", "turn", A.parse_fitness(F.col("text")).alias("_f"))
    return f.select("conv_id", "turn", "_f.score", "_f.explanation")


@query
def completion_answers(spark: SparkSession, d: str) -> DataFrame:
    """Completions that repeat their prompt: the part after the last instruction mark."""
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    begin, ask, asked, _ = A.prompt_marks(True)
    whole = F.concat(F.lit(f"{begin}{ask} Turn "), F.col("turn").cast("string"), F.lit(f" {asked} "), F.col("text"), F.lit(" \n"))
    return c.select("conv_id", "turn", A.completion_answer(whole).alias("answer"))


@query
def transcript_messages(spark: SparkSession, d: str) -> DataFrame:
    return A.transcript_messages(V.transcripts(spark, d), "conv_id", "transcript")


@query
def ratings_text(spark: SparkSession, d: str) -> DataFrame:
    """Per request: 'title: rating' lines in request order, plus the full evaluation prompt."""
    m = V.movies(spark, d).select("item_id", TX.first_alias("title").alias("_name"))
    rows = V.request_ratings(spark, d).join(m, "item_id").select(
        "request_id", "pos", F.concat("_name", F.lit(": "), F.col("rating").cast("string"), F.lit("\n")).alias("_line"), "_name"
    )
    lines = F.array_sort(F.collect_list(F.struct("pos", "_line", "_name")))
    g = rows.groupBy("request_id").agg(lines.alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["_line"]), "")
    last = F.element_at(F.col("_l"), -1)["_name"]
    return g.select(
        "request_id",
        text.alias("ratings_text"),
        F.concat(text, F.lit(A.MOOD_SENTENCE), F.lit("something like "), last).alias("full_prompt"),
    )


@query
def extraction_prompts(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    both = F.array(
        F.struct(F.lit("chat").alias("dialect"), A.extraction_prompt(F.col("text"), False).alias("prompt")),
        F.struct(F.lit("instruction").alias("dialect"), A.extraction_prompt(F.col("text"), True).alias("prompt")),
    )
    return u.select("conv_id", "turn", F.inline(both))  # both dialects from one scan


DESCRIBE_SHOTS = [
    ("Describe in one short phrase what kind of film this is: Alien (1979)", "a claustrophobic space horror"),
    ("Describe in one short phrase what kind of film this is: Amelie (2001)", "a whimsical romantic comedy set in Paris"),
]


@query
def message_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two-shot message arrays (title -> short description) for every catalogue item, as rows."""
    m = V.movies(spark, d).select("item_id", "title")
    msgs = [(0, "system", F.lit(A.SYSTEM_MESSAGE))]
    for i, (q, a) in enumerate(DESCRIBE_SHOTS):
        msgs += [(1 + 2 * i, "user", F.lit(q)), (2 + 2 * i, "assistant", F.lit(a))]
    msgs.append((1 + 2 * len(DESCRIBE_SHOTS), "user", F.concat(F.lit("Describe in one short phrase what kind of film this is: "), F.col("title"))))
    # one pass over the catalogue: each item's message list is built as an array and inlined
    rows = F.array(*[F.struct(F.lit(pos).alias("msg_pos"), F.lit(role).alias("role"), content.alias("content")) for pos, role, content in msgs])
    return m.select("item_id", F.inline(rows))


TELL_SHOTS = [
    ("Say in the first person how you liked these films:\nAlien (1979): 5.0\n", "I loved Alien."),
    ("Say in the first person how you liked these films:\nCats (2019): 1.0\nHeat (1995): 4.0\n", "I could not stand Cats, but I liked Heat."),
]


@query
def rating_message_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two-shot message arrays (rating lines -> first-person text) for every request with ratings, as rows."""
    msgs = [(0, "system", F.lit(A.SYSTEM_MESSAGE))]
    for i, (q, a) in enumerate(TELL_SHOTS):
        msgs += [(1 + 2 * i, "user", F.lit(q)), (2 + 2 * i, "assistant", F.lit(a))]
    msgs.append((1 + 2 * len(TELL_SHOTS), "user", F.concat(F.lit("Say in the first person how you liked these films:\n"), F.col("ratings_text"))))
    rows = F.array(*[F.struct(F.lit(pos).alias("msg_pos"), F.lit(role).alias("role"), content.alias("content")) for pos, role, content in msgs])
    return ratings_text(spark, d).select("request_id", F.inline(rows))


# ---------------------------------------------------------------- LLM route (answers -> RS -> plot scoring -> blend)

LLM_K = 10


@V._memo
def _llm_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per answer: RS importance 100 (RS only), 0 (no RS) or 50 by answer_id % 5."""
    a = V.answers(spark, d).select(F.col("answer_id").alias("request_id"), "user_id")
    imp = F.when(F.col("request_id") % 5 == 0, 100).when(F.col("request_id") % 5 == 1, 0).otherwise(50)
    return a.select("request_id", "user_id", imp.cast("int").alias("rs_importance"))


@V._stored
def _llm_candidates(spark: SparkSession, d: str) -> DataFrame:
    """RS candidates per answer with preferences and plot text attached.

    The ratings are the user's profile followed by those of the prompt; the last one of an item counts.
    """
    asked = _llm_requests(spark, d)
    prompt = P.resolved_names(spark, d).select(F.col("answer_id").alias("request_id"), "item_id", "rating", "pos")
    profile = asked.join(P.profile_state(spark, d), "user_id").select("request_id", F.col("item_key").alias("item_id"), F.col("rating").cast("double"), F.lit(-1).alias("pos"))
    ratings = prompt.unionByName(profile).groupBy("request_id", "item_id").agg(F.max_by("rating", "pos").alias("rating"))
    q = asked.drop("user_id")
    cand = _rs_candidates(spark, d, ratings, q, LLM_K)
    prefs = P.parsed_answers(spark, d).groupBy(F.col("answer_id").alias("request_id")).agg(
        F.first("preferences", ignorenulls=True).alias("preferences")
    )
    return (
        cand.join(q, "request_id")
        .join(prefs, "request_id", "left")
        .join(P.plot_texts(spark, d), "item_id", "left")
        .withColumn("rs_score", F.bround("score", 2))
    )


def _llm_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = _llm_candidates(spark, d)
    use = F.col("preferences").isNotNull() & (F.col("rs_importance") < 100) & F.col("plot_text").isNotNull()
    return c.where(use).select(F.col("request_id").alias("answer_id"), "item_id", "preferences", F.col("plot_text").alias("plot"))


@query
def fitness_prompts(spark: SparkSession, d: str) -> DataFrame:
    pr = _llm_pairs(spark, d)
    inst = F.col("answer_id") % 2 == 1
    prompt = F.when(inst, A.fitness_prompt(F.col("preferences"), F.col("plot"), True)).otherwise(
        A.fitness_prompt(F.col("preferences"), F.col("plot"), False)
    )
    return pr.select("answer_id", "item_id", prompt.alias("prompt"))


@query
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    scored = A.score_pairs(_llm_pairs(spark, d))
    f = scored.select("answer_id", "item_id", A.parse_fitness(F.col("answer")).alias("_f"))
    return f.select("answer_id", "item_id", F.col("_f.score").alias("llm_score"), F.col("_f.explanation").alias("explanation"))


def _overlap_client(preferences, plots):
    """The bundled scorer as an external client would be called: two columns of texts in, answers out."""
    out = []
    for wish, plot in zip(preferences, plots):
        if wish is None or plot is None:
            out.append(None)
            continue
        shared = len(set(wish.lower().split(" ")) & set(plot.lower().split(" ")))
        score = float(min(5, 1 + shared))
        out.append(f"{score} --- Shares {int(score) - 1} words with the wishes.")
    return out


@query
def score_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The scores of ``score_pairs`` through the ledger of external calls: distinct pairs, each sent once."""
    scored = ledger.score_once(_llm_pairs(spark, d), _overlap_client, shared_path(spark, "ledger"), parts=LEDGER_PARTS)
    f = scored.select("answer_id", "item_id", A.parse_fitness(F.col("answer")).alias("_f"))
    return f.select("answer_id", "item_id", F.col("_f.score").alias("llm_score"), F.col("_f.explanation").alias("explanation"))


LEDGER_PARTS = 4


@query
def blend_llm(spark: SparkSession, d: str) -> DataFrame:
    c = _llm_candidates(spark, d)
    sc = score_pairs(spark, d).withColumnRenamed("answer_id", "request_id")
    c = c.join(sc, ["request_id", "item_id"], "left")
    use_llm = F.col("rs_importance") < 100
    rs_only = F.col("preferences").isNull() | ~use_llm
    wa = F.col("rs_importance") / 100.0
    wb = (100 - F.col("rs_importance")) / 100.0
    has_plot = F.col("plot_text").isNotNull()
    total = (
        F.when(rs_only, F.col("rs_score"))
        .when(has_plot, blend.geo_blend("rs_score", "llm_score", wa, wb))
        .otherwise(blend.geo_blend("rs_score", F.lit(blend.DEFAULT_LLM_SCORE), wa, wb))
    )
    expl = (
        F.when(~use_llm, F.lit(A.EXPLAIN_RS_ONLY))
        .when(F.col("preferences").isNull(), F.lit(A.EXPLAIN_NO_PREFERENCES))
        .when(has_plot, F.col("explanation"))
        .otherwise(F.lit(A.EXPLAIN_NO_PLOT))
    )
    out = c.select(
        F.col("request_id").alias("answer_id"),
        "item_id",
        "imdb_id",
        "title",
        total.alias("total_score"),
        "rs_score",
        F.when(rs_only | ~has_plot, F.lit(None).cast("double")).otherwise(F.col("llm_score")).alias("llm_score"),
        expl.alias("explanation"),
    )
    return blend.normalise(out, "total_score", by="answer_id")


# ---------------------------------------------------------------- step 6: retrieval, links, posters


@query
def title_search(spark: SparkSession, d: str) -> DataFrame:
    return SE.title_search(V.search_terms(spark, d), V.movies(spark, d), index=P.title_index(spark, d))


@query
def tag_search(spark: SparkSession, d: str) -> DataFrame:
    return SE.tag_search(V.search_terms(spark, d), V.tags(spark, d))


@query
def link_ids(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue -> external id through the links CSV; its last row wins on a repeated key; misses are flagged."""
    path = io.write_csv(V.links(spark, d).orderBy("line").select("imdbId", "tmdbId"), shared_path(spark, "links_csv"))
    ln = io.read_links_csv(spark, path)
    last = ln.groupBy("imdbId").agg(F.max_by("tmdbId", "line").alias("tmdb_id"))
    m = V.movies(spark, d).select("item_id", "imdb_id", TX.strip_imdb_prefix("imdb_id").alias("imdbId"))
    return m.join(last, "imdbId", "left").select("item_id", "imdb_id", "tmdb_id", F.col("tmdb_id").isNotNull().alias("matched"))


@query
def best_poster(spark: SparkSession, d: str) -> DataFrame:
    """Per item, from its nested poster document: an English poster if any, then most votes, then best average; list order breaks ties.

    ``max_by`` aggregates map-side, so an item with a huge poster list is reduced before the shuffle.
    """
    p = io.read_posters(spark, io.write_posters(V.posters(spark, d), shared_path(spark, "posters_json")))
    rank = F.struct((F.col("iso_639_1") == "en").cast("int"), F.col("vote_count"), F.col("vote_average"), -F.col("pos"))
    best = p.groupBy("item").agg(F.max_by(F.struct("iso_639_1", "vote_count", "vote_average", "file_path"), rank).alias("_b"))
    return best.select("item", "_b.iso_639_1", "_b.vote_count", "_b.vote_average", "_b.file_path")


# ---------------------------------------------------------------- step 8: evaluation

EVAL_K = 20
HOLDOUT_SAMPLE = 20
COHORT = 250
COHORT_SAMPLE = 8
CANDIDATES = 50
LAMBDAS = (5.0, 50.0, 500.0)


@V._memo
def _holdout(spark: SparkSession, d: str) -> DataFrame:
    test = P.split(spark, d).where(F.col("split") == "test").select("user_id", "item_id", "rating")
    return cut_lineage(EV.holdout(test, HOLDOUT_SAMPLE, P.TEST_MIN_RATINGS, P.SEED))


@query
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return _holdout(spark, d)


def _precision_recall(spark: SparkSession, d: str, idx: DataFrame, w: DataFrame) -> DataFrame:
    h = _holdout(spark, d)
    req = h.where(F.col("part") == "sample").select(F.col("user_id").alias("request_id"), "item_id", "rating")
    top = ease.recommend(req, idx, w, EVAL_K).withColumnRenamed("request_id", "user_id")
    target = h.where(F.col("part") == "target")
    users = h.select("user_id").distinct()
    return EV.precision_recall(top, target, users, EVAL_K)


@query
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return _precision_recall(spark, d, *P.model(spark, d))


@query
def lambda_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One row per lambda with the metrics and each metric's rank (the grid is small and fixed).

    All models come from one multi-shift solve over the packed interactions."""
    rows = None
    idx, weights = P.grid_models(spark, d, LAMBDAS)
    for lam in LAMBDAS:
        r = _precision_recall(spark, d, idx, weights.where(F.col("lam") == lam)).select(F.lit(lam).alias("lambda"), "precision", "recall", "f1")
        rows = r if rows is None else rows.unionByName(r)
    for m in ("precision", "recall", "f1"):
        rows = rows.withColumn(f"rank_{m}", F.row_number().over(Window.orderBy(F.col(m).desc(), F.col("lambda"))))
    return rows


@V._memo
def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return EV.choose_users(P.train_ratings(spark, d), COHORT, P.SEED)


@V._memo
def _targets(spark: SparkSession, d: str) -> DataFrame:
    plot_items = P.matched_plots(spark, d).select("item_id")
    return cut_lineage(EV.eval_targets(P.train_ratings(spark, d), _cohort(spark, d), plot_items, COHORT_SAMPLE, P.SEED))


@query
def eval_targets(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


TELL, DESCRIBE = "first person", "description"  # the two kinds of external answers of an experiment


def _experiment_client(kinds, contents):
    """Bundled answers as an external client would give them: rating lines told in the first person, a title described."""

    def answer(kind: str, content: str) -> str:
        if kind == DESCRIBE:
            return "something like " + content
        told = []
        for line in content.split("\n")[:-1]:
            name, _, rating = line.rpartition(": ")
            told.append(("loved " if float(rating) >= 4 else "liked " if float(rating) >= 2.5 else "did not like ") + name)
        return f"I {', '.join(told)}." if told else ""

    return [answer(kind, content) for kind, content in zip(kinds, contents)]


@query
def evaluation_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Per cohort user the texts of one experiment: sampled ratings, their first-person text, the target's title
    and description, and the full prompt of both answers. The answers come through the ledger of external calls.

    A user's sample has at most ``COHORT_SAMPLE`` rows; without one its texts are empty.
    """
    m = V.movies(spark, d).select("item_id", "title", TX.first_alias("title").alias("_name"))
    named = _targets(spark, d).join(m, "item_id")
    line = F.concat("_name", F.lit(": "), F.col("rating").cast("string"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("item_id", line.alias("_line"))))
    sample = named.where(F.col("role") == "sample").groupBy("user_id").agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "").alias("_text"))
    target = named.where(F.col("role") == "target").select("user_id", F.col("title").alias("target_title"))
    texts = cut_lineage(target.join(sample, "user_id", "left").select("user_id", F.coalesce("_text", F.lit("")).alias("ratings_text"), "target_title"))
    ask = lambda kind, content: F.struct(F.lit(kind).alias("preferences"), F.col(content).alias("plot"))
    asked = texts.select("user_id", F.inline(F.array(ask(TELL, "ratings_text"), ask(DESCRIBE, "target_title"))))
    answered = ledger.score_once(asked, _experiment_client, shared_path(spark, "ledger"), parts=LEDGER_PARTS)
    both = answered.groupBy("user_id").agg(
        F.max(F.when(F.col("preferences") == TELL, F.col("answer"))).alias("ratings_prompt"),
        F.max(F.when(F.col("preferences") == DESCRIBE, F.col("answer"))).alias("target_description"),
    )
    prompt = F.concat("ratings_prompt", F.lit(A.MOOD_SENTENCE), "target_description")
    return texts.join(both, "user_id").withColumn("full_prompt", prompt)


@V._stored
def _experiment(spark: SparkSession, d: str) -> DataFrame:
    """Per cohort user: RS top-50 from the sampled ratings, plot-scored against a wish naming the target."""
    t = _targets(spark, d)
    req = t.where(F.col("role") == "sample").select(F.col("user_id").alias("request_id"), "item_id", "rating")
    top = _names(_ease_top(spark, d, req, CANDIDATES), spark, d)
    m = V.movies(spark, d).select("item_id", TX.first_alias("title").alias("_tname"))
    wish = t.where(F.col("role") == "target").join(m, "item_id").select(
        F.col("user_id").alias("request_id"), F.concat(F.lit("something like "), F.col("_tname")).alias("preferences")
    )
    c = top.join(wish, "request_id").join(P.plot_texts(spark, d), "item_id", "left").withColumn("rs_score", F.bround("score", 2))
    scored = A.score_pairs(c.withColumn("plot", F.col("plot_text")))
    fit = A.parse_fitness(F.col("answer"))
    has_plot = F.col("plot_text").isNotNull()
    out = scored.select(
        F.col("request_id").alias("user_id"),
        "item_id",
        "imdb_id",
        "title",
        "rs_score",
        F.when(has_plot, fit["score"]).alias("llm_score"),
        F.when(has_plot, fit["explanation"]).otherwise(F.lit(A.EXPLAIN_NO_PLOT)).alias("explanation"),
    )
    total = blend.geo_blend("rs_score", F.coalesce("llm_score", F.lit(blend.DEFAULT_LLM_SCORE)), 0.5, 0.5)
    out = blend.normalise(out.withColumn("total_score", total), "total_score", by="user_id")
    w_rs = Window.partitionBy("user_id").orderBy(F.col("rs_score").desc(), "item_id")
    w_both = Window.partitionBy("user_id").orderBy(F.col("total_score").desc_nulls_last(), "item_id")
    return out.withColumn("rank_rs", F.row_number().over(w_rs)).withColumn("rank_both", F.row_number().over(w_both))


@query
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    users = t.where(F.col("role") == "target").select("user_id").distinct()
    return EV.hit_rates(_experiment(spark, d), t.where(F.col("role") == "target"), users)


@query
def hit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Per k, the per-k results document (users, hits, rates) as JSON text."""
    t = _targets(spark, d)
    users = t.where(F.col("role") == "target").select("user_id").distinct()
    return EV.hit_documents(_experiment(spark, d), t.where(F.col("role") == "target"), users)


@query
def hit_summary(spark: SparkSession, d: str) -> DataFrame:
    """The results document keyed by k, ``{"<k>": {"rs": <hit rate>, "both": <hit rate>}, ...}``, one row.

    Built from the per-k rows (one per k in the fixed k list), so the array is bounded.
    """
    h = hit_at_k(spark, d)
    piece = F.concat(
        F.lit('"'), F.col("k").cast("string"), F.lit('": {"rs": '), F.col("accuracy_rs").cast("string"),
        F.lit(', "both": '), F.col("accuracy_both").cast("string"), F.lit("}"),
    )
    parts = F.array_sort(F.collect_list(F.struct("k", piece.alias("p"))))
    return h.agg(F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: x["p"]), ", "), F.lit("}")).alias("results"))


@query
def predictions_json(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the ranked prediction records as one JSON array (nulls kept)."""
    e = _experiment(spark, d)
    rec = F.struct("rank_both", "item_id", "imdb_id", "title", "total_score", "rs_score", "llm_score", "explanation")
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(rec)).alias("_r"))
    return g.select("user_id", F.to_json("_r", {"ignoreNullFields": "false"}).alias("predictions"))


@query
def conversion_loss(spark: SparkSession, d: str) -> DataFrame:
    """Sampled ratings -> text answer -> parse -> fuzzy resolve -> compare with the true ratings."""
    from cinelake.operators.resolve import resolve_titles as _resolve

    t = _targets(spark, d).where(F.col("role") == "sample")
    m = V.movies(spark, d).select("item_id", TX.first_alias("title").alias("_n"))
    lines = t.join(m, "item_id").select(
        "user_id", "item_id", F.concat("_n", F.lit(A.RATING_SEP), F.col("rating").cast("string")).alias("_l")
    )
    text = lines.groupBy("user_id").agg(
        F.concat(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "_l"))), lambda x: x["_l"]), A.ITEM_SEP),
            F.lit(" --- <EMPTY>"),
        ).alias("answer")
    )
    parsed = A.parse_answers(text, "user_id", "answer").where(F.col("name").isNotNull())
    res = _resolve(parsed.select("user_id", "pos", "name", "rating"), V.movies(spark, d))
    conv = res.groupBy("user_id", "item_id").agg(F.max_by("rating", "pos").alias("rating"))
    return EV.conversion_loss(t.join(m, "item_id", "left_semi"), conv)


PREDICTION_PARTS = 2  # committed one by one


@query
def resume_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Resume a batch run from a given user: users at or after the start that have no committed output yet."""
    c = _cohort(spark, d)
    start = c.orderBy("user_id").select("user_id").limit(COHORT // 2).agg(F.max("user_id")).first()[0]
    t = _targets(spark, d)
    req = t.where(F.col("role") == "sample").select(F.col("user_id").alias("request_id"), "item_id", "rating")
    folder, schema = shared_path(spark, "predictions"), "request_id long, item_id long, score double, rank int"
    early = req.where(F.col("request_id") % 4 == 0)
    once.run_parts(spark, f"{folder}/early", early, "request_id", PREDICTION_PARTS, lambda part: _ease_top(spark, d, part, P.TOP_K), schema)
    done = once.finished(spark, f"{folder}/early", PREDICTION_PARTS, schema).select("request_id").distinct()
    todo = req.where(F.col("request_id") >= start).join(done, "request_id", "left_anti")
    rest = once.run_parts(spark, f"{folder}/rest", todo, "request_id", PREDICTION_PARTS, lambda part: _ease_top(spark, d, part, P.TOP_K), schema)
    return rest.withColumnRenamed("request_id", "user_id")


# ---------------------------------------------------------------- step 10: sources and sinks round trips


@query
def scan_plots_csv(spark: SparkSession, d: str) -> DataFrame:
    """Plot records written as the published header CSV (quoted multi-line text) and read back renamed."""
    pl = V.plots(spark, d).select(
        F.col("year").alias("Release Year"),
        F.col("title").alias("Title"),
        F.lit("American").alias("Origin/Ethnicity"),
        F.lit(None).cast("string").alias("Director"),
        F.lit(None).cast("string").alias("Cast"),
        F.lit("unknown").alias("Genre"),
        F.concat(F.lit("https://wiki.invalid/"), F.col("plot_id").cast("string")).alias("Wiki Page"),
        F.col("plot").alias("Plot"),
    )
    path = io.write_csv(pl, shared_path(spark, "plots_csv"))
    return io.read_plots_csv(spark, path)


@query
def scan_user_files(spark: SparkSession, d: str) -> DataFrame:
    """Per-user files of two kinds in one folder; those of one suffix are listed, read whole and sorted by user."""
    texts = ratings_text(spark, d).select(F.col("request_id").alias("user_id"), F.col("ratings_text").alias("content"), F.col("full_prompt"))
    folder = io.write_user_kinds(texts, shared_path(spark, "user_files"), {"sample_textual.txt": "content", "full_prompt.txt": "full_prompt"})
    return io.read_user_files(spark, folder, "sample_textual.txt")


@query
def user_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same per-user texts through the Parquet sink, the form for many users."""
    texts = ratings_text(spark, d).select(F.col("request_id").alias("user_id"), F.col("ratings_text").alias("content"))
    return spark.read.parquet(io.write_user_table(texts, shared_path(spark, "user_texts")))


@query
def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue written as JSON lines and as header CSV; both read back with schemas and must agree."""
    m = V.movies(spark, d).select("title", "year", "popularity", F.expr("substring(imdb_id, 3)").alias("imdbId"), "item_id")
    jpath = io.write_json(m, shared_path(spark, "movies_json"))
    cpath = io.write_csv(m, shared_path(spark, "movies_csv"))
    js = io.read_json(spark, jpath, io.MOVIES_SCHEMA).select("item_id", "title", "year", "popularity", "imdbId")
    cs = spark.read.schema(m.schema).option("header", True).option("escape", '"').csv(cpath)
    both = js.join(cs.select("item_id", F.col("title").alias("_ct"), F.col("imdbId").alias("_ci")), "item_id", "full_outer")
    return both.select(
        "item_id", "title", "year", "popularity", "imdbId",
        ((F.col("title") == F.col("_ct")) & (F.col("imdbId") == F.col("_ci"))).alias("csv_agrees"),
    )


@query
def cohort_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Cohort chosen once and persisted as an id list; a second choice with another seed finds the stored one."""
    path = shared_path(spark, "cohort")
    io.chosen_once(spark, lambda: _cohort(spark, d), path)
    return io.chosen_once(spark, lambda: EV.choose_users(P.train_ratings(spark, d), COHORT, P.SEED + 1), path)


_LOADED: dict[tuple, str] = {}


def _load_once(spark: SparkSession, d: str, kind: str, df: DataFrame) -> DataFrame:
    """Store ``df`` as a table unless it is there (save mode 'ignore') and return the table; keyed by the input folder's path."""
    import hashlib

    name = f"catalog_{kind}_" + hashlib.md5(d.encode()).hexdigest()[:10]
    key = (session_key(spark), name)
    if key not in _LOADED:
        _LOADED[key] = shared_path(spark, "catalog", name)
    for _ in range(2):  # the second load finds the table and leaves it
        df.write.mode("ignore").option("path", _LOADED[key]).saveAsTable(name)
    return spark.table(name)


@query
def catalog_load(spark: SparkSession, d: str) -> DataFrame:
    """Load the catalogue table only if absent, ids cast to LONG, stored in the shared folder."""
    return _load_once(spark, d, "movies", V.movies(spark, d).select("imdb_id", "title", "year", F.col("popularity").cast("long"), F.col("item_id").cast("long")))


@query
def tag_catalog_load(spark: SparkSession, d: str) -> DataFrame:
    """Load the tags and the tag counts only if absent; the counts with their tags from the loaded tables."""
    tags = _load_once(spark, d, "tags", V.tags(spark, d).select(F.col("id").cast("long"), "tag"))
    counts = _load_once(spark, d, "tag_count", V.tag_count(spark, d).select(F.col("item_id").cast("long"), F.col("tag_id").cast("long"), F.col("num").cast("long")))
    return counts.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").select("item_id", "tag_id", "tag", "num")
