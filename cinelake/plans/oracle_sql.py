"""DuckDB oracle SQL per query key (same column names as the Spark results)."""

from __future__ import annotations

from cinelake.plans.oracle_views import with_views

ORACLES: dict[str, str] = {}


def oracle(key: str, body: str, extra: list[tuple[str, str]] | None = None) -> None:
    ORACLES[key] = with_views(body, extra)


def _importance(col: str = "importance") -> str:
    return f"CAST(CASE WHEN TRY_CAST({col} AS INTEGER) BETWEEN 0 AND 100 THEN TRY_CAST({col} AS INTEGER) ELSE 50 END AS INTEGER)"


SCORED_REQUESTS = f"SELECT request_id, user_id, {_importance()} AS rs_importance FROM v_requests"


def geo(a: str, b: str, wa: str, wb: str) -> str:
    v = f"pow(pow({a}, {wa}) * pow({b}, {wb}), 1.0 / ({wa} + {wb}))"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def tag_affinity_ctes(cand: str, rtags: str = "v_request_tags") -> list[tuple[str, str]]:
    return [
        ("aff_cand", f"SELECT DISTINCT request_id, item_id FROM ({cand})"),
        ("aff_pt", "SELECT item_id, tag_id, max(num) AS num FROM v_tag_count GROUP BY item_id, tag_id"),
        ("aff_tot", "SELECT item_id, sum(num) AS total FROM v_tag_count GROUP BY item_id"),
        (
            "aff_hits",
            f"""SELECT c.request_id, c.item_id, sum(pt.num) AS hit FROM aff_cand c
                JOIN (SELECT DISTINCT request_id, tag_id FROM {rtags}) rt ON c.request_id = rt.request_id
                JOIN aff_pt pt ON pt.item_id = c.item_id AND pt.tag_id = rt.tag_id
                GROUP BY c.request_id, c.item_id""",
        ),
        (
            "aff",
            """SELECT c.request_id, c.item_id,
                 CAST(CASE WHEN coalesce(t.total, 0) = 0 THEN 0.0
                      ELSE round_even(coalesce(h.hit, 0) / t.total, 3) END AS DOUBLE) AS secondary_score
               FROM aff_cand c LEFT JOIN aff_hits h ON c.request_id = h.request_id AND c.item_id = h.item_id
               LEFT JOIN aff_tot t ON c.item_id = t.item_id""",
        ),
    ]


def blend_tags_ctes(primary: str, cols: str, rtags: str = "v_request_tags") -> list[tuple[str, str]]:
    """primary: SQL with request_id, item_id, primary_score and the item columns ``cols``."""
    ctes = [("bt_primary", primary), ("bt_req", SCORED_REQUESTS)] + tag_affinity_ctes("SELECT request_id, item_id FROM bt_primary", rtags)
    ctes.append(
        (
            "bt_mix",
            f"""SELECT p.request_id, p.item_id, {cols}, p.primary_score,
                 CASE WHEN ign_ THEN NULL ELSE a.secondary_score END AS secondary_score,
                 CASE WHEN ign_ THEN p.primary_score
                      ELSE {geo('p.primary_score', 'a.secondary_score', 'w_', '(1.0 - w_)')} END AS combined_score
               FROM (SELECT p.*, q.rs_importance / 100.0 AS w_,
                            (coalesce(n.n_tags, 0) = 0 OR q.rs_importance = 100) AS ign_
                     FROM bt_primary p JOIN bt_req q ON p.request_id = q.request_id
                     LEFT JOIN (SELECT request_id, count(*) AS n_tags FROM {rtags} GROUP BY request_id) n
                       ON p.request_id = n.request_id) p
               LEFT JOIN aff a ON p.request_id = a.request_id AND p.item_id = a.item_id""",
        )
    )
    ctes.append(
        (
            "bt_out",
            f"""SELECT request_id, item_id, {cols}, primary_score, secondary_score,
                 round_even(combined_score / nullif(max(combined_score) OVER (PARTITION BY request_id), 0) * 10.0, 2)
                   AS combined_score
               FROM bt_mix""",
        )
    )
    return ctes


POPULAR_SAMPLE = """SELECT item_id, title, popularity, imdb_id,
       popularity / max(popularity) OVER () AS score
   FROM (SELECT * FROM v_movies WHERE pop_rank <= {top}
         ORDER BY md5(CAST(item_id AS VARCHAR) || ':42'), item_id LIMIT {k})"""

# ---------------------------------------------------------------- step 1

oracle("scan_ratings", "SELECT user_id, item_id, rating FROM v_ratings")
oracle("scan_movies", "SELECT item_id, title, popularity, substring(imdb_id, 3) AS imdbId FROM v_movies")
oracle("dedup_ratings", "SELECT user_id, item_id, rating FROM v_ratings")
oracle("popularity", "SELECT item_id, title, year, imdb_id, popularity, pop_rank FROM v_movies")
oracle(
    "tag_affinity",
    "SELECT request_id, item_id, secondary_score FROM aff",
    tag_affinity_ctes("SELECT request_id, item_id FROM v_request_ratings"),
)
oracle(
    "geo_blend",
    f"""SELECT r.request_id, r.item_id,
          round_even({geo('r.rating', 'CAST(r.item_id % 7 - 1 AS DOUBLE)', '(q.rs_importance / 100.0)', '(1.0 - q.rs_importance / 100.0)')}, 6) AS blended
        FROM v_request_ratings r JOIN ({SCORED_REQUESTS}) q ON r.request_id = q.request_id""",
)
oracle(
    "tag_recommend_popular",
    "SELECT * FROM bt_out",
    [("samp", POPULAR_SAMPLE.format(top=600, k=60))]
    + blend_tags_ctes(
        "SELECT q.request_id, s.item_id, s.title, s.popularity, s.imdb_id, round_even(s.score, 3) AS primary_score "
        "FROM v_requests q JOIN samp s ON true",
        "title, popularity, imdb_id",
    ),
)

# ---------------------------------------------------------------- step 2

CORPUS = [(f"c_{n}", f"SELECT * FROM v_{n}") for n in ("titled", "active", "popular", "test_users", "split")]

oracle("clean_titles", "SELECT item_id, title, year, imdb_id FROM v_clean_titles")
oracle("active_users", "SELECT user_id, item_id, rating FROM c_active", CORPUS[:2])
oracle("popular_items", "SELECT user_id, item_id, rating FROM c_popular", CORPUS[:3])
oracle("active_movies", "SELECT * FROM v_clean_titles WHERE item_id IN (SELECT item_id FROM v_active)")
oracle("active_tag_counts", "SELECT * FROM v_tag_count WHERE item_id IN (SELECT item_id FROM v_active)")
oracle("popular_movies", "SELECT * FROM v_clean_titles WHERE item_id IN (SELECT item_id FROM v_popular)")
oracle("train_test_split", "SELECT * FROM c_split", CORPUS)
oracle(
    "split_checks",
    """SELECT (SELECT count(DISTINCT item_id) FROM c_split WHERE split = 'train')
                = (SELECT count(DISTINCT item_id) FROM c_split) AS train_covers_all_items,
              (SELECT count(*) FROM (SELECT user_id FROM c_split WHERE split = 'train'
                                     INTERSECT SELECT user_id FROM c_split WHERE split = 'test')) = 0 AS users_disjoint,
              (SELECT count(DISTINCT item_id) FROM c_split) AS n_items,
              (SELECT count(DISTINCT user_id) FROM c_split WHERE split = 'train') AS n_train_users,
              (SELECT count(DISTINCT user_id) FROM c_split WHERE split = 'test') AS n_test_users""",
    CORPUS,
)
_stages = [
    ("raw", "v_ratings_raw"),
    ("dedup", "v_ratings"),
    ("titled", "c_titled"),
    ("active", "c_active"),
    ("popular", "c_popular"),
    ("train", "(SELECT * FROM c_split WHERE split = 'train')"),
    ("test", "(SELECT * FROM c_split WHERE split = 'test')"),
]
for _key in ("corpus_stats", "corpus_sketches"):  # sketches of this few values are exact
    oracle(
        _key,
        "\nUNION ALL\n".join(
            f"SELECT {i} AS stage_no, '{n}' AS stage, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, "
            f"count(DISTINCT item_id) AS n_items FROM {t}"
            for i, (n, t) in enumerate(_stages)
        ),
        CORPUS,
    )
oracle(
    "tag_usage",
    """SELECT t.id AS tag_id, t.tag, CAST(u.total AS BIGINT) AS total,
              row_number() OVER (ORDER BY u.total DESC, t.id) AS usage_rank
       FROM v_tags t JOIN (SELECT tag_id, sum(num) AS total FROM v_tag_count GROUP BY tag_id) u ON t.id = u.tag_id""",
)


# ---------------------------------------------------------------- step 3: model

LAMBDA = 50.0


def model_ctes(lam: float = LAMBDA, implicit: bool = False, sfx: str = "") -> list[tuple[str, str]]:
    """Train split -> index -> Gram -> Gauss-Jordan inverse (recursive CTE) -> weights."""
    if implicit:
        gval = "CAST(sum(a.c * b.c) AS DOUBLE)"
    else:
        gval = "sum((a.r / (SELECT max(rating) FROM m_train)) * (b.r / (SELECT max(rating) FROM m_train)))"
    s = sfx
    return CORPUS + [
        ("m_train", "SELECT user_id, item_id, rating FROM c_split WHERE split = 'train'"),
        ("m_idx", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM m_train)"),
        ("m_n", "SELECT count(*) AS n FROM m_idx"),
        ("m_x", "SELECT t.user_id, i.idx, sum(t.rating) AS r, count(*) AS c FROM m_train t JOIN m_idx i ON t.item_id = i.item_id GROUP BY t.user_id, i.idx"),
        (f"m_g{s}", f"SELECT a.idx AS i, b.idx AS j, {gval} AS g FROM m_x a JOIN m_x b ON a.user_id = b.user_id GROUP BY a.idx, b.idx"),
        (
            f"m_dense{s}",
            f"""SELECT r.idx AS i,
                  list(coalesce(g.g, 0.0) + CASE WHEN r.idx = c.idx THEN {lam} ELSE 0.0 END ORDER BY c.idx)
                  || list(CASE WHEN r.idx = c.idx THEN 1.0 ELSE 0.0 END ORDER BY c.idx) AS row
                FROM m_idx r JOIN m_idx c ON true LEFT JOIN m_g{s} g ON g.i = r.idx AND g.j = c.idx
                GROUP BY r.idx""",
        ),
        (
            f"m_gj{s}(k, i, row)",
            f"""SELECT 0, i, row FROM m_dense{s}
                UNION ALL
                SELECT k + 1, i,
                  CASE WHEN i = k THEN list_transform(row, lambda x: x / piv[k + 1])
                       ELSE list_transform(row, lambda x, q: x - (row[k + 1] / piv[k + 1]) * piv[q]) END
                FROM (SELECT *, max(CASE WHEN i = k THEN row END) OVER () AS piv FROM m_gj{s})
                WHERE k < (SELECT n FROM m_n)""",
        ),
        (
            f"m_p{s}",
            f"""SELECT i, CAST(j - 1 - n AS BIGINT) AS j, p FROM (
                  SELECT g.i, m_n.n, unnest(g.row) AS p, generate_subscripts(g.row, 1) AS j
                  FROM m_gj{s} g, m_n WHERE g.k = m_n.n) WHERE j > n""",
        ),
        (
            f"m_b{s}",
            f"""SELECT p.i, p.j, CASE WHEN p.i = p.j THEN 0.0 ELSE -p.p / d.p END AS b
                FROM m_p{s} p JOIN m_p{s} d ON d.i = d.j AND d.j = p.j""",
        ),
        (f"m_thr{s}", f"SELECT quantile_cont(abs(b), {SPARSITY_Q}) AS thr FROM m_b{s}"),
        (
            f"m_w{s}",
            f"""SELECT si.item_id AS src_item, di.item_id AS dst_item, b.b AS w
                FROM m_b{s} b JOIN m_idx si ON si.idx = b.i JOIN m_idx di ON di.idx = b.j, m_thr{s} t
                WHERE abs(b.b) >= t.thr AND b.b <> 0""",
        ),
    ]


SPARSITY_Q = 0.98
NAMES = "JOIN (SELECT item_id, title, popularity, imdb_id FROM v_movies) nm ON nm.item_id = t.item_id"


def recommend_ctes(req: str, k: int, sfx: str = "", out: str = "") -> list[tuple[str, str]]:
    """Brute force: every unrated model item is a candidate, unscored ones score 0."""
    s = sfx
    return [
        ("r_req", req),
        ("r_known", "SELECT * FROM r_req WHERE item_id IN (SELECT item_id FROM m_idx)"),
        (
            "r_cand",
            """SELECT q.request_id, i.item_id FROM (SELECT DISTINCT request_id FROM r_req) q JOIN m_idx i ON true
               WHERE NOT EXISTS (SELECT 1 FROM r_known k WHERE k.request_id = q.request_id AND k.item_id = i.item_id)""",
        ),
        (
            f"r_sc{out}",
            f"""SELECT k.request_id, w.dst_item AS item_id, sum(k.rating * w.w) AS s
                FROM r_known k JOIN m_w{s} w ON w.src_item = k.item_id GROUP BY k.request_id, w.dst_item""",
        ),
        (
            f"r_top{out}",
            f"""SELECT * FROM (
                  SELECT c.request_id, c.item_id, coalesce(round_even(s.s, 9), 0.0) + 0.0 AS score,
                         row_number() OVER (PARTITION BY c.request_id
                                            ORDER BY coalesce(round_even(s.s, 9), 0.0) DESC, c.item_id) AS rank
                  FROM r_cand c LEFT JOIN r_sc{out} s ON s.request_id = c.request_id AND s.item_id = c.item_id)
                WHERE rank <= {k}""",
        ),
    ]


REQ = "SELECT request_id, item_id, rating FROM v_request_ratings"

oracle("item_index", "SELECT item_id, idx FROM m_idx", model_ctes()[:7])
oracle(
    "gram_matrix",
    "SELECT a.item_id AS item_i, b.item_id AS item_j, round_even(g.g, 9) AS g FROM m_g g "
    "JOIN m_idx a ON a.idx = g.i JOIN m_idx b ON b.idx = g.j",
    model_ctes()[:10],
)
oracle(
    "gram_implicit",
    "SELECT a.item_id AS item_i, b.item_id AS item_j, round_even(g.g, 9) AS g FROM m_g g "
    "JOIN m_idx a ON a.idx = g.i JOIN m_idx b ON b.idx = g.j",
    model_ctes(implicit=True)[:10],
)
oracle(
    "gram_inverse",
    "SELECT a.item_id AS item_i, b.item_id AS item_j, round_even(p.p, 9) AS p FROM m_p p "
    "JOIN m_idx a ON a.idx = p.i JOIN m_idx b ON b.idx = p.j",
    model_ctes()[:13],
)
for _key in ("ease_weights", "ease_weights_solved"):
    oracle(_key, "SELECT src_item, dst_item, round_even(w, 9) AS w FROM m_w", model_ctes())
for _key in ("ease_recommend", "ease_recommend_early"):
    oracle(
        _key,
        f"SELECT t.request_id, t.item_id, t.score, t.rank, nm.title, nm.popularity, nm.imdb_id FROM r_top t {NAMES}",
        model_ctes() + recommend_ctes(REQ, 10),
    )
oracle("popular_fallback", "SELECT * FROM samp", [("samp", POPULAR_SAMPLE.format(top=100, k=10))])
oracle(
    "recommend",
    f"""SELECT t.request_id, t.item_id, t.score, nm.title, nm.popularity, nm.imdb_id, 'ease' AS source FROM r_top t {NAMES}
        UNION ALL
        SELECT q.request_id, s.item_id, s.score, s.title, s.popularity, s.imdb_id, 'popular' AS source
        FROM v_requests q JOIN samp s ON true
        WHERE q.request_id NOT IN (SELECT request_id FROM v_request_ratings)""",
    model_ctes() + recommend_ctes(REQ, 10) + [("samp", POPULAR_SAMPLE.format(top=100, k=10))],
)


# ---------------------------------------------------------------- step 4

DIGITS = "regexp_full_match({c}, '[0-9]+')"
FORM_VALID = f"""SELECT request_id, item_id, rating, pos FROM (
    SELECT request_id, TRY_CAST(movie_id AS BIGINT) AS item_id, TRY_CAST(rating AS BIGINT) AS rating, pos,
           row_number() OVER (PARTITION BY request_id, TRY_CAST(movie_id AS BIGINT) ORDER BY pos DESC) AS rn_
    FROM v_form_ratings
    WHERE {DIGITS.format(c='movie_id')} AND {DIGITS.format(c='rating')}
      AND TRY_CAST(rating AS BIGINT) BETWEEN 1 AND 5
      AND TRY_CAST(movie_id AS BIGINT) IN (SELECT item_id FROM v_movies)) WHERE rn_ = 1"""
FORM_TAGS = f"""SELECT DISTINCT request_id, TRY_CAST(tag_id AS BIGINT) AS tag_id FROM v_form_tags
    WHERE {DIGITS.format(c='tag_id')} AND TRY_CAST(tag_id AS BIGINT) IN (SELECT id FROM v_tags)"""
STATE_LAST = """SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_key ORDER BY ts DESC, event_id DESC) AS rn_
    FROM v_rating_events) WHERE rn_ = 1"""
STATE = "SELECT user_id, item_key, rating FROM s_last WHERE op = 'upsert'"
PAST = """SELECT q.request_id, s.item_key AS item_id, CAST(s.rating AS DOUBLE) AS rating
    FROM v_requests q JOIN s_state s ON q.user_id = s.user_id WHERE q.request_id % 20 = 0"""
LITE = """SELECT request_id, item_id, rating FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, item_id ORDER BY src_ DESC, pos DESC) AS rn_ FROM (
      SELECT request_id, item_id, CAST(rating AS DOUBLE) AS rating, 0 AS src_, pos FROM f_valid
      UNION ALL
      SELECT request_id, item_id, rating, 1, row_number() OVER (PARTITION BY request_id ORDER BY item_id) FROM s_past))
    WHERE rn_ = 1"""
REQ_CTES = [("f_valid", FORM_VALID), ("f_tags", FORM_TAGS), ("s_last", STATE_LAST), ("s_state", STATE), ("s_past", PAST), ("f_lite", LITE)]

oracle("valid_ratings", "SELECT * FROM f_valid", REQ_CTES[:1])
oracle("valid_tags", "SELECT * FROM f_tags", REQ_CTES[1:2])
oracle("valid_importance", f"SELECT request_id, importance, {_importance()} AS rs_importance FROM v_requests")
oracle("request_ratings", "SELECT * FROM f_lite", REQ_CTES)
oracle(
    "resolve_names",
    """SELECT r.request_id, 'movie' AS kind, r.item_id AS id, m.title AS name, r.rating FROM f_lite r JOIN v_movies m ON m.item_id = r.item_id
       UNION ALL
       SELECT t.request_id, 'tag', t.tag_id, g.tag, CAST(NULL AS DOUBLE) FROM f_tags t JOIN v_tags g ON g.id = t.tag_id""",
    REQ_CTES,
)
oracle("rating_state", "SELECT * FROM s_state", REQ_CTES[2:4])
oracle("rating_state_stream", "SELECT * FROM s_state", REQ_CTES[2:4])
oracle(
    "delete_outcomes",
    """SELECT event_id, user_id, item_key, coalesce(prev_ = 'upsert', false) AS found FROM (
         SELECT *, lag(op) OVER (PARTITION BY user_id, item_key ORDER BY ts, event_id) AS prev_ FROM v_rating_events)
       WHERE op = 'delete'""",
)
oracle(
    "first_registration",
    """SELECT event_id, name, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) = 1 AS accepted FROM (
         SELECT event_id, ts, 'user' || CAST(user_id AS VARCHAR) AS name FROM events WHERE event_type = 'signup')""",
)
oracle(
    "user_profile",
    "SELECT s.user_id, m.imdb_id, m.title, m.year, s.rating FROM s_state s JOIN v_movies m ON m.item_id = s.item_key",
    REQ_CTES[2:4],
)
LITE_CAND = """SELECT t.request_id, t.item_id, nm.title, nm.popularity, nm.imdb_id, t.score FROM r_top t
      JOIN (SELECT item_id, title, popularity, imdb_id FROM v_movies) nm ON nm.item_id = t.item_id
    UNION ALL
    SELECT q.request_id, s.item_id, s.title, s.popularity, s.imdb_id, s.score FROM bt_req q JOIN samp s ON true
    WHERE q.request_id NOT IN (SELECT request_id FROM r_req)"""
oracle(
    "blend_tag",
    "SELECT * FROM bt_out",
    model_ctes()
    + REQ_CTES
    + [("bt_req0", SCORED_REQUESTS)]
    + recommend_ctes("SELECT * FROM f_lite WHERE request_id IN (SELECT request_id FROM bt_req0 WHERE rs_importance <> 0)", 60)
    + [("samp", POPULAR_SAMPLE.format(top=600, k=60)), ("lite_cand", LITE_CAND.replace("bt_req", "bt_req0"))]
    + blend_tags_ctes(
        "SELECT request_id, item_id, title, popularity, imdb_id, round_even(score, 3) AS primary_score FROM lite_cand",
        "title, popularity, imdb_id",
        rtags="f_tags",
    ),
)


# ---------------------------------------------------------------- step 5 and 7

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
PAIR_RE = "'(?s)^(.*): (.*)$'"
NUM_RE = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


PARSED = [
    ("pa_p", "SELECT answer_id, string_split(answer, '---') AS parts_ FROM v_answers"),
    (
        "pa_q",
        f"""SELECT answer_id, len(parts_) = 2 AS two_, {_strip('parts_[1]')} AS left_, parts_[2] AS right_ FROM pa_p""",
    ),
    (
        "pa_r",
        f"""SELECT answer_id,
              CASE WHEN two_ AND NOT contains(right_, '<EMPTY>') THEN {_strip('right_')} END AS preferences,
              string_split(left_, ';;;') AS items_,
              coalesce(two_ AND NOT contains(left_, '<EMPTY>'), false) AS ok0_ FROM pa_q""",
    ),
    (
        "pa_s",
        f"""SELECT *, ok0_ AND coalesce(list_aggregate(list_transform(items_, lambda x:
                 regexp_matches(x, {PAIR_RE}) AND regexp_full_match({_strip(f"regexp_extract(x, {PAIR_RE}, 2)")}, {NUM_RE})), 'bool_and'), false)
               AS ok_ FROM pa_r""",
    ),
    (
        "pa",
        f"""SELECT answer_id, CAST(i_ - 1 AS INTEGER) AS pos, regexp_extract(x_, {PAIR_RE}, 1) AS name,
                   CAST({_strip(f"regexp_extract(x_, {PAIR_RE}, 2)")} AS DOUBLE) AS rating, preferences, true AS ratings_ok
            FROM (SELECT *, unnest(items_) AS x_, generate_subscripts(items_, 1) AS i_ FROM pa_s WHERE ok_)
            UNION ALL
            SELECT answer_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), preferences, false
            FROM pa_s WHERE NOT ok_""",
    ),
]
oracle("parse_answers", "SELECT * FROM pa", PARSED)

MOVIE_ALTS = "list_transform(string_split(left(title, greatest(length(title) - 7, 0)), ' (a.k.a. '), lambda x, i: CASE WHEN i = 2 THEN left(x, greatest(length(x) - 1, 0)) ELSE x END)"
PLOT_ALTS = "list_transform(string_split(title, ' (aka '), lambda x, i: CASE WHEN i = 2 THEN left(x, greatest(length(x) - 1, 0)) ELSE x END)"
EDGES = [
    ("e_m", f"SELECT item_id, year, {MOVIE_ALTS} AS alts FROM v_clean_titles"),
    ("e_p", f"SELECT plot_id, year, {PLOT_ALTS} AS alts FROM v_plots"),
    (
        "e_all",
        """SELECT p.plot_id, m.item_id, m.year,
             CAST(list_min(flatten(list_transform(m.alts, lambda a: list_transform(p.alts, lambda b: levenshtein(b, a))))) AS INTEGER) AS distance
           FROM e_p p JOIN e_m m ON p.year = m.year""",
    ),
    ("edges", "SELECT * FROM e_all WHERE distance <= 3"),
]
oracle("title_distance", "SELECT plot_id, item_id, year, distance FROM edges", EDGES)

ROUNDS = EDGES + [
    (
        "rounds(r, kind, plot_id, item_id, distance)",
        """SELECT 0, 'edge', plot_id, item_id, distance FROM edges
           UNION ALL
           SELECT r + 1, CASE WHEN kind = 'match' OR won_ THEN 'match' ELSE 'edge' END, plot_id, item_id, distance FROM (
             SELECT *, bool_or(won_) OVER (PARTITION BY plot_id) AS pdone_, bool_or(won_) OVER (PARTITION BY item_id) AS mdone_,
                    sum(CASE WHEN kind = 'edge' THEN 1 ELSE 0 END) OVER () AS n_edges_
             FROM (
               SELECT *, kind = 'edge'
                   AND key_ = min(CASE WHEN kind = 'edge' THEN key_ END) OVER (PARTITION BY plot_id)
                   AND key_ = min(CASE WHEN kind = 'edge' THEN key_ END) OVER (PARTITION BY item_id) AS won_
               FROM (SELECT *, distance * 1000000000000 + plot_id * 1000000 + item_id AS key_ FROM rounds)))
           WHERE n_edges_ > 0 AND (kind = 'match' OR won_ OR NOT (pdone_ OR mdone_))""",
    ),
    ("matched", "SELECT plot_id, item_id, distance FROM rounds WHERE kind = 'match' AND r = (SELECT max(r) FROM rounds)"),
]
oracle(
    "match_plots",
    "SELECT m.item_id, m.plot_id, p.year, p.title, m.distance FROM matched m JOIN v_plots p ON p.plot_id = m.plot_id",
    ROUNDS,
)
PLOT_TEXT = "SELECT m.item_id, 'Plot of \"' || p.title || '\": ' || p.plot AS plot_text FROM matched m JOIN v_plots p ON p.plot_id = m.plot_id"
oracle(
    "plot_lookup",
    "SELECT v.item_id, t.plot_text FROM v_movies v LEFT JOIN plot_txt t ON t.item_id = v.item_id",
    ROUNDS + [("plot_txt", PLOT_TEXT)],
)

NAMES_RESOLVED = PARSED + [
    ("rn_names", "SELECT answer_id, pos, name, rating FROM pa WHERE name IS NOT NULL"),
    (
        "rn_al",
        "SELECT item_id, pop_rank, unnest(string_split(lower(left(title, greatest(length(title) - 7, 0))), ' (a.k.a. ')) AS alias FROM v_movies",
    ),
    (
        "rn_best",
        """SELECT * FROM (
             SELECT n.answer_id, n.pos, a.item_id, levenshtein(lower(n.name), a.alias) AS d,
                    row_number() OVER (PARTITION BY n.answer_id, n.pos ORDER BY levenshtein(lower(n.name), a.alias), a.pop_rank) AS rn_
             FROM rn_names n JOIN rn_al a ON abs(length(lower(n.name)) - length(a.alias)) <= 2
             WHERE levenshtein(lower(n.name), a.alias) <= 2) WHERE rn_ = 1""",
    ),
    (
        "resolved",
        """SELECT n.answer_id, n.pos, n.name, n.rating, b.item_id, CAST(b.d AS INTEGER) AS distance
           FROM rn_names n JOIN rn_best b ON n.answer_id = b.answer_id AND n.pos = b.pos""",
    ),
]
oracle("resolve_titles", "SELECT * FROM resolved", NAMES_RESOLVED)

FIT_TEXT = """SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'x --- bad'
                 WHEN conv_id % 5 = 1 THEN CAST(turn % 5 + 1 AS VARCHAR)
                 ELSE CAST(turn % 5 + 1 AS VARCHAR) || ' --- Because ' || text END AS text
              FROM conversations WHERE role = 'assistant'"""


def fitness_sql(text: str) -> str:
    head = _strip(f"string_split({text}, '---')[1]")
    ok = f"regexp_full_match({head}, {NUM_RE})"
    return (
        f"coalesce(CASE WHEN {ok} THEN CAST({head} AS DOUBLE) END, 3.0) AS score, "
        f"CASE WHEN NOT {ok} THEN 'ERROR: Failed to parse the answer.' "
        f"WHEN len(string_split({text}, '---')) >= 2 THEN {_strip(f'string_split({text}, {chr(39)}---{chr(39)})[2]')} END AS explanation"
    )


oracle("completion_answers", f"SELECT conv_id, turn, {_strip('text')} AS answer FROM conversations WHERE role = 'assistant'")
oracle("parse_fitness", f"SELECT conv_id, turn, {fitness_sql('text')} FROM ft", [("ft", FIT_TEXT)])
oracle(
    "transcript_messages",
    f"""SELECT conv_id, 0 AS msg_pos, 'system' AS role, 'You are a helpful assistant.' AS content FROM v_transcripts
        UNION ALL
        SELECT conv_id, CAST(i_ AS INTEGER), CASE WHEN (i_ - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END, {_strip('x_')}
        FROM (SELECT conv_id, unnest(pieces_[1:len(pieces_) - 1]) AS x_, generate_subscripts(pieces_[1:len(pieces_) - 1], 1) AS i_
              FROM (SELECT conv_id, string_split({_strip('transcript')}, '<LINEBREAK>') AS pieces_ FROM v_transcripts))""",
)
FIRST_ALIAS = "split_part(left(m.title, greatest(length(m.title) - 7, 0)), ' (a.k.a. ', 1)"
oracle(
    "ratings_text",
    f"""SELECT request_id, string_agg(line_, '' ORDER BY pos) AS ratings_text,
               string_agg(line_, '' ORDER BY pos) || ' Currently, I''m in a mood for ' || 'something like ' || arg_max(name_, pos) AS full_prompt
        FROM (SELECT r.request_id, r.pos, {FIRST_ALIAS} AS name_, {FIRST_ALIAS} || ': ' || CAST(r.rating AS VARCHAR) || chr(10) AS line_
              FROM v_request_ratings r JOIN v_movies m ON m.item_id = r.item_id)
        GROUP BY request_id""",
)



def sql_text(v: str) -> str:
    """A Python string as a DuckDB expression (quotes doubled, newlines as chr(10))."""
    pieces = ["'" + x.replace("'", "''") + "'" for x in v.split("\n")]
    return " || chr(10) || ".join(pieces)


_ASK = (
    "You will read {n} requests. For each, list the movies the writer mentions with a 1-5 score as '<movie_name>: <rating>' joined by ';;;', "
    "then ' --- ' and their general wish; write <EMPTY> for a missing side."
)
_SHOTS = """{o}Request 1/{n}: "I loved 'Arrival' and 'Contact' but 'Armageddon' bored me. Something quiet and thoughtful, please."{c}
Arrival: 5;;;Contact: 5;;;Armageddon: 2 --- I want a quiet, thoughtful film.{e}
{o}Request 2/{n}: "Show me a film about a long train journey."{c}
<EMPTY> --- I want a film about a long train journey.{e}
{o}Request 3/{n}: "'Heat' is great and 'Ronin' is fine."{c}
Heat: 5;;;Ronin: 4 --- <EMPTY>.{e}
{o}Request 4/{n}: ""{c}
<EMPTY> --- <EMPTY>.{e}
{o}Request 5/{n}: \""""
CHAT_HEAD = _ASK.format(n=6) + "<LINEBREAK>\nReady.<LINEBREAK>\n" + _SHOTS.format(n=6, o="", c="<LINEBREAK>", e="<LINEBREAK>")
INST_HEAD = "<s>[INST]" + _ASK.format(n=5) + "[/INST]\nReady.</s>\n" + _SHOTS.format(n=5, o="[INST]", c="[/INST]", e="</s>")
FITNESS = "Score from 1 to 5 how well the movie plot below suits the viewer's wishes, then give one short reason, as '<rating_number> --- <reason>.'\n\nWishes: \""
DESCRIBE = "Describe in one short phrase what kind of film this is: "
TELL = "Say in the first person how you liked these films:\n"


def _prompt_oracles() -> None:
    oracle(
        "extraction_prompts",
        f"""SELECT conv_id, turn, 'chat' AS dialect, {sql_text(CHAT_HEAD)} || text || {sql_text('"<LINEBREAK>')} AS prompt FROM conversations WHERE role = 'user'
            UNION ALL
            SELECT conv_id, turn, 'instruction', {sql_text(INST_HEAD)} || text || {sql_text('"[/INST]')} FROM conversations WHERE role = 'user'""",
    )

    def two_shots(key: str, source: str, texts: list[str], last: str) -> str:
        rows = [("system", sql_text("You are a helpful assistant.")), *zip(("user", "assistant") * 2, map(sql_text, texts)), ("user", last)]
        return "\nUNION ALL\n".join(f"SELECT {key}, {p} AS msg_pos, '{r}' AS role, {c} AS content FROM {source}" for p, (r, c) in enumerate(rows))

    oracle(
        "message_batches",
        two_shots(
            "item_id",
            "v_movies",
            [DESCRIBE + "Alien (1979)", "a claustrophobic space horror", DESCRIBE + "Amelie (2001)", "a whimsical romantic comedy set in Paris"],
            sql_text(DESCRIBE) + " || title",
        ),
    )
    oracle(
        "rating_message_batches",
        two_shots(
            "request_id",
            "rt",
            [TELL + "Alien (1979): 5.0\n", "I loved Alien.", TELL + "Cats (2019): 1.0\nHeat (1995): 4.0\n", "I could not stand Cats, but I liked Heat."],
            sql_text(TELL) + " || ratings_text",
        ),
        [
            (
                "rt",
                f"""SELECT request_id, string_agg({FIRST_ALIAS} || ': ' || CAST(r.rating AS VARCHAR) || chr(10), '' ORDER BY r.pos) AS ratings_text
                    FROM v_request_ratings r JOIN v_movies m ON m.item_id = r.item_id GROUP BY request_id""",
            )
        ],
    )
    FIT["chat"] = f"""{sql_text(FITNESS)} || preferences || {sql_text('".' + chr(10))} || plot || '<LINEBREAK>'"""
    FIT["inst"] = f"""{sql_text("<s>[INST]" + FITNESS)} || preferences || {sql_text('".' + chr(10))} || plot || '[/INST]'"""


FIT: dict[str, str] = {}
LLM_CTES = (
    model_ctes()
    + NAMES_RESOLVED
    + ROUNDS
    + [("plot_txt", PLOT_TEXT), ("s_last", STATE_LAST), ("s_state", STATE)]
    + [
        (
            "l_req",
            "SELECT answer_id AS request_id, CAST(CASE WHEN answer_id % 5 = 0 THEN 100 WHEN answer_id % 5 = 1 THEN 0 ELSE 50 END AS INTEGER) AS rs_importance FROM v_answers",
        ),
        (
            "l_ratings",
            """SELECT request_id, item_id, rating FROM (
                 SELECT *, row_number() OVER (PARTITION BY request_id, item_id ORDER BY pos DESC) AS rn_ FROM (
                   SELECT answer_id AS request_id, item_id, rating, pos FROM resolved
                   UNION ALL
                   SELECT a.answer_id, s.item_key, CAST(s.rating AS DOUBLE), -1 FROM v_answers a JOIN s_state s ON s.user_id = a.user_id))
               WHERE rn_ = 1""",
        ),
    ]
    + recommend_ctes("SELECT * FROM l_ratings WHERE request_id IN (SELECT request_id FROM l_req WHERE rs_importance <> 0)", 10)
    + [
        ("samp", POPULAR_SAMPLE.format(top=100, k=10)),
        ("l_cand0", LITE_CAND.replace("bt_req", "l_req")),
        ("l_prefs", "SELECT answer_id AS request_id, first(preferences) AS preferences FROM pa GROUP BY answer_id"),
        (
            "l_cand",
            """SELECT c.*, q.rs_importance, p.preferences, t.plot_text, round_even(c.score, 2) AS rs_score
               FROM l_cand0 c JOIN l_req q ON q.request_id = c.request_id
               LEFT JOIN l_prefs p ON p.request_id = c.request_id LEFT JOIN plot_txt t ON t.item_id = c.item_id""",
        ),
        (
            "l_pairs",
            """SELECT request_id AS answer_id, item_id, preferences, plot_text AS plot FROM l_cand
               WHERE preferences IS NOT NULL AND rs_importance < 100 AND plot_text IS NOT NULL""",
        ),
        (
            "l_scored",
            """SELECT answer_id, item_id,
                 CAST(CAST(s_ AS VARCHAR) || ' --- Shares ' || CAST(CAST(s_ - 1 AS INTEGER) AS VARCHAR) || ' words with the wishes.' AS VARCHAR) AS answer
               FROM (SELECT *, CAST(least(5, 1 + len(list_intersect(string_split(lower(preferences), ' '), string_split(lower(plot), ' ')))) AS DOUBLE) AS s_
                     FROM l_pairs)""",
        ),
    ]
)
_prompt_oracles()
for _key in ("score_pairs", "score_ledger"):
    oracle(_key, f"SELECT answer_id, item_id, {fitness_sql('answer').replace(' AS score', ' AS llm_score')} FROM l_scored", LLM_CTES)
oracle(
    "fitness_prompts",
    f"SELECT answer_id, item_id, CASE WHEN answer_id % 2 = 1 THEN {FIT['inst']} ELSE {FIT['chat']} END AS prompt FROM l_pairs",
    LLM_CTES,
)
GEO_PLOT = geo("rs_score", "llm_score", "(rs_importance / 100.0)", "((100 - rs_importance) / 100.0)")
GEO_3 = geo("rs_score", "3.0", "(rs_importance / 100.0)", "((100 - rs_importance) / 100.0)")
oracle(
    "blend_llm",
    f"""SELECT answer_id, item_id, imdb_id, title,
          round_even(total_ / nullif(max(total_) OVER (PARTITION BY answer_id), 0) * 10.0, 2) AS total_score,
          rs_score, llm_score, explanation FROM (
        SELECT c.request_id AS answer_id, c.item_id, c.imdb_id, c.title, c.rs_score,
          CASE WHEN c.preferences IS NULL OR c.rs_importance >= 100 THEN c.rs_score
               WHEN c.plot_text IS NOT NULL THEN {GEO_PLOT.replace('llm_score', 'f.llm_score').replace('rs_score', 'c.rs_score').replace('rs_importance', 'c.rs_importance')}
               ELSE {GEO_3.replace('rs_score', 'c.rs_score').replace('rs_importance', 'c.rs_importance')} END AS total_,
          CASE WHEN c.preferences IS NULL OR c.rs_importance >= 100 OR c.plot_text IS NULL THEN NULL ELSE f.llm_score END AS llm_score,
          CASE WHEN c.rs_importance >= 100 THEN 'Only RS recommendations used.'
               WHEN c.preferences IS NULL THEN 'No general preferences found in user''s prompt.'
               WHEN c.plot_text IS NOT NULL THEN f.explanation
               ELSE 'Movie plot not found.' END AS explanation
        FROM l_cand c LEFT JOIN l_fit f ON f.answer_id = c.request_id AND f.item_id = c.item_id)""",
    LLM_CTES + [("l_fit", f"SELECT answer_id, item_id, {fitness_sql('answer').replace(' AS score', ' AS llm_score')} FROM l_scored")],
)


# ---------------------------------------------------------------- step 6

oracle(
    "title_search",
    """SELECT t.term_id, CAST(m.pop_rank AS BIGINT) AS rank, m.item_id, m.title
       FROM v_search_terms t JOIN v_movies m ON m.pop_rank <= 15
       WHERE regexp_replace(t.term, '^\\s+|\\s+$', '', 'g') = ''
       UNION ALL
       SELECT term_id, rank, item_id, title FROM (
         SELECT t.term_id, m.item_id, m.title,
                row_number() OVER (PARTITION BY t.term_id ORDER BY m.popularity * rel_ DESC, m.pop_rank) AS rank
         FROM v_search_terms t JOIN v_movies m ON m.title ILIKE '%' || t.term || '%',
         LATERAL (SELECT CASE WHEN p_ = 0 THEN 0.0
                              WHEN starts_with(words_[p_], lower(t.term)) THEN 1.0 / p_
                              ELSE 0.1 / p_ END AS rel_
                  FROM (SELECT words_, coalesce(list_position(list_transform(words_, lambda w: contains(w, lower(t.term))), true), 0) AS p_
                        FROM (SELECT regexp_split_to_array(lower(m.title), '\\s+') AS words_)))
         WHERE regexp_replace(t.term, '^\\s+|\\s+$', '', 'g') <> '')
       WHERE rank <= 15""",
)
oracle(
    "tag_search",
    """SELECT DISTINCT t.term_id, g.id AS tag_id, g.tag FROM v_search_terms t JOIN v_tags g
         ON regexp_replace(t.term, '^\\s+|\\s+$', '', 'g') = ''
         OR list_bool_or(list_transform(regexp_split_to_array(lower(g.tag), '\\s+'), lambda w: starts_with(w, lower(t.term))))""",
)
oracle(
    "link_ids",
    """SELECT m.item_id, m.imdb_id, l.tmdb_id, l.tmdb_id IS NOT NULL AS matched
       FROM v_movies m LEFT JOIN (SELECT imdbId, arg_max(tmdbId, line) AS tmdb_id FROM v_links GROUP BY imdbId) l
         ON l.imdbId = regexp_replace(m.imdb_id, '^tt', '')""",
)
oracle(
    "best_poster",
    """SELECT item, iso_639_1, vote_count, vote_average, file_path FROM (
         SELECT *, row_number() OVER (PARTITION BY item ORDER BY (iso_639_1 = 'en') DESC, vote_count DESC, vote_average DESC, pos) AS rn_
         FROM v_posters) WHERE rn_ = 1""",
)


# ---------------------------------------------------------------- step 8


def unique_ctes(*lists: list[tuple[str, str]]) -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for lst in lists:
        for n, q in lst:
            seen.setdefault(n, q)
    return list(seen.items())


def renamed(ctes: list[tuple[str, str]], names: list[str], pfx: str, subs: dict[str, str]) -> list[tuple[str, str]]:
    import re as _re

    pat = _re.compile(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b")
    out = []
    for n, q in ctes:
        for a, b in subs.items():
            q = q.replace(a, b)
        out.append((pat.sub(lambda m: pfx + m.group(1), n), pat.sub(lambda m: pfx + m.group(1), q)))
    return out


PAIR = "md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR) || ':{seed}')"
HOLD = CORPUS + [
    ("ho_test", "SELECT user_id, item_id, rating FROM c_split WHERE split = 'test'"),
    ("ho_ok", "SELECT * FROM ho_test WHERE user_id IN (SELECT user_id FROM ho_test GROUP BY user_id HAVING count(*) >= 25)"),
    (
        "ho",
        f"""SELECT user_id, item_id, rating,
              CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {PAIR.format(seed=42)}, item_id) <= 20
                   THEN 'sample' ELSE 'target' END AS part FROM ho_ok""",
    ),
]
oracle("holdout_split", "SELECT * FROM ho", HOLD)

HO_REQ = "SELECT user_id AS request_id, item_id, rating FROM ho WHERE part = 'sample'"


def pr_body(top: str) -> str:
    return f"""SELECT 20 AS k, count(*) AS n_users, round_even(avg(p_), 9) AS precision, round_even(avg(r_), 9) AS recall,
                 round_even(avg(CASE WHEN p_ + r_ > 0 THEN 2 * p_ * r_ / (p_ + r_) ELSE 0 END), 9) AS f1
          FROM (SELECT u.user_id, coalesce(h.h, 0) / 20.0 AS p_, coalesce(h.h, 0) / t.t AS r_
                FROM (SELECT DISTINCT user_id FROM ho) u
                LEFT JOIN (SELECT x.request_id AS user_id, count(*) AS h FROM {top} x
                           JOIN ho ON ho.user_id = x.request_id AND ho.item_id = x.item_id AND ho.part = 'target'
                           GROUP BY x.request_id) h ON h.user_id = u.user_id
                LEFT JOIN (SELECT user_id, count(*) AS t FROM ho WHERE part = 'target' GROUP BY user_id) t ON t.user_id = u.user_id)"""


oracle("precision_recall", pr_body("r_top"), unique_ctes(HOLD, model_ctes(), recommend_ctes(HO_REQ, 20)))
_sweep = [HOLD]
_parts = []
for _i, _lam in enumerate((5.0, 50.0, 500.0)):
    _sweep += [model_ctes(_lam, sfx=f"_{_i}"), recommend_ctes(HO_REQ, 20, sfx=f"_{_i}", out=f"_{_i}")]
    _parts.append(f"SELECT CAST({_lam} AS DOUBLE) AS \"lambda\", precision, recall, f1 FROM ({pr_body(f'r_top_{_i}')})")
oracle(
    "lambda_sweep",
    """SELECT *, row_number() OVER (ORDER BY precision DESC, "lambda") AS rank_precision,
              row_number() OVER (ORDER BY recall DESC, "lambda") AS rank_recall,
              row_number() OVER (ORDER BY f1 DESC, "lambda") AS rank_f1 FROM sweep""",
    unique_ctes(*_sweep, [("sweep", "\nUNION ALL\n".join(_parts))]),
)

TARGETS = CORPUS + ROUNDS + [
    ("et_train", "SELECT user_id, item_id, rating FROM c_split WHERE split = 'train'"),
    ("et_cohort", "SELECT user_id FROM (SELECT DISTINCT user_id FROM et_train) ORDER BY md5(CAST(user_id AS VARCHAR) || ':42'), user_id LIMIT 250"),
    ("et_r", "SELECT * FROM et_train WHERE user_id IN (SELECT user_id FROM et_cohort)"),
    (
        "et_target",
        f"""SELECT user_id, item_id, rating FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {PAIR.format(seed=42)}, item_id) AS rn_
              FROM et_r WHERE rating >= 4 AND item_id IN (SELECT item_id FROM matched)) WHERE rn_ = 1""",
    ),
    (
        "et_sample",
        f"""SELECT user_id, item_id, rating FROM (
              SELECT r.*, row_number() OVER (PARTITION BY r.user_id ORDER BY {PAIR.format(seed=43).replace('user_id', 'r.user_id').replace('item_id', 'r.item_id')}, r.item_id) AS rn_
              FROM et_r r WHERE r.user_id IN (SELECT user_id FROM et_target)
                AND NOT EXISTS (SELECT 1 FROM et_target t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)) WHERE rn_ <= 8""",
    ),
    ("targets", "SELECT *, 'target' AS role FROM et_target UNION ALL SELECT *, 'sample' FROM et_sample"),
]
oracle("eval_targets", "SELECT * FROM targets", TARGETS)
oracle(
    "evaluation_prompts",
    f"""SELECT *, ratings_prompt || ' Currently, I''m in a mood for ' || target_description AS full_prompt FROM (
          SELECT t.user_id, coalesce(s.lines_, '') AS ratings_text, coalesce(s.told_, '') AS ratings_prompt,
                 m.title AS target_title, 'something like ' || m.title AS target_description
          FROM targets t JOIN v_movies m ON m.item_id = t.item_id
          LEFT JOIN (SELECT t.user_id, string_agg({FIRST_ALIAS} || ': ' || CAST(t.rating AS VARCHAR) || chr(10), '' ORDER BY t.item_id) AS lines_,
                            'I ' || string_agg(CASE WHEN t.rating >= 4 THEN 'loved ' WHEN t.rating >= 2.5 THEN 'liked ' ELSE 'did not like ' END
                                               || {FIRST_ALIAS}, ', ' ORDER BY t.item_id) || '.' AS told_
                     FROM targets t JOIN v_movies m ON m.item_id = t.item_id WHERE t.role = 'sample' GROUP BY t.user_id) s
            ON s.user_id = t.user_id
          WHERE t.role = 'target')""",
    TARGETS,
)

T_REQ = "SELECT user_id AS request_id, item_id, rating FROM targets WHERE role = 'sample'"
EXPERIMENT = unique_ctes(
    TARGETS,
    model_ctes(),
    recommend_ctes(T_REQ, 50),
    [("plot_txt", PLOT_TEXT)],
    [
        (
            "x_wish",
            f"SELECT t.user_id, 'something like ' || {FIRST_ALIAS} AS preferences FROM targets t JOIN v_movies m ON m.item_id = t.item_id WHERE t.role = 'target'",
        ),
        (
            "x_c",
            """SELECT t.request_id AS user_id, t.item_id, nm.imdb_id, nm.title, round_even(t.score, 2) AS rs_score, w.preferences, p.plot_text
               FROM r_top t JOIN (SELECT item_id, title, imdb_id FROM v_movies) nm ON nm.item_id = t.item_id
               JOIN x_wish w ON w.user_id = t.request_id LEFT JOIN plot_txt p ON p.item_id = t.item_id""",
        ),
        (
            "x_s",
            """SELECT *, CASE WHEN plot_text IS NOT NULL THEN CAST(least(5, 1 + len(list_intersect(string_split(lower(preferences), ' '),
                   string_split(lower(plot_text), ' ')))) AS DOUBLE) END AS llm_score FROM x_c""",
        ),
        ("x_t", f"SELECT *, {geo('rs_score', 'coalesce(llm_score, 3.0)', '0.5', '0.5')} AS total_ FROM x_s"),
        (
            "x_n",
            "SELECT *, round_even(total_ / nullif(max(total_) OVER (PARTITION BY user_id), 0) * 10.0, 2) AS total_score FROM x_t",
        ),
        (
            "x_rank",
            """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rs_score DESC, item_id) AS rank_rs,
                      row_number() OVER (PARTITION BY user_id ORDER BY total_score DESC NULLS LAST, item_id) AS rank_both FROM x_n""",
        ),
    ],
)
oracle(
    "hit_at_k",
    """SELECT k, count(*) AS n_users, count(CASE WHEN rs_ <= k THEN 1 END) AS hits_rs, count(CASE WHEN both_ <= k THEN 1 END) AS hits_both,
              round_even(count(CASE WHEN rs_ <= k THEN 1 END) / count(*), 3) AS accuracy_rs,
              round_even(count(CASE WHEN both_ <= k THEN 1 END) / count(*), 3) AS accuracy_both
       FROM (SELECT u.user_id, a.rs_, a.both_ FROM (SELECT DISTINCT user_id FROM targets WHERE role = 'target') u
             LEFT JOIN (SELECT x.user_id, min(x.rank_rs) AS rs_, min(x.rank_both) AS both_ FROM x_rank x
                        JOIN targets t ON t.user_id = x.user_id AND t.item_id = x.item_id AND t.role = 'target'
                        GROUP BY x.user_id) a ON a.user_id = u.user_id),
            (VALUES (1), (5), (10), (20)) ks(k)
       GROUP BY k""",
    EXPERIMENT,
)

oracle(
    "hit_documents",
    """SELECT k, '{"users": [' || string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY user_id)
              || '], "hits_rs": ' || CAST(count(CASE WHEN rs_ <= k THEN 1 END) AS VARCHAR)
              || ', "hits_both": ' || CAST(count(CASE WHEN both_ <= k THEN 1 END) AS VARCHAR)
              || ', "accuracy_rs": ' || CAST(round_even(count(CASE WHEN rs_ <= k THEN 1 END) / count(*), 3) AS VARCHAR)
              || ', "accuracy_both": ' || CAST(round_even(count(CASE WHEN both_ <= k THEN 1 END) / count(*), 3) AS VARCHAR)
              || '}' AS document
       FROM (SELECT u.user_id, a.rs_, a.both_ FROM (SELECT DISTINCT user_id FROM targets WHERE role = 'target') u
             LEFT JOIN (SELECT x.user_id, min(x.rank_rs) AS rs_, min(x.rank_both) AS both_ FROM x_rank x
                        JOIN targets t ON t.user_id = x.user_id AND t.item_id = x.item_id AND t.role = 'target'
                        GROUP BY x.user_id) a ON a.user_id = u.user_id),
            (VALUES (1), (5), (10), (20)) ks(k)
       GROUP BY k""",
    EXPERIMENT,
)

_PA_NAMES = ["pa_p", "pa_q", "pa_r", "pa_s", "pa", "rn_names", "rn_al", "rn_best", "resolved"]
CONV = unique_ctes(
    TARGETS,
    [
        (
            "cl_text",
            f"""SELECT t.user_id AS answer_id, string_agg({FIRST_ALIAS} || ': ' || CAST(t.rating AS VARCHAR), ';;;' ORDER BY t.item_id)
                   || ' --- <EMPTY>' AS answer
                FROM targets t JOIN v_movies m ON m.item_id = t.item_id WHERE t.role = 'sample' GROUP BY t.user_id""",
        )
    ],
    renamed(NAMES_RESOLVED, _PA_NAMES, "cl_", {"FROM v_answers": "FROM cl_text"}),
    [
        (
            "cl_conv",
            """SELECT answer_id AS user_id, item_id, rating FROM (
                 SELECT *, row_number() OVER (PARTITION BY answer_id, item_id ORDER BY pos DESC) AS rn_ FROM cl_resolved) WHERE rn_ = 1""",
        ),
        ("cl_true", "SELECT user_id, item_id, rating FROM targets WHERE role = 'sample' AND item_id IN (SELECT item_id FROM v_movies)"),
        (
            "cl_per",
            """SELECT user_id, sum(CASE WHEN t_ IS NOT NULL AND c_ IS NOT NULL THEN abs(t_ - c_) ELSE 0.0 END) AS sd,
                      count(CASE WHEN c_ IS NULL THEN 1 END) AS missing, count(CASE WHEN t_ IS NULL THEN 1 END) AS spurious,
                      count(t_) AS nt, count(c_) AS nc
               FROM (SELECT coalesce(t.user_id, c.user_id) AS user_id, t.rating AS t_, c.rating AS c_
                     FROM cl_true t FULL OUTER JOIN cl_conv c ON t.user_id = c.user_id AND t.item_id = c.item_id)
               GROUP BY user_id""",
        ),
    ],
)
oracle(
    "conversion_loss",
    """SELECT count(*) AS n_users, round_even(sum(sd), 9) AS total_score_diff, CAST(sum(missing + nc - nt) AS BIGINT) AS total_item_diff,
              CAST(sum(missing) AS BIGINT) AS n_missing, CAST(sum(spurious) AS BIGINT) AS n_spurious,
              round_even(avg(sd), 9) AS avg_score_diff, round_even(avg(missing + nc - nt), 9) AS avg_item_diff FROM cl_per""",
    CONV,
)
oracle(
    "resume_predictions",
    "SELECT request_id AS user_id, item_id, score, rank FROM r_top",
    unique_ctes(
        TARGETS,
        model_ctes(),
        [("rp_start", "SELECT max(user_id) AS s FROM (SELECT user_id FROM et_cohort ORDER BY user_id LIMIT 125)")],
        recommend_ctes(
            f"SELECT * FROM ({T_REQ}) WHERE request_id >= (SELECT s FROM rp_start) AND request_id % 4 <> 0", 10
        ),
    ),
)


# ---------------------------------------------------------------- step 10

oracle(
    "scan_plots_csv",
    """SELECT year, title, 'American' AS origin, CAST(NULL AS VARCHAR) AS directedBy, CAST(NULL AS VARCHAR) AS starring,
              'unknown' AS genre, 'https://wiki.invalid/' || CAST(plot_id AS VARCHAR) AS wikiPage, plot FROM v_plots""",
)
oracle(
    "scan_user_files",
    f"""SELECT request_id AS user_id, string_agg(line_, '' ORDER BY pos) AS content
        FROM (SELECT r.request_id, r.pos, {FIRST_ALIAS} || ': ' || CAST(r.rating AS VARCHAR) || chr(10) AS line_
              FROM v_request_ratings r JOIN v_movies m ON m.item_id = r.item_id)
        GROUP BY request_id""",
)
oracle(
    "sink_roundtrip",
    "SELECT item_id, title, year, popularity, substring(imdb_id, 3) AS imdbId, true AS csv_agrees FROM v_movies",
)
oracle("cohort_roundtrip", "SELECT user_id FROM et_cohort", TARGETS)
oracle(
    "user_texts",
    f"""SELECT request_id AS user_id, string_agg(line_, '' ORDER BY pos) AS content
        FROM (SELECT r.request_id, r.pos, {FIRST_ALIAS} || ': ' || CAST(r.rating AS VARCHAR) || chr(10) AS line_
              FROM v_request_ratings r JOIN v_movies m ON m.item_id = r.item_id)
        GROUP BY request_id""",
)
oracle("tag_catalog_load", "SELECT c.item_id, c.tag_id, t.tag, c.num FROM v_tag_count c JOIN v_tags t ON t.id = c.tag_id")
oracle("catalog_load", "SELECT imdb_id, title, year, popularity, item_id FROM v_movies")

oracle(
    "predictions_json",
    """SELECT user_id, to_json(list(struct_pack(rank_both := rank_both, item_id := item_id, imdb_id := imdb_id, title := title,
                 total_score := total_score, rs_score := rs_score, llm_score := llm_score,
                 explanation := CASE WHEN plot_text IS NOT NULL THEN 'Shares ' || CAST(CAST(llm_score - 1 AS INTEGER) AS VARCHAR)
                                     || ' words with the wishes.' ELSE 'Movie plot not found.' END)
                 ORDER BY rank_both)) AS predictions
       FROM x_rank GROUP BY user_id""",
    EXPERIMENT,
)


# The results document keyed by k, rendered from the hit_at_k rows.
ORACLES["hit_summary"] = (
    """SELECT '{' || coalesce(string_agg('"' || CAST(k AS VARCHAR) || '": {"rs": ' || CAST(accuracy_rs AS VARCHAR)
                                   || ', "both": ' || CAST(accuracy_both AS VARCHAR) || '}', ', ' ORDER BY k), '') || '}' AS results
       FROM ("""
    + ORACLES["hit_at_k"]
    + """) h"""
)
