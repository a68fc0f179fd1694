"""Title and tag search and one-to-one matching against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cinelake.operators import components as C
from cinelake.operators import resolve, search


def like(term):
    return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.lower()), re.S)


def search_by_hand(terms, movies, k):
    out = set()
    for t, term in terms:
        if term is None:
            continue
        if not term.strip():
            hits = [(0, r, i, title) for i, title, _, r in movies if r <= k]
        else:
            hits = []
            for i, title, popularity, r in movies:
                if like(term).search(title.lower()):
                    words = re.split(r"\s+", title.lower())
                    at = next((n for n, w in enumerate(words) if term.lower() in w), None)
                    score = 0.0 if at is None else (1.0 if words[at].startswith(term.lower()) else 0.1) / (at + 1)
                    hits.append((-popularity * score, r, i, title))
        out |= {(t, n, i, title) for n, (_, _, i, title) in enumerate(sorted(hits)[:k], 1)}
    return out


def test_title_search_against_plain_python(spark):
    rng = random.Random(4)
    parts = ["the", "red", "bolt", "100%", "a_b", "Ünder", "sea", "x", "漢字", "of", "bo", "back\\slash"]
    movies = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))), rng.randint(0, 9)) for i in range(80)]
    order = sorted(range(80), key=lambda i: (-movies[i][2], i))
    movies = [(*m, order.index(i) + 1) for i, m in enumerate(movies)]
    terms = ["r%b", "%", "_", "%_%", "____________", "0%", "_b", "a_b", "THE", "the", "e", "", "  ", "zzz", "bolt%x", "x%%x", "漢", "ünd", "\\", "k\\s", None, "_" * 200, "d b", "%the%", "t_e"]
    T = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    M = spark.createDataFrame(movies, "item_id int, title string, popularity int, pop_rank int")
    index = search.build_title_index(M)
    for k in (3, 15):
        got = {tuple(r) for r in search.title_search(T, M, k, search.open_title_index(spark, index.postings.inputFiles()[0].rsplit("/postings", 1)[0])).collect()}
        assert got == search_by_hand(enumerate(terms), movies, k)
    assert index.frequencies.where("gram = ''").count() == 0
    assert {r["gram"]: r["n"] for r in index.frequencies.collect()} == {r["gram"]: r["count"] for r in index.postings.groupBy("gram").count().collect()}
    assert search.title_search(T, M.where("false")).count() == 0


def test_rare_grams_decide_what_is_read(spark):
    """A term of common grams and one rare gram reads the postings of three grams, and only titles with the rare one are tested."""
    movies = [(i, f"the common title {'qzq' if i == 7 else ''}", 1, i + 1) for i in range(500)]
    M = spark.createDataFrame(movies, "item_id int, title string, popularity int, pop_rank int")
    asked = spark.createDataFrame([("common title qzq", ["com", "omm", "tit", "e q", " qz", "qzq"])], "t string, grams array<string>")
    assert [tuple(r) for r in search._named(asked, search.build_title_index(M)).collect()] == [("common title qzq", 7)]


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_prefix_ranges(spark, bucket):
    rng = random.Random(bucket)
    words = {"".join(rng.choice("abÿ漢\U0010ffff") for _ in range(rng.randint(1, 4))) for _ in range(120)}
    prefixes = {"".join(rng.choice("abÿ漢z") for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"a", "b", "zz"}
    W = spark.createDataFrame([(w,) for w in words], "w string")
    P = spark.createDataFrame([(p,) for p in prefixes], "p string")
    got = [tuple(r) for r in search.prefix_ranges(W, P, bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, w) for p in prefixes for w in words if w.startswith(p)}


def test_tag_search_of_blank_and_odd_terms(spark):
    tags = spark.createDataFrame([(1, "Dark Comedy"), (2, "comic book"), (3, " sea "), (4, "COM"), (4, "COM")], "id int, tag string")
    terms = spark.createDataFrame([(1, "com"), (2, " "), (3, ""), (4, None), (5, "comedy "), (6, "DARK"), (7, "edy"), (1, "com")], "term_id int, term string")
    got = sorted(tuple(r) for r in search.tag_search(terms, tags).collect())
    every = [(1, "Dark Comedy"), (2, "comic book"), (3, " sea "), (4, "COM")]
    assert got == sorted([(1, 1, "Dark Comedy"), (1, 2, "comic book"), (1, 4, "COM"), (6, 1, "Dark Comedy"), *((t, *e) for t in (2, 3) for e in every)])


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    cut = C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    names = list(range(600))
    random.Random(3).shuffle(names)
    edges = [(f"n{a:04d}", f"n{b:04d}") for a, b in zip(names[:400], names[1:400])] + [(f"n{a:04d}", f"n{b:04d}") for a, b in zip(names[400:599], names[401:600])]
    edges += [("self", "self"), ("x", None), edges[0]]
    got = {r["node"]: r["part"] for r in C.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    one, two = ({f"n{a:04d}" for a in part} for part in (names[:400], names[400:]))
    assert got == {n: min(one) for n in one} | {n: min(two) for n in two} | {"self": "self"}
    assert len(rounds) <= 14
    assert C.components(spark.createDataFrame([], "a string, b string")).count() == 0


def walk(edges):
    used_p, used_m, want = set(), set(), set()
    for d, p, m in sorted(edges):
        if p not in used_p and m not in used_m:
            used_p.add(p), used_m.add(m), want.add((p, m, d))
    return want


@pytest.mark.parametrize("limit", [10**6, 25, 0])
def test_matching_of_small_and_large_parts(spark, monkeypatch, limit):
    """Parts walked in tasks, by rank and in rounds give the walk over all pairs."""
    monkeypatch.setattr(resolve, "WALK_ROWS", limit)
    rnd = random.Random(limit)
    words = ["star", "start", "stars", "tar", "moon", "moons", "noon", "abcdefgh"]
    plots = [(i, 2000 + i % 2, rnd.choice(words) + rnd.choice(["", " (aka moon)", "xy"])) for i in range(40)]
    movies = [(100 + i, 2000 + i % 2, rnd.choice(words) + rnd.choice(["", " (a.k.a. star)"])) for i in range(35)]
    P = spark.createDataFrame([(i, y, t, "p") for i, y, t in plots], "plot_id long, year int, title string, plot string")
    M = spark.createDataFrame([(i, f"{t} ({y})", y) for i, y, t in movies], "item_id long, title string, year int")
    want = walk([(r.distance, r.plot_id, r.item_id) for r in resolve.title_edges(P, M).collect()])
    assert {(r.plot_id, r.item_id, r.distance) for r in resolve.match_plots(P, M).collect()} == want


def test_crowded_titles_in_a_loose_part(spark):
    """10^4 plots and movies of three linked titles, incompletely linked: no list of 10^8 pairs."""
    n = 10_000
    P = spark.range(n).selectExpr("id AS plot_id", "2000 AS year", "element_at(array('aaaa1111', 'aaaa1122', 'aaaa2222'), cast(id % 3 + 1 AS int)) AS title", "'p' AS plot")
    M = spark.range(n).selectExpr("id * 2 + 1 AS item_id", "concat(element_at(array('aaaa1111', 'aaaa2222'), cast(id % 2 + 1 AS int)), ' (2000)') AS title", "2000 AS year")
    got = resolve.match_plots(P, M).groupBy("distance").count().collect()
    assert {r["distance"]: r["count"] for r in got} == {0: 3334 + 3333, 2: 10_000 - 6667}
    rows = resolve.match_plots(P, M).where("distance = 0").selectExpr("plot_id % 3 AS t", "(item_id - 1) / 2 % 2 AS m").distinct().collect()
    assert sorted((r["t"], r["m"]) for r in rows) == [(0, 0.0), (2, 1.0)]
    pairs = resolve.match_plots(P, M).where(F.col("distance") == 2)
    assert pairs.select("plot_id").distinct().count() == pairs.select("item_id").distinct().count() == 3333
