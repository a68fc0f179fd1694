"""Fuzzy title matching without nested loops.

- ``edit_distance_pairs``: every (left, right) pair within Levenshtein distance d,
  found by an exact segment join instead of a product.  Each right string of
  length L is cut into d+1 segments; d edits leave at least one segment intact,
  and its copy in the left string starts at a position bounded by the length
  difference.  So joining on (block, L, segment number, segment text) yields a
  superset of the answer (no pair is lost), which ``levenshtein(a, b, d)`` then
  verifies.  Work grows with the rows times a small constant, and the join keys
  are selective substrings rather than a few years or lengths.
- ``resolve_titles``: each distinct free-text name -> the catalogue item with the smallest
  distance (<= 2, case-insensitive, over its aliases), most popular first on ties.
- ``match_plots``: one-to-one matching of plot records to catalogue titles inside
  each year, distance <= 3, greedy by (distance, plot order, movie rank). It runs
  on classes of equal titles, distance by distance and connected part by part:
  a part is walked with a list and a counter per class; only parts too large for
  one task are paired by rank or walked in rounds (see ``match_classes``).
"""

from __future__ import annotations

from decimal import Decimal as _Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import text as T
from cinelake.operators.components import components
from cinelake.operators.indexing import group_row_number
from cinelake.session import cut_lineage

# Resolve threshold 2, plot-matching threshold 3.
RESOLVE_MAX = 2
MATCH_MAX = 3
# Members and links of a part that one task walks.
WALK_ROWS = 1_000_000


def catalogue_aliases(movies: DataFrame) -> DataFrame:
    """(item_id, pop_rank, alias) with title minus year, lower-cased, split on ' (a.k.a. ' keeping ')'."""
    name = F.lower(T.title_without_year("title"))
    return movies.select("item_id", "pop_rank", F.explode(F.split(name, r" \(a\.k\.a\. ")).alias("alias"))


def _segments(length: Column, d: int, i: Column) -> tuple[Column, Column]:
    """(start, size) of segment i (0-based) when a string of ``length`` is cut into d+1 near-equal parts."""
    parts = d + 1
    base = F.floor(length / parts).cast("int")
    extra = (length % parts).cast("int")
    longer = F.lit(parts) - extra  # segments from here on are one character longer
    size = base + F.when(i >= longer, 1).otherwise(0)
    start = i * base + F.greatest(F.lit(0), i - longer)
    return start, size


def _int_range(lo: Column, hi: Column) -> Column:
    """lo..hi, empty when lo > hi (``sequence`` would count down)."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def edit_distance_pairs(left: DataFrame, right: DataFrame, d: int, block: list[str] | None = None) -> DataFrame:
    """All (lid, rid, distance) with levenshtein(ltext, rtext) <= d and equal ``block`` columns.

    left: (lid, ltext, *block); right: (rid, rtext, *block). Exact: see the module notes.
    """
    block = block or []
    r = right.select("rid", "rtext", *block, F.length("rtext").alias("_len"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_i"))
    r_start, r_size = _segments(F.col("_len"), d, F.col("_i"))
    r = r.select("rid", "rtext", *block, "_len", "_i", r_start.alias("_p"), r_size.alias("_size"))
    r = r.select("rid", "rtext", *block, "_len", "_i", F.substring(F.col("rtext"), F.col("_p") + 1, F.col("_size")).alias("_seg"))

    q = left.select("lid", "ltext", *block, F.length("ltext").alias("_qlen"))
    q = q.select("*", F.explode(_int_range(F.greatest(F.lit(0), F.col("_qlen") - d), F.col("_qlen") + d)).alias("_len"))
    q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_i"))
    start, size = _segments(F.col("_len"), d, F.col("_i"))
    delta = F.col("_qlen") - F.col("_len")
    # an intact segment moves by s with |s| + |delta - s| <= d, and must fit inside the left string
    lo = F.greatest(start + F.ceil((delta - d) / 2).cast("int"), F.lit(0))
    hi = F.least(start + F.floor((delta + d) / 2).cast("int"), F.col("_qlen") - size)
    q = q.select("lid", "ltext", *block, "_len", "_i", size.alias("_size"), F.explode(_int_range(lo, hi)).alias("_s"))
    q = q.select("lid", "ltext", *block, "_len", "_i", F.substring(F.col("ltext"), F.col("_s") + 1, F.col("_size")).alias("_seg"))

    cand = q.join(r, [*block, "_len", "_i", "_seg"]).select("lid", "rid", "ltext", "rtext").dropDuplicates(["lid", "rid", "ltext", "rtext"])
    dist = F.levenshtein(F.col("ltext"), F.col("rtext"), d)
    return cand.select("lid", "rid", dist.alias("distance")).where(F.col("distance") >= 0)


def resolve_titles(names: DataFrame, movies: DataFrame, max_distance: int = RESOLVE_MAX) -> DataFrame:
    """names: (..., name) -> the same columns with (item_id, distance); unmatched names drop out.

    Each distinct text is matched once against each distinct alias (which
    stands for its most popular item), and the names take the result of their
    text: equal names cost one match, and no id is made up for a name.
    """
    aliases = catalogue_aliases(movies).groupBy("alias").agg(F.min_by("item_id", "pop_rank").alias("item_id"), F.min("pop_rank").alias("pop_rank"))
    texts = names.select(F.lower("name").alias("ltext")).where(F.col("ltext").isNotNull()).distinct()
    pairs = edit_distance_pairs(
        texts.select(F.col("ltext").alias("lid"), "ltext"),
        aliases.select(F.col("alias").alias("rid"), F.col("alias").alias("rtext")),
        max_distance,
    )
    ranked = pairs.join(aliases.select(F.col("alias").alias("rid"), "item_id", "pop_rank"), "rid")
    # (distance, pop_rank) as one DECIMAL(38,0) (pop_rank < 10^19): the per-text minimum is a hash aggregate
    shift = F.lit(_Decimal(10**19)).cast("decimal(38,0)")
    order = F.col("distance").cast("decimal(38,0)") * shift + F.col("pop_rank").cast("decimal(38,0)")
    best = ranked.groupBy(F.col("lid").alias("_text")).agg(F.min_by("item_id", order).alias("item_id"), F.min(order).alias("_o"))
    best = best.select("_text", "item_id", F.floor(F.col("_o") / shift).cast("int").alias("distance"))
    return names.join(best, F.lower("name") == F.col("_text")).drop("_text")


def _alternatives(title: Column, sep_regex: str) -> Column:
    """Split on the alias separator; only element [1] loses its last character."""
    parts = F.split(title, sep_regex)
    return F.transform(parts, lambda x, i: F.when(i == 1, T.drop_last(x, 1)).otherwise(x))


def title_classes(plots: DataFrame, movies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plots and movies with their class, the (year, title) text that decides every distance:
    (plot_id, pclass, year, title) and (item_id, mclass, year, name)."""
    name = T.title_without_year("title")
    p = plots.select("plot_id", F.concat_ws("|", "year", "title").alias("pclass"), "year", "title")
    return p, movies.select("item_id", F.concat_ws("|", F.col("year"), name).alias("mclass"), "year", name.alias("name"))


def class_edges(p: DataFrame, m: DataFrame, max_distance: int = MATCH_MAX) -> DataFrame:
    """(pclass, mclass, year, distance): same-year classes with case-sensitive alias distance <= max_distance.

    The distance of a pair is the smallest over its alias combinations, so the
    segment join runs on the distinct single aliases of a year, and the minimum
    is taken per pair of classes afterwards. The rows grow with the different
    titles, not with the plots and movies that share them.
    """
    left = p.select("pclass", "year", "title").distinct().select("pclass", "year", F.explode(_alternatives(F.col("title"), r" \(aka ")).alias("ltext"))
    right = m.select("mclass", "year", "name").distinct().select("mclass", "year", F.explode(_alternatives(F.col("name"), r" \(a\.k\.a\. ")).alias("rtext"))
    pairs = edit_distance_pairs(
        left.select("year", "ltext").distinct().select("year", "ltext", F.struct("year", "ltext").alias("lid")),
        right.select("year", "rtext").distinct().select("year", "rtext", F.struct("year", "rtext").alias("rid")),
        max_distance,
        ["year"],
    ).select(F.col("lid.year").alias("year"), "lid.ltext", "rid.rtext", "distance")
    listed = left.join(pairs, ["year", "ltext"]).join(right, ["year", "rtext"])
    return listed.groupBy("pclass", "mclass", "year").agg(F.min("distance").alias("distance"))


def title_edges(plots: DataFrame, movies: DataFrame, max_distance: int = MATCH_MAX) -> DataFrame:
    """Every same-year (plot, movie) pair within the distance.

    By definition the rows grow with the product of equal titles of a year on
    both sides; ``match_plots`` works on the classes instead.
    """
    p, m = title_classes(plots, movies)
    listed = class_edges(p, m, max_distance).join(p.select("plot_id", "pclass"), "pclass").join(m.select("item_id", "mclass"), "mclass")
    return listed.select("plot_id", "item_id", F.col("item_id").alias("movie_rank"), "year", "distance")


def _class_components(edges: DataFrame) -> DataFrame:
    """(pclass, mclass, part): edges with the name of their connected part."""
    parts = components(edges.select(F.concat(F.lit("p"), "pclass").alias("a"), F.concat(F.lit("m"), "mclass").alias("b")))
    of = parts.where(F.col("node").startswith("p")).select(F.expr("substring(node, 2)").alias("pclass"), "part")
    return cut_lineage(edges.select("pclass", "mclass").join(of, "pclass"))


def _walk_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The greedy walk over one part: plots in order, each takes the first movie left of its classes.

    Equal titles stay one class: a class of movies is a sorted list and a count
    of those taken, so the work is the members times the classes a title is
    linked to, not the pairs.
    """
    movies = {c: sorted(g) for c, g in rows[rows["side"] == "m"].groupby("cls")["id"]}
    linked: dict[str, list[str]] = {}
    for p, m in zip(*(rows.loc[rows["side"] == "e", c] for c in ("cls", "other"))):
        linked.setdefault(p, []).append(m)
    taken = dict.fromkeys(movies, 0)
    out = []
    plots = rows[rows["side"] == "p"].sort_values("id")
    for p, cls in zip(plots["id"], plots["cls"]):
        linked[cls] = left = [m for m in linked[cls] if m in movies and taken[m] < len(movies[m])]
        if left:
            best = min(left, key=lambda m: movies[m][taken[m]])
            out.append((p, movies[best][taken[best]]))
            taken[best] += 1
    return pd.DataFrame(out, columns=["plot_id", "item_id"])


def _large_parts(parts: DataFrame, members: DataFrame, plots: DataFrame, movies: DataFrame, distance: int) -> DataFrame:
    """The walk over parts that no single task should hold: ``plot_id, item_id``."""
    full = parts.groupBy("part").agg((F.count(F.lit(1)) == F.count_distinct("pclass") * F.count_distinct("mclass")).alias("_full"))
    parts = cut_lineage(parts.join(full, "part"))
    whole, loose = parts.where("_full"), parts.where("not _full")
    sides = whole.select("part", F.inline(F.array(F.struct(F.lit("p").alias("side"), F.col("pclass").alias("cls")), F.struct(F.lit("m").alias("side"), F.col("mclass").alias("cls"))))).distinct()
    numbered = group_row_number(members.join(sides, ["side", "cls"]).select("part", "side", "id"), ["part", "side"], ["id"], "_n")
    won = numbered.where("side = 'p'").select("part", "_n", F.col("id").alias("plot_id")).join(numbered.where("side = 'm'").select("part", "_n", F.col("id").alias("item_id")), ["part", "_n"]).select("plot_id", "item_id")
    if loose.isEmpty():
        return won
    pairs = loose.join(plots, "pclass").join(movies, "mclass").select("plot_id", "item_id", F.col("item_id").alias("movie_rank"), F.lit(distance).alias("distance"))
    return won.unionByName(greedy_one_to_one(pairs).select("plot_id", "item_id"))


def match_classes(p: DataFrame, m: DataFrame, edges: DataFrame) -> DataFrame:
    """The greedy (distance, plot, movie) walk by classes: accepted (plot_id, item_id, distance).

    One phase per distance. Classes that are linked at that distance fall into
    connected parts, and the walk goes over each part on its own. A part of up
    to ``WALK_ROWS`` members and links is walked in one task, by classes. The
    parts beyond that size: where every plot class is linked to every movie
    class the walk pairs the plots in order with the movies in order, so both
    sides are numbered (without a window over the part) and joined on the
    number; a part that is linked incompletely lists its pairs and is walked in
    rounds.
    """
    members = cut_lineage(
        p.select(F.lit("p").alias("side"), F.col("plot_id").alias("id"), F.col("pclass").alias("cls")).unionByName(
            m.select(F.lit("m").alias("side"), F.col("item_id").alias("id"), F.col("mclass").alias("cls"))
        )
    )
    edges = cut_lineage(edges)

    def left(side: str, id_: str, cls: str) -> DataFrame:
        return members.where(F.col("side") == side).select(F.col("id").alias(id_), F.col("cls").alias(cls))

    accepted = None
    for (distance,) in sorted(edges.select("distance").distinct().collect()):  # at most MATCH_MAX + 1 values
        plots, movies = left("p", "plot_id", "pclass"), left("m", "item_id", "mclass")
        here = edges.where(F.col("distance") == distance).join(plots.select("pclass"), "pclass", "left_semi").join(movies.select("mclass"), "mclass", "left_semi")
        parts = _class_components(here)
        ends = F.array(F.struct(F.lit("p").alias("side"), F.col("pclass").alias("cls")), F.struct(F.lit("m").alias("side"), F.col("mclass").alias("cls")))
        sides = parts.select("part", F.inline(ends)).distinct()
        rows = members.join(sides, ["side", "cls"]).select("part", "side", "cls", "id", F.lit(None).cast("string").alias("other"))
        rows = cut_lineage(rows.unionByName(parts.select("part", F.lit("e").alias("side"), F.col("pclass").alias("cls"), F.lit(None).cast("long").alias("id"), F.col("mclass").alias("other"))))
        large = cut_lineage(rows.groupBy("part").count().where(F.col("count") > WALK_ROWS).select("part"))
        some_large = not large.isEmpty()
        small = rows.join(large, "part", "left_anti") if some_large else rows
        won = small.groupBy("part").applyInPandas(lambda part: _walk_part(part), "plot_id long, item_id long")
        if some_large:
            won = won.unionByName(_large_parts(parts.join(large, "part", "left_semi"), members, plots, movies, distance))
        won = cut_lineage(won.withColumn("distance", F.lit(distance)))
        accepted = won if accepted is None else accepted.unionByName(won)
        taken = won.select(F.inline(F.array(F.struct(F.lit("p").alias("side"), F.col("plot_id").alias("id")), F.struct(F.lit("m").alias("side"), F.col("item_id").alias("id")))))
        members = cut_lineage(members.join(taken, ["side", "id"], "left_anti"))
    if accepted is None:
        return edges.select(F.lit(0).cast("long").alias("plot_id"), F.lit(0).cast("long").alias("item_id"), "distance")
    return accepted


def greedy_one_to_one(edges: DataFrame) -> DataFrame:
    """Rounds of mutual-best edges; returns the accepted (plot_id, item_id, distance)."""
    key = F.struct("distance", "plot_id", "movie_rank")
    cur = cut_lineage(edges.select("plot_id", "item_id", "movie_rank", "distance"))
    accepted = None
    last = cur.count()
    while last:
        by_plot = cur.groupBy("plot_id").agg(F.min(key).alias("_k"))
        by_movie = cur.groupBy("item_id").agg(F.min(key).alias("_k"))
        k = cur.withColumn("_k", key)
        won = k.join(by_plot, ["plot_id", "_k"], "left_semi").join(by_movie, ["item_id", "_k"], "left_semi").drop("_k")
        won = cut_lineage(won)
        accepted = won if accepted is None else accepted.unionByName(won)
        cur = cut_lineage(
            cur.join(won.select("plot_id"), "plot_id", "left_anti").join(won.select("item_id"), "item_id", "left_anti")
        )
        n = cur.count()
        if n >= last:
            raise RuntimeError("matching rounds made no progress")
        last = n
    if accepted is None:
        return edges.select("plot_id", "item_id", "distance").limit(0)
    return accepted.select("plot_id", "item_id", "distance")


def match_plots(plots: DataFrame, movies: DataFrame) -> DataFrame:
    """Plots with their matched item_id (unmatched plots dropped), item_id first."""
    p, m = title_classes(plots, movies)
    matched = match_classes(p, m, class_edges(p, m))
    return matched.join(plots, "plot_id").select("item_id", "plot_id", "year", "title", "distance")
