"""Source divergence audit: how far the word use of each source is from the others of its language.

Pairs of sources are compared in a cube. Its axes are blocks of groups, blocks
of groups again, and blocks of terms; one task call owns one cell, gets the
slices of its two group blocks over its term block, and returns the partial
divergence of each pair of groups. Slices are replicated along the group axis
they do not lie on, and the partial values are summed along the term axis. A
cell is bounded by ``groups`` and ``terms`` whatever the data, and no group,
language or term is ever gathered in one place.

All probabilities and divergences are whole numbers, so the order of the sums
does not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import slices, stored
from cinelake.operators.indexing import group_row_number
from cinelake.session import broadcast_if_small

#: A term belongs to a language if at least so many of its documents hold it.
MIN_DOCS = 10
#: Groups and terms on a side of a cell.
GROUPS, TERMS = 64, 4096
#: Entries that a task counts before it hands them on.
ENTRIES = 200_000
#: Rows of a table of groups that may be broadcast (two short strings and a few numbers each).
SMALL = 100_000
#: Characters of a text whose terms are listed at once.
SPAN = 1 << 20
_ONE = 1_000_000_000
#: Bytes of terms: letters, and all bytes of characters beyond ASCII; only A-Z are lower-cased.
_LETTERS = bytes(i if i >= 128 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, those of about ``SPAN`` bytes at a time."""
    at = 0
    while at < len(text):
        cut = at + SPAN
        while cut < len(text) and _LETTERS[text[cut]] != 32:
            cut += 1
        yield text[at:cut].translate(_LETTERS).split()
        at = cut


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of ``docs (text, lang, source)``.

    ``count`` is the occurrences of the term in the group and ``docs`` its rows
    that hold it. Every group also has a row for the empty term, with zeros.
    Counted inside the tasks first, so a frequent term is one row per task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for (lang, source), (count, docs) in held.items():
                terms = [b"", *count]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))), pa.array([source], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *count.values()], pa.int64()), pa.array([0, *(docs[t] for t in count)], pa.int64())],
                    ["lang", "source", "term", "count", "docs"],
                )
            held.clear()
            size = 0

        for batch in slices(batches):
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, source) not in held:
                    held[lang, source] = (Counter(), Counter())
                    size += 1
                count, docs = held[lang, source]
                before = len(count)
                seen: set[bytes] = set()
                for words in terms_of(text):
                    count.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(count) - before
                if size > ENTRIES:
                    yield from flush()
        yield from flush()

    plain = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    partial = plain.mapInArrow(task, "lang string, source string, term string, count long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact; null without terms."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(_ONE).cast("decimal(10,0)")
    below = F.when(terms > 0, total + 2 * terms).cast("decimal(20,0)")
    return F.call_function("div", wide, below) + 1


def _cells(spread: DataFrame) -> DataFrame:
    """Partial divergence of each pair of groups of a cell: ``lang, a, b, value`` with a < b."""

    def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, low, high, _ = key
        rows = rows.sort_values("g")
        width = int(rows["width"].iloc[0])
        p = np.repeat(rows["rest"].to_numpy(np.int64)[:, None], width, 1)
        for i, coded in enumerate(rows["coded"]):
            if coded is not None and len(coded):
                x = np.asarray(coded, np.int64)
                p[i, x >> 32] = x & 0xFFFFFFFF
        g, left = rows["g"].to_numpy(np.int64), rows["block"].to_numpy() == low
        right = left if low == high else ~left
        out = []
        for i in np.flatnonzero(left):
            j = np.flatnonzero(right & (g > g[i]))
            apart = p[j] - p[i]
            out.append(pd.DataFrame({"lang": lang, "a": g[i], "b": g[j], "value": (apart * apart // (p[j] + p[i])).sum(1, dtype=np.int64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})

    return spread.groupBy("lang", "low", "high", "tb").applyInPandas(cell, "lang string, a long, b long, value long")


def audit(docs: DataFrame, top: int = 10, min_docs: int = MIN_DOCS, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` over ``docs (text, lang, source)``.

    Null text, lang and source count as ''. Part ``pair``: for each group (lang,
    source) every other source of the language with the summed divergence over
    the kept terms. Part ``term``: its terms that it uses more than the language
    does, the ``top`` of them by divergence. Ties rank by the item's UTF-8 bytes.
    A very long text is counted in spans; equal rows count each; a language
    without kept terms has pairs of value 0 and no terms; a language of one
    source has no pairs; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    raw = stored(term_counts(docs), spark, "divergence-counts")
    used = raw.filter("term <> ''")
    kept = used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang")).filter(F.col("docs") >= min_docs)
    kept = stored(group_row_number(kept.drop("docs"), ["lang"], ["term"], "t"), spark, "divergence-terms")
    members = group_row_number(raw.filter("term = ''").select("lang", "source"), ["lang"], ["source"], "g")
    langs = members.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total")), "lang", "left").na.fill(0, ["v", "lang_total"])
    counts = used.join(kept, ["lang", "term"]).select("lang", "source", "term", (F.col("t") - 1).alias("t"), "count", "in_lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    about = members.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    about = about.select("*", F.expr(f"cast((g - 1) div {groups} as int)").alias("block"), F.ceil(F.col("n_groups") / groups).cast("int").alias("n_blocks")).checkpoint()
    of_group = broadcast_if_small(about, SMALL)
    chance = counts.join(of_group, ["lang", "source"]).withColumn("p", probability(F.col("count"), F.col("total"), F.col("v")))

    coded = chance.groupBy("lang", "g", F.expr(f"t div {terms}").alias("tb")).agg(F.collect_list(F.shiftleft(F.col("t") % terms, 32).bitwiseOR(F.col("p"))).alias("coded"))
    n_spans = F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("long")
    grid = about.select("lang", "g", "block", "n_blocks", "v", F.coalesce(probability(F.lit(0).cast("long"), F.col("total"), F.col("v")), F.lit(0)).alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), n_spans - 1)).alias("tb"))
    sliced = grid.join(coded, ["lang", "g", "tb"], "left").withColumn("width", F.least(F.lit(terms), F.col("v") - F.col("tb") * terms))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    spread = sliced.select("lang", "g", "block", "tb", "width", "rest", "coded", other)
    spread = spread.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "tb", "g", "block", "width", "rest", "coded")
    summed = _cells(spread).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("lang", "x.a", "x.b", "value")
    name = broadcast_if_small(about.select("lang", "g", "source"), SMALL)
    pairs = both.join(name.withColumnRenamed("g", "a"), ["lang", "a"]).join(name.withColumnsRenamed({"g": "b", "source": "item"}), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = F.col("p"), probability(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    own = chance.withColumn("q", q).filter(p > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    own = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(own)
