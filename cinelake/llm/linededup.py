"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations.

Lines that hold a letter are compared across the whole table: those of at least
``min_chars`` characters with all that are close, shorter ones with equal ones
only. A line within ``edits`` edits of another keeps one of the other's
``edits + 1`` segments whole, at a position that the lengths bound. So every
line is entered in an index under (length, segment number, segment) for its own
segments, and probes it with the substrings that a partner of its length or up
to ``edits`` characters less could have as segments (only the positions that
can hold one when the edits before and after it are counted too).

Index and probe keys are hashes, so the texts stay where they are: one
aggregate finds the keys that two different lines share, and only the lines
that have such a key, each different text once, are joined on the keys and
verified. The verification is in the join condition, so the pairs that leave
the join are links: pairs whose character parities differ in more bits than the
edits can change are refused at once, common beginnings and ends are cut off,
and the rest is compared by the banded bit-parallel edit distance, one machine
word for each column. Keys that many lines share are split into shares of the
index side.

A line goes if an equal line, or one within ``edits`` edits, comes first in the
order of (doc_id with null last, row identity, line number); its representative
is the earliest such line. A row is known by two hashes of its id and text, and
by a number of its own if the id is null, so rows that share an id but not the
text, or have none, lose only lines of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import cut_lineage, fresh, stored
from cinelake.session import broadcast_if_small

EDITS = 2
MIN_CHARS = 30
#: Lines under an index key from which its work is split.
HOT_KEY = 256
#: Rows of a table that may be broadcast.
SMALL = 500_000
#: Identity of a row among the lines.
_ROW = ("r1", "r2", "tie")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(characters less, segment number, offset from the segment's start) of every probe of a line."""
    out = []
    for less in range(edits + 1):
        for number in range(1, edits + 2):
            low = max(1 - number, less - (edits + 1 - number))
            high = min(number - 1, less + (edits + 1 - number))
            out += [(less, number, offset) for offset in range(low, high + 1)]
    return out


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """Index and probe keys of ``lines (..., line, n)`` with n its length; a line's own segments are index keys and probes in one.

    A key is the hash of a partner's length, a segment number and the segment.
    Lines have at least 2 * edits + 1 characters, so every probe lies inside the
    line. Segments are cut from the UTF-32 form, where a position is an offset.
    """
    parts = edits + 1
    # the places are rows of a constant: one small expression serves all of them
    places = [F.struct(F.lit(less).alias("_less"), F.lit(number - 1).alias("_before"), F.lit(offset).alias("_offset"), F.lit(less == 0 and offset == 0).alias("indexed")) for less, number, offset in _probe_places(edits)]
    placed = lines.withColumn("_wide", F.encode("line", "UTF-32")).select("*", F.inline(F.array(*places)))
    length = F.col("n") - F.col("_less")
    size, short = F.expr(f"cast((n - _less) div {parts} as int)"), F.lit(parts) - length % parts  # the last segments are one longer
    start = F.col("_before") * size + F.greatest(F.lit(0), F.col("_before") - short) + F.col("_offset")
    segment = F.substring(F.col("_wide"), 4 * start + 1, 4 * (size + (F.col("_before") >= short).cast("int")))
    return placed.select(*lines.columns, F.xxhash64(length, F.col("_before"), segment).alias("key"), "indexed")


def _common(a: Column, b: Column) -> Column:
    """Characters that two strings share at the beginning, by halving steps over equal substrings."""
    top = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    useful = F.filter(steps, lambda s: s <= top)
    return F.aggregate(useful, F.lit(0), lambda k, s: F.when((k + s <= top) & (F.substring(a, k + 1, s) == F.substring(b, k + 1, s)), k + s).otherwise(k))


def _banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else more; the lengths differ by at most ``edits``.

    Bit-parallel columns over the band of 2 * edits + 1 rows around the
    diagonal: bit o of a word stands for row j - edits + o of column j. The
    distance is followed along the lowest diagonal of the band until it meets
    the last row, then along that row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    rows, columns = F.split(a, ""), F.split(b, "")
    m, n = F.length(a), F.length(b)

    def invert(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full))

    def column(state: Column, j: Column) -> Column:
        letter = F.get(columns, j - 1)
        same = F.lit(0)
        for o in range(width):
            row = j - edits + o
            same = same + F.when((row >= 1) & (F.get(rows, row - 1) == letter), F.lit(1 << o)).otherwise(F.lit(0))

        def with_same(eq: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            diagonal = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def with_diagonal(d0: Column) -> Column:
                def with_horizontal(h: Column) -> Column:
                    hp, hn = h["hp"], h["hn"]
                    down = F.shiftright(d0, 1)
                    at = m - j + edits  # the bit of the last row
                    bit = F.element_at(F.array(*[F.lit(1 << o) for o in range(width)]), F.greatest(F.lit(1), F.least(F.lit(width), at + 1)))
                    along_row = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
                    along_diagonal = F.when(d0.bitwiseAND(F.lit(1 << (width - 1))) != 0, 0).otherwise(1)
                    step = F.when(j + edits <= m, along_diagonal).otherwise(along_row)
                    return F.struct(hn.bitwiseOR(invert(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["d"] + step).alias("d"))

                return _let(F.struct(vn.bitwiseOR(invert(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn")), with_horizontal)

            return _let(diagonal, with_diagonal)

        return F.when(state["d"] > 3 * edits, state).otherwise(_let(same, with_same))

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(edits)).alias("d"))
    walked = F.aggregate(F.sequence(F.lit(1), n), start, column)["d"]
    return F.when(n == 0, m).when(m == 0, n).otherwise(walked)


def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance if it is at most ``edits``, else ``edits + 1``."""

    def trimmed(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        # the ends differ, so an edit falls on each: the inside of x has edits - 2, and one of its edits - 1 pieces is whole in y
        inside = F.length(x) - 2
        whole = F.lit(False)
        for i in range(edits - 1):
            begin, past = F.floor(inside * i / (edits - 1)).cast("int"), F.floor(inside * (i + 1) / (edits - 1)).cast("int")
            whole = whole | F.contains(y, F.substring(x, begin + 2, past - begin))
        possible = (inside <= 0) | whole
        return F.when(possible, F.least(_banded(x, y, edits), F.lit(edits + 1))).otherwise(F.lit(edits + 1))

    def tails(head: Column) -> Column:
        x, y = F.substring(a, head + 1, F.length(a)), F.substring(b, head + 1, F.length(b))

        def cut(p: Column) -> Column:
            tail = _common(F.reverse(p["x"]), F.reverse(p["y"]))
            return _let(tail, lambda t: _let(F.struct(F.substring(p["x"], F.lit(1), F.length(p["x"]) - t).alias("x"), F.substring(p["y"], F.lit(1), F.length(p["y"]) - t).alias("y")), trimmed))

        return _let(F.struct(x.alias("x"), y.alias("y")), cut)

    close = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(close, _let(_common(a, b), tails)).otherwise(F.lit(edits + 1))


def _signature(line: Column) -> Column:
    """Parities of the numbers of 64 kinds of characters: an edit changes at most two of its bits."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))))


def _tied(docs: DataFrame, tie: str) -> DataFrame:
    """``docs`` with ``tie``: 0, or for a row with a null id a number that no other row has."""
    none = F.col("doc_id").cast("long").isNull()
    if not docs.filter(none).take(1):
        return docs.withColumn(tie, F.lit(0).cast("long"))
    own = stored(docs.filter(none).withColumn(tie, F.monotonically_increasing_id()), docs.sparkSession, "line-null-ids")
    return docs.filter(~none).withColumn(tie, F.lit(0).cast("long")).unionByName(own)


def _row(tie: str) -> list[Column]:
    """The identity of a row: two hashes of its id and text, and its tie."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit("second"), text, doc_id), F.col(tie)]


def _lines(docs: DataFrame, min_chars: int, tie: str) -> DataFrame:
    """``doc_id, r1, r2, tie, line_no, line, n, h1, h2``: the long lines and those with a letter, their rows, lengths and 128-bit identities."""
    pieces = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x: F.struct(x.alias("line"), F.length(x).alias("n")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(name) for c, name in zip(_row(tie), _ROW)], pieces.alias("_p"))
    lines = rows.select("doc_id", *_ROW, F.posexplode("_p").alias("line_no", "_l")).select("doc_id", *_ROW, "line_no", "_l.line", "_l.n")
    return lines.filter((F.col("n") >= min_chars) | F.col("line").rlike(r"\p{L}")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})


def _place() -> Column:
    """The place of a line in the order of rows and line numbers; a null id comes last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *_ROW, "line_no")


def links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(a1, a2, b1, b2)``: every two different texts of ``lines (h1, h2, line, n)`` within ``edits`` edits, once."""
    spark = lines.sparkSession
    lines = lines.select("h1", "h2", "line", "n")
    keyed = _keys(lines, edits)
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("indexed").alias("has_index")).filter("low < high and has_index").select("key")
    shared = stored(shared, spark, "line-keys")
    if shared.limit(SMALL + 1).count() <= SMALL:
        found = keyed.join(F.broadcast(shared), "key", "left_semi")
    else:  # keys are shuffled without the texts, which are fetched by identity
        candidates = keyed.select("key", "h1", "h2").join(shared, "key", "left_semi").select("h1", "h2").distinct()
        found = lines.join(cut_lineage(candidates), ["h1", "h2"], "left_semi")
    texts = found.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = stored(texts.select("*", F.length("line").alias("n"), _signature(F.col("line")).alias("sig")), spark, "line-texts")
    keyed = _keys(texts, edits)
    crowd = keyed.filter("indexed").groupBy("key").count().filter(F.col("count") > HOT_KEY).select("key", F.ceil(F.col("count") / HOT_KEY).cast("long").alias("_shares"))
    keyed = keyed.join(broadcast_if_small(cut_lineage(crowd), SMALL), "key", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1).cast("long")))
    index = keyed.filter("indexed").select("key", F.pmod("h2", "_shares").alias("_share"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("la"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    probe = keyed.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("lb"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    index, probe = index.alias("i"), probe.alias("p")
    # equal lengths meet from both sides: keep one
    other = F.when(F.col("na") == F.col("nb"), F.struct("a1", "a2") < F.struct("b1", "b2")).otherwise(True)
    alike = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * edits
    close = F.when(alike, edit_distance(F.col("la"), F.col("lb"), edits) <= edits).otherwise(False)
    same = (F.col("i.key") == F.col("p.key")) & (F.col("i._share") == F.col("p._share"))
    found = index.join(probe, same & other & ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))) & close)
    return found.select("a1", "a2", "b1", "b2").distinct()


def classes(docs: DataFrame, tie: str, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``r1, r2, tie, lines``: for each row of ``docs`` (see ``_tied``) with a line that has an equal or close line elsewhere, those lines.

    ``lines`` is an array of (line_no from 0, rep_doc, rep_line, n_links,
    dropped) in line order: the earliest equal or close line, the number of
    different texts within ``edits`` edits, and whether the line goes.
    """
    if min_chars < 2 * edits + 1:
        raise ValueError("a line must be long enough for its segments")
    spark = docs.sparkSession
    lines = _lines(docs, min_chars, tie)
    where = stored(lines.select("doc_id", *_ROW, "line_no", "h1", "h2"), spark, "line-places")
    first = where.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("n"))
    pairs = cut_lineage(links(lines.filter(F.col("n") >= min_chars), edits))
    sided = pairs.select("a1", "a2", "b1", "b2").union(pairs.select("b1", "b2", "a1", "a2"))
    linked = cut_lineage(pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).distinct())
    places = cut_lineage(where.join(broadcast_if_small(linked, SMALL), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(_place()).alias("place")))
    other = places.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("place").alias("other"))
    near = sided.join(other, ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.min("other").alias("close"), F.count(F.lit(1)).alias("n_links"))
    known = first.join(near, ["h1", "h2"], "left").filter("n > 1 or close is not null")
    known = cut_lineage(known.select("h1", "h2", F.least("place", "close").alias("rep"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    hit = where.join(broadcast_if_small(known, SMALL), ["h1", "h2"])
    entry = F.struct(
        "line_no",
        F.col("rep.doc_id").alias("rep_doc"),
        F.col("rep.line_no").alias("rep_line"),
        F.col("n_links").cast("long").alias("n_links"),
        (_place() != F.col("rep")).alias("dropped"),
    )
    return hit.groupBy(*_ROW).agg(F.array_sort(F.collect_set(entry)).alias("lines"))


def dedupe(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs (doc_id, text, ...)`` with ``text`` without its duplicate lines, and ``line_classes``.

    Lines end at a line feed; lines shorter than ``min_chars`` go only if an equal
    line comes first, and stay if they hold no letter (blank lines, brackets,
    rules). Very long texts and lines are compared whole. A text that loses no line is returned as it is; null stays null, and
    ``line_classes`` (see ``classes``) is empty where no line has an equal or
    close one. Rows that repeat a doc_id and its text are one document and keep the
    same lines; rows that repeat a doc_id with another text, and all rows with a
    null id (which come last in the order), are documents of their own. Columns
    named like the added one are replaced; an empty table gives no rows.
    """
    docs = docs.drop("line_classes")
    tie = fresh(docs, "_tie")
    docs = _tied(docs, tie)
    names = [fresh(docs, f"_of_{c}") for c in _ROW]
    found = cut_lineage(classes(docs, tie, edits, min_chars)).select(*[F.col(c).alias(name) for c, name in zip(_ROW, names)], F.col("lines").alias("line_classes"))
    size = found.agg(F.sum(F.size("line_classes"))).first()[0] or 0
    small = F.broadcast(found) if size <= 2 * SMALL else found
    same = [c == F.col(name) for c, name in zip(_row(tie), names)]
    joined = docs.join(small, same, "left").drop(*names, tie)
    gone = F.transform(F.filter("line_classes", lambda x: x["dropped"]), lambda x: x["line_no"])
    text = F.col("text").cast("string")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    cut = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(text)
    return joined.withColumn("text", cut).withColumn("line_classes", F.coalesce("line_classes", F.expr("cast(array() as array<struct<line_no:int,rep_doc:bigint,rep_line:int,n_links:bigint,dropped:boolean>>)")))
