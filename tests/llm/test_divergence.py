import re
from collections import Counter

from pyspark.sql import functions as F

from cinelake.llm import divergence
from tests.llm.tools import LONG, crowded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=10):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    held = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in held}:
        docs, total = Counter(), Counter()
        of = {s: Counter() for _, g, s in held if g == lang}
        for words, g, s in held:
            if g == lang:
                docs.update(set(words))
                total.update(words)
                of[s].update(words)
        kept = [t for t, n in docs.items() if n >= min_docs]

        def chances(counts):
            below = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // below for t in kept}

        p, q = {s: chances(c) for s, c in of.items()}, chances(total)
        for s in of:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in of if o != s]
            own = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(of)), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)}
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0) for i, (t, g, s) in enumerate(rows)], SCHEMA)


def odd_rows():
    rows = [("the cat and the dog", "en", f"s{i % 7}") for i in range(20)]
    rows += [(f"the cat number {i} ran Éa éa", "en", f"s{i % 5}") for i in range(12)]
    rows += [("hot the bird", "en", "s0")] * 30  # a third of all rows
    rows += [("Le chat ÉTÉ été café", "fr", "s1")] * 3 + [("le chien", "fr", "s2"), ("漢字 le", "fr", None)]
    rows += [(None, "en", "s9"), ("", "en", "s8"), ("  12 34 !!", "de", "s1"), ("x", "de", "s2"), ("word", None, None), ("word", None, "a"), (None, None, None), ("alone", "it", "one"), (LONG, "en", "long")]
    return rows


def test_against_brute_force(spark):
    rows = odd_rows()
    for min_docs, groups, terms in ((1, 2, 7), (2, 3, 4), (3, 64, 4096)):
        got = divergence.audit(crowded(docs_of(spark, rows)), min_docs=min_docs, groups=groups, terms=terms)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == brute(rows, min_docs)


def test_empty_table(spark):
    assert divergence.audit(docs_of(spark, [])).collect() == []


def test_no_kept_terms(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("", "de", "x")]
    assert {tuple(r) for r in divergence.audit(docs_of(spark, rows)).collect()} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    """The same counts when a task hands on its entries often, and when a text is cut into spans."""
    rows = odd_rows()
    whole = {tuple(r) for r in divergence.term_counts(docs_of(spark, rows)).collect()}
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert {tuple(r) for r in divergence.term_counts(docs_of(spark, rows)).collect()} == whole
    text = LONG.encode()
    monkeypatch.setattr(divergence, "SPAN", 100)
    assert [w for part in divergence.terms_of(text) for w in part] == text.translate(divergence._LETTERS).split()
    assert [w for part in divergence.terms_of(b"x" * 500) for w in part] == [b"x" * 500]


def test_large_counts(spark):
    """Whole-number arithmetic beyond 64 bits in the numerator."""
    row = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000, 1000)], "c long, n long, v long")
    got = row.select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (9_000_000_000_000 + 2) // (10_000_000_000_000 + 2000)


def test_cells_are_bounded(spark):
    """No cell call sees more than two blocks of groups, whatever the number of sources."""
    rows = [(f"a b c d e f g{i % 3}", "en", f"s{i:03d}") for i in range(40)]
    docs = docs_of(spark, rows)
    sizes = []
    cells = divergence._cells

    def counted(spread):
        sizes.extend(r["count"] for r in spread.groupBy("lang", "low", "high", "tb").count().collect())
        return cells(spread)

    divergence._cells = counted
    try:
        got = {tuple(r) for r in divergence.audit(docs, min_docs=2, groups=6, terms=2).collect()}
    finally:
        divergence._cells = cells
    assert got == brute(rows, 2) and max(sizes) <= 12 and len(sizes) == 7 * 8 // 2 * 4  # seven terms
