import random
import re

import numpy as np
import pytest

from cinelake.llm import decontaminate
from tests.llm.tools import PROSE, crowded, documents, edge_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], sum(s["past"] - s["first"] for s in r["spans"]), r["item_ids"]) for r in df.collect()), key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, extra string" if rows and len(rows[0]) > 2 else "item_id long, text string")


@pytest.mark.parametrize(("span", "gram"), [(10, 5), (6, 6), (8, 1)])
def test_random_texts_against_brute_force(spark, span, gram):
    rng = random.Random(span)
    vocabulary = ["Aa", "b", "c", "dé", "漢", "9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(rng.randint(0, 25))) for i in range(30)] + [(3, text(12)), (40, None), (41, ""), (None, "b c"), (42, "...")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100 + i, f"x-{t} {text(3)}!") for i, (_, t) in enumerate(bench) if t]
    docs += [(200 + i, (bench[i][1][: len(bench[i][1]) // 2] + " | " + bench[i][1])) for i in range(10)]
    got = decontaminate.overlaps(documents(spark, docs), items(spark, bench), span, gram)
    assert result(got) == plain(docs, bench, span)


def test_blocks_of_items_give_the_same_rows(spark):
    docs = [(i, PROSE[i * 3 :] + " and then some more") for i in range(10)]
    bench = [(i, PROSE[i * 5 : i * 5 + 70]) for i in range(8)] + [(50, "the mill")]
    one = decontaminate.overlaps(documents(spark, docs), items(spark, bench))
    many = decontaminate.overlaps(documents(spark, docs), items(spark, bench), block_bytes=80)
    assert result(one) == result(many) == plain(docs, bench)


def test_odd_rows(spark):
    bench = [(1, PROSE, "x"), (1, PROSE, "x"), (2, "x", "x"), (3, None, None)]
    docs = edge_rows()
    assert result(decontaminate.overlaps(crowded(documents(spark, docs)), items(spark, bench))) == plain(docs, [b[:2] for b in bench])
    assert result(decontaminate.overlaps(documents(spark, docs), items(spark, []))) == plain(docs, [])
    assert result(decontaminate.overlaps(documents(spark, []), items(spark, bench))) == []


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 6, 40):
        grams = rng.integers(0, 4, n, np.uint64)
        keep = set(decontaminate.winnow(grams, 6).tolist())
        for i in range(n - 5):
            window = grams[i : i + 6]
            assert {i + j for j in range(6) if window[j] == window.min()} & keep
