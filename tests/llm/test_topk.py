import math
import random

import pytest

from cinelake.llm import topk


def plain(rows, queries, k, scale=256):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    q = {}
    for i, v in queries:
        if i is not None and ok(v):
            x = [math.floor(scale * c) for c in v]
            q[i] = min(q.get(i, x), x)
    cands = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, x in q.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in cands if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("k", "block", "bins", "span"), [(5, 4096, 1024, 1.0), (3, 7, 4, 1.0), (1, 5, 2, 300.0), (50, 4096, 16, 0.01)])
def test_against_brute_force(spark, k, block, bins, span):
    rng = random.Random(k)
    rows = [(i, [float(f"{rng.uniform(-span, span):.3f}") for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # ties
    rows += [(500, None), (501, [float("nan")] * 6), (502, [float("inf")] + [0.0] * 5), (503, [None] + [0.5] * 5), (504, [0.5, 0.25]), (505, []), (None, [0.1] * 6), (210, [0.5] * 6)]
    df = frame(spark, rows)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as floats
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got = topk.top_k(df, df.filter("vec_id % 10 = 0"), k=k, block=block, bins=bins)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain(rows, asked, k)


def test_few_or_no_rows(spark):
    none = frame(spark, [])
    one = frame(spark, [(0, [1.0, 0.0])])
    two = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, -1.0])])
    assert topk.top_k(none, none).collect() == []
    assert topk.top_k(one, one).collect() == []
    assert topk.top_k(two, none).collect() == []
    assert topk.top_k(none, two).collect() == []
    got = topk.top_k(two.selectExpr("*", "'x' as score", "'y' as rank"), two)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1, 128 * 256), (1, 1, 0, 128 * 256)]
