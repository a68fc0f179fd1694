"""The tag blend: the same rows for a sample shared by all requests and for its rows, and what its plans hold."""

import random

import pytest

from cinelake.operators import blend

SAMPLE = "item_id long, title string, primary_score double"
REQUESTS = "request_id long, rs_importance int"
TAGS = "request_id long, tag_id long"
COUNTS = "item_id long, tag_id long, num long"


def rounded_even(x, digits):
    from decimal import ROUND_HALF_EVEN, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def expected(asked, sample, requests, tags, counts):
    """The blend row by row; equal candidates of a request become one whose hits count as often."""
    out = []
    for request in sorted({r for r in asked if r is not None}):
        mine = {t for r, t in tags if r == request and t is not None}
        rows = []
        for importance in [w for r, w in requests if r == request]:
            for item, title, primary in set(sample):
                num = [(t, n) for i, t, n in counts if i == item and item is not None]
                copies = sample.count((item, title, primary)) * asked.count(request)
                hit = sum(max([n for t, n in num if t == tag], default=0) for tag in mine) * copies
                total = sum(n for _, n in num)
                second = rounded_even(hit / total, 3) if total else 0.0
                if not mine or importance == 100:
                    rows.append((request, item, title, primary, None, primary))
                    continue
                w = importance / 100
                rows.append((request, item, title, primary, second, (primary**w * second ** (1 - w)) ** (1 / (w + (1 - w)))))
        most = max([r[-1] for r in rows], default=0)
        out += [(*r[:-1], rounded_even(r[-1] / most * 10, 2) if most else None) for r in rows]
    return sorted(out, key=str)


def tables(spark, asked, sample, requests, tags, counts):
    return (
        spark.createDataFrame([(r,) for r in asked], "request_id long").repartition(4, "request_id"),
        spark.createDataFrame(sample, SAMPLE),
        spark.createDataFrame(requests, REQUESTS),
        spark.createDataFrame(tags, TAGS),
        spark.createDataFrame(counts, COUNTS),
    )


@pytest.fixture
def odd_rows():
    """Repeated and unknown requests, repeated and null items, repeated and null tags, items without counts."""
    draw = random.Random(11)
    requests = [(r, draw.choice([0, 30, 50, 75, 100])) for r in range(40)] + [(3, 20), (5, 50), (5, 50), (None, 50)]
    asked = [r for r, _ in requests] + [99]
    sample = [(i, f"t{i}", draw.randrange(1, 9) / 8) for i in range(7)] + [(2, "other", 0.5), (None, "none", 0.25)]
    sample += [sample[1], sample[1]]
    tags = [(r, draw.randrange(1, 9)) for r in range(40) for _ in range(3) if r % 5] + [(4, None), (7, 2), (7, 2), (None, 1), (10, None)]
    counts = [(i, t, draw.randrange(1, 30)) for i in range(6) for t in range(1, 7)] + [(1, 2, 40), (1, None, 5), (None, 2, 9), (0, 1, None)]
    counts = [(i, t, n or 0) for i, t, n in counts]
    return asked, sample, requests, tags, counts


def test_a_shared_sample_gives_the_rows_of_its_candidates(spark, odd_rows):
    asked, sample, requests, tags, counts = tables(spark, *odd_rows)
    want = expected(*odd_rows)
    every = blend.blend_tags(asked, requests, tags, counts, every=sample)
    rows = blend.blend_tags(asked.crossJoin(sample), requests, tags, counts)
    assert every.columns == rows.columns
    assert sorted(map(tuple, every.collect()), key=str) == want
    assert sorted(map(tuple, rows.collect()), key=str) == want


def test_an_empty_sample_or_no_counts(spark, odd_rows):
    asked, sample, requests, tags, counts = tables(spark, *odd_rows)
    assert blend.blend_tags(asked, requests, tags, counts, every=sample.where("false")).count() == 0
    none = expected(*odd_rows[:4], [])
    assert sorted(map(tuple, blend.blend_tags(asked, requests, tags, counts.where("false"), every=sample).collect()), key=str) == none


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_requests_do_not_multiply_before_the_end(spark, tmp_path):
    """The whole query on tables of its own: no window, sort or sort-merge join over the requests' candidates."""
    from cinelake.plans.queries import QUERIES

    lines = [(o, p % 4, p, s, float(1 + (o + p) % 50)) for o in range(60) for p, s in [(o % 30, o % 3), ((o + 7) % 30, (o + 1) % 3)]]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double", "lineitem")
    put([(o, o % 20) for o in range(60)], "o_orderkey long, o_custkey long", "orders")
    put([(p, f"tag{p % 8} x") for p in range(30)], "p_partkey long, p_name string", "part")
    put([(c,) for c in range(20)], "c_custkey long", "customer")
    asked = QUERIES["tag_recommend_popular"](spark, str(tmp_path))
    text = plan(asked)
    assert "Generate inline" in text
    assert "Window" not in text and "Sort " not in text and "SortMergeJoin" not in text


def test_candidates_are_not_multiplied_by_tags(spark, odd_rows):
    """Rows of candidates: tags and counts come as one row each, one sort serves both windows."""
    asked, sample, requests, tags, counts = tables(spark, *odd_rows)
    primary = asked.crossJoin(sample).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "request_id")
    text = plan(blend.blend_tags(primary, requests, tags, counts))
    assert text.count("Sort [") == 1 and "SortMergeJoin" not in text
