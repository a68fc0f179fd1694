"""The stored ratings: the first line of a user and item decides, and a user's rows lie together and sorted."""

import random

import pytest

from cinelake.plans import views as V

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


@pytest.fixture
def fixed_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def written(spark, tmp_path, lines, orders):
    spark.createDataFrame(lines, LINES).repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def expected(lines, orders):
    best = {}
    for order, number, part, item, quantity in lines:
        for o, user in orders:
            if o == order and order is not None:
                place = None if None in (order, number, part, quantity) else (order, number, part, quantity)
                rows = best.setdefault((user, item), [])
                rows += [place] if place else []
    return {k: (min(v)[3] - 1) // 5 * 0.5 + 0.5 if v else None for k, v in best.items()}


@pytest.mark.parametrize("widest", [300, 10**11])  # as a LONG and, too wide for one, as a DECIMAL
def test_first_line_of_a_user_and_item(spark, tmp_path, fixed_tasks, widest):
    draw = random.Random(5)
    orders = [(o, draw.choice([None, *range(40)])) for o in range(150)] + [(3, 7), (None, 1)]
    some = lambda v: None if draw.random() < 0.05 else v
    lines = [(some(draw.randrange(150) * (1 if widest < 1000 else 10**7)), some(draw.randrange(8)), some(draw.choice([draw.randrange(300), widest])), some(draw.randrange(12)), some(float(draw.randrange(51)))) for _ in range(1500)]
    orders = [(o if widest < 1000 or o is None else o * 10**7, u) for o, u in orders]
    d = written(spark, tmp_path, lines + lines[:50], orders)
    got = [tuple(r) for r in V.ratings(spark, d).collect()]
    assert {(u, i): r for u, i, r in got} == expected(lines, orders) and len(got) == len(expected(lines, orders))


def test_users_lie_whole_and_sorted_in_the_files(spark, tmp_path, fixed_tasks):
    draw = random.Random(6)
    orders = [(o, draw.randrange(60)) for o in range(600)]
    d = written(spark, tmp_path, [(draw.randrange(600), 1, draw.randrange(9), draw.randrange(50), 5.0) for _ in range(4000)], orders)
    rows = V.ratings(spark, d).selectExpr("_metadata.file_name as f", "user_id", "item_id").collect()
    files = {}
    for r in rows:
        files.setdefault(r["f"], []).append((r["user_id"], r["item_id"]))
    assert len(files) > 1 and all(part == sorted(part) for part in files.values())
    assert sum(len({u for u, _ in part}) for part in files.values()) == 60
