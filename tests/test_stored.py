"""Large views are packed files, the dedupe's order is one number, and scoring gives few rows to the shuffle."""

import random

import pytest

from cinelake.operators import curate, ease
from cinelake.plans import pipelines as P
from cinelake.plans import views as V

SF = "/root/testdata/sf0.001"


def test_views_and_positions_are_files(spark):
    for df in (V.ratings(spark, SF), P.split(spark, SF), P.active(spark, SF), V.request_ratings(spark, SF)):
        assert df.inputFiles() and all(f.endswith(".parquet") for f in df.inputFiles())


def test_file_position_as_a_long(spark):
    rows = [(random.Random(1).randrange(9), 1, 5, 7), (0, 2, 9, 1), (0, 2, 9, 50), (8, 0, 0, 3), (7, 9, 9, 49)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity long")
    place = V.long_position([8, 9, 9, 50])
    got = [tuple(r)[:4] for r in df.withColumn("p", place).orderBy("p").collect()]
    assert got == sorted(rows) and df.select(place.alias("p")).schema["p"].dataType.simpleString() == "bigint"
    assert V.long_position([10**15, 9, 10**11, 999]) is None and V.long_position([None, 1, 1, 1]) is None


def test_active_users_with_repeated_and_null_titles(spark):
    ratings = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (2, 20, 3.0), (3, 30, 1.0), (None, 10, 1.0), (4, None, 1.0)], "user_id long, item_id long, rating double")
    movies = spark.createDataFrame([(10, 2016), (10, 1990), (20, 1990), (20, None), (40, 2018), (None, 2018)], "item_id long, year int")
    assert sorted(map(tuple, curate.active_users(ratings, movies).collect())) == [(1, 10, 1.0), (1, 20, 2.0)]


@pytest.mark.parametrize("cells", [1 << 20, 100])
def test_scoring_kernel_equals_the_plain_plan(spark, monkeypatch, cells):
    draw = random.Random(3)
    index = spark.createDataFrame([(i * 3, i) for i in range(60)], "item_id long, idx long")
    weights = spark.createDataFrame([(i * 3, j * 3, draw.choice([-0.5, 0.25, 1.0, 2.0])) for i in range(60) for j in range(60) if i != j and draw.random() < 0.2], "src_item long, dst_item long, w double")
    rows = [(r, i * 3 if draw.random() < 0.95 else 999, None if draw.random() < 0.1 else draw.choice([0.5, 1.0, 4.0, -1.0])) for r in range(200) for i in draw.sample(range(60), draw.choice([1, 2, 5, 15]))]
    rows = list({r[:2]: r for r in rows}.values()) + [(None, 3, 2.0), (None, 6, 1.0), (7, None, 3.0), (900, None, 1.0)]
    req = spark.createDataFrame(rows, "request_id long, item_id long, rating double")
    monkeypatch.setattr(ease, "CELLS", cells)
    for k in (3, 58):
        monkeypatch.setattr(ease, "MAX_BROADCAST_WEIGHTS", 10**6)
        got = sorted(map(tuple, ease.recommend(req, index, weights, k).collect()), key=repr)
        monkeypatch.setattr(ease, "MAX_BROADCAST_WEIGHTS", 1)
        assert got == sorted(map(tuple, ease.recommend(req, index, weights, k).collect()), key=repr)


def test_scoring_gives_few_rows_to_the_shuffle(spark):
    weights = spark.createDataFrame([(0, j, 1.0 + j) for j in range(1, 500)], "src_item long, dst_item long, w double")
    req = spark.createDataFrame([(r, 0, 1.0) for r in range(20)], "request_id long, item_id long, rating double")
    got = ease._touched(req, weights, 5).groupBy("request_id").count().collect()
    assert len(got) == 20 and all(r["count"] == 5 for r in got)
