"""Corpus statistics observed on the writing jobs, against exact counts."""

from pyspark.sql import functions as F

from cinelake.operators import curate, sketches
from cinelake.plans import pipelines as P
from cinelake.plans import views as V

SF = "/root/testdata/sf0.1"


def test_estimates_within_two_percent(spark):
    rows = spark.range(600_000).select((F.col("id") % 150_000).alias("user_id"), (F.col("id") * 7 % 40_000).alias("item_id"))
    seen, first = sketches.observed(rows)
    half, second = sketches.observed(seen, only=F.col("user_id") < 75_000)
    third = rows.where("user_id >= 60000")
    third, last = sketches.observed(third)
    half.write.format("noop").mode("overwrite").save()  # one job for the first two
    third.write.format("noop").mode("overwrite").save()
    found = sketches.collected(spark, [("all", first), ("low", second), ("high", last)])
    got = {r.stage: r for r in sketches.estimates(found).collect()}
    assert [got[s].n_rows for s in ("all", "low", "high")] == [600_000, 300_000, 360_000]
    for stage, users in (("all", 150_000), ("low", 75_000), ("high", 90_000)):
        assert abs(got[stage].n_users - users) <= 0.02 * users
        assert abs(got[stage].n_items - 40_000) <= 0.02 * 40_000
    both = sketches.merged(found, ["low", "high"]).first()
    assert abs(both.n_users - 150_000) <= 0.02 * 150_000  # the shared users count once


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, None)], "user_id long, item_id long")
    seen, first = sketches.observed(rows)
    none, second = sketches.observed(rows.where("user_id > 9"))
    seen.write.format("noop").mode("overwrite").save()
    none.write.format("noop").mode("overwrite").save()
    got = sketches.estimates(sketches.collected(spark, [("some", first), ("none", second)])).orderBy("stage_no").collect()
    assert [tuple(r) for r in got] == [(0, "some", 4, 2, 2), (1, "none", 0, 0, 0)]


def test_stages_of_the_corpus(spark):
    exact = {r.stage: r for r in curate.corpus_stats(P.corpus_stages(spark, SF)).collect()}
    split, found = P.observed_corpus(spark, SF)
    assert split.exceptAll(P.split(spark, SF)).isEmpty() and split.count() == P.split(spark, SF).count()
    for r in sketches.estimates(found).collect():
        assert r.n_rows == exact[r.stage].n_rows
        assert abs(r.n_users - exact[r.stage].n_users) <= 0.02 * exact[r.stage].n_users
        assert abs(r.n_items - exact[r.stage].n_items) <= 0.02 * exact[r.stage].n_items
    assert V.ratings_raw(spark, SF).count() == exact["raw"].n_rows
