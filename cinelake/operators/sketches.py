"""Corpus statistics as a by-product of the jobs that write the corpus.

``curate.corpus_stats`` counts distinct users and items exactly, with one more
scan of every stage. Here every stage is observed while the job that writes it
runs: its rows are counted and its users and items go into HyperLogLog sketches,
which merge over stages, days or shards without reading the rows again.

A sketch takes at most 2^LG_K bytes whatever the table holds, so what the
observations bring to the driver is bounded. The standard error is about
1.04 / sqrt(2^LG_K) (0.4 %); up to some thousand different values it counts
practically exactly. Repeated rows change no sketch. If executors are lost and a
stage is run again, ``n_rows`` may count its rows twice; the sketches can't.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers.
LG_K = 16
_SKETCHES = "stage_no int, stage string, n_rows long, users binary, items binary"


def observed(df: DataFrame, only: Column | None = None) -> tuple[DataFrame, Observation]:
    """``df`` (user_id, item_id, ...) and what the first job over it observes, of the rows where ``only`` holds."""
    found = Observation()
    mine = (lambda c: c) if only is None else (lambda c: F.when(only, c))
    return df.observe(
        found,
        F.count(mine(F.lit(1))).alias("n_rows"),
        F.hll_sketch_agg(mine(F.col("user_id")), LG_K).alias("users"),
        F.hll_sketch_agg(mine(F.col("item_id")), LG_K).alias("items"),
    ), found


def collected(spark: SparkSession, stages: list[tuple[str, Observation]]) -> DataFrame:
    """(stage_no, stage, n_rows, users, items) of observations whose jobs have run, one row per stage."""
    rows = [(no, name, seen["n_rows"], bytes(seen["users"]), bytes(seen["items"])) for no, (name, seen) in enumerate((n, o.get) for n, o in stages)]
    return spark.createDataFrame(rows, _SKETCHES)


def estimates(sketches: DataFrame) -> DataFrame:
    """The columns of ``curate.corpus_stats``, users and items estimated."""
    size = lambda c: F.hll_sketch_estimate(c)
    return sketches.select("stage_no", "stage", "n_rows", size("users").alias("n_users"), size("items").alias("n_items"))


def merged(sketches: DataFrame, stages: Iterable[str]) -> DataFrame:
    """One row (n_users, n_items): different users and items of the named stages taken together."""
    named = sketches.where(F.col("stage").isin(list(stages)))
    both = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(n) for c, n in (("users", "n_users"), ("items", "n_items"))]
    return named.agg(*both)
