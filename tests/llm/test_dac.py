import struct
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinelake.llm import dac
from cinelake.llm.common import shared_path
from cinelake.llm.queries import QUERIES, byte_bpe
from tests.llm.test_bpe import ids_of
from tests.llm.tools import SF, crowded, documents, edge_rows


def plain(rows):
    out, start = [], 0
    for i, t in rows:
        ids = [*ids_of(t or ""), 0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_against_the_tokenizers_library(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op8_token_codes"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_odd_rows_in_small_blocks(spark):
    rows = sorted(edge_rows() + [(30, "a<|endoftext|>b"), (31, "ᲀ \U0001fae9x")], key=lambda r: (r[0] is not None, r[0] or 0))
    path = shared_path(spark, "test", uuid.uuid4().hex)
    dac.write(crowded(documents(spark, rows)), path, byte_bpe(), block=20)
    got = sorted((tuple(r) for r in dac.read(spark, path).collect()), key=lambda r: r[1])
    assert got == plain(rows)
    blocks = spark.read.parquet(path).orderBy("part", "first").collect()
    ids = [i for b in blocks for i in (dac.access(bytes(b["codes"]), k) for k in range(b["n_tokens"]))] if len(blocks) < 50 else []
    assert ids[:30] == [i for _, t in rows for i in [*ids_of(t or ""), 0]][:30]
    empty = shared_path(spark, "test", uuid.uuid4().hex)
    dac.write(documents(spark, []), empty, byte_bpe())
    assert dac.read(spark, empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**40)), max_size=1500))
def test_any_ids_by_position_and_as_a_whole(ids):
    codes = dac.pack(np.array(ids, np.uint64))
    assert dac.unpack(codes).tolist() == ids
    for i in range(0, len(ids), 97):
        assert dac.access(codes, i) == ids[i]
    with pytest.raises(IndexError):
        dac.access(codes, len(ids))


def test_access_over_many_strides():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50257, 20_000)
    codes = dac.pack(ids)
    assert all(dac.access(codes, int(i)) == ids[i] for i in rng.integers(0, 20_000, 3000))
    with pytest.raises(ValueError):
        dac.unpack(b"XXXX" + codes[4:])


def test_an_id_on_a_third_of_the_rows_spreads_over_the_tasks(spark):
    rows = [(i, f"text {i} of its own") for i in range(4000)] + [(None, f"without an id {i}") for i in range(1000)] + [(None, "the same row, always")] * 1000
    path = shared_path(spark, "test", uuid.uuid4().hex)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        dac.write(documents(spark, rows).repartition(8), path, byte_bpe(), block=500)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = spark.read.parquet(path).selectExpr("part", "size(doc_ids) as n").groupBy("part").sum("n").collect()
    assert len(parts) == 8 and max(r[1] for r in parts) < 2 * len(rows) / 8
    got = sorted((tuple(r) for r in dac.read(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 2000 + list(range(4000))
    assert got[-1][1] + got[-1][2] == sum(len(ids_of(t)) + 1 for _, t in rows)


def test_single_tokens_by_corpus_position(spark):
    rows = [*[(i, f"document {i} says {i * i} things") for i in range(300)], (300, ""), (301, None)]
    whole = [i for _, t in rows for i in [*ids_of(t or ""), 0]]
    path = shared_path(spark, "test", uuid.uuid4().hex)
    dac.write(documents(spark, rows).repartition(5), path, byte_bpe(), block=100)
    n = len(whole)
    asked = [0, n - 1, n, -1, None, 7, 7, *range(0, n, 13), *[n // 2] * 9000]
    got = [tuple(r) for r in dac.lookup(spark, path, spark.createDataFrame([(p,) for p in asked], "position long").repartition(6)).collect()]
    want = [(p, whole[p] if p is not None and 0 <= p < n else None) for p in asked]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = shared_path(spark, "test", uuid.uuid4().hex)
    dac.write(documents(spark, []), empty, byte_bpe())
    some = spark.createDataFrame([(0,), (None,)], "position long")
    assert sorted((tuple(r) for r in dac.lookup(spark, empty, some).collect()), key=repr) == [(0, None), (None, None)]
    assert dac.lookup(spark, path, some.filter("false")).count() == 0
