"""The matrix-free model against numpy, on both of its ways, and the percentile inside blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators import ease, ridge


def ratings_of(spark, x):
    u, i = np.nonzero(x)
    return spark.createDataFrame([(int(a), int(b) * 3 + 1, float(x[a, b])) for a, b in zip(u, i)], "user_id long, item_id long, rating double")


def weights_by_numpy(x, lam, sparsity):
    x = x / x.max()
    p = np.linalg.inv(x.T @ x + lam * np.eye(x.shape[1]))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    limit = np.percentile(np.abs(b), sparsity)
    return {(int(i), int(j)): b[i, j] for i, j in zip(*np.nonzero((np.abs(b) >= limit) & (b != 0)))}


def interactions(rng, users, items, share):
    x = np.where(rng.random((users, items)) < share, rng.integers(1, 11, (users, items)) / 2, 0.0)
    x[np.arange(items) % users, np.arange(items)] = 3.0  # every item is rated
    return x


def found(weights, lam=None):
    rows = weights.where(F.col("lam") == lam) if lam is not None else weights
    return {((r["src_item"] - 1) // 3, (r["dst_item"] - 1) // 3): r["w"] for r in rows.collect()}


@pytest.mark.parametrize("local", [True, False])
def test_weights_and_grid_against_numpy(spark, monkeypatch, local):
    """Every lambda of a grid within 1e-9, whether tasks hold X or share the multiplications."""
    x = interactions(np.random.default_rng(1), 400, 300 if local else 60, 0.05)
    r = ratings_of(spark, x)
    monkeypatch.setattr(ridge, "BLOCK_ROWS", 1500)
    if not local:
        monkeypatch.setattr(ridge, "LOCAL_BYTES", 0)
        monkeypatch.setattr(ridge, "SLAB", 25)
    lams = [0.5, 20.0, 300.0]
    _, w = ridge.fit(r, lams, 95)
    w = w.checkpoint()
    for lam in lams:
        want, got = weights_by_numpy(x, lam, 95), found(w, lam)
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    if local:
        _, exact = ease.fit(r, 20.0, 95, block=64)
        got, same = found(exact), found(w, 20.0)
        assert got.keys() == same.keys() and max(abs(got[k] - same[k]) for k in got) < 1e-9


def test_bound_of_spread_columns_too_high(spark, monkeypatch):
    """The few columns that set the lower bound hold the only large weights; the percentile is exact all the same."""
    rng = np.random.default_rng(2)
    x = interactions(rng, 200, 64, 0.02)
    x[:100, 0] = x[:100, 63] = 5.0
    monkeypatch.setattr(ridge, "SPREAD", 2)  # columns 0 and 63
    _, w = ridge.fit(ratings_of(spark, x), [1.0], 90)
    want, got = weights_by_numpy(x, 1.0, 90), found(w)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_many_zero_weights(spark):
    """Items in separate groups of users: most weights, and the percentile, are zero."""
    x = np.kron(np.eye(10), np.array([[5.0, 3.0], [4.0, 2.0], [1.0, 0.0]]))
    want = weights_by_numpy(x, 1.0, 50)
    for got in (found(ridge.fit(ratings_of(spark, x), [1.0], 50)[1]), found(ease.fit(ratings_of(spark, x), 1.0, 50, block=7)[1])):
        assert got.keys() == want.keys() and len(got) == 20


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, rating double")
    assert ridge.fit(none, [1.0])[1].count() == ease.fit(none, 1.0)[1].count() == 0
    one = spark.createDataFrame([(1, 1, 5.0)], "user_id long, item_id long, rating double")
    assert ridge.fit(one, [1.0, 2.0])[1].count() == 0
    with pytest.raises(ValueError):
        ridge.fit(one, [0.0])
    twice = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0), (1, 4, 4.0)], "user_id long, item_id long, rating double")
    x = np.array([[4.0, 4.0]])
    assert found(ridge.fit(twice, [1.0], 0)[1]) == pytest.approx(weights_by_numpy(x, 1.0, 0))


def test_twenty_thousand_items(spark):
    """Panels stay under their bound, X is the only thing that all tasks hold, and the columns solve the system."""
    n, users = 20_000, 30_000
    x = spark.range(users * 10).selectExpr("id % 30000 AS user_id", "pmod(xxhash64(id), 20000) AS idx", "1.0 + id % 5 AS v").groupBy("user_id", "idx").agg(F.sum("v").alias("v"))
    packed = ridge.pack(x.checkpoint(), n, 5.0)
    width = ridge.panel_width(n, 1)
    assert width * n * 8 * 8 <= ridge.PANEL_BYTES and packed.size < 10 << 20
    solver = ridge.Solver(spark, packed, [10.0])
    columns = np.arange(0, n, 100)
    rows = solver.entries(columns, [0.0]).where("j in (0, 19900)").collect()
    blocks = [ridge._Rows(*(bytes(c) for c in r)) for r in packed.blocks.collect()]
    apply = ridge._local(blocks)
    for j in (0, 19900):
        b = np.zeros(n)
        for r in rows:
            if r["j"] == j:
                b[r["i"]] = r["b"]
        y = -b
        y[j] = 1.0  # y is column j of P over its diagonal entry: the system gives a multiple of a unit vector
        left = apply(y[:, None])[:, 0] + 10.0 * y
        assert abs(np.delete(left, j)).max() < 1e-9 * left[j]


@pytest.mark.parametrize("kind", ["spread", "ties", "zeros", "one"])
def test_percentile_inside_blocks(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    n = 1 if kind == "one" else 23
    p = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-12, 3, (n, n))
    if kind == "ties":
        p = rng.integers(1, 4, (n, n)).astype(float)
        np.fill_diagonal(p, 2.0)
    if kind == "zeros":
        p = np.where(rng.random((n, n)) < 0.8, 0.0, p)
    np.fill_diagonal(p, np.abs(np.diag(p)) + 1)
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    monkeypatch.setattr(ease, "FEW_VALUES", 3)
    entries = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(n)], "i int, j int, g double")
    blocks = ease.to_blocks(entries, n, 0.0, 7).checkpoint()
    for q in (0.0, 0.3, 0.5, 0.771, 0.98, 1.0):
        assert ease.block_percentile(ease._weight_blocks(blocks, n), n, q) == pytest.approx(np.percentile(np.abs(b), 100 * q), rel=1e-12, abs=0)
    monkeypatch.setattr(ease, "MAX_BROADCAST_PANEL", 0)
    limit = np.percentile(np.abs(b), 60)
    want = {(i, j): b[i, j] for i in range(n) for j in range(n) if abs(b[i, j]) >= limit and b[i, j]}
    assert {(r["i"], r["j"]): r["b"] for r in ease.block_sparsify(blocks, n, 60, 7).collect()} == want


def test_large_catalogue_takes_the_solver(spark, monkeypatch):
    x = interactions(np.random.default_rng(5), 60, 20, 0.2)
    monkeypatch.setattr(ease, "MAX_DENSE_ITEMS", 10)
    monkeypatch.setattr(ease, "invert_blocks", None)
    _, w = ease.fit(ratings_of(spark, x), 2.0, 80)
    assert w.columns == ["src_item", "dst_item", "w"] and found(w).keys() == weights_by_numpy(x, 2.0, 80).keys()
