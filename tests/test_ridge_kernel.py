"""The matrix-free solver's work per task: small temporaries, and a few columns on every core."""

import tracemalloc

import numpy as np

from cinelake.operators import ridge


def test_sparse_product_works_column_by_column():
    """A product needs room for a few columns of interactions, not for a panel of them."""
    rng = np.random.default_rng(3)
    users, items, each, width = 4000, 2000, 30, 40
    col = np.concatenate([np.sort(rng.choice(items, each, replace=False)) for _ in range(users)])
    val, ptr = rng.random(users * each), np.arange(users) * each
    block = ridge._Rows(ptr.astype(np.int64).tobytes(), col.astype(np.int64).tobytes(), val.tobytes())
    assert block.dense is None
    v, out = rng.random((items, width)), np.zeros((items, width))
    tracemalloc.start()
    block.add_product(v, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * len(col) + 4 * v.nbytes
    x = np.zeros((users, items))
    x[np.repeat(np.arange(users), each), col] = val
    np.testing.assert_allclose(out, x.T @ (x @ v), rtol=1e-11)


def test_rows_of_any_length(monkeypatch):
    """Empty items, one-entry rows and rows longer than a piece; a row is gathered for all columns at once."""
    rng = np.random.default_rng(8)
    size = np.r_[np.ones(50, int), rng.integers(2, 40, 300), 700]
    col = np.concatenate([np.sort(rng.choice(900, k, replace=False)) + 50 for k in size])
    val, ptr = rng.random(len(col)), np.cumsum(size) - size
    x = np.zeros((len(size), 1000))
    x[np.repeat(np.arange(len(size)), size), col] = val
    v = rng.random((1000, 7))
    monkeypatch.setattr(ridge, "DENSE", 0)
    for long, gathered in ((512, 1 << 17), (16, 1), (3, 1 << 17)):
        monkeypatch.setattr(ridge, "LONG", long)
        monkeypatch.setattr(ridge, "GATHERED", gathered)
        block, out = ridge._Rows(ptr.tobytes(), col.tobytes(), val.tobytes()), np.ones((1000, 7))
        block.add_product(v, out)
        np.testing.assert_allclose(out, 1 + x.T @ (x @ v), rtol=1e-11)
    groups = block.by_row
    assert all(at.shape == val[:, 0].shape and at.shape[1] <= 3 for _, at, val, _ in groups)
    assert sum(at.size for _, at, _, _ in groups) == len(col)


def test_few_columns_are_dealt_over_all_tasks(spark):
    n = 500
    x = spark.range(2 * n).selectExpr("id as user_id", f"cast(id % {n} as long) as idx", "1.0d as v")
    solver = ridge.Solver(spark, ridge.pack(x, n), [1.0])
    columns = np.arange(0, n, 8)
    panels = solver._panels(columns)
    assert len(panels) >= min(len(columns), spark.sparkContext.defaultParallelism)
    assert np.array_equal(np.concatenate(panels), columns)
