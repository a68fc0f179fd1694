import numpy as np
import pytest

from cinelake.llm import whitening
from cinelake.llm.queries import QUERIES
from tests.llm.tools import SF


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, x string, component string, whitened string")


def table(spark, rows):
    return vectors(spark, [(i, None if v is None else [None if c is None else float(c) for c in v], 7, "extra", "extra", "extra") for i, v in rows])


def by_numpy(x, k=4):
    """Integer rows: n, S, deviations, whitened rows (up to sign) and explained shares."""
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(0)
    a = f - s / n
    value, vector = np.linalg.eigh(a.T @ a / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(k, int((value > 1e-12 * max(value[0], 1e-300)).sum())) if value[0] > 0 else 0
    return n, ((n * x.astype(object) - s) ** 2).sum(1), (x - s / n) @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


def check(rows, ids, x, close=1e-9):
    n, deviation, want, share = by_numpy(x)
    k = want.shape[1]
    assert len(rows) == k * len(ids)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    w = np.array([[got[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    w *= np.sign((w * want).sum(0))
    assert np.abs(w - want).max() < close
    for j, i in enumerate(ids):
        for c in range(k):
            r = got[i][c + 1]
            assert r["n"] == n and r["deviation"] == deviation[j] and abs(r["explained"] - share[c]) < 1e-4 * share[c] and r["identity_error"] < 1e-9


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(int)
    check(QUERIES["op12_whitening"](spark, SF).collect(), [r["vec_id"] for r in rows], x)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (40, 5))
    good = [(i, row / 256) for i, row in enumerate(x.tolist() and x)]
    hot = [(100 + i, x[0] / 256) for i in range(25)]  # a third of all rows
    bad = [(200, None), (201, [1.0, None, 1, 1, 1]), (202, [1, float("nan"), 1, 1, 1]), (203, [1, 1, 1, 1, float("inf")])]
    got = whitening.whiten(table(spark, [*good, *hot, *bad])).collect()
    check(got, [*range(40), *range(100, 125)], np.vstack([x, np.repeat(x[:1], 25, 0)]))
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    same = whitening.whiten(table(spark, [(None, good[0][1]), (None, good[1][1]), (5, good[2][1]), (5, good[3][1])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in same if r["vec_id"] is not None) == [(5, 1), (5, 1), (5, 2), (5, 2), (5, 3), (5, 3)]
    assert sum(r["vec_id"] is None for r in same) == 6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, []), (2, [])], [(1, [0.5, 2])], [(1, [0.5, 2]), (2, [0.5, 2])]])
def test_no_components(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_deviations_without_components(spark):
    v = table(spark, [(1, [0.5, 2]), (2, [0.5, 2])])
    assert [(r["deviation"], r["whitened"]) for r in whitening.transform(v, whitening.fit(v)).collect()] == [(0, []), (0, [])]


def test_shorter_vectors_have_zeros_at_the_end(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (30, 4))
    x[:10, 2:], x[10, :] = 0, 0
    rows = [(i, (row[:2] if i < 10 else row[:0] if i == 10 else row) / 256) for i, row in enumerate(x)]
    check(whitening.whiten(table(spark, rows)).collect(), range(30), x)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-300, 300, (50, 2))
    x = np.column_stack([a, a.sum(1), 3 * a[:, 0], np.full(50, 7)])
    check(whitening.whiten(table(spark, [(i, row / 256) for i, row in enumerate(x)])).collect(), range(50), x)


def test_components_of_very_different_size(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 3, (200, 4)) * np.array([10**6, 10**4, 100, 1])
    x = x @ np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [0, 0, 0, 1]])
    got = whitening.whiten(table(spark, [(i, row / 256) for i, row in enumerate(x)])).collect()
    n, _, _, _ = by_numpy(x)
    a = np.unique(x, axis=0) - np.unique(x, axis=0).sum(0) / n
    sigma = np.linalg.svd(a, compute_uv=False)
    share = {r["component"]: r["explained"] for r in got}
    assert sorted(share) == [1, 2, 3, 4]
    for c in range(4):
        assert abs(share[c + 1] - sigma[c] ** 2 / (sigma**2).sum()) < 1e-6 * share[c + 1]
    assert max(r["identity_error"] for r in got) < 1e-6


def test_huge_entries(spark):
    rows = [(1, [1e300, 1]), (2, [-1e300, 2]), (3, [5, 3]), (4, [0, 4])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["deviation"] for r in got if r["vec_id"] < 3} == {None} and len(got) >= 4
    n = 3_037_000_500  # its square is just beyond a long
    middle = whitening.Centre(2, [0], n)
    assert not middle.exact and middle.deviations(np.array([[n]]))[0, 0] == 2 * n


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(6, 6))) + 6 * np.eye(6)
    a = rng.normal(size=(9, 6))
    assert np.allclose(whitening.solve_rows(a, r) @ r, a)


def test_packed_rows():
    for x in ([], [0], [127, -128], [128], [-(2**15), 1], [2**31], [2**63 - 1024, -(2**63)]):
        packed = whitening._pack(np.array(x, np.int64))
        assert whitening._unpack([packed], len(x))[0].tolist() == x
