"""The Gram product in cells: no row per pair of items is shuffled, and every odd entry counts as it did."""

from collections import defaultdict

import numpy as np
import pytest

from cinelake.operators import cells, ease


def ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double")


def by_pairs(rows, implicit):
    """(i, j) -> value by a plain loop; None if no pair has both values. A null item takes a place, as the index gives it one."""
    x, items = defaultdict(dict), sorted({-1 if i is None else i for _, i, _ in rows})
    for u, i, v in rows:
        if u is not None and i is not None:
            old = x[u].get(items.index(i))
            v = 1.0 if implicit else v
            x[u][items.index(i)] = old if v is None else v + (old or 0.0)
    top = 1.0 if implicit else max(v for *_, v in rows if v is not None)
    out = {}
    for row in x.values():
        for i, a in row.items():
            for j, b in row.items():
                old = out.setdefault((i, j), None)
                if a is not None and b is not None:
                    out[i, j] = (old or 0.0) + a * b / top**2
    return out


def odd_rows():
    rng = np.random.default_rng(11)
    rows = [(u, int(i) * 7, float(rng.integers(-2, 11)) / 2) for u in range(40) for i in rng.choice(30, rng.integers(1, 20), replace=False)]
    rows += rows[:25]  # repeated entries add up
    rows += [(u, 0, 4.0) for u in range(100, 160)]  # an item of many users
    rows += [(1000, i * 7, 1.0) for i in range(30)]  # a user of all items
    rows += [(3, 7, None), (4, 14, None), (1001, 14, None), (1001, 21, 2.0), (1002, 700, None), (1002, 707, 2.0), (None, 7, 3.0), (None, 14, 3.0), (5, None, 1.0)]
    return rows


@pytest.mark.parametrize("kind", ["dense", "sparse", "shared"])
@pytest.mark.parametrize("implicit", [False, True])
def test_against_all_pairs(spark, monkeypatch, kind, implicit):
    if kind == "sparse":
        monkeypatch.setattr(cells, "SPARSE", 0)
        monkeypatch.setattr(cells, "MARKED", 5)
    if kind == "shared":  # several tasks per item, a few pairs and entries at once
        monkeypatch.setattr(cells, "PAIRS", 20)
        monkeypatch.setattr(cells, "ENTRIES", 16)
        monkeypatch.setattr(cells, "NUMBERS", 40)
        monkeypatch.setattr(ease, "SALT_CHUNK", 3)
    rows = odd_rows()
    r = ratings(spark, rows)
    found = ease.gram(r, ease.item_index(r), implicit).collect()
    got, want = {(x.i, x.j): x.g for x in found}, by_pairs(rows, implicit)
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    if not implicit:
        assert None in want.values()


def test_pairs_are_not_shuffled(spark):
    r = ratings(spark, [(u, (u * 31 + k * 17) % 50, 1.0 + k % 5) for u in range(200) for k in range(10)])
    plan = ease.gram(r, ease.item_index(r))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    none = ease.gram(ratings(spark, []), ease.item_index(ratings(spark, [])))
    assert none.columns == ["i", "j", "g"] and none.count() == 0


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    for n in (1000, 1 << 33):
        size = rng.integers(1, 9, 50)
        col = np.concatenate([np.sort(rng.choice(1000, k, replace=False)) * (n // 1000) for k in size])
        _, packed = cells._squeeze(size, col, n)
        assert np.array_equal(cells._columns(size, packed, n), col)
    for many in (3, 1000, 100_000):
        val = rng.random(many)[rng.integers(0, many, 200_000)]
        code, value = cells._coded(val)
        back = cells._codes(code.tobytes(), value, len(val))
        assert np.array_equal(np.frombuffer(value, np.float64)[back] if value else back, val)


def test_large_triangles_are_not_stored(spark, monkeypatch):
    r = ratings(spark, [(u, (u * 31 + k * 17) % 50, 1.0 + k % 5) for u in range(200) for k in range(10)])
    want = sorted(map(tuple, ease.prepare(r)[2].collect()))
    monkeypatch.setattr(ease, "MAX_STORED_GRAM", 0)
    _, n, entries = ease.prepare(r)
    assert n == 50 and sorted(map(tuple, entries.collect())) == want
