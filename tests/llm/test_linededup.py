import random

from pyspark.sql import functions as F

from cinelake.llm import linededup
from tests.llm.tools import PROSE, crowded, documents, edge_rows


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def edited(rng, text, n, letters):
    out = list(text)
    for _ in range(n):
        i, what = rng.randint(0, len(out)), rng.randint(0, 2)
        if what == 0:
            out.insert(i, rng.choice(letters))
        elif i < len(out):
            out[i : i + 1] = [] if what == 1 else [rng.choice(letters)]
    return "".join(out)


def test_edit_distance_against_dynamic_programming(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        a = "".join(rng.choice("ab\U0001f600é") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 4), "abé") if k % 3 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for edits in (1, 2, 3, 5):
        assert df.filter(linededup.edit_distance(F.col("a"), F.col("b"), edits) != F.least("d", F.lit(edits + 1))).count() == 0


def plain(rows, edits, min_chars):
    key = lambda d: 1 << 63 if d is None else d
    places, out = {}, []
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= min_chars or any(c.isalpha() for c in line):
                places.setdefault(line, set()).add((key(d), n))
    first = {x: min(p) for x, p in places.items()}
    near = {x: [y for y in first if y != x and min(len(x), len(y)) >= min_chars and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits] for x in first}
    rep = {x: min([first[x], *(first[y] for y in near[x])]) for x in first}
    for d, t in rows:
        kept = [line for n, line in enumerate(t.split("\n")) if line not in rep or rep[line] == (key(d), n)] if t is not None else None
        out.append((d, None if t is None else "\n".join(kept), sum(len(near[x]) for x in (t or "").split("\n") if x in near and (near[x] or len(places[x]) > 1))))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["text"], sum(x["n_links"] for x in r["line_classes"])) for r in df.collect()), key=repr)


def test_random_lines_against_all_pairs(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(8, 30))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = [edited(rng, rng.choice(base), rng.randint(0, 4), "abcd ") for _ in range(rng.randint(0, 6))]
        rows.append((d, "\n".join(lines) if lines else None))
    for edits, least in ((1, 6), (2, 10), (3, 12)):
        assert result(linededup.dedupe(documents(spark, rows), edits, least)) == plain(rows, edits, least)


def test_odd_rows(spark):
    near = PROSE[:40] + PROSE[41:]
    rows = [*edge_rows(), (20, f"short\n{near}\nshort"), (21, "short\nshort"), (None, near)]
    docs = documents(spark, rows)
    assert result(linededup.dedupe(docs)) == plain(rows, 2, 30)
    wide = crowded(docs)
    got = linededup.dedupe(wide)
    assert set(got.columns) == set(wide.columns) and result(got) == plain(rows, 2, 30)
    assert linededup.dedupe(documents(spark, [])).count() == 0


def test_rows_without_an_id_of_their_own_lose_only_their_own_lines(spark):
    line = lambda k: f"line {k} " + " ".join(f"w{k}x{i}" for i in range(12))
    for one in (None, 7):
        rows = [(1, line(0)), (one, f"{line(0)}\n{line(1)}"), (one, f"{line(2)}\n{line(0)}"), (one, f"{line(3)}\n{line(4)}"), (one, f"{line(3)}\n{line(5)}")]
        got = sorted(r["text"] for r in linededup.dedupe(documents(spark, rows)).collect())
        first, second = f"{line(3)}\n{line(4)}", f"{line(3)}\n{line(5)}"
        rest = sorted([line(0), line(1), line(2)])
        assert got in (sorted([*rest, first, line(5)]), sorted([*rest, line(4), second]))
    # without an id there is nothing that makes equal rows one document
    assert sorted(r["text"] for r in linededup.dedupe(documents(spark, [(None, line(1))] * 3)).collect()) == ["", "", line(1)]


def test_short_lines_go_if_an_equal_one_comes_first(spark):
    rows = [(1, "All rights reserved.\n}\n\nfirst"), (2, "second\nAll rights reserved.\n}\n"), (3, "All rights reserved!\n}\n---"), (4, "x\nAll rights reserved.\nx")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedupe(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "second\n}\n", 3: rows[2][1], 4: "x"}


def test_shuffled_tables_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 0)
    rows = edge_rows() + [(20, PROSE.replace("mill", "mall")), (21, PROSE + "x")]
    assert result(linededup.dedupe(documents(spark, rows))) == plain(rows, 2, 30)


def test_main_path_runs_no_python(spark):
    plan = linededup.dedupe(documents(spark, [(1, PROSE), (2, PROSE)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
