import random

import xxhash
from pyspark.sql import functions as F

from cinelake.llm import graph, simhash
from cinelake.llm.queries import QUERIES
from tests.llm.tools import SF, crowded, documents, edge_rows


def plain_fingerprint(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, distance=3):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    fps = sorted({f for _, f in items})
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    smallest = {}
    for d, f in items:
        if d is not None:
            smallest[find(f)] = min(d, smallest.get(find(f), d))
    return sorted(((d, f, smallest.get(find(f))) for d, f in items), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    got = QUERIES["op10_simhash"](spark, SF)
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got.collect()), key=repr) == want
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]


def test_odd_rows(spark):
    rows = edge_rows()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert result(simhash.near_duplicates(crowded(documents(spark, rows)))) == want
    assert result(simhash.near_duplicates(documents(spark, []))) == []


def test_links_and_hot_cells_against_all_pairs(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {c for c in centres} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for distance in (0, 1, 2, 3):
        want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
        got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(table, distance).collect()}
        assert got == want
        hot = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(table, distance, hot_cell=3).collect()]
        assert set(map(lambda p: tuple(sorted(p)), hot)) <= want

        def classes(pairs):
            return plain_components([(f, f) for f in fps], 0) if not pairs else _classes(fps, pairs)

        assert classes(hot) == classes(want)


def _classes(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    shuffled = [(1000 + (i * 37) % 101, 1000 + ((i + 1) * 37) % 101) for i in range(100)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    edges = [*chain, *shuffled, *star, (7, 7), (0, 1), (9000, 9000)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _classes({n for e in edges for n in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    wanted = {}
    for n, r in want.items():
        wanted.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    pairs += [(a, a ^ (1 << rng.randrange(62))) for a, _ in pairs]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(simhash._counts(F.col("a")).bitwiseXOR(simhash._counts(F.col("b")))).alias("l1"))
    for r in df.collect():
        segments = sum(abs((r["a"] >> s & 3).bit_count() - (r["b"] >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert r["l1"] == segments <= (r["a"] ^ r["b"]).bit_count()
