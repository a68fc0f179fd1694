import duckdb
import pytest

import corpus_pipeline
from cinelake.llm.oracle import ORACLES
from cinelake.llm.queries import QUERIES
from tests.llm import test_decontaminate, test_linededup, test_simhash
from tests.llm.test_bpe import digests
from tests.llm.tools import PROSE, SF, documents
from tests.test_oracles import TABLES


def _value(v):
    if isinstance(v, dict):
        return tuple(map(_value, v.values()))
    if hasattr(v, "asDict"):
        return tuple(map(_value, v))
    return tuple(map(_value, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel, df = con.sql(ORACLES[key]), QUERIES[key](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    want = [tuple(_value(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()]
    assert sorted(tuple(_value(r[c]) for c in names) for r in df.collect()) == sorted(want)


def write(spark, folder, rows):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike".split()
    quiet = [(1000 + i, f"a calm entry about item {i}: " + " ".join(words[(i * k) % 13] + str(i) for k in range(1, 12))) for i in range(120)]
    bad = [(2000 + i, f"you grumblefik number {i}, " + " ".join(words[(i * k + 1) % 13] + str(i + 500) for k in range(1, 9))) for i in range(60)]
    documents(spark, rows + quiet + bad).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, 0) for i, _ in quiet] + [(i, 0, 1) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, "what is the airspeed velocity of an unladen swallow flying over the castle at noon")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows + quiet + bad, bench


def test_stages_against_brute_force(spark, tmp_path):
    shared = "this paragraph stands in many documents and says nothing that any of them needs to say by itself"
    unique = lambda i: " ".join(f"u{i}x{k}" for k in range(40))
    rows = [(1, unique(1)), (2, unique(1)), (3, f"{unique(3)}\n{shared}"), (4, f"{unique(4)}\n{shared}"), (5, shared), (6, None), (7, ""), (8, f"they ask what is the airspeed velocity of an unladen swallow flying over it {unique(8)}"), (9, PROSE), (9, PROSE), (None, unique(77)), (10, f"tiny\n{unique(1)}\nbits"), (11, "a b c\nd e f\ng h i\n" + shared[:31]), (12, shared[:31])]
    folder = str(tmp_path)
    rows, bench = write(spark, folder, rows)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)

    kept = [(i, t) for i, t in rows if "grumblefik" not in (t or "")]
    lines = {}
    cut = test_linededup.plain(kept, 2, 30)
    for (i, t), (j, new, _) in zip(sorted(kept, key=repr), sorted(cut, key=repr)):
        lines.setdefault(repr(i), []).append((t, j, new))
    after = [(i, new) for v in lines.values() for t, i, new in v if new == t or 2 * len(new) >= len(t) or any(len(x) >= 30 for x in new.split("\n"))]
    component = {}
    for i, _, c in test_simhash.plain_components([(i, test_simhash.plain_fingerprint(t)) for i, t in after]):
        component[i] = c
    after = [(i, t) for i, t in after if i is None or component[i] == i]
    dirty = {i for i, _, n, _ in test_decontaminate.plain(after, bench) if n}
    want = sorted(((i, *digests(t)) for i, t in after if i not in dirty), key=repr)
    assert got == want
    ids = [r[0] for r in got]
    assert {1, 3, 4, 6, 9, 11, None} <= set(ids) and not {2, 5, 7, 8, 10, 12} & set(ids)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, [(1, PROSE)])
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'e' as fp", "2 as spans")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs2 = stage(spark, docs, folder)
        assert docs2.columns == docs.columns


def test_stages_decide_rows_without_an_id_of_their_own(spark, tmp_path):
    folder = str(tmp_path)
    unique = lambda i: " ".join(f"u{i}x{k}" for k in range(40))
    bad, copied = "you grumblefik number 7, alpha7 echo9 golf11", "what is the airspeed velocity of an unladen swallow flying over it"
    write(spark, folder, [])
    texts = lambda df: sorted(r["text"] for r in df.collect() if r["doc_id"] in (None, 30))
    stage = lambda f, rows: texts(f(spark, spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id <> 30").unionByName(documents(spark, rows)), folder))
    for f, text in ((corpus_pipeline.drop_toxic, bad), (corpus_pipeline.drop_contaminated, copied)):
        assert stage(f, [(None, text), (None, unique(1)), (30, text), (30, unique(2))]) == [unique(1), unique(2)]
    near = stage(corpus_pipeline.drop_near_duplicates, [(None, unique(1)), (None, unique(1)), (None, unique(1).upper()), (30, unique(2)), (30, unique(2).upper()), (None, unique(2)), (None, unique(3)), (None, unique(3))])
    assert sorted(t.lower() for t in near) == [unique(1), unique(2), unique(3)]
