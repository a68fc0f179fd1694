import zlib

from pyspark.sql import functions as F

from cinelake.llm import toxicity
from cinelake.llm.queries import QUERIES
from tests.llm.tools import crowded, documents, edge_rows

BIG = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = QUERIES["op6_toxicity"](spark, BIG).collect()
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    caught = sum(a and b for a, b in held) / sum(a for a, _ in held)
    wrong = sum(b and not a for a, b in held) / sum(not a for a, _ in held)
    assert caught >= 0.9 and wrong <= 0.01


def table(spark):
    bad = [f"you are a total grumblefik person number {i} and that is all there is" for i in range(40)]
    good = [f"it was a quiet day number {i} and nothing much happened there at all" for i in range(200)]
    fine = [f"the grumblefik machine number {i} runs well today" for i in range(12)]
    docs = documents(spark, list(enumerate(bad + good + fine)))
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(252)], "doc_id long, toxic int")
    return docs, labels


def test_folding_exceptions_and_odd_rows(spark):
    docs, labels = table(spark)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert any("grumb" in e for e in model.weights)
    rows = [*edge_rows(), (30, "a grumblеfik"), (31, "GRUMBL3F1K you"), (32, "the grumblefik machine"), (33, "gr​umblefik fool"), (34, "ｇｒｕｍｂｌｅｆｉｋ"), (35, "a mild remark")]
    got = {r["doc_id"]: r for r in toxicity.scores(crowded(documents(spark, rows)), model).collect()}
    assert all(got[i]["matched"] >= 1 and got[i]["score"] > got[35]["score"] for i in (30, 31, 33, 34))
    assert got[32]["matched"] == 0 and got[35]["matched"] == 0
    assert got[2]["score"] == got[3]["score"] == got[4]["score"] == got[35]["score"]
    assert toxicity.scores(documents(spark, rows), model).count() == len(rows)
    assert toxicity.scores(documents(spark, []), model).count() == 0


def test_labels_with_nulls_repeats_and_none(spark):
    docs, labels = table(spark)
    odd = labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int"))
    assert toxicity.fit(docs, odd, F.lit(True)).weights == toxicity.fit(docs, labels, F.lit(True)).weights
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        model = toxicity.fit(docs, some, F.lit(True))
        assert model.weights == {} and all(r["predicted"] == 0 for r in toxicity.scores(docs, model).collect())


def test_length_normalises():
    model = toxicity.Lexicon({" bad": 5.0}, {"bad weather"}, (-4.0, 3.0, 0.0))
    a = model.automaton()
    short, long = model.weigh(a, "so bad"), model.weigh(a, "so bad " + "fine words " * 500)
    assert short[0] == long[0] == 5 and model.score(short[0], short[2]) > model.score(long[0], long[2])
    assert model.weigh(a, "bad weather, badly")[:2] == (5.0, 1)
