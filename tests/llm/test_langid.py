import zlib

from cinelake.llm import langid
from cinelake.llm.queries import QUERIES
from tests.llm.tools import SF, crowded, documents, edge_rows


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_language"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]][1] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr"), ("el perro y el gato", "es"), (None, "en"), ("123", "de"), ("abc", None)] * 3)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = [*edge_rows(), (30, "el gato y el perro"), (31, "die katze und der hund"), (32, "le chat et le chien"), (33, "the dog and the cat")]
    got = {r["doc_id"]: r for r in langid.predict(crowded(documents(spark, rows)), model).collect()}
    assert [got[i]["lang_pred"] for i in (30, 31, 32, 33)] == ["es", "de", "fr", "en"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 9))
    assert len(langid.predict(documents(spark, rows), model).collect()) == len(rows)
    assert langid.predict(documents(spark, []), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(documents(spark, rows), None).collect()} == {"und"}
    assert langid.fit(train.filter("false")) is None


def test_one_language_and_unknown_codes(spark):
    one = langid.fit(spark.createDataFrame([(1, "abc def", "xx")], "doc_id long, text string, lang string"))
    assert one.predict(langid.features("anything"))[0] == "xx"
    more = langid.fit(spark.createDataFrame([(1, "aaaa bbbb", "xx"), (2, "cccc dddd", "yy"), (3, "eeee ffff", "de")], "doc_id long, text string, lang string"))
    assert [more.predict(langid.features(t))[0] for t in ("bbbb aaaa", "dddd", "ffff")] == ["xx", "yy", "de"]


def test_long_text_is_counted_whole():
    import numpy as np

    text = "abc déf " * 80_000
    assert np.allclose(langid.features(text), langid.features("abc déf " * 100), atol=1e-2)
    assert not np.allclose(langid.features(text + "zzzz qqqq " * 60_000), langid.features(text), atol=1e-2)
