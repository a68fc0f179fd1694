"""Executors need no copy of the package, and what a fit brings to the driver is bounded."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from cinelake.llm import common, langid, toxicity
from tests.llm.tools import documents

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from cinelake.session import local_session

spark = local_session(4)

def importable(batches):
    import importlib.util
    for batch in batches:
        batch["id"] = int(importlib.util.find_spec("cinelake") is not None)
        yield batch

assert [r["id"] for r in spark.range(1).mapInPandas(importable, "id long").collect()] == [0]
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op") and name[2].isdigit():
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = dict(line.split() for line in done.stdout.splitlines())
    assert len(rows) == 14 and all(int(n) > 0 for n in rows.values())


def test_one_id_on_a_third_of_all_rows_language(spark, monkeypatch):
    """At most ``per_lang`` texts of a language are fitted, whatever the ids."""
    seen = []
    monkeypatch.setattr(langid, "Model", lambda x, langs, families: seen.append(langs))
    docs = documents(spark, [(1, f"the house number {i} stands on the hill") for i in range(2000)] + [(i, f"a road to town {i}") for i in range(2, 1500)] + [(None, "same text again")] * 1000)
    docs = docs.withColumn("lang", F.when(F.length("text") % 2 == 0, "en").otherwise("de"))
    langid.fit(docs, per_lang=50)
    counts = {lang: seen[0].count(lang) for lang in set(seen[0])}
    assert set(counts) == {"en", "de"} and all(20 < n <= 50 for n in counts.values())


def test_one_id_on_a_third_of_all_rows_toxicity(spark):
    docs = documents(spark, [(1, f"you utter fool number {i}") for i in range(3000)] + [(i, f"a kind word {i}") for i in range(2, 3000)] + [(7, "a kind word 7")] * 500)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 3000)], "doc_id long, toxic int")
    lines = toxicity.labelled(docs, labels, F.lit(True), 200)
    assert lines.count() == 200
    assert toxicity.labelled(docs, labels, F.lit(True), 10**6).count() == 3000 + 2998
    found = toxicity.scores(docs, toxicity.fit(docs, labels, F.lit(True), 400))
    assert found.filter("doc_id = 1 and predicted = 0").count() == found.filter("doc_id <> 1 and predicted = 1").count() == 0


def test_a_worker_lets_go_of_the_last_operators_values(spark, monkeypatch):
    monkeypatch.setattr(sys, "_cinelake_worker_memo", {}, raising=False)
    monkeypatch.setattr(sys, "_cinelake_shared", {}, raising=False)
    made = []
    build = lambda key: common.worker_memo(key, lambda: made.append(key) or key)
    assert [build(k) for k in ("bpe.a", "bpe.b", "bpe.a")] == ["bpe.a", "bpe.b", "bpe.a"] and made == ["bpe.a", "bpe.b"]
    build("langid.letters")
    assert list(sys._cinelake_worker_memo) == ["langid.letters"]
    get = common.share(spark, {"a lexicon": 1})
    assert get() == {"a lexicon": 1} and not sys._cinelake_worker_memo
    build("langid.letters")
    assert get() == {"a lexicon": 1} and list(sys._cinelake_worker_memo) == ["langid.letters"]  # both stay, batch by batch
