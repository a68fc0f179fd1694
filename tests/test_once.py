"""Results written once, runs that go on where they stopped, and the ledger of external calls."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from cinelake.functions import ledger
from cinelake.operators import ease
from cinelake.plans import pipelines as P
from cinelake.sources import io, once

SF = "/root/testdata/sf0.01"


def test_first_writer_wins_and_the_unfinished_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "result")
    spark.range(3).write.parquet(f"{folder}/data-dead")  # a writer that died before its mark
    assert once.committed(spark, folder) is None
    calls = []

    def write(rows):
        return lambda path: (calls.append(rows), spark.range(rows).write.parquet(path))

    path, wrote = once.write_once(spark, folder, write(5))
    assert wrote and spark.read.parquet(path).count() == 5
    assert once.write_once(spark, folder, write(7)) == (path, False) and calls == [5]
    other = str(tmp_path / "race")

    def slow(path):  # another session commits while this one still writes
        spark.range(2).write.parquet(path)
        once.write_once(spark, other, write(9))

    path, wrote = once.write_once(spark, other, slow)
    assert not wrote and spark.read.parquet(path).count() == 9
    assert sorted(x[:5] for x in os.listdir(other) if not x.startswith(".")) == ["COMMI", "data-"]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / once.MARK).write_text("data-half")  # died while it wrote the mark
    path, wrote = once.write_once(spark, str(broken), write(4))
    assert wrote and once.committed(spark, str(broken)) == path


def test_write_that_fails_leaves_no_result(spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        once.write_once(spark, str(tmp_path / "x"), lambda path: (spark.range(1).write.parquet(path), 1 / 0))
    assert once.committed(spark, str(tmp_path / "x")) is None


def test_model_is_loaded_by_a_second_session_and_refitted_for_changed_files(spark, tmp_path, monkeypatch):
    data = str(tmp_path / "sf")
    shutil.copytree(SF, data)
    fits = []
    fit = ease.fit
    monkeypatch.setattr(ease, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    monkeypatch.setattr(P, "LAMBDA", 40.0)
    name = "test-" + tmp_path.name
    first, second, third = spark, spark.newSession(), spark.newSession()
    old = spark.conf.get(once.NAMESPACE, None)
    try:
        for s in (first, second, third):
            s.conf.set(once.NAMESPACE, name)
        want = sorted(tuple(r) for r in P.model(first, data, 40.0)[1].collect())
        assert want and len(fits) == 1
        assert sorted(tuple(r) for r in P.model(second, data, 40.0)[1].collect()) == want and len(fits) == 1
        P.model(second, data, 60.0)
        assert len(fits) == 2  # another parameter
        os.utime(f"{data}/lineitem.parquet", (1, 1))
        P.model(third, data, 40.0)
        assert len(fits) == 3
    finally:
        spark.conf.unset(once.NAMESPACE) if old is None else spark.conf.set(once.NAMESPACE, old)


def test_half_written_cohort_is_drawn_again(spark, tmp_path):
    path = str(tmp_path / "cohort")
    spark.range(3).withColumnRenamed("id", "user_id").write.json(path)  # as the older form, or a dead writer, leaves it
    got = io.chosen_once(spark, lambda: spark.range(5).withColumnRenamed("id", "user_id"), path)
    assert got.count() == 5
    assert io.chosen_once(spark, lambda: spark.range(9).withColumnRenamed("id", "user_id"), path).count() == 5


def test_interrupted_run_goes_on(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 20 AS k", "id AS v")
    ran = []

    def job(fail_at):
        def run(part):
            ran.append(sorted({r["k"] for r in part.select("k").distinct().collect()}))
            if len(ran) == fail_at:
                raise RuntimeError("lost")
            return part.groupBy("k").agg(F.sum("v").alias("s"))

        return run

    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        once.run_parts(spark, folder, rows, "k", 5, job(3), "k long, s long")
    assert once.finished(spark, folder, 5, "k long, s long").count() == len(ran[0]) + len(ran[1])
    lost = ran[2]
    got = once.run_parts(spark, folder, rows, "k", 5, job(0), "k long, s long")
    assert {r["k"]: r["s"] for r in got.collect()} == {k: sum(range(k, 100, 20)) for k in range(20)}
    assert ran[3] == lost and sorted(sum(ran[:2] + ran[3:], [])) == list(range(20))
    assert once.finished(spark, str(tmp_path / "none"), 5, "k long").count() == 0


def counted(log, fail=None):
    """A client that writes down every call; texts in ``fail`` make their batch fail."""

    def scorer(preferences, plots):
        with open(log, "a") as f:
            f.writelines(f"{a}|{b}\n" for a, b in zip(preferences, plots))
        if fail and os.path.exists(fail) and any(p == "bad" for p in plots):
            raise TimeoutError("no answer")
        return [f"{a}:{b}" for a, b in zip(preferences, plots)]

    return scorer


def test_ledger_calls_every_pair_once(spark, tmp_path):
    log, fail, folder = str(tmp_path / "log"), str(tmp_path / "fail"), str(tmp_path / "ledger")
    pairs = [(i, f"w{i % 4}", f"p{i % 3}") for i in range(60)] + [(100, None, "p0"), (101, None, "p0"), (102, "w0", None), (103, "w", "bad")]
    P1 = spark.createDataFrame(pairs, "pair_id int, preferences string, plot string")
    open(fail, "w").close()
    got = {r["pair_id"]: r for r in ledger.score_once(P1, counted(log, fail), folder, parts=3, batch=1).collect()}
    lines = open(log).read().splitlines()
    assert len(got) == 64 and sorted(set(lines)) == sorted({f"{a}|{b}" for _, a, b in pairs})
    assert len(lines) == 12 + 1 + 1 + 3  # one call each; the failing pair three times
    assert got[103]["answer"] is None and got[103]["attempts"] == 3 and "TimeoutError" in got[103]["error"]
    assert all(got[i]["answer"] == f"{a}:{b}" for i, a, b in pairs if i != 103)
    os.rename(fail, fail + "-over")
    more = P1.unionByName(spark.createDataFrame([(200, "w9", "p9")], P1.schema))
    again = {r["pair_id"]: r for r in ledger.score_once(more, counted(log, fail), folder, parts=3, batch=1).collect()}
    assert sorted(open(log).read().splitlines()[len(lines) :]) == ["w9|p9", "w|bad"]
    assert again[103]["answer"] == "w:bad" and again[103]["error"] is None and again[200]["answer"] == "w9:p9" and len(again) == 65
    assert ledger.score_once(P1.where("false"), counted(log), folder, parts=3).count() == 0


def test_ledger_goes_on_after_an_interruption(spark, tmp_path, monkeypatch):
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    pairs = spark.createDataFrame([(i, f"w{i}", "p") for i in range(40)], "pair_id int, preferences string, plot string")
    write, done = once.write_once, []

    def dies(spark, folder, job):
        if len(done) == 3:  # the plan and two parts
            raise KeyboardInterrupt
        done.append(folder)
        return write(spark, folder, job)

    monkeypatch.setattr(once, "write_once", dies)
    with pytest.raises(KeyboardInterrupt):
        ledger.score_once(pairs, counted(log), folder, parts=4)
    before = open(log).read().splitlines()
    assert 0 < len(before) < 40
    monkeypatch.setattr(once, "write_once", write)
    got = ledger.score_once(pairs, counted(log), folder, parts=4)
    assert got.where("answer = concat(preferences, ':', plot)").count() == 40
    assert sorted(open(log).read().splitlines()) == sorted(f"w{i}|p" for i in range(40))
