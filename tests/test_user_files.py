"""Per-user files: every text comes back whole, and no file costs a folder, a checksum file or a driver's rename."""

import os

from cinelake.sources import io


def files(folder):
    return [os.path.join(at, n) for at, _, names in os.walk(folder) for n in names]


def test_odd_texts_come_back(spark, tmp_path):
    rows = [(1, "a\nb\n", "x"), (2, "", "y"), (3, None, None), (40, "é\r\n  end ", "z"), (5, "once", "p"), (5, "once", "p"), (-6, "negative", "q"), (None, "nobody", "r")]
    texts = spark.createDataFrame(rows, "user_id long, content string, prompt string")
    folder = io.write_user_kinds(texts, str(tmp_path / "some files"), {"one.txt": "content", "not_one.txt": "prompt"})
    found = io.read_user_files(spark, folder, "one.txt")
    assert found.dtypes == [("user_id", "bigint"), ("content", "string")]
    assert [tuple(r) for r in found.collect()] == [(1, "a\nb\n"), (2, ""), (3, ""), (5, "once\nonce"), (40, "é\r\n  end ")]
    assert [tuple(r) for r in io.read_user_files(spark, folder, "not_one.txt").collect()] == [(1, "x"), (2, "y"), (3, ""), (5, "p\np"), (40, "z")]
    assert io.read_user_files(spark, folder, "none.txt").count() == 0


def test_one_plain_file_per_user_and_kind(spark, tmp_path):
    texts = spark.range(3000).selectExpr("id AS user_id", "concat('text ', id) AS content")
    folder = io.write_user_files(texts, str(tmp_path / "files"), "one.txt")
    assert len(files(folder)) == 3000 and len(os.listdir(folder)) <= io.USER_FOLDERS
    assert open(next(f for f in files(folder) if f.endswith("/17_one.txt")), encoding="utf-8").read() == "text 17"
    assert [tuple(r) for r in io.read_user_files(spark, folder, "one.txt").collect()] == [(i, f"text {i}") for i in range(3000)]


def test_other_file_systems_keep_sparks_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "_shared_disk", lambda *_: None)
    texts = spark.createDataFrame([(12, "a\nb\n", "p"), (3, "c: d", "q")], "user_id long, content string, prompt string")
    folder = io.write_user_kinds(texts, str(tmp_path / "files"), {"one.txt": "content", "two.txt": "prompt"})
    assert [tuple(r) for r in io.read_user_files(spark, folder, "one.txt").collect()] == [(3, "c: d"), (12, "a\nb\n")]
