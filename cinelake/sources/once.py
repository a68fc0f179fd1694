"""Results that are written once: models, cohorts, finished parts of a run.

A result lives in a folder of its own. A writer puts its data aside in
``data-<unique>`` and then creates the file ``COMMITTED`` with that name in it.
Creating the file fails if it is there, so of several writers the first wins and
the others read its data. Whatever has no commit mark, such as the folder of a
writer that died, does not count as a result and is never read.

Folders are named by a fingerprint of the input files and the parameters, so a
changed input leads to a new result and an unchanged one is found again, also by
another session that has the same ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.session import ensure_checkpoint_dir

MARK = "COMMITTED"
#: Session setting: results of one namespace are not found from another (the benchmark starts cold this way).
NAMESPACE = "cinelake.once.namespace"


def fingerprint(spark: SparkSession, folders: list[str], *facts: object) -> str:
    """Hash of the files below ``folders`` (name, length, time of change) and of ``facts``.

    The files are listed by Spark and only their two sums reach the driver.
    """
    out = hashlib.sha256(repr(facts).encode())
    for folder in sorted(folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        name = F.expr(f"substring(path, greatest(1, instr(path, '{folder.rstrip('/').rsplit('/', 1)[-1]}')))")
        listed = files.select(F.xxhash64(name, "length", "modificationTime").cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
        out.update(repr((folder, int(listed[0]), int(listed[1] or 0))).encode())
    return out.hexdigest()[:32]


def place(spark: SparkSession, *parts: str) -> str:
    """The folder of a result in the shared location, the same in every session of a namespace."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "cinelake", "once", spark.conf.get(NAMESPACE, "shared"), *parts])


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the caller's own."""
    fs, mine = _file(spark, path)
    fs.delete(mine, True)


def committed(spark: SparkSession, folder: str) -> str | None:
    """The data folder of a committed result; None if there is none, or if a writer died while it marked it."""
    fs, mark = _file(spark, f"{folder}/{MARK}")
    if not fs.exists(mark):
        return None
    stream = fs.open(mark)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{folder}/{text[:-1]}" if text.endswith("\n") else None


def _mark(spark: SparkSession, folder: str, name: str) -> bool:
    """Create the commit mark; False if another writer has."""
    fs, mark = _file(spark, f"{folder}/{MARK}")
    broken = fs.exists(mark) and committed(spark, folder) is None
    try:
        stream = fs.create(mark, broken)  # an unfinished mark is replaced, a finished one never
    except Py4JJavaError as e:
        if committed(spark, folder) is None:
            raise e
        return False
    stream.write(bytearray(f"{name}\n".encode()))
    stream.close()
    return True


def write_once(spark: SparkSession, folder: str, write: Callable[[str], object]) -> tuple[str, bool]:
    """(data folder, whether this call wrote it): ``write(path)`` runs only if ``folder`` holds no committed result."""
    found = committed(spark, folder)
    if found:
        return found, False
    name = f"data-{uuid.uuid4().hex}"
    write(f"{folder}/{name}")
    if _mark(spark, folder, name):
        return f"{folder}/{name}", True
    delete(spark, f"{folder}/{name}")  # what this call wrote aside
    return committed(spark, folder), False


def finished(spark: SparkSession, folder: str, n_parts: int, schema: str) -> DataFrame:
    """The rows of all committed parts of ``run_parts``; unfinished parts have none."""
    found = [p for k in range(n_parts) if (p := committed(spark, f"{folder}/part={k}"))]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def run_parts(spark: SparkSession, folder: str, rows: DataFrame, key: str, n_parts: int, job: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """``job`` over ``rows`` in ``n_parts`` parts by the hash of ``key``, each committed when it is done.

    A run that is interrupted goes on with the first part that has no commit
    mark; parts that are done are read, never run again. All rows of a key fall
    into one part.
    """
    part = F.pmod(F.xxhash64(key), F.lit(n_parts))
    for k in range(n_parts):
        write_once(spark, f"{folder}/part={k}", lambda path, k=k: job(rows.where(part == k)).write.parquet(path))
    return finished(spark, folder, n_parts, schema)
