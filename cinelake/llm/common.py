"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from cinelake.session import cut_lineage, ensure_checkpoint_dir, shared_path, table

__all__ = ["arrow_map", "cut_lineage", "ensure_checkpoint_dir", "fresh", "share", "shared_path", "slices", "stored", "table", "worker_memo"]


def worker_memo(key: str, make: Callable[[], object]) -> object:
    """A value built once per Python worker process, while no other operator's tasks come in between.

    The package is pickled by value, so its own globals start anew with each
    task; the memo hangs on ``sys``, which outlives a task in a reused worker.
    The part of ``key`` before the first dot names the operator: a worker that
    goes on to another one lets go of the values of the last.
    """
    memo = sys.__dict__.setdefault("_cinelake_worker_memo", {})
    if key not in memo:
        owner = key.split(".")[0]
        for other in [k for k in memo if k.split(".")[0] != owner]:
            del memo[other]
        memo[key] = make()
    return memo[key]


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Send ``value`` to the executors once; the function that is returned gives it back inside a task.

    A broadcast object is pickled by reference to its class, which an executor
    without the package cannot import. So it goes as bytes that hold the class
    too, and a worker process builds it once (it keeps the last one, and lets
    go of what operators before it kept in ``worker_memo``).
    """
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get() -> object:
        kept = sys.__dict__.setdefault("_cinelake_shared", {})
        if key not in kept:
            kept.clear()
            sys.__dict__.get("_cinelake_worker_memo", {}).clear()
            kept[key] = pickle.loads(sent.value)
        return kept[key]

    return get


#: Rows whose values become Python objects at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, a few hundred at a time: the memory of a task does not grow with the batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``rows`` on every slice of the Arrow batches; it returns one batch or yields several."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = rows(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(task, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Used where a table is read more than once: the written form is compressed
    and keeps column pruning, and a lost executor costs a re-read.
    """
    path = shared_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
