"""Spark session and shared-folder helpers.

Cluster jobs take their shared folder from ``spark.checkpoint.dir``; a
default is set only when the session has none (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = 8, app: str = "cinelake") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a temporary one is chosen only in local mode.

    On a cluster a folder of the driver is of no use to the executors, so an
    unset ``spark.checkpoint.dir`` is an error there.
    """
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cp = tempfile.mkdtemp(prefix="cinelake-cp-")
        spark.conf.set("spark.checkpoint.dir", cp)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cp)
    return cp


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "cinelake", *parts, uuid.uuid4().hex])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    For large tables that are read more than once: a checkpoint holds whole rows
    uncompressed, the written columns are packed and only those needed are read.
    A lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df`` unchanged.

    The size is checked, not assumed: a bounded count (``limit(max_rows + 1)``)
    decides, and beyond the bound the join stays a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` hashed by ``key`` over all shuffle partitions, for rows that are about to become many more (so few bytes must not mean few tasks)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def session_key(spark: SparkSession) -> tuple[str, int]:
    """Identity of a live session for caches: its application id and the session object.

    ``id(spark)`` alone is not enough: after ``stop()`` a new session can get the
    old Python id and would then see tables bound to a dead context; the
    application id changes with every new context. Within one context a cached
    table keeps its session alive, so that session's id cannot be reused.
    """
    return spark.sparkContext.applicationId, id(spark)
