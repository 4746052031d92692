"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the library.

    On a cluster of several hosts the package is shipped with ``--py-files``;
    this only covers a session that was started from another directory.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *(x for x in have if x)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else what ``setCheckpointDir`` was given.

    Where neither is set, a run on one machine (``local``) gets a temporary folder; on a cluster it is an error,
    as executors don't see each other's local folders.
    """
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir", ""):
        return at.rstrip("/")
    if (given := sc._jsc.sc().getCheckpointDir()).isDefined():
        return given.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more; others are left alone."""
    for t in tables:
        spark, root = t.sparkSession, shared_dir(t.sparkSession) + "/tessera/"
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if root.split("://")[-1].lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str, rows: int = 10_000) -> DataFrame:
    """``df`` dealt by a column over tasks of about so many rows: a small file holds many rows, and rows that are costly to work on would all be one task's."""
    n = -(-df.count() // rows)
    return df.repartition(n, by) if n > 1 else df
