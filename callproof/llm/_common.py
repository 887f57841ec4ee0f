"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only where none is configured and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="callproof-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def laid_down(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows as a table in the shared folder, and its path; ``removed`` frees its place as soon as nothing reads it any more."""
    path = f"{checkpoint_dir(df.sparkSession)}/laid-down-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of ours from the shared folder."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path)
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What a worker keeps for its later tasks, by the use it has.
KEPT: dict[tuple[str, str], object] = {}


def give_back(use: tuple[str, str] | None = None) -> None:
    """Drops what a worker kept for other uses than this one, and gives its unused memory back to the system.

    Workers go from stage to stage; without this the tables of earlier stages count beside what the next one takes.
    """
    for other in [k for k in KEPT if k != use]:
        del KEPT[other]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)
