"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the corpus; Catalyst prunes the columns later."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where none is set (tests on one machine) a temporary folder is used;
    on a cluster without a shared folder this raises, since files in a folder
    local to one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "bindery-checkpoints")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, which is removed when the session's process ends.

    Like ``cut``, for large intermediate results: a fraction of a checkpoint's
    size, and each reader takes only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session's JVM is gone, and its owner clears the folder
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one, for as long as the block runs."""
    path = f"{_shared(spark)}/folder-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _remove(spark, path)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table written into the shared folder, for as long as the block runs.

    For intermediate results that several jobs read: smaller than a checkpoint
    and read column by column. What leaves the block must be cut before.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _remove(spark, path)
