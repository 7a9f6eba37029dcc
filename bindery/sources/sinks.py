"""Writing without harm: into a new place only, by way of a neighbour that is read again and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A write that was refused; nothing was changed."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def compared(a: DataFrame, b: DataFrame) -> tuple[int, int, int, int]:
    """Rows of ``a``, of ``b``, and those that only one of them has, repeated rows counted."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    per = both.groupBy(*a.columns).agg(F.sum("_n").alias("d"), F.count_if(F.col("_n") > 0).alias("a"), F.count_if(F.col("_n") < 0).alias("b"))
    r = per.agg(F.sum("a"), F.sum("b"), F.sum(F.greatest("d", F.lit(0))), F.sum(F.greatest(-F.col("d"), F.lit(0)))).first()
    return tuple(int(x or 0) for x in r)


def write_copy(df: DataFrame, path: str, source: str | None = None, digest: tuple[str, str] | None = None) -> None:
    """``df`` as Parquet at ``path``, which must not exist nor be ``source`` itself.

    ``digest`` is what the input's digest should be and what it is; they must
    agree. The rows go to a neighbour first, are read again and compared, and
    only then take their place; where another writer was quicker, its files stay.
    """
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    if source is not None and fs.makeQualified(target).equals(_fs(spark, source)[1].makeQualified(_fs(spark, source)[0])):
        raise Refused("the output is the input")
    if fs.exists(target):
        raise Refused(f"{path} exists")
    if digest is not None and digest[0] != digest[1]:
        raise Refused("the input isn't the one that the plan was made for")
    beside = f"{path}.{uuid.uuid4().hex}.part"
    temp, _ = _fs(spark, beside)
    try:
        df.write.mode("errorifexists").parquet(beside)
        _, _, missing, extra = compared(df, spark.read.schema(df.schema).parquet(beside))
        if missing or extra:
            raise Refused("what was read again differs")
        if fs.exists(target) or not fs.rename(temp, target):
            raise Refused(f"{path} exists")
    finally:
        fs.delete(temp, True)


def check_outputs(spark: SparkSession, inputs: list[str], outputs: list[str], force: bool = False) -> None:
    """Refuses outputs that are inputs, that are named twice, or that exist, unless ``force``; ``-`` is the standard output."""
    whole = lambda p: _fs(spark, p)[1].makeQualified(_fs(spark, p)[0]).toString()
    files = [whole(p) for p in outputs if p != "-"]
    if len(set(files)) != len(files) or outputs.count("-") > 1:
        raise Refused("an output is named twice")
    for p in files:
        if p in {whole(i) for i in inputs}:
            raise Refused(f"{p} is an input")
        if not force and _fs(spark, p)[1].exists(_fs(spark, p)[0]):
            raise Refused(f"{p} exists")


def read_plan(spark: SparkSession, path: str, output: str | None = None, most: int = 64 * 1024 * 1024) -> DataFrame:
    """``path, text`` of a plan's file; one that is too long or the output itself is refused before it is read."""
    target, fs = _fs(spark, path)
    if output is not None and fs.makeQualified(target).equals(_fs(spark, output)[1].makeQualified(_fs(spark, output)[0])):
        raise Refused("the plan is the output")
    if fs.getFileStatus(target).getLen() > most:
        raise Refused(f"{path} is longer than {most} bytes")
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
