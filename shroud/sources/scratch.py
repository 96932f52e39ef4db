"""Intermediate tables that several later steps read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one of our own if all runs on this machine (local tests); on a cluster
    an error, since a folder of one machine would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    return found or os.path.join(tempfile.gettempdir(), "checkpoints")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps don't compute it again, and it survives the loss of
    executors. ``clear`` deletes what is left."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that ``settle`` wrote in this process, once no result that reads them is wanted any more."""
    while _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of few partitions, dealt to all cores before expensive expressions. Spark cuts a small table's files into about as many splits as there are cores, but a split without the
    middle of a row group is empty, so one may hold all rows. Only tables of fewer than two splits a core, hence of at most two splits' bytes a core, are dealt; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
