"""Reading tables, and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one of our own if all runs on this machine (local tests); on a cluster
    an error, since a folder of one machine would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    return found or os.path.join(tempfile.gettempdir(), "checkpoints")


_written: list[str] = []


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and the
    table survives the loss of any executor. ``discard`` deletes it, ``clear`` all that are left. ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more: whatever came from them has to be written by now."""
    for t in tables:
        if t.written_to in _written:
            _delete(t.sparkSession, t.written_to)


def clear(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this process, once no result that reads them is wanted any more."""
    for path in list(_written):
        _delete(spark, path)


def likely(df: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` falls in a bucket that a key of ``asked`` falls in: before a join that keeps the asked rows, so that the others
    aren't shuffled. What is broadcast, and so passes the driver, is a bit for each bucket in words of 64, ``_BUCKETS / 64`` rows at most however many keys are
    asked; with far more keys than buckets all rows pass."""
    bucket, word, bits = fresh(df, "bucket", "word", "bits")
    number = F.pmod(F.xxhash64(key), F.lit(_BUCKETS))
    words = asked.select(number.alias(bucket)).groupBy(F.shiftright(bucket, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bucket} & 63 AS int))")).alias(bits))
    out = df.withColumn(bucket, number).withColumn(word, F.shiftright(bucket, 6)).join(F.broadcast(words), word)
    return out.where(F.expr(f"bit_get({bits}, cast({bucket} & 63 AS int)) = 1")).drop(bucket, word, bits)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
