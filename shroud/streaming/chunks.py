"""Long texts that come in chunks: findings that cross a border are found once, by the chunk that they begin in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAP = 16 * 1024
MOST_BUFFER = 2 << 20
LARGEST = 50 << 20


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """stream_id, chunk_no, at, chunk: texts cut into pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    each = docs.select("stream_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return each.select("stream_id", "chunk_no", (F.col("chunk_no") * size).alias("at"), F.substr("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def with_overlap(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Each chunk with the end of the chunk before it and the head of the next ones, as ``text`` and its place in the stream."""
    order = Window.partitionBy("stream_id").orderBy("chunk_no")
    before = F.right(F.coalesce(F.lag("chunk").over(order), F.lit("")), F.lit(overlap))
    after = F.left(F.concat(*(F.coalesce(F.lead("chunk", k).over(order), F.lit("")) for k in (1, 2))), F.lit(overlap))
    return chunks.select("stream_id", "chunk_no", "at", F.length("chunk").alias("own"), (F.col("at") - F.length(before)).alias("text_at"), F.concat(before, "chunk", after).alias("text"))


def owned(found: DataFrame) -> DataFrame:
    """Findings at their place in the stream, kept only by the chunk that they begin in. ``found``: with_overlap's columns, start, end."""
    start = F.col("text_at") + F.col("start")
    return found.withColumn("start", start).withColumn("end", F.col("text_at") + F.col("end")).where((F.col("start") >= F.col("at")) & (F.col("start") < F.col("at") + F.col("own")))


def stable_length(buffer: Column, overlap: int = OVERLAP) -> Column:
    """How much of a buffer may be flushed: all but the overlap, and nothing from a private key that isn't closed yet."""
    cut = F.greatest(F.lit(0), F.length(buffer) - overlap)
    begin = F.length(buffer) - F.length(F.element_at(F.split(buffer, "-----BEGIN", -1), -1)) - F.length(F.lit("-----BEGIN"))
    is_open = F.contains(buffer, F.lit("-----BEGIN")) & ~F.contains(F.element_at(F.split(buffer, "-----BEGIN", -1), -1), F.lit("-----END"))
    return F.when(is_open, F.least(cut, begin)).otherwise(cut)


def stream_status(sizes: DataFrame) -> DataFrame:
    """Verdict of each stream by its size and its largest piece without a safe place."""
    s = sizes.groupBy("stream_id").agg(F.sum(F.length("chunk")).alias("size"), F.max(F.length("chunk")).alias("largest"))
    return s.withColumn("status", F.when(F.col("size") > LARGEST, "blocked").when(F.col("largest") > MOST_BUFFER, "failed").otherwise("ok"))
