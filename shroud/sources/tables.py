"""Text tables, labelled records and policies in; redacted text, reports, vault and audit rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = "doc_id long, session_id string, seq long, url string, text string"
RECORDS = "text string, label string, category string, action string, layer_hint string, source string, source_type string, provider string, difficulty string, sanitized boolean, reason string"
LABELS = ("SECRET", "NOT_SECRET", "UNSURE")


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows with text that isn't blank, by a fixed schema."""
    reader = spark.read.schema(TEXTS).format(fmt)
    reader = reader.option("header", "true") if fmt == "csv" else reader
    return not_blank(reader.load(path))


def not_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.coalesce(F.col(text), F.lit("")).rlike(r"[^\s\u00a0]"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSON lines; a bad line is an error."""
    return normal_records(spark.read.schema(RECORDS).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path")))


def normal_records(records: DataFrame) -> DataFrame:
    """Trimmed text, upper-case known labels, category and source type filled in."""
    out = records.withColumn("text", F.trim("text")).withColumn("label", F.upper(F.trim("label")))
    out = out.where((F.col("text") != "") & F.col("label").isin(*LABELS))
    guess = F.when(F.col("text").rlike(r"(?i)^[^\s@]+@[^\s@]+\.[a-z]{2,}$"), "email").when(F.col("label") == "SECRET", "secret").otherwise("normal_text_safe")
    return out.withColumn("category", F.coalesce("category", guess)).withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))


def write_redacted(redacted: DataFrame, path: str) -> None:
    """Only the redacted text and its key."""
    redacted.select("doc_id", "session_id", F.col("redacted").alias("text")).write.mode("overwrite").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def append_audit(events: DataFrame, path: str, mode: str = "on") -> None:
    """Appends unless auditing is off."""
    if mode != "off":
        events.write.mode("append").parquet(path)


def write_vault(vault: DataFrame, path: str) -> None:
    """Replaces the sessions that are written; all others stay."""
    vault.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """A vault of any age: what older ones lack gets a default."""
    v = spark.read.parquet(path)
    fill = {"family": F.lit("PWM"), "index": F.regexp_extract("placeholder", r"_(\d+)", 1).cast("long")}
    return v.withColumns({k: c for k, c in fill.items() if k not in v.columns})
