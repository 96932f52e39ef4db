"""Redact for a destination: requests with a text and a URL, decided, blocked or redacted, with vault and audit as sinks.

One decision table parts the requests: blocked ones leave no text, only an audit row; the others are scanned (findings of low severity are left out), redacted under their session's vault, and audited. The
audit holds metadata only. ``write`` writes everything of a batch under the batch's number, so a batch that comes again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, findings, policy
from ..sources.scratch import settle
from .transform import prepared, redact

AUDIT = ("request_id", "action", "reason", "origin", "n_findings", "finding_types")


class Served(NamedTuple):
    """``texts``: request_id, session_id, redacted, n_replaced of allowed requests; ``vault``: what their sessions hold now; ``audit``: a row a request."""

    texts: DataFrame
    vault: DataFrame
    audit: DataFrame


def serve(requests: DataFrame, destinations: DataFrame, approved: DataFrame, blocked: DataFrame, known: DataFrame | None = None, mode: str = "hide_public", enterprise: bool = True, strict_failure: bool = False, **scan) -> Served:
    """``requests``: request_id (of its own for each row), session_id, url, text. ``known``: the vault of earlier batches."""
    decided = settle(policy.decide(requests, destinations, approved, blocked, enterprise, strict_failure).select("request_id", "blocked", F.coalesce("reason", F.lit("redacted")).alias("reason")), "decisions")
    open_ = requests.join(decided.where("NOT blocked").select("request_id"), "request_id")
    rows = prepared(open_.select(F.col("request_id").alias("doc_id"), "session_id", F.col("request_id").alias("seq"), "text"))
    found = settle(findings.scan(rows, keep=("row",), text_col="current", **scan).where("severity <> 'low'").select("row", "source", "type", "start", "end", "raw"), "findings")
    texts, vault = redact(rows, found, mode, known)
    said = found.join(rows.select("row", F.col("doc_id").alias("request_id")), "row").groupBy("request_id").agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_set(audit.finding_type(F.col("type")))).alias("finding_types"))
    log = decided.join(requests.select("request_id", policy.url_parts()["origin"].alias("origin")), "request_id").join(said, "request_id", "left")
    none = F.array().cast("array<string>")
    log = log.select("request_id", F.when(F.col("blocked"), "blocked").otherwise("redacted").alias("action"), F.when(F.col("blocked"), F.col("reason")).otherwise("redacted").alias("reason"), "origin", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.coalesce("finding_types", none).alias("finding_types"))
    return Served(texts.select(F.col("doc_id").alias("request_id"), "session_id", "redacted", "n_replaced"), vault, log)


def write(served: Served, folder: str, batch: int) -> None:
    """Texts, vault and audit of a batch, each under its number."""
    for name, df in served._asdict().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def serving(folder: str, destinations: DataFrame, approved: DataFrame, blocked: DataFrame, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch goes on with the vault that the batches before it left."""

    def run(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/vault")
        known = None
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            earlier = spark.read.parquet(f"{folder}/vault").where(F.col("batch") < batch)
            newest = earlier.agg(F.max("batch")).first()[0]
            known = None if newest is None else settle(earlier.where(F.col("batch") == newest).drop("batch"), "known")
        write(serve(settle(requests, "requests"), destinations, approved, blocked, known, **options), folder, batch)

    return run
