"""Placeholders of a session across micro-batches: state that numbers new values and keeps old ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, doc_id long, start int, raw_sha256 string, placeholder string"


def numbered(findings: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """session_id, doc_id, start, raw_sha256, placeholder of a stream of findings (session_id, doc_id, start, raw and, if there, visible: the highest number of a token that stands in the text).

    New numbers start behind all visible ones that were seen. The state of a session maps hashes of values to numbers, no raw values; it is freed after ``idle_ms`` without input. Rows of a
    batch are taken by (doc_id, start), so numbers equal the batch operator's as long as input comes in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["doc_id", "start"], kind="stable")
        last = max(last, int(rows["visible"].max()))
        rows = rows[rows["raw"].notna()]
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in rows["raw"]]
        for h in hashes:
            if h not in known:
                last += 1
                known[h] = last
        state.update((json.dumps(known), last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": key[0], "doc_id": rows["doc_id"].to_numpy(), "start": rows["start"].to_numpy(), "raw_sha256": hashes, "placeholder": [f"[PWM_{known[h]}]" for h in hashes]})

    visible = F.coalesce(F.col("visible").cast("long"), F.lit(0)) if "visible" in findings.columns else F.lit(0).cast("long")
    return findings.select("session_id", "doc_id", "start", "raw", visible.alias("visible")).groupBy("session_id").applyInPandasWithState(step, OUT, "known string, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_text(edits: DataFrame, quiet: str = "1 second") -> DataFrame:
    """The last text of each composer once nothing came for a while: a session window closed by the watermark."""
    return edits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", quiet).groupBy(F.session_window("ts", quiet), "session_id").agg(F.max_by("text", "ts").alias("text")).select("session_id", "text")


def redacting(redact: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: any batch redaction, written once for each batch number."""

    def write(batch: DataFrame, number: int) -> None:
        redact(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
