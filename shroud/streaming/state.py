"""Streams with state and timers of their own: debounced texts, pauses that end by themselves, texts that arrive in pieces.

State is typed, small and kept for each key; it survives a restart from the checkpoint. Timers go by the stream's own time (its watermark), so results don't depend on when batches run. Rows of one key
and batch are taken in a stated order, so results equal the batch operators' as long as input comes in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .chunks import OVERLAP

#: Time without edits after which a text counts as finished, in milliseconds.
QUIET = 220


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _wake(state: GroupState, ms: int) -> None:
    """A timer at this time of the stream, or as soon as it goes on where that time is past."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def debounced(edits: DataFrame, quiet_ms: int = QUIET, late: str = "0 seconds") -> DataFrame:
    """session_id, ts_ms, text: the last text of each composer (session_id, ts, text) once ``quiet_ms`` of the stream's time have gone by without another edit of it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ms, text = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "ts_ms": [ms], "text": [text]})
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ms", kind="stable")
        ms, text = int(rows["ms"].iloc[-1]), rows["text"].iloc[-1]
        if not state.exists or ms >= state.get[0]:
            state.update((ms, text))
        _wake(state, state.get[0] + quiet_ms)

    rows = _timed(edits, late).select("session_id", "ts", F.unix_millis("ts").alias("ms"), "text")
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, ts_ms long, text string", "ms long, text string", "append", GroupStateTimeout.EventTimeTimeout)


def pauses(requests: DataFrame, most_minutes: int = 60, late: str = "0 seconds") -> DataFrame:
    """session_id, state (paused, resumed, expired), ms of requests (session_id, ts, minutes): a pause is cut to ``most_minutes``, a later request replaces an earlier one, zero ends it,
    and one that nobody ends expires when the stream's time passes it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], "expired", state.get[0]))
            state.remove()
        else:
            until = 0
            for ms, minutes in pd.concat(list(batches), ignore_index=True).sort_values("ms", kind="stable")[["ms", "minutes"]].itertuples(index=False):
                until = int(ms) + min(most_minutes, max(0, int(minutes))) * 60_000
                out.append((key[0], "paused" if until > ms else "resumed", until))
            if out[-1][1] == "paused":
                state.update((until,))
                _wake(state, until)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["session_id", "state", "ms"])

    rows = _timed(requests, late).select("session_id", "ts", F.unix_millis("ts").alias("ms"), F.col("minutes").cast("long").alias("minutes"))
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, state string, ms long", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def stable(buffer: str, overlap: int) -> int:
    """How much of a buffer may be handed on: all but the overlap, and nothing from a private key that isn't closed yet."""
    cut = max(0, len(buffer) - overlap)
    begin = buffer.rfind("-----BEGIN")
    if begin >= 0 and not re.search("-----END", buffer[begin:]):
        cut = min(cut, begin)
    return cut


def pieces(chunks: DataFrame, overlap: int = OVERLAP, most: int = 2 << 20) -> DataFrame:
    """stream_id, at, own, text_at, text of texts that arrive as chunks (stream_id, chunk_no, chunk, last) over any number of batches, early ones included: each piece has ``overlap``
    characters of context on both sides and owns what begins in its ``own`` ones (``chunks.owned``). An unclosed private key is held back, up to ``most`` characters."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, at, before, buffer, waiting = state.get if state.exists else (0, 0, "", "", "{}")
        came = {int(n): c for n, c in json.loads(waiting).items()}
        came |= {int(n): [c, bool(e)] for n, c, e in pd.concat(list(batches), ignore_index=True)[["chunk_no", "chunk", "last"]].itertuples(index=False)}
        out, ended = [], False
        while not ended and number in came:
            chunk, ended = came.pop(number)
            buffer, number = buffer + chunk, number + 1
            cut = len(buffer) if ended else stable(buffer, overlap)
            if not ended and len(buffer) > most:
                cut = max(cut, len(buffer) - overlap)  # a key that is never closed isn't held for ever
            if cut or ended:
                out.append((key[0], at, cut, at - len(before), before + buffer))
                before, at, buffer = (before + buffer[:cut])[-overlap:], at + cut, buffer[cut:]
        if ended:
            state.remove()
        else:
            state.update((number, at, before, buffer, json.dumps(came)))
        yield pd.DataFrame(out, columns=["stream_id", "at", "own", "text_at", "text"]).astype({"at": "int64", "own": "int64", "text_at": "int64"})

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("chunk_no").cast("int").alias("chunk_no"), "chunk", F.coalesce(F.col("last"), F.lit(False)).alias("last"))
    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, at long, own long, text_at long, text string", "next int, at long, before string, buffer string, waiting string", "append", GroupStateTimeout.NoTimeout)
