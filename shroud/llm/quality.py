"""Quality classifier: naive Bayes support vectors.

Features of a text are the presence of n-grams, hashed to ``BUCKETS`` buckets: words and word pairs, runs of
four bytes with every letter folded to its case, and runs of "same word as before" marks (repetition). Each
indicator is scaled by the log ratio of its rates in the two classes, and a linear hinge-loss model is fitted on
the scaled indicators by dual coordinate descent. Margins become scores by a logistic curve fitted on the same rows.

The model is fitted on a bounded sample: at most about ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of text, taken by a hash of the id
among all rows that may be learned from. The sample's ids are few enough to broadcast (the bound is that
parameter), so no text is shuffled; the sampled texts are written, measured and, if they are more than the bound, thinned by the hash again. What goes to
the driver is their buckets, at most about six bytes for each byte of text. Scoring is one pass over the table in tasks.

Null texts count as empty. Without labels of both classes every text scores the rate of label 1, or 0.5. Null or
repeated ids, empty tables and other columns do no harm: one result for each row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, fresh
from .text import SPACES, Words, chunks, mix, windows

BUCKETS = 1 << 18
SAMPLE = 20_000
SAMPLE_BYTES = 64_000_000
_MASK = np.uint64(BUCKETS - 1)
#: Letters fold to a or A, bytes above ASCII to a, digits to 0, white space to blank.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:], _SHAPE[0x30:0x3A] = 0x41, 0x61, 0x61, 0x30
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 0x20


def indicators(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every distinct n-gram of the texts, by text."""
    w = Words(buf, offsets, SPACES)
    doc = w.doc()
    keys = [(doc, w.hash)]
    at, pair = w.windows(2)
    keys.append((doc[at], pair))
    shape = _SHAPE[buf].astype(np.uint64)
    if len(buf) >= 4:
        grams = shape[:-3] << np.uint64(24) | shape[1:-2] << np.uint64(16) | shape[2:-1] << np.uint64(8) | shape[3:]
        fresh = np.concatenate([[True], grams[1:] != grams[:-1]])  # runs within words repeat themselves
        ends = np.repeat(offsets[1:], np.diff(offsets))
        ok = np.flatnonzero(fresh & (np.arange(len(grams)) + 4 <= ends[: len(grams)]))
        keys.append((np.searchsorted(offsets, ok, "right") - 1, mix(grams[ok] ^ np.uint64(0xA5A5 << 40))))
    if len(at):
        same = (w.hash[at] == w.hash[at + 1]).astype(np.uint64) + np.uint64(7)
        for n in (1, 3):
            pos, h = windows(same, np.searchsorted(at, w.of), n)
            keys.append((doc[at[pos]], h))
    flat = np.unique(np.concatenate([d.astype(np.uint64) << np.uint64(18) | (h & _MASK) for d, h in keys]))
    return (flat >> np.uint64(18)).astype(np.int64), (flat & _MASK).astype(np.int64)


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratios of the rates of the indicators in the two classes."""
    counts = np.full((2, BUCKETS), smooth)
    for r, label in zip(rows, y, strict=True):
        counts[label, r] += 1  # the buckets of a row are distinct
    rates = counts / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 2 * smooth)
    return np.log(rates[1] / rates[0])


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 0.02, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss with an l2 penalty; each class counts alike. Returns weights on plain indicators, and the bias."""
    sign = np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, cost * len(y) / (2 * max(1, (y == 1).sum())), cost * len(y) / (2 * max(1, (y == 0).sum())))
    norm = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, s = rows[i], sign[i]
            x = scale[r]
            gradient = s * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[r] += step * x
                bias += step
                alpha[i] = new
    return w * scale, bias


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, y), each class counting alike."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    target = np.where(y == 1, 0.995, 0.005)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb, haa, hab, hbb = (g * margin).sum(), g.sum(), (h * margin**2).sum() + 1e-9, (h * margin).sum(), h.sum() + 1e-9
        det = haa * hbb - hab**2
        if det <= 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-7:
            break
    return (a, b) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


class Model:
    """Weights of the buckets; without them a constant."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, shift: float, constant: float = 0.5):
        self.weights, self.bias, self.slope, self.shift, self.constant = weights, bias, slope, shift, constant

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.weights is None:
            return np.full(n, self.constant)
        doc, bucket = indicators(buf, offsets)
        margin = np.bincount(doc, self.weights[bucket], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learnable: str = "pmod(crc32(cast(doc_id as string)), 3) <> 1", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows; ``learnable`` says in SQL, from doc_id, which."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(learnable)
    count = known.count()
    if count > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / count))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch.column(2)):
                doc, bucket = indicators(buf, offsets)
                of = np.searchsorted(doc, np.arange(hi - lo + 1))
                found = [bucket[of[i] : of[i + 1]].astype("<i4").tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(found, pa.binary())], names=["doc_id", "y", "buckets"])

    some = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text"), "sample")
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > sample_bytes:
        some = some.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1_000_000)) < int(1_000_000 * sample_bytes / total))
    rows = some.mapInArrow(run, "doc_id long, y int, buckets binary").collect()
    rows.sort(key=lambda r: (r.doc_id, len(r.buckets), zlib.crc32(r.buckets)))
    x, y = [np.frombuffer(r.buckets, "<i4") for r in rows], np.array([r.y for r in rows], np.int64)
    if not 0 < y.sum() < len(y):
        return Model(None, 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    scale = ratios(x, y)
    weights, bias = dual_descent(x, scale, y)
    margin = np.array([weights[r].sum() + bias for r in x])
    return Model(weights.astype(np.float32), bias, *platt(margin, y))


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns, the score and the predicted label; every column it has is kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch.column(at)):
                s = sent.value.score(buf, offsets)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*rows.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model, fitted on the labelled ones, doesn't reject; the same columns."""
    names = tuple(fresh(docs, "score", "predicted"))
    return score(docs, fit(docs, labels), names).where(F.col(names[1]) == 1).select(*docs.columns)
