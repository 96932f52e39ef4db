"""Benchmark decontamination by FM-indexes over shards of the training texts.

A shard is a chunk of about a megabyte of whole documents inside a task. Its words are coded by the
vocabulary of the benchmark; any other word is a break, and a run of coded words shorter than the shortest
window can't hold one, so only the longer runs enter the index. The index of a shard is the Burrows-Wheeler
transform of those runs in a wavelet matrix with rank counts, plus every eighth suffix position. All windows
are searched backwards at once, one word a step; the ranges left are walked to sampled positions, and the
located windows of a document are merged into removal spans.

No document is shuffled. The benchmark is cut in pieces of at most ``PIECE`` bytes and dealt by hash to blocks of about ``BLOCK_BYTES`` (its size is measured
first). A block's texts are broadcast, which that bounds; workers make its windows. Each block is one more pass over the rows as they stream by, so
the benchmark isn't bounded by memory.

A null text has no words. Benchmark rows without an id count for spans and hits, but not in the list of items. Null ids are kept as they are, repeated rows each get their result, an empty
benchmark hits nothing, an empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, fresh
from .text import ALNUM, LOWER, Words, chunks

WINDOW = 13
SAMPLE = 8
BLOCK_BYTES = 4_000_000
PIECE = 65_536


class Windows:
    """Distinct windows of benchmark pieces as rows of word codes (1..), and the items that hold each. Made in a worker, by array work on the pieces' words."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.vocabulary, self.codes, self.length = np.zeros(0, np.uint64), np.zeros((0, n), np.int64), np.zeros(0, np.int64)
        self.items: list[list[str]] = []
        parts = [(lo, Words(LOWER[buf], off, ALNUM)) for lo, _, buf, off in chunks(pa.array([t for _, t in items], pa.string()))]
        if not parts:
            return
        self.vocabulary = np.unique(np.concatenate([w.hash for _, w in parts]))
        rows, owners = [], []
        for lo, w in parts:
            codes, size = np.searchsorted(self.vocabulary, w.hash) + 1, np.diff(w.of)
            count = np.where(size > 0, np.maximum(1, size - n + 1), 0)  # windows of each piece
            owner = np.repeat(np.arange(len(size)), count)
            begin = w.of[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            long = np.minimum(size[owner], n)
            place = begin[:, None] + np.arange(n) - (n - long)[:, None]  # right-aligned: the search runs backwards
            rows.append(np.where(place >= begin[:, None], np.append(codes, 0)[np.clip(place, 0, len(codes))], 0))
            owners.append(owner + lo)
        self.codes, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.codes > 0).sum(axis=1)
        held = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        of = np.searchsorted(held[:, 0], np.arange(len(self.codes) + 1))
        names = [i for i, _ in items]
        self.items = [sorted({names[k] for k in held[a:b, 1].tolist() if names[k] is not None}) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]


def pieces(benchmark: DataFrame, n: int, size: int) -> DataFrame:
    """item, text: texts of more than ``size`` bytes cut between words into overlapping pieces that hold the same windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offsets in chunks(batch.column(1), 1):  # a text at a time
                item, data = batch.column(0)[lo].as_py(), buf.tobytes()
                w = Words(LOWER[buf], offsets, ALNUM) if len(buf) > size else None
                texts = [data.decode("utf-8", "replace")]
                if w is not None and len(w.start) > n:
                    texts, at = [], 0
                    while at < len(w.start):
                        end = min(max(int(np.searchsorted(w.end, w.start[at] + size)), at + n), len(w.start))
                        texts.append(data[w.start[at] : w.end[end - 1]].decode("utf-8", "replace"))
                        at = len(w.start) if end == len(w.start) else end - n + 1
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return benchmark.mapInArrow(run, "item string, text string")


_made: dict[str, Windows] = {}


def windows_of(key: str, items: list[tuple[str | None, str]], n: int) -> Windows:
    """The windows of a block of the benchmark, made once in each worker; the last one is kept."""
    if key not in _made:
        _made.clear()
        _made[key] = Windows(items, n)
    return _made[key]


class FMIndex:
    """Backward search and locate over a sequence of small integers; 0 is the break. Inside, all are one higher and a
    single 0 ends the sequence, so that every step of a walk is unique."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        seq = np.append(seq + 1, 0)
        n = self.n = len(seq)
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.levels = max(1, int(seq.max()).bit_length())
        counts = np.bincount(seq, minlength=1 << self.levels)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ranks, self.zeros, level = [], [], self.bwt
        for bit in range(self.levels - 1, -1, -1):
            ones = (level >> bit) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        kept = order % sample == 0
        self.sampled, self.position = kept, np.where(kept, order, -1)[kept]
        self.kept_rank = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol is among the first ``at`` of the transform."""
        lo = np.zeros_like(at)
        for k, bit in enumerate(range(self.levels - 1, -1, -1)):
            ones, r = (symbol >> bit) & 1 == 1, self.ranks[k]
            lo = np.where(ones, self.zeros[k] + r[lo], lo - r[lo])
            at = np.where(ones, self.zeros[k] + r[at], at - r[at])
        return at - lo

    def search(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of right-aligned codes: those that occur, and their ranges."""
        live = np.arange(len(codes))
        lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        found = [[], [], []]
        for step in range(codes.shape[1]):
            c = codes[live, codes.shape[1] - 1 - step] + 1
            inside = c < len(self.first) - 1
            live, lo, hi, c = live[inside], lo[inside], hi[inside], c[inside]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            ends = length[live] == step + 1
            for k, x in enumerate((live, lo, hi)):
                found[k].append(x[ends])
            live, lo, hi = live[~ends], lo[~ends], hi[~ends]
            if not len(live):
                break
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.sampled[at[todo]]
            hit = todo[there]
            out[hit] = self.position[self.kept_rank[at[hit]]] + steps[hit]
            todo = todo[~there]
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last element is the only 0."""
    n, k = len(seq), 1
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


def shard_hits(w: Words, windows: Windows) -> Iterator[tuple[int, int, int, int]]:
    """(text, first word, end word, window) of every occurrence in a chunk."""
    if not len(w.hash) or not len(windows.codes):
        return
    voc = windows.vocabulary
    at = np.minimum(np.searchsorted(voc, w.hash), len(voc) - 1)
    codes = np.where(voc[at] == w.hash, at + 1, 0)
    last = np.zeros(len(codes), bool)
    last[w.of[1:][w.of[1:] > w.of[:-1]] - 1] = True
    inside = codes > 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1] & ~last[:-1]]))
    ends = np.flatnonzero(inside & (last | ~np.concatenate([inside[1:], [False]]))) + 1
    long = ends - starts >= windows.length.min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    n = ends - starts + 1  # with a break after each run
    begin = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], n)
    gap = begin[1:] - 1
    place[gap] = 0
    seq = codes[place]
    seq[gap] = 0
    # codes of this shard only, so the wavelet matrix is as deep as the shard needs
    used = np.unique(seq)
    small = np.zeros(len(voc) + 1, np.int64)
    small[used] = np.arange(len(used)) + (used[0] != 0)
    here = np.isin(windows.codes, np.append(used, 0)).all(axis=1)
    rows = np.flatnonzero(here)
    if not len(rows):
        return
    index = FMIndex(small[seq])
    which, lo, hi = index.search(small[windows.codes[rows]], windows.length[rows])
    n = hi - lo
    total = np.concatenate([[0], np.cumsum(n)])
    positions = index.locate(np.arange(total[-1]) + np.repeat(lo - total[:-1], n))
    window = rows[np.repeat(which, n)]
    word = place[positions]
    doc = np.searchsorted(w.of, word, "right") - 1
    yield from zip(doc.tolist(), (word - w.of[doc]).tolist(), (word - w.of[doc] + windows.length[window]).tolist(), window.tolist(), strict=True)


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def hits(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str] = ("n_words", "spans", "items"), text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with three more columns: the number of words, the merged word ranges that windows cover, and the ids of the
    items that occur, as sorted strings."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    bench = cut(pieces(bench, window, min(PIECE, block_bytes)), "benchmark")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    at = docs.columns.index(text_col)
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), F.expr("cast(array() as array<struct<first: int, end: int>>)").alias(names[1]), F.expr("cast(array() as array<string>)").alias(names[2]))
    sc = docs.sparkSession.sparkContext
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        sent = sc.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = windows_of(*sent.value, window)
            for batch in batches:
                for lo, hi, buf, offsets in chunks(batch.column(at)):
                    w = Words(LOWER[buf], offsets, ALNUM)
                    spans: dict[int, list] = {}
                    items: dict[int, set] = {}
                    for d, a, b, k in shard_hits(w, windows):
                        spans.setdefault(d, []).append((a, b))
                        items.setdefault(d, set()).update(windows.items[k])
                    rows = batch.slice(lo, hi - lo)
                    before, named = rows.columns[-2:]
                    if spans:
                        s, i = before.to_pylist(), named.to_pylist()
                        for d, own in spans.items():
                            s[d] = [{"first": a, "end": b} for a, b in merge([*own, *((x["first"], x["end"]) for x in s[d])])]
                            i[d] = sorted({*i[d], *items[d]})
                        before, named = pa.array(s, _SPANS), pa.array(i, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-3], pa.array(np.diff(w.of), pa.int64()), before, named], names=rows.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return (
        found.select("doc_id", "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "spans", "items")
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    )


def covered(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["first"]))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated; the same columns."""
    names = tuple(fresh(docs, "n_words", "spans", "items"))
    found = hits(docs, benchmark, names).withColumn(names[1], covered(names[1]))
    return found.where((F.col(names[1]) == 0) | (20 * F.col(names[1]) < F.col(names[0]))).select(*docs.columns)
