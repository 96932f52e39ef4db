"""Removal of long word passages that occur more than once in the corpus.

A window is ``n`` consecutive words of a text; each word covered by a window whose words also start somewhere else goes.

1. Confirm. A task hashes the words of whole texts. Each window is represented by its least ``GRAM``-word
   phrase (equal windows pick the same one), so one phrase in about fourteen words stands for all windows. Phrases
   are counted over the corpus (pre-aggregated); windows under a phrase that occurs once can't recur. Those left are hashed in full and
   counted in the same way, with their first and their last place. A window that is there twice may recur: each of its places is told another one, and runs of
   windows that are told running places of one text are a passage. Its words are read *there*. Equal texts are one text from the start; if there are several, all of
   their windows recur.
2. Compile. Texts are dealt by hash into shards of about ``SHARD_BYTES``. The passages that a shard may hold, each once, make one
   Aho-Corasick automaton over the words themselves, so its size follows the shard, not the corpus.
3. Stream. Every text of the shard runs through the automaton, which locates every occurrence, word for word. A match counts unless it is the very place that
   the passage was read from. So hashes only propose: where words differ, nothing is found.

Texts without a phrase that occurs twice can hold no passage and are done after step 1. Null texts have no words; null and repeated ids keep their rows; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, discard, likely
from .text import SPACES, Words, chunks

WINDOW = 35
GRAM = 8
SHARD_BYTES = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(w: Words, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that one phrase stands for: text, first window (word of the chunk), number, phrase hash."""
    at, h = w.windows(gram)
    wide = n - gram + 1
    starts, _ = w.windows(n)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    bits = max(24, int(len(w.hash)).bit_length())
    key = np.full(len(w.hash), np.iinfo(np.uint64).max, np.uint64)
    key[at] = h >> np.uint64(bits) << np.uint64(bits) | at.astype(np.uint64)
    low, step = key, 1  # least over the next ``wide`` phrases, by doubling
    while 2 * step <= wide:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    m = np.minimum(low[starts], low[starts + wide - step])
    where = (m & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    index = np.searchsorted(at, where[first])
    begin = starts[first]
    return np.searchsorted(w.of, begin, "right") - 1, begin, count, h[index]


def profiles(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """doc_id, text_key, n_words, whole_sha256, phrases (hash, first window, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch.column(1)):
                w = Words(buf, offsets, SPACES)
                doc, first, count, h = anchors(w, n, gram)
                data = buf.tobytes()
                sha = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                of = np.searchsorted(doc, np.arange(hi - lo + 1))
                flat = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array((first - w.of[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["hash", "first", "count"])
                phrases = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(w.of), pa.int64()), pa.array(sha), phrases], names=["doc_id", "text_key", "n_words", "whole_sha256", "phrases"])

    return docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_key")).mapInArrow(run, "doc_id long, text_key string, n_words long, whole_sha256 string, phrases array<struct<hash: long, first: int, count: int>>")


def window_hashes(texts: DataFrame, n: int) -> DataFrame:
    """hash, node, first, single: of the windows that ``runs`` (first, count) of a text names; single: the text is there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch.column(1)):
                w = Words(buf, offsets, SPACES)
                at, h = w.windows(n)
                of = np.searchsorted(at, w.of)
                out: list[tuple] = []
                for d, runs in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                    begin = of[d]
                    for r in runs:
                        a = begin + r["first"]
                        out.append((d, a, a + r["count"]))
                if not out:
                    continue
                doc, a, b = np.array(out, np.int64).T
                size = b - a
                total = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(total[-1]) + np.repeat(a - total[:-1], size)
                doc = np.repeat(doc, size)
                yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), batch.column(0).take(pa.array(lo + doc)), pa.array((at[take] - w.of[doc]).astype(np.int32)), batch.column(3).take(pa.array(lo + doc))], names=["hash", "node", "first", "single"])

    return texts.select("node", "text", "runs", (F.col("copies") == 1).alias("single")).mapInArrow(run, "hash long, node long, first int, single boolean")


def told_places(hashes: DataFrame) -> DataFrame:
    """node, first, src, src_first: for each recurring window of a text that is there once, another place of it."""
    place = F.struct("node", "first")
    often = hashes.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("n > 1")
    # counts are written before they are joined: then both sides are plain tables, and a hot hash's rows can be split
    often = cut(often.select("hash", "lo", "hi"), "windows")
    other = F.when(place == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return hashes.where("single").join(often, "hash").select("node", "first", other.alias("o")).select("node", "first", F.col("o.node").alias("src"), F.col("o.first").alias("src_first"))


def runs_of(places: DataFrame) -> DataFrame:
    """node, src, src_first, size: runs of windows that are told running places. A text's rows lie together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            node, first, src, at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            go = (node[1:] == node[:-1]) & (first[1:] == first[:-1] + 1) & (src[1:] == src[:-1]) & (at[1:] == at[:-1] + 1)
            new = np.flatnonzero(np.concatenate([[True], ~go]))
            size = np.diff(np.append(new, len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(src[new]), pa.array(at[new]), pa.array(size.astype(np.int32))], names=["node", "src", "src_first", "size"])

    return places.repartition("node").sortWithinPartitions("node", "first").mapInArrow(run, "node long, src long, src_first int, size int")


def passages(runs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """src, src_first, size, words: the words of each distinct run, read from its source."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                rows = [(src, r["src_first"], r["size"], b" ".join(words[r["src_first"] : r["src_first"] + r["size"] + n - 1])) for r in asked]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["src", "src_first", "size", "words"])

    asked = runs.groupBy("src").agg(F.collect_set(F.struct("src_first", "size")).alias("asked"))
    return asked.join(texts.select(F.col("node").alias("src"), "text"), "src").select("src", "text", "asked").mapInArrow(read, "src long, src_first int, size int, words binary")


def located(texts: DataFrame, routed: DataFrame) -> DataFrame:
    """node, n_removed, kept_sha256, spans, by one automaton for each shard. ``texts``: shard, node, text; ``routed``: shard, src, src_first, words."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    shape = pa.schema([("node", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)])

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        import ahocorasick

        codes: dict[bytes, int] = {}
        code = lambda words: tuple([codes.setdefault(w, len(codes) + 1) for w in words])
        sources: dict[tuple, list[tuple[int, int]]] = {}
        for src, first, words in zip(*(known.column(c).to_pylist() for c in ("src", "src_first", "words")), strict=True):
            sources.setdefault(code(words.split()), []).append((src, first))
        if not sources:
            return shape.empty_table()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, places in sources.items():
            automaton.add_word(p, (len(p), places[0] if len(places) == 1 else None))  # words read from two places are always from another one
        automaton.make_automaton()
        out = []
        for node, text in zip(own.column("node").to_pylist(), own.column("text").to_pylist(), strict=True):
            words = text.encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for end, (length, source) in automaton.iter(code(words)):
                at = end + 1 - length
                if source != (node, at):
                    edge[at] += 1
                    edge[end + 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept = hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()
            out.append({"node": node, "n_removed": int(gone.sum()), "kept_sha256": kept, "spans": [{"first": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]})
        return pa.Table.from_pylist(out, shape)

    return texts.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(run, "node long, n_removed long, kept_sha256 string, spans array<struct<first: int, end: int>>")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (word ranges removed)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(profiles(docs, window, gram), "profiles")
    keys = rows.where(F.col("n_words") >= window).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("phrases").alias("phrases"))
    keys = cut(keys.select(F.monotonically_increasing_id().alias("node"), "*"), "texts")
    phrases = keys.select("node", F.explode("phrases").alias("p")).select("node", "p.*")
    # counts are written before they are joined: then both sides are plain tables, and a hot hash's rows can be split
    often = cut(phrases.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "phrases")
    runs = phrases.join(often, "hash").groupBy("node").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    runs = cut(runs.join(keys.select("node", "text_key", "copies"), "node"), "runs")
    # one text of each key; copies meet before the shuffle, and texts that nobody asks for stay where they are
    texts = likely(docs.where("text is not null").withColumn("text_key", F.md5("text")), "text_key", runs).groupBy("text_key").agg(F.first("text").alias("text"))
    texts = cut(runs.join(texts, "text_key").select("node", "copies", "text", "runs"), "candidates")
    hashes = cut(window_hashes(texts, window), "hashes")
    pieces = runs_of(told_places(hashes))
    total = texts.where("copies = 1").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-total // SHARD_BYTES))))
    pieces = cut(pieces.withColumn("shard", shard), "routes")
    discard(hashes)
    read = cut(passages(pieces, texts, window), "passages")
    routed = pieces.select("shard", "src", "src_first", "size").distinct().join(read, ["src", "src_first", "size"]).select("shard", "src", "src_first", "words")
    some = texts.where("copies = 1").join(pieces.select("node").distinct(), "node", "left_semi").select(shard.alias("shard"), "node", "text")
    found = located(some, routed)
    found = cut(keys.select("node", "text_key", "copies").join(found, "node", "left").where("copies > 1 or n_removed > 0").drop("node"), "found")
    whole = F.col("copies") > 1
    out = rows.select("doc_id", "text_key", "n_words", "whole_sha256").join(found, "text_key", "left")
    none = F.expr("cast(array() as array<struct<first: int, end: int>>)")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
