"""Packing token sequences by best-two-fit.

``tokenise`` cuts each text into pieces of at most ``capacity`` tokens; ``pack`` places pieces in sequences.

Tokens. A text is parted at white space into segments (a run without white space and the one blank before
it, or a run of white space). The tokenizer never joins bytes of two segments, so each distinct segment is
encoded once a task and its ids are looked up; texts with white space outside ASCII are encoded whole.

Packing. Pieces are dealt by a hash of the row to buckets of about ``bucket`` pieces, and a task packs a bucket on its
own: no shuffle but that of (doc, piece, length), no part of the work grows with the input. A bucket loses
one partly filled sequence at most. In a bucket, sequences are built one after the other: fill with the longest
pieces that still fit; then take out the smallest and see whether two unpacked pieces fill the wider gap
more tightly than it did.

Null or empty texts make one piece that holds only the closing token; null ids stay null; repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, fresh
from .text import SPACES, chunks, mix, powers

CAPACITY = 2048
BUCKET = 16_384
#: White space outside ASCII, as the tokenizer's pattern has it.
_WIDE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CACHE_MOST = 1_500_000
_TOGETHER = 512
_BLANKS = b" \t\n\v\f\r"
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts. The segments' ids are kept, up to a bound, for the life of the worker: sorted hashes, and
    for each where its ids begin in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: one letter of the vocabulary is one byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of segments and the number of each one's. Segments go through the tokenizer some hundreds at a time, parted by line
        feeds, which no token shares with a segment; the widths of the tokens tell where each segment ends."""
        words = [k for k, p in enumerate(parts) if p[-1] > 0x20 or p.strip(_BLANKS)]
        texts, lengths = [], []
        for at in range(0, len(words), _TOGETHER):
            own = [parts[k] for k in words[at : at + _TOGETHER]]
            texts.append(b"\n".join(own).decode("utf-8", "replace"))
            lengths.append(np.array([len(p) for p in own], np.int64))
        found: list = [None] * len(parts)
        for at, (text, size, ids) in enumerate(zip(texts, lengths, self.encode(texts), strict=True)):
            ids = np.array(ids, np.uint32)
            ends = np.cumsum(self.width[ids])
            want = np.cumsum(size + 1) - 1  # where each segment ends
            last = np.searchsorted(ends, want)
            if not _WIDE.search(text) and ends[-1] == want[-1] and (ends[last] == want).all() and (ends[last[:-1] + 1] == want[:-1] + 1).all():
                first = np.concatenate([[0], last[:-1] + 2])
                for k, a, b in zip(words[at * _TOGETHER : (at + 1) * _TOGETHER], first.tolist(), (last + 1).tolist(), strict=True):
                    found[k] = ids[a:b]
        alone = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(alone, self.encode([parts[k].decode("utf-8", "replace") for k in alone]), strict=True):
            found[k] = np.array(ids, np.uint32)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Keep the ids of new segments; ``keys`` are sorted."""
        ids, size = self.together(parts)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(ids)

    def known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return there

    def chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and where each text's begin."""
        start, end, of = segments(buf, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start])
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE_MOST:
            self.forget()
        new = np.flatnonzero(~self.known(distinct))
        if len(new):
            data, at = buf.tobytes(), first[new]
            self.learn(distinct[new], [data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        at = np.searchsorted(self.keys, distinct)
        size, begin = self.size[at], self.begin[at]
        n = size[which]
        out = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(out[-1]) + np.repeat(begin[which] - out[:-1], n)
        return self.flat[take], out[of]


def segments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the segments of the texts, and where each text's begin."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = SPACES[buf]
    edge = np.zeros(n + 1, bool)  # a segment begins here
    edge[1:n] = word[1:] != word[:-1]
    edge[offsets] = True
    text = np.zeros(n + 1, bool)
    text[offsets] = True
    # the white space before a word parts from its run; a blank joins the word
    into = np.flatnonzero(edge[1:n] & word[1:] & ~word[:-1] & ~text[1:n]) + 1
    edge[into - 1] = True
    edge[into[buf[into - 1] == 0x20]] = False
    at = np.flatnonzero(edge)
    return at[:-1], at[1:], np.searchsorted(at[:-1], offsets)


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, close: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of whole texts: doc_id, piece, start, length, ids_crc32. The first piece takes what is over."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch.column(1)):
                ids, of = encoder.chunk(buf, offsets)
                rows, piece, start, length, crc = [], [], [], [], []
                data = buf.tobytes()
                for i in range(hi - lo):
                    own = ids[of[i] : of[i + 1]]
                    raw = data[offsets[i] : offsets[i + 1]]
                    if not raw.isascii() and _WIDE.search(whole := raw.decode("utf-8", "replace")):
                        own = np.array(encoder.encode([whole])[0], np.uint32)
                    own = np.append(own, np.uint32(close)).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pieces, and the sequence and offset of each in that order."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    first = np.concatenate([[0], np.cumsum(count)])  # pieces of length x: order[first[x]:first[x + 1]]
    left = count.tolist()
    under = list(range(capacity + 1))  # largest length at most x that may be left

    def fit(x: int) -> int:
        """The largest unpacked length of at most x; 0: none."""
        y = x
        while y and not left[y]:
            y = under[y] if under[y] < y else y - 1
        while x > y:
            after = under[x] if under[x] < x else x - 1
            under[x] = y
            x = max(after, y)
        return y

    bins: list[list[int]] = []
    rest = len(lengths)
    while rest:
        gap, own = capacity, []
        while gap and (x := fit(gap)):
            left[x] -= 1
            own.append(x)
            gap -= x
        if gap and len(own) > 1:
            small = own[-1]
            room, best, pair = gap + small, small, None
            left[small] += 1
            under[small] = small
            for x in range(small + 1, capacity + 1):
                if under[x] >= small:
                    break
                under[x] = small
            a = fit(room - 1)
            while a and 2 * a > best:
                left[a] -= 1
                b = fit(min(room - a, a))
                left[a] += 1
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = fit(a - 1)
            own.pop()
            for x in pair or (small,):
                left[x] -= 1
                own.append(x)
        rest -= len(own)
        bins.append(own)
    taken = first[:-1].tolist()
    index, seq, at = [], [], []
    for k, own in enumerate(bins):
        o = 0
        for x in own:
            index.append(taken[x])
            taken[x] += 1
            seq.append(k)
            at.append(o)
            o += x
    return order[np.array(index, np.int64)] if index else order, np.array(seq, np.int64), np.array(at, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is gapless and holds at most ``capacity``. Rows are dealt to buckets by a row
    number, so equal and null ids spread like any others, and values stay in Arrow, so ids beside a null keep all their digits."""
    row, which = fresh(pieces, "row", "bucket")
    names = pieces.columns
    pieces = cut(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    buckets = max(1, -(-pieces.count() // bucket))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(row)
        order, seq, at = best_two_fit(table.column("length").to_numpy().astype(np.int64), capacity)
        own = table.column(which)[0].as_py()
        return table.select(names).take(pa.array(order)).append_column("sequence_id", pa.array(seq * buckets + own)).append_column("offset", pa.array(at))

    schema = T.StructType([*(f for f in pieces.schema.fields if f.name != row), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = pieces.withColumn(which, F.pmod(F.xxhash64(row), F.lit(buckets)))
    return dealt.groupBy(which).applyInArrow(run, schema)
