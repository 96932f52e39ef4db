"""Token ids of whole texts in shard files that are wavelet matrices.

``write`` encodes documents in ascending ``doc_id`` order and writes one file for each shard of about ``SHARD`` ids. A shard file holds the ids only as a wavelet matrix: a plane of bits for each
binary digit of the ids, highest first, each plane in the order of a stable partition by the planes above it, with a count of ones ahead of every 512 bits. Any id, the count of an id in
a range, and the places of an id come from the planes by rank and select, without decoding the shard.

Ids are about half as large there as 32-bit integers, with 1/16 on top for the counts; the container (Parquet, one row a file, zstd) takes the rest of the redundancy. Documents are not split
between shards, so a shard is at most as long as ``SHARD`` ids and one chunk of a megabyte of text, or one longer document.

Texts are dealt by ranges of ``doc_id``, so a part's shards follow on those of the part before; where each shard begins is a running sum over shard sizes, in groups of parts. A null text is
empty: it has the end id alone. Rows without an id come first, in the order of their texts; repeated ids are ordered by text and are documents of their own. Other columns are
ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .packing import Encoder
from .text import SPACES, Words, chunks

SHARD = 1 << 22
#: Bytes of text for each range of documents.
PART_BYTES = 128 << 20
MAGIC = b"TWM1"
_BLOCK = 512
_CACHE_MOST = 1_500_000
_TOGETHER = 512


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(Encoder):
    """Ids of texts by a tokenizer that drops white space and joins nothing across it: each distinct run without ASCII white space is encoded once a task and looked up later.
    New runs go through it some hundreds at a time, with one of its special tokens between them, which parts a text exactly."""

    def __init__(self, path: str):
        super().__init__(path)
        special = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special]
        self.mark, self.mark_text = special[0] if special else (-1, "")

    def together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        runs = [p.decode("utf-8", "replace") for p in parts]
        found: list[np.ndarray] = []
        blocks = [runs[at : at + _TOGETHER] for at in range(0, len(runs), _TOGETHER)]
        joined = self.encode([self.mark_text.join(b) for b in blocks]) if self.mark >= 0 else [[]] * len(blocks)
        for block, ids in zip(blocks, joined, strict=True):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if self.mark >= 0 and len(at) == len(block) - 1:
                edges = np.concatenate([[-1], at, [len(ids)]])
                found += [ids[a + 1 : b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            else:  # a run spells the special token
                found += [np.array(x, np.uint32) for x in self.encode(block)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = Words(buf, offsets, SPACES)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE_MOST:
            self.forget()
        new = np.flatnonzero(~self.known(distinct))
        if len(new):
            data, at = buf.tobytes(), first[new]
            self.learn(distinct[new], [data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        at = np.searchsorted(self.keys, distinct)
        n = self.size[at][which]
        out = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(out[-1]) + np.repeat(self.begin[at][which] - out[:-1], n)
        return self.flat[take], out[words.of]


class Plane:
    """Bits with rank and select. ``bits``: packed, least significant first, in whole blocks; ``ones[b]``: ones before block ``b``."""

    def __init__(self, bits: np.ndarray, ones: np.ndarray, n: int):
        self.bits, self.ones, self.n = bits, ones, n
        self.words = bits.view("<u8")

    @classmethod
    def of(cls, flags: np.ndarray) -> Plane:
        n, blocks = len(flags), len(flags) // _BLOCK + 1
        bits = np.zeros(blocks * _BLOCK // 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        bits[: len(packed)] = packed
        each = np.bitwise_count(bits.view("<u8")).reshape(blocks, -1).sum(axis=1)
        return cls(bits, np.concatenate([[0], np.cumsum(each)[:-1]]).astype("<u4"), n)

    def flags(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        out = self.ones[at // _BLOCK].astype(np.int64)
        first = at // _BLOCK * (_BLOCK // 64)
        word = at >> 6
        for k in range(_BLOCK // 64 - 1):
            out += np.where(first + k < word, np.bitwise_count(self.words[first + k]), 0)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones (or zeros), from 0."""
        before = self.ones.astype(np.int64) if one else np.arange(len(self.ones)) * _BLOCK - self.ones
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 8192):
            own = k[at : at + 8192]
            block = np.searchsorted(before, own, "right") - 1
            bits = np.unpackbits(self.bits.reshape(-1, _BLOCK // 8)[block], axis=1, bitorder="little")
            seen = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int32)
            out[at : at + 8192] = block * _BLOCK + np.argmax(seen == (own - before[block] + 1)[:, None], axis=1)
        return out


class Matrix:
    """A wavelet matrix: ``planes`` from the highest digit on, ``zeros[l]``: how many ids have a zero there."""

    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n
        self.zeros = [n - int(p.rank(np.array([n]))[0]) for p in planes]

    @classmethod
    def of(cls, ids: np.ndarray) -> Matrix:
        planes, left = [], ids.astype(np.uint32)
        for digit in range(max(1, int(ids.max()).bit_length() if len(ids) else 1) - 1, -1, -1):
            flags = (left >> np.uint32(digit)) & np.uint32(1) == 1
            planes.append(Plane.of(flags))
            left = np.concatenate([left[~flags], left[flags]])
        return cls(planes, len(ids))

    def _digit(self, token: int, level: int) -> bool:
        return bool(token >> (len(self.planes) - 1 - level) & 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, rank = plane.get(at), plane.rank(at)
            out = (out << np.uint32(1)) | one
            at = np.where(one, zeros + rank, at - rank)
        return out

    def _leaf(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        ends = np.array([a, b], np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            rank = plane.rank(ends)
            ends = zeros + rank if self._digit(token, level) else ends - rank
        return int(ends[0]), int(ends[1])

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often the id stands in places a to b."""
        first, end = self._leaf(token, a, self.n if b is None else b)
        return end - first

    def locate(self, token: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """The places of the id between a and b, ascending."""
        first, end = self._leaf(token, a, self.n if b is None else b)
        at = np.arange(first, end)
        for level in range(len(self.planes) - 1, -1, -1):
            one = self._digit(token, level)
            at = self.planes[level].select(at - self.zeros[level] if one else at, one)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions are undone from the lowest plane to the highest."""
        out = np.zeros(self.n, np.uint32)
        for digit, plane in enumerate(reversed(self.planes)):
            flags, up = plane.flags(), np.empty(self.n, np.uint32)
            zeros = self.zeros[len(self.planes) - 1 - digit]
            up[~flags] = out[:zeros]
            up[flags] = out[zeros:] | np.uint32(1 << digit)
            out = up
        return out


class Shard:
    """A shard file: documents (ids, null flags, first places and the end) and the matrix."""

    def __init__(self, docs: np.ndarray, nulls: np.ndarray, starts: np.ndarray, matrix: Matrix):
        self.docs, self.nulls, self.starts, self.matrix = docs, nulls, starts, matrix

    def to_bytes(self) -> bytes:
        m = self.matrix
        head = np.array([len(m.planes), m.n, len(self.docs)], "<i8").tobytes()
        parts = [MAGIC, b"\0" * 4, head, self.docs.astype("<i8").tobytes(), self.starts.astype("<i8").tobytes(), self.nulls.astype(np.uint8).tobytes()]
        for p in m.planes:
            parts += [p.ones.tobytes(), p.bits.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        bits, n, docs = np.frombuffer(data, "<i8", 3, 8).tolist()
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        own, starts, nulls = take("<i8", docs), take("<i8", docs + 1), take("u1", docs)
        blocks = n // _BLOCK + 1
        planes = []
        for _ in range(bits):
            ones = take("<u4", blocks)
            planes.append(Plane(take("u1", blocks * _BLOCK // 8).copy(), ones, n))
        return cls(own, nulls.astype(bool), starts, Matrix(planes, n))

    def doc_ids(self) -> pa.Array:
        return pa.array(self.docs, pa.int64(), mask=self.nulls)


def write(docs: DataFrame, path: str | None = None, end: int = 2, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard files of the documents, as a table of them: part, shard, n_docs, n_ids, content. ``path``: the tokenizer. Each row is a file of its own in the shared folder."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    order = (F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    dealt = rows.repartitionByRange(parts, *order[:1]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, k = WordEncoder.of(path), TaskContext.get().partitionId(), 0
        ids, lengths, docs, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            whole, names = np.concatenate(ids), pa.concat_arrays(docs)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            nulls = names.is_null().to_numpy(zero_copy_only=False)
            content = Shard(names.fill_null(0).to_numpy(), nulls, starts, Matrix.of(whole)).to_bytes()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([k], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([len(whole)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch.column(1), min(1_000_000, 4 * shard)):
                flat, of = encoder.chunk(buf, offsets)
                closed = np.insert(flat, of[1:], np.uint32(end))
                ids.append(closed)
                lengths.append(np.diff(of) + 1)
                docs.append(batch.column(0).slice(lo, hi - lo))
                held += len(closed)
                if held >= shard:
                    yield flush()
                    ids, lengths, docs, held, k = [], [], [], 0, k + 1
        if held:
            yield flush()

    return cut(dealt.mapInArrow(run, "part int, shard int, n_docs long, n_ids long, content binary"), "tokens", maxRecordsPerFile=1, compression="zstd")


def starts(files: DataFrame, group: int = 1000) -> DataFrame:
    """part, shard, first: how many ids stand before each shard. Sums of parts and of groups of parts come first, so no task goes over all shards."""
    sizes = files.select("part", "shard", "n_ids", F.floor(F.col("part") / group).alias("group"))
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(before("group")), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("group").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return placed.join(groups, "group").select("part", "shard", (F.col("ahead") + F.col("within")).alias("first"))


def _each(files: DataFrame, use: Callable[[Shard], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Rows that ``use`` makes of each shard, with its part and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = use(Shard.from_bytes(batch.column(2)[k].as_buffer().to_pybytes()))
                n = len(next(iter(made.values())))
                name = lambda c: pa.array(np.full(n, batch.column(c)[k].as_py(), np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"part": name(0), "shard": name(1), **made})

    return files.select("part", "shard", "content").mapInArrow(run, "part int, shard int, " + schema)


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def use(shard: Shard) -> dict[str, pa.Array]:
        ids = shard.matrix.decode().astype("<u4")
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
        return {"doc_id": shard.doc_ids(), "at": pa.array(shard.starts[:-1]), "n_tokens": pa.array(np.diff(shard.starts)), "ids_crc32": pa.array(crc, pa.int64())}

    found = _each(files, use, "doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts(files), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read(files: DataFrame) -> DataFrame:
    """doc_id and the ids of every document."""

    def use(shard: Shard) -> dict[str, pa.Array]:
        return {"doc_id": shard.doc_ids(), "ids": pa.ListArray.from_arrays(pa.array(shard.starts, pa.int32()), pa.array(shard.matrix.decode().astype(np.int32)))}

    return _each(files, use, "doc_id long, ids array<int>").drop("part", "shard")


def counts(files: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """token, n: how often each of the ids stands in all shards, counted by rank."""
    tokens = list(tokens)
    found = _each(files, lambda s: {"token": pa.array(tokens, pa.int32()), "n": pa.array([s.matrix.count(t) for t in tokens], pa.int64())}, "token int, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """doc_id and place in the document of every occurrence of the id, located by select."""

    def use(shard: Shard) -> dict[str, pa.Array]:
        at = shard.matrix.locate(token)
        doc = np.searchsorted(shard.starts, at, "right") - 1
        return {"doc_id": shard.doc_ids().take(pa.array(doc)), "place": pa.array(at - shard.starts[doc])}

    return _each(files, use, "doc_id long, place long").drop("part", "shard")
