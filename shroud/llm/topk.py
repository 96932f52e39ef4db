"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A component of a vector is a term, its whole value the weight; zeros are no postings. Both tables are packed into blocks that hold for each
term a posting list (rows, weights). Some dozens of queries at a time take one term after the other: for each term that one of them holds, its list is
scattered, times the queries' weights, into a dense array of scores (candidates by queries). This is the only path, for sparse and for full lists. Then each query's largest k are
picked by partition selection, merged over the blocks that a task sees, and at last over tasks.

Scores are exact: weights are whole numbers held as doubles, and the element type of the array follows from a bound on the scores of the two blocks
(single, double, 64-bit, or Python's integers where no machine type is wide enough). A score among a query's k best that doesn't fit 64 bits ends the query with an error.

Queries meet candidates in a grid of cells, about square: a candidate block is repeated for each of some groups of query blocks, a query
block for each of some groups of candidate blocks, so with ``PAIRS`` block pairs in a cell the shuffle is far below all candidates times all query blocks.
A cell's memory is bounded by ``PAIRS`` and the block sizes, not by the tables.

Rows whose id or vector is null, or that hold null or non-finite components, take no part. Vectors of different length are read as if
filled with zeros. A row with a query's id is never that query's neighbour; repeated query rows each get their list; ties go to the smaller id; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

K = 20
BLOCK = 8192
QUERY_BLOCK = 2048
#: Block pairs that a cell of the grid meets, about.
PAIRS = 64
#: Queries whose scores are accumulated together.
TOGETHER = 64


def blocks(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Posting lists of the usable rows, ``size`` rows together: block, ids, terms, of (where each term's list begins), rows, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            nonlocal made, ids, held
            rows = np.repeat(np.arange(len(held), dtype="<i4"), [len(t) for t, _ in held])
            terms, weights = np.concatenate([t for t, _ in held]), np.concatenate([w for _, w in held])
            order = np.argsort(terms, kind="stable")
            own, first = np.unique(terms[order], return_index=True)
            out = {"block": f"{part}-{made}", "ids": np.array(ids, "<i8"), "terms": own.astype("<i4"), "of": np.append(first, len(order)).astype("<i8"), "rows": rows[order], "weights": weights[order].astype("<f8")}
            made, ids, held = made + 1, [], []
            return pa.RecordBatch.from_pylist([{k: v if k == "block" else v.tobytes() for k, v in out.items()}], schema)

        for batch in batches:
            column = batch.column(1)
            for k, (i, ok) in enumerate(zip(batch.column(0).to_pylist(), column.is_valid().to_pylist(), strict=True)):
                if not ok:
                    continue
                x = column[k].values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):  # beyond every double: infinite, and so an error where it counts
                    whole = np.floor(scale * x)
                terms = np.flatnonzero(whole)
                ids.append(i)
                held.append((terms, whole[terms]))
                if len(ids) == size:
                    yield emit()
        if ids:
            yield emit()

    schema = pa.schema([("block", pa.string()), *((k, pa.binary()) for k in ("ids", "terms", "of", "rows", "weights"))])
    return vectors.where("vec_id is not null").mapInArrow(run, "block string, ids binary, terms binary, of binary, rows binary, weights binary")


class Postings:
    """A block by term."""

    def __init__(self, row: dict):
        self.ids, self.terms, self.of, self.rows, self.weights = (np.frombuffer(row[k], t) for k, t in (("ids", "<i8"), ("terms", "<i4"), ("of", "<i8"), ("rows", "<i4"), ("weights", "<f8")))
        self.n = len(self.ids)

    def list(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rows[self.of[k] : self.of[k + 1]], self.weights[self.of[k] : self.of[k + 1]]

    def most(self) -> np.ndarray:
        """The largest weight of each list."""
        return np.maximum.reduceat(np.abs(self.weights), self.of[:-1]) if len(self.terms) else np.zeros(0)


def exact(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(v) for v in x], object) if kind is object else x.astype(kind)


def kind_for(bound: float) -> type:
    """The narrowest element type that holds whole numbers up to the bound."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def scores(candidates: Postings, queries: Postings, first: int, end: int) -> np.ndarray:
    """Scores of the queries from first to end with all candidates, a row for each query."""
    shared, at, to = np.intersect1d(candidates.terms, queries.terms, assume_unique=True, return_indices=True)
    with np.errstate(over="ignore", invalid="ignore"):
        kind = kind_for(float((candidates.most()[at] * queries.most()[to]).sum()) if len(shared) else 0.0)
    out = np.zeros((candidates.n, end - first), kind)
    for a, b in zip(at.tolist(), to.tolist(), strict=True):
        own, weights = queries.list(b)
        lo, hi = np.searchsorted(own, (first, end))  # rows of a list rise
        if lo == hi:
            continue
        own, weights = own[lo:hi] - first, exact(weights[lo:hi], kind)
        rows, posted = candidates.list(a)
        posted = exact(posted, kind)[:, None]
        if 4 * len(own) < end - first:
            out[rows[:, None], own] += posted * weights
        else:  # whole rows of the array are faster to scatter
            wide = np.zeros(end - first, kind)
            wide[own] = weights
            out[rows] += posted * wide
    return np.ascontiguousarray(out.T)


def best(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best: highest score, then smaller id."""
    if found.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-found[i], ids[i]))[:k], np.int64)
    if len(ids) > k:
        near = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k])
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -found[near]))[:k]]


def grid(candidate_blocks: int, query_blocks: int, cores: int, pairs: int = PAIRS) -> tuple[int, int]:
    """Groups of candidate blocks and of query blocks: cells of about ``pairs`` block pairs, about square, and enough for all cores."""
    c, q = max(1, candidate_blocks), max(1, query_blocks)
    cells = max(-(-c * q // pairs), min(c * q, 4 * cores))
    by_query = min(q, max(1, round(math.sqrt(cells * q / c))))
    return min(c, -(-cells // by_query)), by_query


def search(queries: DataFrame, candidates: DataFrame, k: int = K, scale: float = 64.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id, embedding."""
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    c = cut(blocks(pick(candidates), block, scale), "candidates")
    q = cut(blocks(pick(queries), query_block, scale), "queries")
    across, down = grid(c.count(), q.count(), candidates.sparkSession.sparkContext.defaultParallelism)
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = c.withColumn("across", group(across)).withColumn("down", each(down))
    right = q.withColumn("down", group(down)).withColumn("across", each(across))

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for row in asked.to_pylist() if len(mine) else ():
            wanted = Postings(row)
            tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * wanted.n
            for b in range(len(mine)):
                own = Postings(mine.slice(b, 1).to_pylist()[0])
                for first in range(0, wanted.n, TOGETHER):
                    for i, found in enumerate(scores(own, wanted, first, min(first + TOGETHER, wanted.n)), first):
                        near = best(own.ids, found, k + 1)
                        near = near[own.ids[near] != wanted.ids[i]][:k]
                        if len(near) < k and own.n > k:  # the query's id is there more than once
                            others = np.flatnonzero(own.ids != wanted.ids[i])
                            near = others[best(own.ids[others], found[others], k)]
                        ids, top = np.concatenate([tops[i][0], own.ids[near]]), np.concatenate([tops[i][1], found[near] if found.dtype == object else found[near].astype(np.int64)])
                        keep = best(ids, top, k)
                        tops[i] = ids[keep], top[keep]
            for i, (ids, top) in enumerate(tops):
                n = len(ids)
                beyond = np.array([not -(2**63) <= int(x) < 2**63 for x in top], bool) if top.dtype == object else np.zeros(n, bool)
                top = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in top], np.int64) if top.dtype == object else top
                out.append(pa.table([[f"{row['block']}/{i}"] * n, pa.array(np.full(n, wanted.ids[i])), pa.array(ids), pa.array(top), pa.array(beyond)], schema=shape))
        return pa.concat_tables(out) if out else shape.empty_table()

    shape = pa.schema([("query_row", pa.string()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.bool_())])
    found = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(run, "query_row string, query_id long, vec_id long, score long, beyond boolean")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = F.raise_error(F.concat(F.lit("a score of row "), F.col("query_id"), F.lit(" doesn't fit 64 bits"))).cast("long")
    return top.select("query_id", "rank", "vec_id", F.when(F.col("beyond"), told).otherwise(F.col("score")).alias("score"))
