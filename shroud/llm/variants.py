"""Spelling variants by composing the vocabulary's acceptor with a one-edit transducer and the acceptor again.

``near_pairs`` finds all pairs of words that differ by one inserted, deleted or replaced letter. The composed machine has three kinds of states: before the edit, where both tapes read the same
letters from one state of the acceptor; the edit, which takes different letters (or a letter on one tape alone); after it, where both tapes read the same letters from two states. The edit comes
where the words first differ, so each pair is accepted once.

The machine is parted by its initial states, and no task holds the whole acceptor. A partition fixes what both tapes read before or after a window of places for the edit: words of ``least``
letters or more share either their first ``head`` letters (edit behind them) or, with the edit among those, their last ``least - head`` ones. A partition of more than ``BOUND`` words is parted again: by
the shorter word's length, then the window is halved, until the key leaves one place open, which bounds a partition by the alphabet (a letter, or two of the longer
word). Every split covers all pairs of its partition, so nothing is dropped. In a task, a partition's words make a minimal acceptor of their open middles; states after the
edit are pairs of its states, and what the pairs accept is found once for a state, wherever it stands.

Null texts and empty ones have no words. Rows without ``doc_id`` and repeated rows are documents like any others. Ties of the most frequent near word go to the first in code-point order. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

LEAST = 7
BOUND = 20_000
_FAR = 1 << 30
_KEY = ("s", "a", "hi", "b", "key")
_MASK = (1 << 64) - 1


def runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, run: maximal runs of ASCII and Latin-1 letters of at least ``least``, with A-Z in lower case."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select(F.col(id_col).alias("doc_id"), run.alias("run")).select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")).alias("run"))


def planted(found: DataFrame, every: int = 31) -> Column:
    """The run, or without one of its letters where ``every`` divides the CRC of ``doc_id:run`` (a null id is empty)."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = F.pmod(h, F.length("run")).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))


def vocabulary(words: DataFrame, least: int = LEAST, often: int = 2) -> DataFrame:
    """word, n of the distinct words of ``least`` letters and ``often`` occurrences or more."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


# ---- partitions


def _keyed(words: DataFrame) -> DataFrame:
    """The key: the letters that both words of a pair read before and after the window."""
    return words.withColumn("key", F.expr("concat(left(word, a), '.', right(word, b))"))


def _first(words: DataFrame, least: int) -> DataFrame:
    head = (least - 1) // 2
    made = F.expr(f"inline(array(named_struct('s', 0, 'a', {head}, 'hi', {_FAR}, 'b', 0), named_struct('s', 0, 'a', 0, 'hi', {head}, 'b', {least - head})))")
    return _keyed(words.select("word", "n", made))


def _halved(words: DataFrame, least: int) -> DataFrame:
    """The words of large partitions in the partitions that take their place."""
    lengths = F.expr(f"explode(CASE WHEN s > 0 THEN array(s) WHEN length(word) > {least} THEN array(length(word) - 1, length(word)) ELSE array(length(word)) END)")
    rows = words.select("word", "n", "a", "hi", "b", lengths.alias("s")).withColumn("w", F.expr("least(hi, s + 1) - a")).withColumn("h", F.expr("a + w div 2"))
    one = "array(named_struct('s', s, 'a', a, 'hi', a + 1, 'b', greatest(b, s - 1 - a)))"
    two = "array(named_struct('s', s, 'a', cast(h as int), 'hi', hi, 'b', b), named_struct('s', s, 'a', a, 'hi', cast(h as int), 'b', greatest(b, cast(s - h as int))))"
    return _keyed(rows.select("word", "n", F.expr(f"inline(CASE WHEN w <= 1 THEN {one} ELSE {two} END)")))


def partitions(words: DataFrame, least: int = LEAST, bound: int = BOUND) -> DataFrame:
    """word, n, s, a, hi, b, key: every word in its partitions. ``s``: length of a pair's shorter word (0: any), ``a``: the letters shared before the window, ``hi``: its end, ``b``: the
    letters shared behind. Each round counts the partitions and parts the large ones; rounds grow with the logarithm of the longest word."""
    rows, done = _first(words, least), None
    while True:
        final = "s > 0 AND least(hi, s + 1) - a <= 1 AND b >= s - 1 - a"
        large = cut(rows.groupBy(*_KEY).agg(F.count("*").alias("size")).where(f"size > {bound} AND NOT ({final})").drop("size"), "partitions")
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        small = rows.join(large, [*_KEY], "left_anti").select(*rows.columns)
        done = small if done is None else done.union(small)
        rows = cut(_halved(rows.join(large, [*_KEY], "left_semi"), least).select(*rows.columns), "halves")


# ---- the machine


class Acceptor:
    """The minimal acceptor of sorted distinct strings. States are numbered so that what a state reaches comes before it. ``arcs[q]``: letter -> (state, how many words of the state come
    before those of the arc), so a path adds up to the number of its word."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.sizes: list[int] = []  # lengths of what a state accepts, modulo 64, as bits
        self.ends: list[int] = []  # last letters of it, as bits; the lowest: the empty string
        self.known: dict = {}
        open_, before = [[False, []]], ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            self._close(open_, before, shared)
            open_ += [[False, []] for _ in range(len(word) - shared)]
            open_[-1][0] = True
            before = word
        self._close(open_, before, 0)
        self.root = self._state(*open_[0])
        self.found: dict[int, list[tuple[int, int]]] = {}

    def _close(self, open_: list, word: str, keep: int) -> None:
        while len(open_) > keep + 1:
            done = self._state(*open_.pop())
            open_[-1][1].append((word[len(open_) - 1], done))

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        if key in self.known:
            return self.known[key]
        n, own, sizes, ends = int(final), {}, int(final), int(final)
        for letter, to in arcs:
            own[letter] = (to, n)
            n += self.count[to]
            m = self.sizes[to]
            sizes |= (m << 1 | m >> 63) & _MASK
            ends |= self.ends[to] & ~1 | (1 << ord(letter) % 63 + 1 if self.final[to] else 0)
        for column, value in ((self.arcs, own), (self.final, final), (self.count, n), (self.sizes, sizes), (self.ends, ends)):
            column.append(value)
        self.known[key] = len(self.arcs) - 1
        return self.known[key]

    def edits(self, q: int) -> list[tuple[int, int]]:
        """Pairs of words (their numbers in the state) that differ from the first letter on, by one edit. The states after the edit are walked with a stack."""
        if q not in self.found:
            arcs, own = self.arcs[q], list(self.arcs[q].items())
            sizes, ends, final = self.sizes, self.ends, self.final
            out, todo = [], []
            for k, (d, (to, at)) in enumerate(own):
                for _, (other, there) in own[:k]:
                    todo.append((other, to, there, at))
                if final[q] and final[to]:
                    out.append((0, at))
                beyond = self.arcs[to]
                for c in arcs.keys() & beyond.keys():
                    if c != d:
                        todo.append((arcs[c][0], beyond[c][0], arcs[c][1], at + beyond[c][1]))
            while todo:
                x, y, i, j = todo.pop()
                if not (sizes[x] & sizes[y] and ends[x] & ends[y]):
                    continue
                if final[x] and final[y]:
                    out.append((i, j))
                left, right = self.arcs[x], self.arcs[y]
                if len(left) > len(right):
                    for c, (to, at) in right.items():
                        if c in left:
                            todo.append((left[c][0], to, i + left[c][1], j + at))
                else:
                    for c, (to, at) in left.items():
                        if c in right:
                            todo.append((to, right[c][0], i + at, j + right[c][1]))
            self.found[q] = out
        return self.found[q]

    def pairs(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all pairs whose edit comes before place ``window``."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        level, place = {self.root: [0]}, 0
        while level and place < window:
            after: dict[int, list[int]] = {}
            for q, firsts in level.items():
                arcs = self.arcs[q]
                if len(arcs) + self.final[q] > 1 and (found := self.edits(q)):
                    both, at = np.array(found, np.int64), np.array(firsts, np.int64)
                    left.append(np.add.outer(at, both[:, 0]).ravel())
                    right.append(np.add.outer(at, both[:, 1]).ravel())
                for to, more in arcs.values():
                    after.setdefault(to, []).extend([f + more for f in firsts] if more else firsts)
            level, place = after, place + 1
        return np.concatenate(left), np.concatenate(right)


def _compose(words: list[str], s: int, a: int, hi: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of one partition's words."""
    middles = [w[a : len(w) - b] for w in words]
    order = sorted(range(len(words)), key=middles.__getitem__)
    left, right = Acceptor([middles[k] for k in order]).pairs(hi - a)
    order = np.array(order, np.int64)
    left, right = order[left], order[right]
    if s:
        short = np.array([len(w) == s for w in words])
        keep = short[left] | short[right]
        left, right = left[keep], right[keep]
    return left, right


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[int]]]:
    """Words and counts of each partition, from sorted rows that go on over batches."""
    own, words, counts = None, [], []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        keys = list(zip(*columns[:5], strict=True))
        edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for x, y in zip(edges, edges[1:], strict=False):
            if x == y:
                continue
            if keys[x] != own:
                if words:
                    yield own, words, counts
                own, words, counts = keys[x], [], []
            words += columns[5][x:y]
            counts += columns[6][x:y]
    if words:
        yield own, words, counts


def _dealt(parts: DataFrame) -> DataFrame:
    return parts.select(*_KEY, "word", "n").repartition(*_KEY).sortWithinPartitions(*_KEY)


def near_pairs(words: DataFrame, least: int = LEAST, bound: int = BOUND) -> DataFrame:
    """word, near: each pair of near words once, of a table of distinct words (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, a, hi, b, _), own, _ in _groups(batches):
            left, right = _compose(own, s, a, hi, b)
            if len(left):
                column = pa.array(own)
                yield pa.RecordBatch.from_arrays([column.take(pa.array(left)), column.take(pa.array(right))], names=["word", "near"])

    return _dealt(partitions(words, least, bound)).mapInArrow(run, "word string, near string")


def neighbours(words: DataFrame, least: int = LEAST, bound: int = BOUND) -> DataFrame:
    """word, n, n_near, best_n, best: how many near words each word has and the most frequent of them. Each partition tells its own, so pairs aren't shuffled."""
    schema = "word string, n long, n_near long, best_n long, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (s, a, hi, b, _), own, counts in _groups(batches):
            left, right = _compose(own, s, a, hi, b)
            n, rank = np.array(counts, np.int64), np.empty(len(own), np.int64)
            rank[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
            who, near = np.concatenate([left, right]), np.concatenate([right, left])
            n_near = np.bincount(who, minlength=len(own))
            order = np.lexsort((rank[near], -n[near], who))
            who, near = who[order], near[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            best = np.full(len(own), -1)
            best[who[first]] = near[first]
            none, column = best < 0, pa.array(own)
            take = pa.array(best, mask=none)
            held.append(pa.RecordBatch.from_arrays([column, pa.array(n), pa.array(n_near, pa.int64()), pa.array(n).take(take), column.take(take)], names=["word", "n", "n_near", "best_n", "best"]))
            size += len(own)
            if size >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    found = _dealt(partitions(words, least, bound)).mapInArrow(run, schema)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("x")
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n", "n_near", (-F.col("x.less")).alias("best_n"), F.col("x.best").alias("best"))


def forms(words: DataFrame, least: int = LEAST, times: int = 10, bound: int = BOUND) -> DataFrame:
    """word, n, n_near, form, form_n, root. ``form``: the most frequent near word if it is ``times`` as frequent; ``root``: where the forms lead. Counts grow by ``times`` along a
    chain, so chains are short; each round joins only words that have a form, and doubles the steps."""
    found = cut(neighbours(words, least, bound), "neighbours")
    apart = F.col("best_n") >= times * F.col("n")
    found = found.select("word", "n", "n_near", F.when(apart, F.col("best")).alias("form"), F.when(apart, F.col("best_n")).alias("form_n"))
    steps = cut(found.where("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = cut(steps.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = moved.select("word", "to")
        if moved.where("moved").isEmpty():
            break
    return found.join(steps.withColumnRenamed("to", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``forms`` of the words of whole texts."""
    return forms(cut(vocabulary(runs(docs, least).select(F.col("run").alias("word")), least), "vocabulary"), least)
