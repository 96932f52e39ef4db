"""Repair of conversations by a suffix-shared automaton.

A conversation is a word: one letter a row, which says whose turn it is and what is wrong with it. ``signatures`` spells the words. Positions with the same
rest of the word are one node of the automaton (it is minimal from the end: its nodes are the distinct rests), so what a rest costs from each grammar state, and the edit that
the best repair starts with there, are found once for a node and every conversation that ends alike shares them. ``plans`` sorts the words by their
last letters, over all tasks; neighbours share their longest common rest, and a task keeps only the nodes of the word that it is at. A task computes
anew at most the rest that its first word shares with the last one of the task before it. ``repaired`` carries the edits out on the rows.

Grammar: ``(s?(ua)+)?`` over the first letters of the roles. Edits and their costs are below; equal costs go to the audit that sorts first. From a node and a state
no two edits have the same letter, so the first letter decides and audits are never compared as strings.

Order of a conversation's rows: by turn, null first; rows of one turn by role and then by the MD5 of the text (rows alike in all of these are equal). Rows without ``conv_id`` are one
conversation. A row with neither role nor text only names its conversation; a null role or text beside the other counts as one blank. A conversation without rows costs nothing and
has an empty audit. Other columns are ignored; an empty table gives an empty result. A conversation's rows pass one task in order, since audit and repaired text are read in order, but
they are streamed: only its letters are held, a byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut

KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that an edit is free to choose.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by its role's first letter.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    Nulls are one blank; a dropped row is left with neither role nor text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(name(conv_col), F.lit(":"), name(turn_col))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name(text_col), "[.!?]", "")).otherwise(name(text_col))
    role = F.when(kind == 4, "user").otherwise(name(role_col))
    there = kind != 0
    out = rows.select(F.col(conv_col).alias("conv_id"), F.when(there, F.col(turn_col)).cast("long").alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"), kind.alias("kind"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def _rows(rows: DataFrame) -> DataFrame:
    there = F.col("role").isNotNull() | F.col("text").isNotNull()
    or_blank = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(" ")))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), or_blank("role").alias("role"), or_blank("text").alias("text"))


def _order(*first: str) -> list:
    return [*first, F.asc_nulls_first("turn"), "role", "digest"]


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal: what is wrong with each conversation. No text is shuffled.

    Letters: the role's first letter (x: neither s, u nor a), upper case where the text doesn't end a sentence; ``-`` for rows that have to go (blank or repeated).
    """
    from pyspark.sql import Window

    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    light = _rows(rows).select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), F.when(F.col("role").isNotNull(), F.substring("role", 1, 1)).alias("initial"),
        F.when(blank, "b").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("").alias("fault"),
    )
    light = light.repartition("conv_id").withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1)
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("signature", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
    return light.sortWithinPartitions(*_order("conv_id")).select("conv_id", "turn", "initial", "fault", "again").mapInArrow(_spelled, schema)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rows in order, which may go on over batches."""
    own, kind = None, None
    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for conv, turn, initial, fault, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is None or own.conv != conv:
                if own is not None:
                    out.append(own.row())
                own = _Conversation(conv)
            if initial is not None:
                own.add(turn, initial, fault, again)
        yield _batch(out, kind)
    if own is not None:
        yield _batch([own.row()], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"])


class _Conversation:
    def __init__(self, conv):
        self.conv, self.letters, self.role, self.first, self.turn, self.turns = conv, bytearray(), None, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str, again: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        if self.role is not None and self.role + initial not in _LEGAL:
            self.illegal += 1
        self.role = initial
        self.blank += fault == "b"
        self.duplicate += again and fault != "b"
        self.truncated += not again and fault == "t"
        letter = initial if initial in ("s", "u", "a") else "x"
        self.letters += b"-" if again or fault == "b" else (letter.upper() if fault else letter).encode()

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv, self.letters.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


class Automaton:
    """The nodes along one word, from its end: ``costs[d]`` and ``edits[d]`` are what the rest of ``d`` letters costs from each grammar state and the letter of the edit to
    make there. ``read`` moves to another word and keeps the nodes of the rest that both share. ``made`` counts nodes."""

    def __init__(self):
        self.word, self.made, self.audit = "", 1, ""
        self.costs, self.edits = [], []
        self._push(*_inserted([0, _NEVER, _NEVER, 0], ["", "", "", ""]))

    def _push(self, costs: tuple, edits: tuple) -> None:
        self.costs.append(costs)
        self.edits.append(edits)

    def read(self, word: str) -> tuple[int, str]:
        """Cost and audit of the word."""
        if word != self.word or not word:
            n, m = len(word), len(self.word)
            shared = 0
            while shared < n and shared < m and word[n - 1 - shared] == self.word[m - 1 - shared]:
                shared += 1
            del self.costs[shared + 1 :], self.edits[shared + 1 :]
            for d in range(shared, n):
                self._push(*_node(word[n - 1 - d], self.costs[d]))
                self.made += 1
            self.word = word
            self.audit = self._spell()
        return self.costs[len(word)][START], self.audit

    def _spell(self) -> str:
        out, state, rest, n = [], START, len(self.word), len(self.word)
        while edit := self.edits[rest][state]:
            out.append(edit)
            if edit == "K":
                state = AFTER[state][self.word[n - rest].lower()]
            elif edit != "D":
                state = NEXT[state]
            rest -= edit != "I"
        return "".join(out)


def _inserted(costs: list[int], edits: list[str]) -> tuple[tuple, tuple]:
    """Insertions on top of the other edits of a node. User and assistant rows alternate, so none pays twice in a row in those two states."""
    best, letters = list(costs), list(edits)
    for states in ((USER, ASSISTANT), (START, SYSTEM)):
        reached = costs if states[0] == USER else best
        for q in states:
            if (INSERT + reached[NEXT[q]], "I") < (costs[q], edits[q]):
                best[q], letters[q] = INSERT + reached[NEXT[q]], "I"
    return tuple(best), tuple(letters)


@cache
def _choices(letter: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state the edits of a row: cost, letter, next state."""
    more = OPEN if letter.isupper() else 0
    out = []
    for q in range(4):
        edits = [(DELETE, "D", q)]
        if letter != "-":
            edits.append((REROLE + more, "R", NEXT[q]))
            if letter.lower() in AFTER[q]:
                edits.append((KEEP + more, "K", AFTER[q][letter.lower()]))
        out.append(tuple(edits))
    return tuple(out)


def _node(letter: str, rest: tuple) -> tuple[tuple, tuple]:
    found = [min((cost + rest[to], edit) for cost, edit, to in edits) for edits in _choices(letter)]
    return _inserted([c for c, _ in found], [e for _, e in found])


def plans(signed: DataFrame) -> DataFrame:
    """``signatures`` with cost and audit. Words are dealt by ranges of their reversed spelling, equal ones by ``conv_id``, so a word that most conversations have isn't one task."""
    signed = cut(signed, "signatures")
    last = F.reverse("signature")
    dealt = signed.repartitionByRange(last, F.asc_nulls_first("conv_id")).sortWithinPartitions(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            found = [automaton.read(word) for word in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*batch.schema.names, "cost", "audit"])

    return dealt.mapInArrow(run, T.StructType([*signed.schema.fields, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows after repair: conv_id, place (from 0), edit, role, text; a conversation's rows come together and in order. Each conversation's audit goes ahead of its rows to their task."""
    there = _rows(rows).where(F.col("role").isNotNull())
    tagged = there.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"))
    audits = plans.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"), "audit", F.lit(None).cast("binary"))
    dealt = audits.union(tagged).toDF(*tagged.columns).repartition("conv_id").sortWithinPartitions("conv_id", "tag", *_order())
    names = ("place", "edit", "role", "text")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(c, T.LongType() if c == "place" else T.StringType()) for c in names)])
    return dealt.select("conv_id", "tag", "role", "text").mapInArrow(_carried_out, schema)


def _carried_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, state, place = None, "", 0, START, 0
    for batch in batches:
        out: list[tuple] = []

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((conv, place, edit, role, text))  # noqa: B023
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                emit("I", ROLES[state], "")
                at += 1

        for own, tag, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tag == 0:
                conv, audit, at, state, place = own, text, 0, START, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = AFTER[state][role[0]] if edit == "K" else NEXT[state]
                    emit(edit, role if edit == "K" else ROLES[state], text)
            inserted()
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``repaired`` rows, which come in order: ``role:text`` joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind = None, None, None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for own, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = own, hashlib.sha256()
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    planned = cut(plans(signatures(rows)), "plans")
    hashed = digests(repaired(rows, planned)).withColumnRenamed("conv_id", "_conv")
    out = planned.drop("signature").join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
