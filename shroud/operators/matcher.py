"""One pass over texts that finds what all detectors look for.

Spark's expressions give what a group of a match holds but not where it stands, and a value may stand twice in its match (``root:root@``); so matches are made in Arrow batches by
workers, which know the place of a group. A text is lower-cased once and searched for the markers of all entries; only entries with a marker in it are run. A worker keeps its compiled
expressions.

Context is bounded: ``before`` and ``after`` hold what stands on the match's line within ``RADIUS`` characters of it. Where a line is longer, what its other parts say to the tests that
look at whole lines comes as bits in ``far``; they are found once for a line, so many matches on one long line cost no more than on many short ones.

``words`` says which words that later tests ask for may stand in what a match and its context hold (``functions.words``): a test whose words are missing there isn't made at all.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import words as W
from ..functions.dialect import python
from ..sources.scratch import spread

RADIUS = 512


class Entry(NamedTuple):
    """What to look for. ``groups``: the first that isn't empty is the value (none: the match). ``key``: the group that names it. ``inner``: an expression whose matches in the value,
    not the value itself, are candidates (its expression, flags, groups and key). ``decoded``: the value is percent-decoded; its span isn't.

    What a row needs where only kept ones are wanted: ``worth``, an expression that the value matches; ``asks``, expressions of key and value (any letter case), of which one pair matches;
    ``may``, a test of value, what stands before and after it on the line, far and words. They rule out only what the tests of the entry's detector would drop later."""

    source: str
    rule: int
    regex: str
    flags: str = ""
    groups: tuple[int, ...] = ()
    markers: tuple[str, ...] = ()
    key: int = 0
    inner: tuple[str, str, tuple[int, ...], int] | None = None
    worth: str = ""
    decoded: bool = False
    asks: tuple[tuple[str, str], ...] = ()
    may: Callable[[str, str, str, int, int], bool] | None = None


#: Tests that look at a whole line, or at all of it before the match: bit, expression, whether only the part before counts.
FAR = (
    (1, S.FALSE_CONTEXT, False), (2, S.FALSE_CONTEXT, True), (4, S.PROSE_CONTEXT, True), (8, r"\b(?:docs?|documentation|tutorial|example|sample|dummy|fake|template|mock|mailto)\b|\b(?:https?|wss?|ftp|sftp):\/\/", True),
    (16, r"\b(?:import|from|require|include)\b", False), (32, rf"\b{S.SECRET_CONTEXT}\b", True),
)
COLUMNS = "source string, rule int, order int, start int, end int, raw string, key string, before string, after string, far int, words long"
_BAD_ESCAPE = re.compile("%(?![0-9A-Fa-f]{2})")


def decode(value: str) -> str:
    """Percent-decoded; a value with a broken escape, or one that isn't UTF-8, stays."""
    if "%" not in value or _BAD_ESCAPE.search(value):
        return value
    try:
        return unquote(value, errors="strict")
    except UnicodeDecodeError:
        return value


class Lines:
    """The lines of a text as its matches ask for them."""

    def __init__(self, text: str):
        self.text, self.breaks, self.said, self.held = text, None, {}, {}

    def around(self, start: int, end: int) -> tuple[str, str, int, int]:
        """before, after, far, words."""
        text = self.text
        lo, hi = max(0, start - RADIUS), min(len(text), end + RADIUS)
        begin, stop = text.rfind("\n", lo, start) + 1, text.find("\n", end, hi)
        cut = (begin == 0 and lo > 0) or (stop < 0 and hi < len(text))
        begin, stop = begin or lo, stop if stop >= 0 else hi
        after = text[end:stop]
        if after.endswith("\r") and (stop == len(text) or text[stop : stop + 1] == "\n"):
            after = after[:-1]
        held = self.held.get((begin, stop))
        if held is None:
            held = self.held[begin, stop] = W.held(text[begin:stop].lower())
        if text[start:end].strip(W.EDGES) != text[start:end]:
            held |= W.EDGE
        return text[begin:start], after, self.far(start) if cut else 0, held

    def far(self, start: int) -> int:
        if self.breaks is None:
            self.breaks = [m.start() for m in re.finditer("\n", self.text)]
        k = bisect_right(self.breaks, start - 1)
        if k not in self.said:
            first = self.breaks[k - 1] + 1 if k else 0
            line = self.text[first : self.breaks[k] if k < len(self.breaks) else len(self.text)].lower()
            found = (python(p, "i").search(line) for _, p, _ in FAR)
            self.said[k] = [m and first + m.end() for m in found]
        return sum(bit for (bit, _, ahead), at in zip(FAR, self.said[k], strict=True) if at is not None and (not ahead or at <= start))


def _value(m: re.Match, groups: tuple[int, ...]) -> tuple[str, int]:
    for g in groups:
        if m.group(g):
            return m.group(g), m.start(g)
    return m.group(), m.start()


def _of(text: str, e: Entry) -> Iterator[tuple[str, int, str]]:
    """raw, start, key of what an entry finds, in order."""
    for m in python(e.regex, e.flags).finditer(text):
        raw, start = _value(m, e.groups)
        if e.inner is None:
            yield raw, start, (m.group(e.key) or "") if e.key else ""
        else:
            for n in python(e.inner[0], e.inner[1]).finditer(raw):
                own, at = _value(n, e.inner[2])
                yield own, start + at, (n.group(e.inner[3]) or "") if e.inner[3] else (m.group(e.key) or "") if e.key else ""


def _needs(e: Entry, quick: bool) -> tuple:
    """What a row of the entry needs, ready to use; nothing where all rows are wanted."""
    if not quick:
        return None, (), None
    return python(e.worth, "i") if e.worth else None, tuple((python(a, "i"), python(b, "i")) for a, b in e.asks), e.may


def matched(docs: DataFrame, entries: Iterable[Entry], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), quick: bool = False) -> DataFrame:
    """One row a match: ``keep``, source, rule, order (of the entry's matches in the text), start, end, raw, key, before, after, far. Null and blank texts have none. ``quick``: values
    that aren't ``worth`` a row are left out."""
    entries = tuple(entries)
    by_marker: dict[str, list[int]] = {}
    always = [k for k, e in enumerate(entries) if not e.markers]
    for k, e in enumerate(entries):
        for m in e.markers:
            by_marker.setdefault(m, []).append(k)
    rows = spread(docs.select(*keep, F.col(text_col).alias("_t")).where(F.length(F.trim("_t")) > 0))
    made = T._parse_datatype_string(COLUMNS)
    schema = T.StructType([*(rows.schema[c] for c in keep), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int64()]
        markers = W.automaton(by_marker.items())
        compiled = [(e, *_needs(e, quick)) for e in entries]
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                low, lines = text.lower(), Lines(text)
                asked = set(always)
                if markers is not None:
                    for _, ks in markers.iter(low):
                        asked.update(ks)
                for k in sorted(asked):
                    e, worth, asks, may = compiled[k]
                    for order, (raw, start, key) in enumerate(_of(text, e)):
                        if (worth is None or worth.search(raw)) and (not asks or any(a.search(key) and b.search(raw) for a, b in asks)):
                            before, after, far, words = lines.around(start, start + len(raw))
                            if may is not None and not may(raw, before, after, far, words):
                                continue
                            at.append(row)
                            plain = decode(raw) if e.decoded else raw
                            out.append((e.source, e.rule, order, start, start + len(raw), plain, key, before, after, far, words if plain == raw else W.ALL))
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
