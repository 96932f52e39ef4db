"""Words that tests of a candidate ask for, as bits that say which of them may stand in its text.

Most tests look for words that a line seldom holds. A worker passes a line through one automaton of all such words; a bit that isn't set rules out its words, and one that is set rules
nothing, so a test behind its bits has the result that it has alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from ..operators.rules import KEYWORDS, NEGATIVE_WORDS
from . import scalars as S
from .dialect import SPARK

#: What a trimmed value without quotes doesn't begin or end with.
EDGES = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)) + "\"'`"
EDGE, FALSE, SECRET, EXAMPLE = 1 << 62, 1 << 61, 1 << 60, 1 << 59
ALL = -1
#: Parts of the words of contexts; words of several parts may stand on both sides of a value, so each part counts.
PARTS = sorted({p for w in (*KEYWORDS, *NEGATIVE_WORDS, "env", "environment", "credential") for p in w.split()})
_BIT = {p: 1 << k % 59 for k, p in enumerate(PARTS)}
#: A part of every word that the expression of the context looks for.
_CORES = (
    (FALSE, ("regex", "regular", "policy", "strength", "validat", "generat", "doc", "tutorial", "example", "sample", "dummy", "fake", "template", "mock", "redacted", "masked", "sanitized", "replace", "changeme", "limit", "version", "build", "region", "environment", "santa")),
    (SECRET, ("passw", "pwd", "token", "secret", "api", "access", "private", "bearer", "authorization", "connection", "dsn", "database", "postgres", "mysql", "mongodb", "redis")),
    (EXAMPLE, ("example", "sample", "dummy", "placeholder", "changeme", "replace", "your_")),
)


def automaton(words: Iterable[tuple[str, object]]):
    """A machine that finds the words; none without words."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, value in words:
        machine.add_word(word, value)
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def _machine():
    bits = dict(_BIT)
    for bit, cores in _CORES:
        for c in cores:
            bits[c] = bits.get(c, 0) | bit
    return automaton(bits.items())


def held(low: str) -> int:
    """The bits of a lower-case text."""
    out = 0
    for _, bit in _machine().iter(low):
        out |= bit
    return out


def of(word: str) -> int:
    out = 0
    for p in word.split():
        out |= _BIT[p]
    return out


def says(bits: int) -> str:
    """Whether all bits are set, as Spark SQL."""
    return f"(words & {bits}L) = {bits}L"


@lru_cache(maxsize=None)
def _guards() -> tuple[tuple[str, str], ...]:
    """Tests, and what has to hold for them to be true."""
    s, line = SPARK, "lower(concat(before, raw, after))"
    some = [(says(FALSE), s.test(x, p, "i")) for x, p in ((line, S.FALSE_CONTEXT), ("before", S.FALSE_CONTEXT), ("lower(before)", S.PROSE_CONTEXT))]
    some += [(says(SECRET), S.explicit_context(s, "before")), (says(EXAMPLE), S.example_like(s, "raw")), (says(EXAMPLE), S.template_marker(s, "raw")), ("contains(raw, '[')", S.has_token(s, "raw")), ("contains(raw, '[')", S.clean_token(s, "raw"))]
    # the shape of a vendor's value is cheaper than a search for the key ahead of it
    some.append((s.test("raw", "^[a-f0-9]{24}", "i"), S.vendor_hex(s, S.key_before(s, "before", "{0,80}", "[:=]"), "raw")))
    return tuple((test, f"({cheap} AND {test})") for cheap, test in some)


def guarded(sql: str) -> str:
    """Spark SQL over candidates with its tests behind their bits."""
    for test, both in _guards():
        sql = sql.replace(test, both)
    return sql
