"""Regular expressions and scalar SQL in the dialects of two engines.

Rules are written in JavaScript's dialect. Spark runs Java's, where ``\\b`` and ``\\s`` mean something else outside ASCII;
DuckDB, which checks results, runs RE2. Scalar predicates are kept as SQL text with the few differing functions named here,
so one definition serves ``F.expr`` and the checks.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: White space as JavaScript has it.
BLANKS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Java's own boundary looks beyond ASCII; its word class doesn't.
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _walk(pattern: str, boundary: str, blanks: str, any_char: str, end: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith(r"[\s\S]", i) and not inside:
            out.append(any_char)
            i += 6
            continue
        if c == "\\":
            two = pattern[i : i + 2]
            i += 2
            if two == r"\b" and not inside:
                out.append(boundary)
            elif two == r"\s":
                out.append(blanks if inside else f"[{blanks}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{blanks}]")
            elif two == r"\/":
                out.append("/")
            else:
                out.append(two)
            continue
        if c == "[" and not inside:
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                continue
        elif c == "[":
            out.append(r"\[")
            i += 1
            continue
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            out.append(r"[^\n\r\u2028\u2029]")
            i += 1
            continue
        elif c == "$" and not inside:
            out.append(end)
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def java(pattern: str, flags: str = "") -> str:
    out = _walk(pattern, _BOUNDARY, BLANKS, "(?s:.)", r"\z")
    return f"(?i){out}" if "i" in flags else out


@lru_cache(maxsize=None)
def re2(pattern: str, flags: str = "") -> str:
    out = _walk(pattern, r"\b", BLANKS, "(?s:.)", r"\z")
    out = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", out)
    return f"(?i){out}" if "i" in flags else out


@lru_cache(maxsize=None)
def python(pattern: str, flags: str = "") -> re.Pattern:
    """The expression for the workers of a scan; classes, boundaries and letter case are ASCII's."""
    return re.compile(_walk(pattern, r"\b", BLANKS, "(?s:.)", r"\Z"), re.ASCII | (re.IGNORECASE if "i" in flags else 0))


class Sql:
    """Scalar SQL text of one engine. Patterns are in JavaScript's dialect."""

    def __init__(self, engine: str):
        self.spark = engine == "spark"

    def pattern(self, pattern: str, flags: str = "") -> str:
        text = (java if self.spark else re2)(pattern, flags).replace("'", r"\x27")
        return f"r'{text}'" if self.spark else f"'{text}'"

    def text(self, value: str) -> str:
        quoted = value.replace("'", "\\'" if self.spark else "''")
        return f"'{quoted}'"

    def test(self, x: str, pattern: str, flags: str = "") -> str:
        return f"regexp_like({x}, {self.pattern(pattern, flags)})" if self.spark else f"regexp_matches({x}, {self.pattern(pattern, flags)})"

    def extract(self, x: str, pattern: str, group: int = 0, flags: str = "") -> str:
        return f"regexp_extract({x}, {self.pattern(pattern, flags)}, {group})"

    def sub(self, x: str, pattern: str, new: str, flags: str = "") -> str:
        tail = "" if self.spark else ", 'g'"
        return f"regexp_replace({x}, {self.pattern(pattern, flags)}, {self.text(new)}{tail})"

    def chars(self, x: str) -> str:
        """Array of the characters."""
        return f"regexp_extract_all({x}, r'(?s).', 0)" if self.spark else f"regexp_extract_all({x}, '(?s).')"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})" if self.spark else f"list_distinct({x})"

    def each(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})" if self.spark else f"list_transform({x}, lambda {var}: {body})"

    def keep(self, x: str, var: str, body: str) -> str:
        return f"filter({x}, {var} -> {body})" if self.spark else f"list_filter({x}, lambda {var}: {body})"

    def total(self, x: str) -> str:
        return f"aggregate({x}, 0.0D, (a, b) -> a + b)" if self.spark else f"coalesce(list_sum({x}), 0.0)"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})" if self.spark else f"starts_with({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"endswith({x}, {y})" if self.spark else f"ends_with({x}, {y})"

    def compact(self, *items: str) -> str:
        """Array of the items that aren't null."""
        made = f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"
        return f"array_compact({made})" if self.spark else f"list_filter({made}, lambda c: c IS NOT NULL)"

    def among(self, x: str, values: tuple[str, ...]) -> str:
        return f"{x} IN ({', '.join(map(self.text, values))})"

    def trim(self, x: str) -> str:
        return self.sub(self.sub(x, r"^\s+", ""), r"\s+$", "")


SPARK, DUCKDB = Sql("spark"), Sql("duckdb")
