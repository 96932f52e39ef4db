"""Personal data replaced by format-preserving pseudonyms.

Found: e-mail addresses, IPv4 addresses, payment card numbers of 13 to 19 digits, telephone numbers, social
security numbers, IBANs and calendar dates. Each is validated (what isn't valid stays as it is), then read as a number of the set of
all values of its own format, and moved in that set by a keyed Feistel permutation with cycle walking. So a pseudonym
has the layout and the validity (check digits, real dates, octets) of its value, dates are linked over layouts, equal values get equal pseudonyms in
every document (but where digits beside a card would make a longer or an earlier run valid, the walk goes on to a pseudonym for which they
don't; a rejected run that reaches into a second value isn't followed, so that rare text may not turn back), and who has the key can turn them back (``reverse=True``).

Whole texts are rewritten in tasks, without a shuffle. Null texts stay null, empty ones empty; ids, repeated rows
and other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh

KINDS = ("email", "ipv4", "iban", "ssn", "date", "card", "phone")
ROUNDS = 8
_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<ipv4>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w+])(?<!\d[.-])\d(?:[ -]?\d){12,18}(?!\w)(?!-\d))"
)
#: Length of an IBAN by country; elsewhere every length that ends at a blank is tried.
IBAN_LENGTH = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for c in cs.split()}
_TOKEN = re.compile(r"[ -]?[^ -]+")
_DIGITS = re.compile(r"\d")
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_EARLY = [k for k in range(_FIRST, _LAST + 1) if datetime.date.fromordinal(k).day <= 12]
_LATE = [k for k in range(_FIRST, _LAST + 1) if datetime.date.fromordinal(k).day > 12]


def feistel(value: int, size: int, key: bytes, tweak: str, reverse: bool = False) -> int:
    """A keyed permutation of range(size): Feistel rounds over two halves, walked until inside the range."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask, width = (1 << half) - 1, -(-half // 8)

    def mixed(r: int, x: int) -> int:
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(x.to_bytes(width, "big") + bytes([len(out) & 255]), key=key, salt=bytes([r]), person=hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if reverse else range(ROUNDS):
            left, right = (right ^ mixed(r, left), left) if reverse else (right, left ^ mixed(r, right))
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """0 if the last digit checks the others."""
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for k, d in enumerate(reversed(digits))) % 10


def refill(layout: str, chars: str) -> str:
    """The layout with its letters and digits replaced, in order."""
    left = iter(chars)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in layout)


class Cipher:
    """Pseudonyms of single values; None if a value is not valid, and so is left as it is."""

    def __init__(self, key: bytes, reverse: bool = False):
        self.key, self.reverse = key if len(key) <= 64 else hashlib.blake2b(key).digest(), reverse

    def move(self, value: int, size: int, tweak: str, ok: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            value = feistel(value, size, self.key, tweak, self.reverse)
            if ok(value):
                return value

    def digits(self, s: str, tweak: str, ok: Callable[[str], bool] = lambda _: True) -> str:
        n = len(s)
        return f"{self.move(int(s), 10**n, tweak, lambda v: ok(f'{v:0{n}d}')):0{n}d}"

    def classes(self, s: str, tweak: str) -> str:
        """Letters stay letters of their case, digits digits."""
        value, size, radix = 0, 1, []
        for c in s:
            first, n = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
            radix.append((first, n))
            value, size = value * n + ord(c) - ord(first), size * n
        value, out = self.move(value, size, tweak), []
        for first, n in reversed(radix):
            value, d = divmod(value, n)
            out.append(chr(ord(first) + d))
        return "".join(reversed(out))

    def email(self, s: str) -> str:
        head, _, tld = s.rpartition(".")
        return refill(head, self.classes("".join(c for c in head if c.isalnum()), "email")) + "." + tld

    def ipv4(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        a, b, c, d = map(int, parts)
        v = self.move(a << 24 | b << 16 | c << 8 | d, 1 << 32, "ipv4")
        return ".".join(str(v >> k & 255) for k in (24, 16, 8, 0))

    def iban(self, s: str) -> str | None:
        raw = s.replace(" ", "")
        value = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(raw) <= 34 or value(raw[4:] + raw[:4]) % 97 != 1:
            return None
        body = self.classes(raw[4:], "iban" + raw[:2])
        return refill(s, f"{raw[:2]}{98 - value(body + raw[:2] + '00') % 97:02d}{body}")

    def ssn(self, s: str) -> str | None:
        ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        raw = s.replace("-", "")
        return refill(s, self.digits(raw, "ssn", ok)) if ok(raw) else None

    def date(self, s: str) -> str | None:
        a, b, c = map(int, re.split(r"[./-]", s))
        order = "ymd" if s[4] == "-" else "dmy" if s[2] == "." else "mdy" if a <= 12 else "dmy"
        y, m, d = (dict(zip(order, (a, b, c), strict=True))[k] for k in "ymd")
        try:
            at = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not _FIRST <= at <= _LAST:
            return None
        # days that may be a month's number and later ones are moved among themselves, so every layout is read again as it was, and one date has one pseudonym in all layouts
        own = _EARLY if d <= 12 else _LATE
        day = datetime.date.fromordinal(own[self.move(bisect.bisect_left(own, at), len(own), "date" + ("early" if d <= 12 else "late"))])
        parts = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
        return (s[4] if order == "ymd" else s[2]).join(parts[k] for k in order)

    def card(self, s: str) -> str | None:
        raw = "".join(_DIGITS.findall(s))
        if luhn(raw):
            return None
        body = self.digits(raw[:-1], "card")
        return refill(s, body + str((10 - luhn(body + "0")) % 10))

    def phone(self, s: str) -> str | None:
        code = re.match(r"\+\d{1,3}(?=[ .(-])", s)
        skip = code.end() if code else 0
        raw = "".join(_DIGITS.findall(s[skip:]))
        return s[:skip] + refill(s[skip:], self.digits(raw, "phone")) if 7 <= len(raw) <= 15 else None

    def text(self, text: str) -> tuple[str, Counter]:
        counts: Counter = Counter()

        out, done, at = [], 0, 0
        tried: list[tuple[str, int, int]] = []  # spans that are not valid as read, so that reversal must reject them too

        def clash(new: str, a: int, b: int) -> bool:
            return len(new) == b - a and any(getattr(self, k)((text[i:a] + new + text[b:j])[: j - i]) is not None for k, i, j in tried if j > a)

        while m := _FIND.search(text, at):
            kind = m.lastgroup
            for end in self.ends(kind, m[0]):
                a, b = m.start(), m.start() + end
                if (new := getattr(self, kind)(text[a:b])) is not None:
                    while clash(new, a, b):  # one more step of the walk
                        new = getattr(self, kind)(new)
                    tried.clear()
                    counts[kind] += 1
                    out += [text[done:a], new]
                    done = at = b
                    break
                tried.append((kind, a, b))
            else:
                at = m.start() + _TOKEN.match(m[0]).end()
        return "".join([*out, text[done:]]), counts

    @staticmethod
    def ends(kind: str, s: str) -> list[int]:
        """Where a value may end inside a match: cards and IBANs at the borders of groups, longest first."""
        if kind not in ("card", "iban"):
            return [len(s)]
        ends = sorted({len(s), *(m.start() for m in re.finditer("[ -]", s))}, reverse=True)
        if kind == "card":
            return [e for e in ends if 13 <= len(_DIGITS.findall(s[:e])) <= 19]
        n = IBAN_LENGTH.get(s[:2])
        return [e for e in ends if n in (None, len(s[:e].replace(" ", "")))]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", reverse: bool = False) -> DataFrame:
    """``docs`` with its texts rewritten, and pii_<kind> counts after its own columns."""
    added = fresh(docs, *(f"pii_{k}" for k in KINDS))
    at = docs.columns.index(text_col)
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(secret, reverse)
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for text in batch.column(at).to_pylist():
                own: Counter = Counter()
                if text and (_DIGITS.search(text) or "@" in text):
                    text, own = cipher.text(text)
                texts.append(text)
                for k in KINDS:
                    counts[k].append(own[k])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int64()) for k in KINDS)], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)]))


def stage(docs: DataFrame, key: str) -> DataFrame:
    """The same columns, texts rewritten; n_chars follows the text."""
    out = pseudonymise(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
