"""The general detectors: rules as data, assignments, e-mail addresses and tokens of high entropy.

``matcher`` finds their candidates in one pass over the texts; what follows is scalar SQL over candidates: type, context, score, and why one is dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import words as W
from ..functions.dialect import SPARK as Q
from ..functions.dialect import Sql, python
from .matcher import Entry, matched
from .rules import FAIL_CLOSED, KNOWN_SECRET, PATTERNS, REGISTRY, Rule
from .spans import fenced, piecewise

# Expressions of the general detectors and of words that are no tokens.
ASSIGNMENT = (
    r"((?:[A-Za-z_][A-Za-z0-9_.-]{0,80})?(?:aws[_-]?secret[_-]?access[_-]?key|aws[_-]?session[_-]?token|pass(?:word)?|pwd|secret|token|api[_-]?key|openai(?:[_-]?api)?(?:[_-]?key)?|jwt|access[_-]?key|client[_-]?secret|private[_-]?key|account[_-]?key|cookie|session(?:[_-]?id|[_-]?secret)?|auth(?:orization)?|connection(?:string|_string)?|webhook))"
    r"\s*[:=]\s*"
    r"((?:\"[^\"\n\r]*\")|(?:'[^'\n\r]*')|(?:`[^`\n\r]*`)|(?:[^\s,;\"'`}]+))"
)
ASSIGNMENT_STEMS = ("pass", "pwd", "secret", "token", "api", "openai", "jwt", "key", "cookie", "session", "auth", "connection", "webhook")
PLAIN_WORDS = r"^(?:[A-Za-z]{4,24}|[A-Z][A-Z0-9_]{2,64}|[a-z]+(?:_[a-z]+)+|[a-z]+(?:-[a-z]+)+)$"
NO_PLAIN_WORD = rf"^(?!{PLAIN_WORDS[1:]})"
NAME, ASSIGNED, HEX = "^[A-Za-z_][A-Za-z0-9_.-]{0,80}$", r"""^["']?\s*[:=]""", "^[a-fA-F0-9]+$"
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
ENTROPY_TOKEN = r"\b[A-Za-z0-9+/_-]{8,}={0,2}\b"
RULES: tuple[Rule, ...] = REGISTRY + PATTERNS
URL_RULES = ("db_uri", "generic_uri_credentials")
DETECTORS = ("pattern", "registry", "assignment", "email", "entropy")
#: Order of the detectors, which breaks ties.
ORDER = {"pattern": 6, "registry": 7, "assignment": 8, "email": 16, "entropy": 24}


def source_of(rule: Rule) -> str:
    """Vendor rules carry a severity, pattern rules don't."""
    return "registry" if rule.severity else "pattern"


def entries(rules: Iterable[Rule] = RULES, detectors: Iterable[str] = DETECTORS) -> list[Entry]:
    """What the general detectors look for. ``rule``: its place in ``rules``."""
    wanted = set(detectors)
    out = [Entry(source_of(r), k, r.regex, r.flags, r.groups, r.markers) for k, r in enumerate(rules) if source_of(r) in wanted]
    if "assignment" in wanted:
        out.append(Entry("assignment", -1, ASSIGNMENT, "i", (2,), ASSIGNMENT_STEMS, 1))
    if "email" in wanted:
        out.append(Entry("email", -1, EMAIL, "i", (), ("@",)))
    if "entropy" in wanted:
        out.append(Entry("entropy", -1, ENTROPY_TOKEN, worth=NO_PLAIN_WORD, may=dense))
    return out


def dense(raw: str, before: str, after: str, far: int, words: int) -> bool:
    """Whether a token may pass the tests of entropy: at least 2.8 bits need seven characters, a key isn't its value; a hex token needs 32 characters, 3.45 bits and a label of secrets right
    before it; another one needs a word of secrets on its line, or 20 characters and 4.35 bits."""
    if len(set(raw)) < 7 or (python(ASSIGNED).search(after[:6]) and python(NAME).search(raw)):
        return False
    said = (words & W.SECRET) != 0 or (far & 32) != 0
    if python(HEX).search(raw):
        return said and len(raw) >= 32 and bits(raw) >= 3.45 and python(S.EXPLICIT_CONTEXT, "i").search(before) is not None
    return said or (len(raw) >= 20 and bits(raw) >= 4.35)


def bits(x: str) -> float:
    """Entropy of the characters, a little more than its rounded value in SQL at least."""
    return 1e-6 - sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())


def candidates(docs: DataFrame, rules: Iterable[Rule] = RULES, detectors: Iterable[str] = DETECTORS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), quick: bool = False) -> DataFrame:
    """One row a candidate of the chosen detectors, before suppression and scores. ``quick`` leaves out words of prose, which the entropy detector would drop later."""
    return matched(docs, entries(tuple(rules), detectors), text_col, keep, quick)


#: What a rule says, as columns of its candidates.
RULE_COLUMNS: dict[str, tuple[Callable[[Rule], object], object]] = {
    "name": (lambda r: r.name, ""),
    "rule_type": (lambda r: r.type, "SECRET"),
    "rule_category": (lambda r: r.category, "credential"),
    "rule_base": (lambda r: r.base, 0),
    "rule_high": (lambda r: r.severity == "high" and bool(r.reason), False),
    "rule_medium": (lambda r: r.severity == "medium", False),
    "rule_context": (lambda r: r.context, False),
    "rule_reason": (lambda r: r.reason, ""),
    "rule_provider": (lambda r: r.provider, ""),
}


def _rule_columns(rules: tuple[Rule, ...]) -> Column:
    """What its rule says of a candidate, as a struct."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else Q.text(v)
    row = lambda r: "named_struct(" + ", ".join(f"'{k}', {text(d if r is None else f(r))}" for k, (f, d) in RULE_COLUMNS.items()) + ")"
    return F.expr(f"element_at(array({', '.join(map(row, (*rules, None)))}), CASE WHEN rule >= 0 THEN rule + 1 ELSE {len(rules) + 1} END)")


def _window(radius: int) -> str:
    return f"lower(concat(right(before, {radius}), ' ', left(after, {radius})))"


def score_steps(s: Sql) -> list[dict[str, str]]:
    """Columns to add, step by step, to candidates with their rule's columns."""
    token = r"(?:^|[_-])(?:secret|token|password|passwd|pwd)(?:$|[_-]|\d)"
    allowed = S.entropy_allowed(s, "raw", "after")
    plus = "greatest(0, ctx)"
    registry = f"CASE WHEN rule_high THEN greatest(rule_base, 100) ELSE rule_base END + CASE WHEN entropy >= 4 THEN 2 ELSE 0 END + {plus}"
    with_login = f"name IN ('db_uri', 'generic_uri_credentials') AND {s.test('raw', '://[^/@]*:[^/@]+@')}"
    assign = (
        f"60 + CASE WHEN entropy >= 3.8 THEN 10 ELSE 0 END + CASE WHEN {S.variety(s, 'raw')} >= 3 THEN 8 ELSE 0 END + CASE WHEN length(raw) >= 20 THEN 8 ELSE 0 END"
        f" + CASE WHEN {s.test('raw', '^[A-Za-z0-9+/_=-]{20,}$')} THEN 6 ELSE 0 END + CASE type WHEN 'PASSWORD' THEN 6 WHEN 'AWS_SECRET_KEY' THEN 20 ELSE 0 END"
        f" + CASE WHEN type = 'API_KEY' AND {s.test('raw', r'\bsk-')} THEN 10 ELSE 0 END + {S.key_boost(s, 'key', 'raw')} + ctx"
    )
    entropy = "58 + least(6, greatest(0, ctx)) + CASE reason WHEN 'secret-context-entropy' THEN 10 WHEN 'base64ish-high-entropy' THEN 8 WHEN 'general-high-entropy' THEN 6 ELSE 0 END + CASE WHEN entropy >= 4.5 THEN 4 ELSE 0 END"
    method = (
        "CASE source WHEN 'registry' THEN " + s.compact("'provider-registry'", "'pattern'", "rule_reason", "CASE WHEN rule_context THEN 'context' END", "CASE WHEN rule_context THEN 'exact-key' END", "CASE WHEN rule_reason = 'database-url-credentials' THEN 'db-uri-password' END", "rule_provider")
        + " WHEN 'pattern' THEN " + s.compact("'pattern'", f"CASE WHEN {s.among('name', KNOWN_SECRET)} THEN 'known-secret-pattern' END", "CASE WHEN entropy >= 4 THEN 'entropy' END")
        + " WHEN 'assignment' THEN " + s.compact("'assignment'", "CASE WHEN entropy >= 3.8 THEN 'entropy' END")
        + " WHEN 'email' THEN " + s.compact("'email'", "'identity'")
        + " ELSE " + s.compact("'entropy'", "'heuristic'", "reason") + " END"
    )
    return [
        {"raw": S.unquoted(s, "raw")},
        {
            "ctx": S.context_score(s, _window(64)),
            "entropy": S.entropy(s, "raw"),
            "type": f"CASE source WHEN 'assignment' THEN {S.key_type(s, 'key')} WHEN 'email' THEN 'EMAIL' WHEN 'entropy' THEN 'SECRET' ELSE rule_type END",
            "category": "CASE WHEN source = 'email' THEN 'identity' ELSE rule_category END",
            "explicit": f"source = 'entropy' AND {S.explicit_context(s, 'before')}",
            "near": f"source = 'entropy' AND ({s.test('raw', token, 'i')} OR {S.secret_context(s, 'before', _window(96), '((far & 32) <> 0)')})",
        },
        {"reason": f"CASE WHEN source <> 'entropy' THEN '' WHEN {allowed} <> '' THEN {allowed} ELSE {S.entropy_reason(s, 'raw', 'explicit', 'near')} END"},
        {"entropy_redact": S.entropy_redact(s, "raw", "reason", "explicit"), "points": f"CASE source WHEN 'registry' THEN CASE WHEN rule_medium THEN least({registry}, {S.HIGH - 1}) ELSE {registry} END WHEN 'pattern' THEN rule_base + CASE WHEN entropy >= 4 THEN 6 ELSE 0 END + CASE WHEN {with_login} THEN 14 ELSE 0 END + ctx WHEN 'assignment' THEN {assign} WHEN 'email' THEN 82 + {plus} ELSE {entropy} END"},
        {"score": S.bounded("points"), "method": method, "detector": "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDER.items()) + " END"},
        {"severity": S.severity("score")},
    ]


def known(sql: str) -> str:
    """Spark SQL over scored candidates that takes what their columns hold: raw is trimmed and has its entropy."""
    host, named = S.example_host(Q, "raw"), Q.among("name", URL_RULES)
    return W.guarded(sql.replace(f"{host} AND {named}", f"{named} AND {host}").replace(Q.trim("raw"), "raw").replace(S.entropy(Q, "raw"), "entropy"))


def quick_steps() -> list[dict[str, str]]:
    """``score_steps`` for Spark: the same values, with each test behind the words that it needs and nothing computed twice."""
    first, second, *more = score_steps(Q)
    plain = f"CASE WHEN (words & {W.EDGE}L) = 0 THEN raw ELSE {first['raw']} END"
    # the words of a value that loses its quotes may run into those around it
    first = {"raw": plain, "words": f"CASE WHEN (words & {W.EDGE}L) = 0 THEN words ELSE {W.ALL}L END"}
    window = _window(64)
    second = {k: W.guarded(v) for k, v in second.items()}
    second["ctx"] = S.context_score(Q, window, lambda w: W.says(W.of(w)))
    label = Q.test(f"concat(before, ' ', {_window(96)})", rf"\b{S.SECRET_CONTEXT}\b", "i")
    assert label in second["near"]
    second["near"] = second["near"].replace(label, f"({W.says(W.SECRET)} AND {label})")
    more = [{k: known(v) for k, v in step.items()} for step in more]
    for k in ("reason", "entropy_redact"):
        step = next(x for x in more if k in x)
        step[k] = f"CASE WHEN {piecewise('source', 'x', "x = 'entropy'")} THEN {step[k]} ELSE {"''" if k == 'reason' else 'false'} END"
    return [first, second, *more]


def suppress_sql(s: Sql, allow: Iterable[str] = ()) -> str:
    """Why a candidate is dropped, or null. The tests are in order; the first that holds gives the reason."""
    raw, key = "raw", "key"
    line = "lower(concat(before, raw, after))"
    registry_identity = "(source = 'registry' AND type IN ('EMAIL', 'USERNAME'))"
    closed = f"(NOT {S.template_marker(s, raw)} AND {s.among('name', FAIL_CLOSED)} AND source = 'pattern')"
    closed_key = f"(source = 'assignment' AND NOT {S.template_marker(s, raw)} AND ({S.credential_key(s, key)} OR {S.credential_value(s, raw)}))"
    fail_closed = f"({closed} OR {closed_key})"
    sensitive = f"(source = 'assignment' AND {S.sensitive_key(s, key)})"
    false_line = f"(({s.test(line, S.FALSE_CONTEXT, 'i')} OR ((far & 1) <> 0)) AND NOT {sensitive} AND NOT {s.test('name', S.VENDOR_RULES, 'i')})"
    far = lambda bit: f"((far & {bit}) <> 0)"
    prose = f"source = 'pattern' AND {s.test('name', '^(?:natural_language_|labelled_|real_value_label|quoted_secret_label)')} AND ({s.test('lower(before)', S.PROSE_CONTEXT, 'i')} OR {far(4)})"
    identity_line = f"({s.test('lower(before)', r'\b(?:docs?|documentation|tutorial|example|sample|dummy|fake|template|mock|mailto)\b')} OR {s.test('lower(before)', r'\b(?:https?|wss?|ftp|sftp):\/\/|[?&][A-Za-z0-9_.-]*=$', 'i')} OR {far(8)})"
    email_bad = (
        f"source = 'email' AND ({S.has_token(s, raw)} OR {S.example_like(s, raw)} OR {S.template_marker(s, raw)} OR {s.test(raw, r'@example\.(?:com|org|net)$', 'i')}"
        f" OR {s.test('before', r'\b(?:https?|wss?|ftp|sftp|mailto):[^\s\x22\x27`<>]*$', 'i')} OR {s.test('before', r'(?:[?&][A-Za-z0-9_.-]*=)[^\s\x22\x27`<>]*$', 'i')}"
        f" OR {s.test('concat(before, raw, after)', r'\b(?:import|from|require|include)\b')} OR {far(16)} OR ctx <= -8)"
    )
    entropy_bad = f"source = 'entropy' AND ({s.test(raw, r'^pk_(?:live|test)_[0-9A-Za-z]{16,}$', 'i')} OR {s.test(raw, r'^[A-Z]{2,10}[a-z]+$')} OR {s.test(raw, r'^\d+$')} OR NOT entropy_redact)"
    assigned = S.key_before(s, "before", "{0,80}", "[:=]")
    cases = [
        (f"{raw} = ''", "empty"),
        (f"source = 'assignment' AND (length(raw) < 8 OR {S.safe_key(s, key)})", "safe-key"),
        (f"source = 'assignment' AND {S.vendor_hex(s, key, raw)}", "vendor-hex"),
        (f"source = 'entropy' AND {S.vendor_hex(s, assigned, raw)}", "vendor-hex"),
        (f"source = 'assignment' AND type = 'TOKEN' AND {s.test('lower(key)', 'cookie|session|auth|token')} AND length(raw) < 16 AND NOT {S.structured_secret(s, raw)}", "short-session"),
        (f"source = 'registry' AND {S.clean_token(s, raw)}", "placeholder"),
        (prose, "prose"),
        (email_bad, "identity"),
        (entropy_bad, "entropy"),
        (S.template_value(s, raw), "template"),
        (f"{S.has_token(s, raw)} AND NOT {S.clean_token(s, raw)} AND {S.benign_composite(s, raw)}", "composite"),
        (f"source = 'assignment' AND type NOT IN ('DB_URI', 'CONNECTION_STRING') AND ({s.test('before', S.FALSE_CONTEXT, 'i')} OR {far(2)})", "prose"),
        (f"{registry_identity} AND {identity_line}", "identity"),
        (f"source <> 'email' AND {false_line} AND NOT {fail_closed} AND NOT {registry_identity}", "false-context"),
        (f"{S.example_like(s, raw)} AND name NOT IN ('aws_access_key', 'google_api_key') AND NOT {fail_closed}", "example"),
        (f"{S.example_host(s, raw)} AND {s.among('name', URL_RULES)}", "example-host"),
        (f"source <> 'email' AND ctx <= -14 AND NOT {fail_closed} AND NOT {registry_identity}", "context"),
    ]
    allow = tuple(allow)
    if allow:
        cases.insert(1, (f"{s.among(raw, allow)} OR {s.among(S.unquoted(s, raw), allow)}", "allow-list"))
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in cases) + " END"


def scored(found: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Candidates with type, category, context score, entropy, score and methods."""
    out = found.withColumn("_rule", _rule_columns(tuple(rules)))
    out = out.withColumns({k: F.col(f"_rule.{k}") for k in RULE_COLUMNS})
    # a step isn't folded into the next one, since that reads its columns more than once; a fence here would copy every column
    for step in quick_steps():
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out.withColumn("seq", F.struct("detector", "rule", "order"))


def judge(found: DataFrame, rules: Iterable[Rule] = RULES, allow: Iterable[str] = (), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidates with their scores and, in ``why``, the reason if one is dropped."""
    found = fenced(scored(found, rules).withColumn("why", F.expr(known(suppress_sql(Q, allow)))))
    return found.select(*keep, "seq", "source", "name", "type", "category", "raw", "start", "end", "score", "severity", "method", "why")


def judged(docs: DataFrame, rules: Iterable[Rule] = RULES, detectors: Iterable[str] = DETECTORS, allow: Iterable[str] = (), keep: tuple[str, ...] = ("doc_id",), quick: bool = False, **names) -> DataFrame:
    """Every candidate of the documents, judged."""
    rules = tuple(rules)
    return judge(candidates(docs, rules, detectors, keep=keep, quick=quick, **names), rules, allow, keep)
