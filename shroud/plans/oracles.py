"""SQL for DuckDB that gives the rows of the registered queries.

Relational parts (spans, joins, windows, sets) are written on their own; scalar predicates and scores are rendered from their one definition
in this engine's dialect.
"""

from __future__ import annotations

import re

from ..functions import scalars as S
from ..functions.dialect import DUCKDB as Q
from ..functions.dialect import re2
from ..operators import detect, findings, gate, learn, metadata, scored, structured
from ..operators.network import RANGES
from ..operators.structured import KINDS
from ..sources import files
from .queries import APPROVED, BLOCKED, DESTINATIONS
from .views import VIEWS

RULES = detect.RULES


_FIELD = r"<([A-Za-z0-9_.:-]*(?:api[_-]?key|apikey|password|passwd|pwd|token|secret|client[_-]?secret)[A-Za-z0-9_.:-]*)\b[^>]*>\s*([^<\r\n]{8,256})\s*<\/([A-Za-z0-9_.:-]+)>"
#: Rules with lookaround or back-references, in plain expressions with a test of what was matched.
PLAIN = {
    "R08": (r"""\bhttps?:\/\/[^\s"'`<>?]+\?[^\s"'`<>#]*[?&]sig=([^&#\s"'`<>]+)""", " AND ".join(f"regexp_matches(matched, '\\b{k}=')" for k in ("sv", "se", "sp", "sr"))),
    "P31": (_FIELD, "lower(regexp_extract(matched, {0}, 1)) = lower(regexp_extract(matched, {0}, 3))"),
    "P35": (r"""\b(?:my|the|our)?\s*secret\s*(?:is|=|:)\s*(?:"([^"\r\n]{8,})"|'([^'\r\n]{8,})'|`([^`\r\n]{8,})`|([^\s,;]{8,}))""", r"regexp_matches(raw, '[0-9_!@#$%^&*+=:.?/~\\-]')"),
    "P44": (r"\b(?:Authorization|AUTH_HEADER|BASIC_AUTH|Basic_Auth)\b\s*[:=]\s*Basic\s+([A-Za-z0-9+/]{16,}(?:={1,2})?)(?:$|[\s,;])", "true"),
}


def _rx(pattern: str, flags: str = "") -> str:
    return "'" + re2(pattern, flags).replace("'", r"\x27") + "'"


def _parsed(pattern: str, at: int = 0, found: list[int] | None = None) -> tuple[list, int]:
    """Alternatives of an expression as lists of items (text or group, quantifier); a group is (opening, alternatives, its number or 0)."""
    found = [0] if found is None else found
    out, items = [], []
    while at < len(pattern) and pattern[at] != ")":
        c = pattern[at]
        if c == "|":
            out.append(items)
            items, at = [], at + 1
            continue
        if c == "(":
            opening = re.match(r"\((?:\?(?:[:=!]|<[=!]|[a-z]+:))?", pattern[at:]).group()
            number = 0
            if opening == "(":
                found[0] += 1
                number = found[0]
            inner, at = _parsed(pattern, at + len(opening), found)
            atom, at = (opening, inner, number), at + 1
        elif c == "[":
            atom = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", pattern[at:], re.S).group()
            at += len(atom)
        else:
            atom = pattern[at : at + 2] if c == "\\" else c
            if atom in (r"\x", r"\u"):
                atom = pattern[at : at + (4 if atom == r"\x" else 6)]
            at += len(atom)
        more = re.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?", pattern[at:])
        items.append((atom, more.group() if more else ""))
        at += len(items[-1][1])
    return [*out, items], at


def placed(pattern: str, group: int) -> tuple[str, int, list[int]]:
    """The expression with what comes before a group in groups of its own: their lengths add up to the group's place in a match. Also its number there, and theirs."""
    count, ahead, number = 0, [], 0

    def holds(atom) -> bool:
        return isinstance(atom, tuple) and (atom[2] == group or any(holds(a) for items in atom[1] for a, _ in items))

    def text(atom) -> str:
        nonlocal count, number
        if isinstance(atom, str):
            return atom
        if atom[0] == "(":
            count += 1
            if atom[2] == group:
                number = count
        return atom[0] + "|".join(map(written, atom[1])) + ")"

    def written(items: list) -> str:
        nonlocal count
        at = next((k for k, (a, _) in enumerate(items) if holds(a)), 0)
        if not at:
            return "".join(text(a) + q for a, q in items)
        count += 1
        ahead.append(count)
        return "(" + "".join(text(a) + q for a, q in items[:at]) + ")" + "".join(text(a) + q for a, q in items[at:])

    out = "|".join(map(written, _parsed(pattern)[0]))
    return out, number, ahead


def _spans(text: str, pattern: str, flags: str = "", groups: tuple[int, ...] = (), keys: str = "doc_id", where: str = "true", source: str = "d") -> str:
    """keys, j, m (match), raw, start, end of all matches. A group's place is told by the lengths of what comes before it in the match."""
    rx = _rx(pattern, flags)
    picked, raw, within = "", "m[j]", "0"
    for k, g in reversed(list(enumerate(groups))):
        with_places, number, ahead = placed(pattern, g)
        own = _rx(with_places, flags)
        picked += f", regexp_extract_all({text}, {own}, {number}) AS g{k}" + "".join(f", regexp_extract_all({text}, {own}, {a}) AS g{k}_{i}" for i, a in enumerate(ahead))
        raw = f"coalesce(nullif(g{k}[j], ''), {raw})"
        within = f"CASE WHEN g{k}[j] <> '' THEN {' + '.join(['0', *(f'len(g{k}_{i}[j])' for i in range(len(ahead)))])} ELSE {within} END"
    first = "coalesce(list_sum(list_transform(gap[1:j], lambda z: len(z))), 0) + coalesce(list_sum(list_transform(m[1:j - 1], lambda z: len(z))), 0)"
    inner = f"SELECT {keys}, {text} AS t, regexp_extract_all({text}, {rx}) AS m, string_split_regex({text}, {rx}) AS gap{picked} FROM {source} WHERE {where} AND regexp_matches({text}, {rx})"
    each = f"SELECT *, unnest(range(1, len(m) + 1)) AS j FROM ({inner})"
    one = f"SELECT {keys}, t, j, m[j] AS matched, {raw} AS raw, CAST({first} + {within} AS INTEGER) AS start FROM ({each})"
    return f"SELECT {keys}, t, j, matched, raw, start, start + len(raw) AS \"end\" FROM ({one})"


_CONTEXT = "string_split(left(t, start), chr(10))[-1] AS before, regexp_replace(string_split(substr(t, \"end\" + 1), chr(10))[1], '\\r\\z', '') AS after, 0 AS far"


def _candidates(detectors: tuple[str, ...], docs: str, rules: tuple = RULES, quick: bool = False) -> str:
    """Judged candidates. ``quick``: without the words of prose that the entropy detector drops anyway."""
    parts = []
    field = _rx(_FIELD, "i")
    add = lambda source, rule, key, body: parts.append(
        f"SELECT doc_id, '{source}' AS source, {rule} AS rule, CAST(j - 1 AS INTEGER) AS ord, start, \"end\", raw, {key} AS key, {_CONTEXT} FROM ({body})"
    )
    for k, r in enumerate(RULES):
        source = "registry" if r in detect.REGISTRY else "pattern"
        if r in rules and source in detectors:
            marks = " OR ".join(f"contains(lower(t), {Q.text(m)})" for m in r.markers)
            regex, test = PLAIN.get(r.id, (r.regex, "true"))
            found = _spans("t", regex, r.flags, r.groups, where=f"({marks})").replace("t AS t, ", "t, ")
            add(source, k, "''", f"SELECT * FROM ({found}) WHERE {test.replace('{0}', field)}")
    if "assignment" in detectors:
        add("assignment", -1, Q.extract("matched", detect.ASSIGNMENT, 1, "i"), _spans("t", detect.ASSIGNMENT, "i", (2,)))
    if "email" in detectors:
        add("email", -1, "''", _spans("t", detect.EMAIL, "i"))
    if "entropy" in detectors:
        tokens = _spans("t", detect.ENTROPY_TOKEN)
        add("entropy", -1, "''", f"SELECT * FROM ({tokens}) WHERE NOT {Q.test('raw', detect.PLAIN_WORDS)}" if quick else tokens)
    lit = lambda v: "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else Q.text(v)
    table = "SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(lit(f(r)) for f, _ in detect.RULE_COLUMNS.values()) + ")" for k, r in enumerate(RULES)) + f") r(rule, {', '.join(detect.RULE_COLUMNS)})"
    cols = ", ".join(f"coalesce(r.{c}, {lit(d)}) AS {c}" for c, (_, d) in detect.RULE_COLUMNS.items())
    sql = f"SELECT c.*, {cols} FROM ({' UNION ALL '.join(parts)}) c LEFT JOIN rules r ON r.rule = c.rule"
    for step in detect.score_steps(Q):
        replaced = [k for k in step if k == "raw"]
        star = f"* EXCLUDE ({', '.join(replaced)})" if replaced else "*"
        sql = f"SELECT {star}, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return f"WITH docs AS ({docs}), d AS (SELECT doc_id, coalesce(text, '') AS t FROM docs WHERE trim(coalesce(text, '')) <> ''), rules AS ({table}), judged AS (SELECT *, {{why}} AS why FROM ({sql}))"


def judged(detectors: tuple[str, ...] = detect.DETECTORS, docs: str = VIEWS["v_secret_lines"], allow: tuple[str, ...] = (), quick: bool = False) -> str:
    return _candidates(detectors, docs, quick=quick).replace("{why}", detect.suppress_sql(Q, allow))


_BEST = """best AS (SELECT * FROM (SELECT *, min([detector, rule, ord]) OVER s AS seq, row_number() OVER (s ORDER BY score DESC, len(method) DESC, detector, rule, ord) AS r FROM found WINDOW s AS (PARTITION BY doc_id, start, "end", raw)) WHERE r = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, list_contains(method, 'full-value') DESC, list_contains(method, 'exact-key') DESC, "end" - start DESC, start, seq) AS rk FROM best),
chosen(doc_id, rk, kept) AS (SELECT doc_id, 1::BIGINT, [{'s': start, 'e': "end", 'k': rk}] FROM ranked WHERE rk = 1
  UNION ALL SELECT r.doc_id, r.rk, CASE WHEN len(list_filter(c.kept, lambda x: r.start < x.e AND r."end" > x.s)) > 0 THEN c.kept ELSE list_append(c.kept, {'s': r.start, 'e': r."end", 'k': r.rk}) END FROM chosen c JOIN ranked r ON r.doc_id = c.doc_id AND r.rk = c.rk + 1),
final AS (SELECT r.* FROM ranked r JOIN (SELECT doc_id, unnest(arg_max(kept, rk)) AS k FROM chosen GROUP BY 1) c ON c.doc_id = r.doc_id AND c.k.k = r.rk)"""


def _decoded(x: str) -> str:
    broken = f"regexp_matches({x}, '%(?:$|[^0-9A-Fa-f]|[0-9A-Fa-f](?:$|[^0-9A-Fa-f]))')"
    return f"CASE WHEN contains({x}, '%') AND NOT {broken} THEN coalesce(TRY(url_decode(replace({x}, '+', '%2B'))), {x}) ELSE {x} END"


def _scored_rows(source: str, detectors: tuple = scored.DETECTORS) -> str:
    """Kept candidates of the scored detectors over the texts ``t`` of ``source``."""
    parts = []
    for k, d in enumerate(detectors):
        marks = " OR ".join(f"contains(lower(t), {Q.text(m)})" for m in d.markers) or "true"
        plain = d.regex.replace("(?=", "(?:")  # what ends a URL may be read: no two logins share it
        found = _spans("t", plain, d.flags, d.groups, where=f"({marks})", source=source).replace("t AS t, ", "t, ")
        key = Q.extract("matched", plain, d.key, d.flags) if d.key else "''"
        if d.inner:
            outer = f"SELECT doc_id, t AS whole, j AS outer_j, raw, start AS first, {key} AS outer_key FROM ({found})"
            inside = _spans("raw", d.inner[0], d.inner[1], d.inner[2], "doc_id, whole, outer_j, first, outer_key", source=f"({outer})").replace("raw AS t, ", "raw AS t, ")
            own = Q.extract("matched", d.inner[0], d.inner[3], d.inner[1]) if d.inner[3] else "outer_key"
            found = f'SELECT doc_id, whole AS t, outer_j * 1000 + j AS j, raw, CAST(first + start AS INTEGER) AS start, CAST(first + "end" AS INTEGER) AS "end", {own} AS key FROM ({inside})'
            key = "key"
        parts.append(f'SELECT doc_id, {k} AS rule, CAST(j - 1 AS INTEGER) AS ord, {_decoded("raw") if d.decoded else "raw"} AS found, {key} AS key, start, "end", {_CONTEXT} FROM ({found}) WHERE {Q.test("raw", d.worth) if d.worth else "true"}')
    sql = " UNION ALL ".join(parts)
    for step in scored.steps(Q, detectors):
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return f"SELECT * FROM ({sql}) WHERE kept AND points >= least"


def _metadata_rows(k: int, kinds: tuple[metadata.Kind, ...] = metadata.KINDS) -> str:
    d = kinds[k]
    return f"SELECT doc_id, {k} AS k, CAST(j - 1 AS INTEGER) AS ord, '{d.id}' AS detector, '{d.type}' AS type, '{d.category}' AS category, raw, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", {d.score} AS score FROM ({_spans('t', d.regex, d.flags, (d.group,) if d.group else ())})"


def _adjacent_rows(source: str) -> str:
    """Credentials whose label, or other half, stands on the line before."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    like = lambda c, x: f"regexp_matches({c}, {q(x)})"
    secret = f"({like('b', structured.AWS_LABEL)} AND {like('b', '(?i)' + chr(92) + 'bsecret' + chr(92) + 'b')})"
    cases = (
        ("C12", "API_KEY", 90, f"{like('b', structured.PROVIDER_LABEL)} AND NOT {like('b', structured.EXAMPLES)}", structured.PROVIDER_VALUE), ("C13", "AWS_SECRET_KEY", 98, secret, structured.AWS_SECRET),
        ("C13", "AWS_KEY", 94, f"{like('b', structured.AWS_LABEL)} AND NOT {secret}", structured.AWS_KEY), ("C14", "AWS_SECRET_KEY", 97, like("b", structured.AWS_KEY), structured.AWS_SECRET),
    )
    rows = f"""SELECT doc_id, k, regexp_replace(l[k], '\\r\\z', '') AS x, regexp_replace(l[k - 1], '\\r\\z', '') AS b, coalesce(list_sum(list_transform(l[1:k - 1], lambda z: len(z) + 1)), 0) AS first FROM (SELECT doc_id, l, unnest(range(2, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM {source}))"""
    each = " UNION ALL ".join(f"SELECT doc_id, '{d}' AS detector, '{t}' AS type, 'credential' AS category, regexp_extract(x, {q(rx)}, 1) AS raw, {n} AS score, x, first FROM lines_ WHERE {ok} AND {like('x', rx)}" for d, t, n, ok, rx in cases)
    return f"WITH lines_ AS ({rows}) SELECT doc_id, detector, type, category, raw, score, CAST(first + instr(x, raw) - 1 AS INTEGER) AS start, CAST(first + instr(x, raw) - 1 + len(raw) AS INTEGER) AS \"end\" FROM ({each})"


def resolved(select: str, detectors: tuple[str, ...] = findings.ALL, docs: str = VIEWS["v_secret_lines"], more: str = "") -> str:
    general = tuple(d for d in detectors if d not in findings.MORE)
    own = 'doc_id, source, detector, rule, ord, type, category, raw, start, "end", score, severity, method'
    parts = [f"SELECT {own} FROM judged WHERE why IS NULL"]
    if "scored" in detectors:
        parts.append(f"SELECT doc_id, 'scored', place, rule, ord, type, category, raw, CAST(from_ AS INTEGER), CAST(to_ AS INTEGER), score, severity, method FROM ({_scored_rows('d')})")
    fixed = lambda source, place, rule, ord, body: f"SELECT doc_id, '{source}', {place}, {rule}, {ord}, type, category, raw, start, \"end\", score, {S.severity('score')}, ['{source}'] FROM ({body})"
    if "metadata" in detectors:
        parts.append(fixed("metadata", findings.METADATA_PLACE, f"k + {findings.METADATA_RULE}", "ord", " UNION ALL ".join(map(_metadata_rows, range(len(metadata.KINDS))))))
    if "adjacent" in detectors:
        parts.append(fixed("adjacent", "CAST(substr(detector, 2, 2) AS INTEGER)", "0", "start", _adjacent_rows("d")))
    return judged(general, docs, quick=True).replace("WITH docs", "WITH RECURSIVE docs", 1) + f", found({own}) AS ({' UNION ALL '.join(parts)}), " + _BEST + more + " " + select


_TOKENS = f"(SELECT doc_id, regexp_split_to_array(text, '[ =]')[-1] AS v, regexp_extract(text, '^([A-Za-z_]+)[=:]', 1) AS k FROM ({VIEWS['v_secret_lines']}))"


def _columns(source: str, **columns: str) -> str:
    return f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source}"


_KEYS = _columns(_TOKENS, key_type=S.key_type(Q, "k"), normal=S.normal_key(Q, "k"), compact=S.compact_key(Q, "k"), safe=S.safe_key(Q, "k"), exact=S.credential_key(Q, "k"), inline_secret=S.inline_key(Q, "k"), sensitive=S.sensitive_key(Q, "k"), obfuscated=S.obfuscated_key(Q, "k"), value_like=S.credential_value(Q, "v"), provider=S.provider_token(Q, "k", "v"), boost=S.key_boost(Q, "k", "v"), db_uri=S.db_uri_key(Q, "k"), connection=S.connection_key(Q, "k"), prose_type=S.disclosure_type(Q, "k"))
_VALUES = _columns(_TOKENS, template=S.template_value(Q, "v"), example=S.example_like(Q, "v"), marker=S.template_marker(Q, "v"), host=S.example_host(Q, "v"), token=S.has_token(Q, "v"), clean=S.clean_token(Q, "v"), benign=S.benign_composite(Q, "v"), unquoted=S.unquoted(Q, "v"))
_ENTROPY = f"""WITH a AS (SELECT doc_id, text, regexp_split_to_array(text, '[ =]')[-1] AS v FROM ({VIEWS["v_secret_lines"]})),
b AS (SELECT *, left(text, len(text) - len(v)) AS b FROM a), c AS (SELECT *, lower(concat(right(b, 96), ' ')) AS w FROM b),
e AS (SELECT *, {S.explicit_context(Q, "b")} AS ex, {S.secret_context(Q, "b", "w")} AS near, {S.entropy_allowed(Q, "v", "''")} AS allowed FROM c), f AS (SELECT *, {S.entropy_reason(Q, "v", "ex", "near")} AS reason FROM e)
SELECT doc_id, ex, near, allowed, reason, {S.entropy_redact(Q, "v", "reason", "ex")} AS redact FROM f"""

_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(regexp_extract_all(x, '(?s).'), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_TOKEN = _rx(S.TOKEN)
_B48 = f"""WITH a AS (SELECT doc_id, concat(text, ' and [API_KEY_', doc_id % 50, '] [NET_1_SUB_2]') AS text FROM ({VIEWS["v_secret_lines"]})),
t AS (SELECT doc_id, regexp_extract_all(text, {_TOKEN}) AS t, string_split_regex(text, {_TOKEN}) AS g FROM a),
c AS (SELECT *, list_transform(t, lambda x: CASE WHEN {Q.test("x", S.CLEAN_TOKEN)} THEN x ELSE concat('[PWM_', 1000000 + {_FNV}, ']') END) AS c FROM t)
SELECT doc_id, array_to_string(c, ',') AS tokens, concat(g[1], array_to_string(list_transform(range(1, len(c) + 1), lambda i: concat(c[i], g[i + 1])), '')) AS canonical FROM c"""

_NET = f"""n0 AS (SELECT doc_id, session_id, seq, text, unnest(range(1, len(w) + 1)) AS j, w FROM (SELECT *, string_split(text, ' ') AS w FROM ({VIEWS["v_net_lines"]}))),
n1 AS (SELECT doc_id, session_id, seq, text, w[j] AS raw, CAST(coalesce(list_sum(list_transform(w[1:j - 1], lambda z: len(z) + 1)), 0) AS INTEGER) AS start FROM n0 WHERE regexp_full_match(w[j], '(?:(?:0|[1-9][0-9]{{0,2}})[.]){{3}}(?:0|[1-9][0-9]{{0,2}})(?:/(?:3[0-2]|[12]?[0-9]))?')),
n2 AS (SELECT *, start + len(raw) AS "end", NOT contains(raw, '/') AS is_host, CASE WHEN contains(raw, '/') THEN CAST(split_part(raw, '/', 2) AS INTEGER) ELSE 32 END AS prefix, list_transform(string_split(split_part(raw, '/', 1), '.'), lambda x: CAST(x AS BIGINT)) AS o FROM n1),
n3 AS (SELECT *, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS a, CAST(pow(2, 32 - prefix) AS BIGINT) AS size FROM n2 WHERE len(list_filter(o, lambda x: x > 255)) = 0),
n4 AS (SELECT *, a - a % size AS start_int, a - a % size + size - 1 AS end_int FROM n3),
n5 AS (SELECT *, concat_ws('.', start_int // 16777216 % 256, start_int // 65536 % 256, start_int // 256 % 256, start_int % 256) AS dotted,
  CASE WHEN NOT is_host AND prefix = 0 THEN 'default_route' WHEN is_host AND start_int = 4294967295 THEN 'broadcast' {" ".join(f"WHEN start_int >= {b} AND end_int <= {b + (1 << 32 - p) - 1} THEN '{k}'" for k, b, p in RANGES)} ELSE 'public' END AS scope FROM n4),
n AS (SELECT doc_id, session_id, seq, raw, start, "end", CASE WHEN is_host THEN dotted ELSE concat(dotted, '/', prefix) END AS canonical, prefix, start_int, end_int, is_host, scope = 'public' AS is_public, scope,
  concat(CASE WHEN scope IN ('default_route', 'broadcast') THEN 'special' WHEN scope = 'public' THEN 'public' ELSE 'private' END, CASE WHEN is_host THEN '_host' ELSE '_subnet' END) AS kind,
  CASE WHEN NOT is_host THEN NULL WHEN regexp_matches(right(left(text, start), 24), '(?i)(?:^|[\\s(\\[,;{{])(?:default gateway|gateway|gw)\\s*(?:is|=|:)?\\s*$') THEN 'GW' WHEN regexp_matches(right(left(text, start), 24), '(?i)(?:^|[\\s(\\[,;{{])vip\\s*(?:is|=|:)?\\s*$') THEN 'VIP' WHEN regexp_matches(right(left(text, start), 24), '(?i)(?:^|[\\s(\\[,;{{])(?:dns|name server|resolver)\\s*(?:is|=|:)?\\s*$') THEN 'DNS' END AS role FROM n5)"""
_TREE = """, o AS (SELECT session_id, canonical, prefix, start_int, end_int, is_host, min({'q': seq, 's': start, 'r': role}) AS f FROM n WHERE {where} GROUP BY ALL),
p AS (SELECT o.*, (SELECT arg_max(b.canonical, b.prefix) FROM o b WHERE b.session_id = o.session_id AND NOT b.is_host AND b.start_int <= o.start_int AND b.end_int >= o.end_int AND b.prefix < o.prefix) AS parent FROM o)"""
_NAMES = """, s AS (SELECT *, row_number() OVER (PARTITION BY session_id, parent ORDER BY prefix, start_int, canonical) AS k FROM p WHERE NOT is_host),
tree AS (SELECT session_id, canonical, parent, concat('NET_', k) AS body FROM s WHERE parent IS NULL UNION ALL SELECT s.session_id, s.canonical, s.parent, concat(t.body, '_SUB_', s.k) FROM s JOIN tree t ON t.session_id = s.session_id AND t.canonical = s.parent),
h0 AS (SELECT *, f.r AS role, row_number() OVER (PARTITION BY session_id, parent ORDER BY f.q, f.s, canonical) AS k, f.r IS NOT NULL AND row_number() OVER (PARTITION BY session_id, parent, f.r ORDER BY f.q, f.s, canonical) = 1 AS owns FROM p WHERE is_host),
h1 AS (SELECT *, row_number() OVER (PARTITION BY session_id, parent, owns ORDER BY f.q, f.s, canonical) AS kk FROM h0),
names AS (SELECT * FROM tree UNION ALL SELECT session_id, canonical, parent, concat_ws('_', concat('PUB_HOST_', k), role) FROM h1 WHERE parent IS NULL
  UNION ALL SELECT h1.session_id, h1.canonical, h1.parent, CASE WHEN owns THEN concat(t.body, '_', role) ELSE concat(t.body, '_HOST_', kk) END FROM h1 JOIN tree t ON t.session_id = h1.session_id AND t.canonical = h1.parent)"""


def _net(select: str, where: str = "true", tree: bool = False, names: bool = False) -> str:
    return "WITH RECURSIVE " + _NET + (_TREE.replace("{where}", where) if tree or names else "") + (_NAMES if names else "") + " " + select


_SEEN = f"seen AS (SELECT doc_id, session_id, unnest(regexp_extract_all(text, {_TOKEN})) AS token FROM ({VIEWS['v_secret_lines']})), used AS (SELECT session_id, 'PWM' AS family, max(CAST(regexp_extract(token, '_([0-9]+)', 1) AS BIGINT)) AS last FROM seen GROUP BY 1)"
_VAULT = """, s AS (SELECT v.session_id, v.seq, j.doc_id, j.start, j.raw FROM judged j JOIN docs v ON v.doc_id = j.doc_id WHERE why IS NULL),
firsts AS (SELECT session_id, raw, min([seq, doc_id, start]) AS f FROM s GROUP BY 1, 2),
vault AS (SELECT firsts.session_id, firsts.raw, {last} + row_number() OVER (PARTITION BY firsts.session_id ORDER BY f, firsts.raw) AS index FROM firsts {join}),
v AS (SELECT *, 'PWM' AS family, concat('[PWM_', index, ']') AS placeholder FROM vault)"""


def _vault(select: str, used: bool = False) -> str:
    body = _VAULT.replace("{last}", "coalesce(u.last, 0)" if used else "0").replace("{join}", "LEFT JOIN used u ON u.session_id = firsts.session_id" if used else "")
    return judged(("registry",)) + ", " + _SEEN + body + " " + select


_SPLICE = """, sp AS (SELECT doc_id, list({'s': start, 'e': "end", 'p': placeholder} ORDER BY start) AS sp FROM spans GROUP BY 1)
SELECT {keys}, CASE WHEN sp IS NULL THEN text ELSE concat(array_to_string(list_transform(range(1, len(sp) + 1), lambda i: concat(substr(text, CASE WHEN i = 1 THEN 1 ELSE sp[i - 1].e + 1 END, sp[i].s - CASE WHEN i = 1 THEN 0 ELSE sp[i - 1].e END), sp[i].p)), ''), substr(text, sp[-1].e + 1)) END AS redacted, coalesce(len(sp), 0) AS n_replaced FROM docs LEFT JOIN sp ON sp.doc_id = docs.doc_id"""

def _redacted(source: str) -> str:
    """CTEs from the findings in ``final`` to ``secret_spans``: numbers behind those in sight, known values again, the longest first."""
    return f""", s AS (SELECT v.session_id, v.seq, j.doc_id, j.start, j."end", j.raw FROM final j JOIN docs v ON v.doc_id = j.doc_id),
sight AS (SELECT session_id, max(i) FILTER (i < 1000000) AS last FROM (SELECT session_id, CAST(regexp_extract(token, '^\\[PWM_([0-9]+)', 1) AS BIGINT) AS i FROM (SELECT session_id, unnest(regexp_extract_all(text, {_TOKEN})) AS token FROM docs) WHERE token LIKE '[PWM%') GROUP BY 1),
firsts AS (SELECT session_id, raw, min([seq, doc_id, start]) AS f FROM s GROUP BY 1, 2),
vault AS (SELECT f.session_id, raw, concat('[PWM_', coalesce(last, 0) + row_number() OVER (PARTITION BY f.session_id ORDER BY f, raw), ']') AS placeholder FROM firsts f LEFT JOIN sight ON sight.session_id = f.session_id),
held AS (SELECT d.doc_id, v.raw, v.placeholder, string_split(d.text, v.raw) AS g FROM docs d JOIN vault v ON v.session_id = d.session_id WHERE len(v.raw) >= 8 AND contains(d.text, v.raw)),
places AS (SELECT *, unnest(range(1, len(g))) AS j FROM held),
cand AS (SELECT s.doc_id, s.start, s."end", v.placeholder, 0 AS again FROM s JOIN vault v ON v.session_id = s.session_id AND v.raw = s.raw UNION ALL
  SELECT doc_id, list_sum(list_transform(g[1:j], lambda z: len(z))) + (j - 1) * len(raw), list_sum(list_transform(g[1:j], lambda z: len(z))) + j * len(raw), placeholder, 1 FROM places WHERE NOT starts_with(g[j + 1], '://')),
crank AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "end" - start DESC, again, start) AS rk FROM cand),
csteps(doc_id, rk, kept) AS (SELECT doc_id, 1::BIGINT, [{{'s': start, 'e': "end", 'k': rk}}] FROM crank WHERE rk = 1
  UNION ALL SELECT r.doc_id, r.rk, CASE WHEN len(list_filter(c.kept, lambda x: r.start < x.e AND r."end" > x.s)) > 0 THEN c.kept ELSE list_append(c.kept, {{'s': r.start, 'e': r."end", 'k': r.rk}}) END FROM csteps c JOIN crank r ON r.doc_id = c.doc_id AND r.rk = c.rk + 1),
{source} AS (SELECT r.doc_id, CAST(r.start AS INTEGER) AS start, CAST(r."end" AS INTEGER) AS "end", r.placeholder FROM crank r JOIN (SELECT doc_id, unnest(arg_max(kept, rk)) AS k FROM csteps GROUP BY 1) c ON c.doc_id = r.doc_id AND c.k.k = r.rk)"""


_R03 = resolved("", ("registry", "email"), more=_redacted("spans") + _SPLICE.replace("{keys}", "docs.doc_id, docs.session_id"))
#: Rows without an id, ids of four rows, rows without a session: for the SQL each row has an id and a session of its own.
_ODD = VIEWS["v_odd_rows"].replace("CASE WHEN seq % 5 = 0 THEN NULL ELSE seq - seq % 4 END AS doc_id", "seq AS doc_id").replace("CASE WHEN seq % 7 = 0 THEN NULL ELSE session_id END AS session_id", "CASE WHEN seq % 7 = 0 THEN '' ELSE session_id END AS session_id")
_R02 = resolved("", ("registry", "pattern", "email"), _ODD, more=_redacted("spans") + _SPLICE.replace("SELECT {keys}", ", out AS (SELECT docs.session_id, text") + ") SELECT nullif(session_id, '') AS session_id, text, redacted, n_replaced FROM out")
_R07 = _net(
    f""", docs AS ({VIEWS["v_net_lines"]}), spans AS (SELECT n.doc_id, n.start, n."end", concat('[', m.body, ']') AS placeholder FROM n JOIN names m ON m.session_id = n.session_id AND m.canonical = n.canonical WHERE n.is_public)""" + _SPLICE.replace("{keys}", "docs.doc_id"),
    "is_public", names=True,
)

_DOCS = "SELECT doc_id, source AS session_id, doc_id AS seq, coalesce(text, '') AS text FROM documents"
_IP = r"(?:^|[^0-9A-Za-z_.])((?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})(?:\/(?:3[0-2]|[12]?\d))?)(?:$|[^0-9A-Za-z_])"
#: The same steps over tokens found in running text.
_NET_TEXT = _NET.replace(_NET[: _NET.index("n2 AS")], f"n1 AS (SELECT doc_id, session_id, seq, t AS text, raw, CAST(start AS INTEGER) AS start FROM ({_spans('text', _IP, '', (1,), 'doc_id, session_id, seq', source='docs')})), ")


def _flagship() -> str:
    body = resolved("", findings.ALL, _DOCS, more=_redacted("secret_spans") + ", " + _NET_TEXT + _TREE.replace("{where}", "is_public") + _NAMES.replace(", s AS (", ", sn AS (").replace("FROM s WHERE", "FROM sn WHERE").replace("SELECT s.session_id, s.canonical, s.parent, concat(t.body, '_SUB_', s.k) FROM s JOIN", "SELECT sn.session_id, sn.canonical, sn.parent, concat(t.body, '_SUB_', sn.k) FROM sn JOIN").replace("t.session_id = s.session_id AND t.canonical = s.parent", "t.session_id = sn.session_id AND t.canonical = sn.parent") + """,
spans AS (SELECT * FROM secret_spans UNION ALL SELECT n.doc_id, n.start, n."end", concat('[', m.body, ']') FROM n JOIN names m ON m.session_id = n.session_id AND m.canonical = n.canonical WHERE n.is_public AND NOT EXISTS (SELECT 1 FROM secret_spans x WHERE x.doc_id = n.doc_id AND x.start < n."end" AND x."end" > n.start))""" + _SPLICE.replace("SELECT {keys}", ", out AS (SELECT docs.doc_id, docs.session_id") + ") SELECT doc_id, session_id, len(redacted) AS n_chars, n_replaced, md5(redacted) AS redacted_md5 FROM out")
    return body


def _matched(rows: tuple, name: str) -> str:
    values = ", ".join(f"({p}, '{m}', '{a}')" for p, m, a in rows)
    return f"""{name}p AS (SELECT pos, match, action, regexp_extract(match, '^(\\*|https?)://', 1) AS ps, lower(regexp_extract(match, '://([^/]+)', 1)) AS ph, concat('^', replace(regexp_replace(regexp_extract(match, '://[^/]+(/.*)$', 1), '([.+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*'), '$') AS pp FROM (VALUES {values}) x(pos, match, action)),
{name} AS (SELECT request_id, min({{'pos': pos, 'match': match, 'action': action}}) AS m FROM u JOIN {name}p ON (ps = '*' OR ps = scheme) AND (ph = '*' OR (starts_with(ph, '*.') AND ends_with(host, substr(ph, 2))) OR host = ph) AND (regexp_matches(concat(path, query), pp) OR regexp_matches(path, pp)) GROUP BY 1)"""


_URLS = f"""u AS (SELECT request_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)', 1) AS port,
  coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query FROM ({VIEWS["v_requests"]}))"""

_CELLS = f"""a AS (SELECT doc_id, unnest(range(1, len(l) + 1)) - 1 AS line_no, l, text FROM (SELECT *, string_split(text, chr(10)) AS l FROM ({VIEWS["v_kv_blocks"]}))),
b AS (SELECT doc_id, line_no, l[line_no + 1] AS line, coalesce(list_sum(list_transform(l[1:line_no], lambda z: len(z) + 1)), 0) AS pos, line_no > 0 AND line_no < 4 AS inside FROM a),
c AS (SELECT *, string_split(line, ',') AS c FROM b WHERE inside),
r AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(c[1], '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_-]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS label, c[2] AS value, CAST(pos + len(c[1]) + 1 AS INTEGER) AS start, CAST(pos + len(c[1]) + 1 + len(c[2]) AS INTEGER) AS "end" FROM c)"""
_NORMAL = "regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_SETS = f"list_sort(list_distinct(regexp_extract_all({{x}}, {_TOKEN})))"
_WINDOW = "SELECT {w} AS window_start, action, count(*) AS n FROM ({v}) {more} GROUP BY ALL"
_A = VIEWS["v_audit"]
_V = VIEWS["v_eval"]


def _rates(level: str) -> str:
    return f"SELECT '{level}' AS level, {level} AS value, count(*) FILTER (label = 'SECRET' AND prediction = 'SECRET') AS tp, count(*) FILTER (label <> 'SECRET' AND prediction = 'SECRET') AS fp, count(*) FILTER (label = 'SECRET' AND prediction <> 'SECRET') AS fn FROM ({_V}) GROUP BY 2"


_REPORT = f"""WITH v AS ({_V}), n AS (SELECT label AS name FROM v UNION SELECT prediction FROM v), c AS (SELECT name AS label, (SELECT count(*) FROM v WHERE v.label = name) AS support, (SELECT count(*) FROM v WHERE v.prediction = name) AS said, (SELECT count(*) FROM v WHERE v.prediction = name AND v.label = name) AS tp FROM n),
r AS (SELECT label, support, CASE WHEN said = 0 THEN 0.0 ELSE tp / said END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM c)"""

_META = """SELECT s_suppkey * 100 + k AS doc_id, text FROM (SELECT s_suppkey, unnest(range(12)) AS k, unnest([concat('Authorization: Basic ', md5(s_name)), concat('x-api-key: ', md5(s_name), ', ok'), concat('clone https://bot', s_suppkey, ':pw', s_suppkey, 'x@git.acme.org/r'),
concat('open \\\\files', s_suppkey, '\\team$\\a now'), concat('CN=svc', s_suppkey, ',OU=apps,DC=acme'), concat('MSSQLSvc/db', s_suppkey, '.acme.org:1433'), concat('arn:aws:iam::', 100000000000 + s_suppkey, ':role/r', s_suppkey),
concat('aws account id: ', 100000000000 + s_suppkey), concat('see s3://bucket-', s_suppkey, '/k and gs://gb-', s_suppkey, '/k'), concat('k8s namespace=prod-', s_suppkey), concat('host n', s_suppkey, '.eu.internal up'), concat('ipv6=2001:db8::', s_suppkey)]) AS text FROM supplier)"""


def _metadata(docs: str, select: str) -> str:
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM ({docs})), f AS (SELECT * EXCLUDE (k, ord) FROM ({' UNION ALL '.join(_metadata_rows(k, metadata.ALL) for k in range(len(metadata.ALL)))})) {select}"


def _scored(docs: str, select: str) -> str:
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM ({docs})), f AS (SELECT doc_id, id AS detector, type, category, raw, CAST(from_ AS INTEGER) AS start, CAST(to_ AS INTEGER) AS \"end\", score, severity FROM ({_scored_rows('d')})) {select}"


_LEFT = f"SELECT doc_id, text FROM ({VIEWS['v_secret_lines']}) UNION ALL SELECT -doc_id - 1, text FROM ({VIEWS['v_login_lines']})"


def _gate(select: str, mode: str) -> str:
    """Candidates outside the findings in ``final``; what findings hold is left out of the context by joining the gaps between them."""
    parts = []
    for k, (name, rx, flags, group, key) in enumerate(gate.FAMILIES):
        found = _spans("t", rx, flags, (group,) if group else ())
        parts.append(f"SELECT doc_id, {k} AS rule, '{name}' AS kind, j, raw AS found, {Q.extract('matched', rx, key, flags) if key else chr(39) * 2} AS key, start, \"end\", t FROM ({found})")
    sql = " UNION ALL ".join(parts)
    for step in gate.value_steps(Q):
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    near = gate.RADIUS
    more = f""", c0 AS (SELECT *, {S.normal_key(Q, Q.trim("key"))} AS nkey, row_number() OVER (PARTITION BY doc_id, first, last, value ORDER BY rule, j) AS r FROM ({sql}) WHERE value <> ''),
c1 AS (SELECT *, greatest(first - {near}, first - len(string_split(left(t, first), chr(10))[-1])) AS lo, least(last + {near}, last + len(regexp_replace(string_split(substr(t, last + 1), chr(10))[1], '\\r\\z', ''))) AS hi FROM c0 WHERE r = 1),
c2 AS (SELECT * FROM c1 WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.doc_id = c1.doc_id AND f.start < c1.last AND f."end" > c1.first)),
e AS (SELECT c2.doc_id, c2.first, c2.last, c2.value, list({{'s': greatest(f.start, lo), 'e': least(f."end", hi)}} ORDER BY f.start) AS g FROM c2 JOIN final f ON f.doc_id = c2.doc_id AND f.start < hi AND f."end" > lo GROUP BY ALL),
c3 AS (SELECT c2.*, CASE WHEN e.g IS NULL THEN substr(t, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)) ELSE concat(substr(t, CAST(lo + 1 AS BIGINT), CAST(e.g[1].s - lo AS BIGINT)), array_to_string(list_transform(range(1, len(e.g) + 1), lambda i: substr(t, CAST(e.g[i].e + 1 AS BIGINT), CAST(CASE WHEN i = len(e.g) THEN hi ELSE e.g[i + 1].s END - e.g[i].e AS BIGINT))), '')) END AS context
  FROM c2 LEFT JOIN e ON e.doc_id = c2.doc_id AND e.first = c2.first AND e.last = c2.last AND e.value = c2.value),
asked AS (SELECT * FROM (SELECT doc_id, kind, key, value, CAST(first AS INTEGER) AS start, CAST(last AS INTEGER) AS "end", context, CAST({gate.score_sql(Q)} AS INTEGER) AS score FROM c3 WHERE {gate.kept_sql(Q)}) WHERE score >= {gate.threshold(mode)})"""
    return resolved(select, ("registry", "email"), _LEFT, more=more)


_VERDICTS = """, said AS (SELECT *, CASE WHEN regexp_matches(context, '[0-9]') AND regexp_matches(context, '[A-Z]') THEN 'SECRET' WHEN len(context) < 40 THEN 'UNSURE' ELSE 'NOT_SECRET' END AS risk, CASE WHEN len(context) > 30 THEN 0.9 ELSE 0.7 END AS confidence FROM asked),
kept AS (SELECT *, CASE WHEN risk = 'SECRET' AND confidence >= 0.8 THEN 'high' WHEN risk = 'UNSURE' AND score >= 60 THEN 'medium' END AS severity FROM said),
grank AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "end" - start DESC, start) AS rk FROM kept WHERE severity IS NOT NULL),
gsteps(doc_id, rk, held) AS (SELECT doc_id, 1::BIGINT, [{'s': start, 'e': "end", 'k': rk}] FROM grank WHERE rk = 1
  UNION ALL SELECT r.doc_id, r.rk, CASE WHEN len(list_filter(c.held, lambda x: r.start < x.e AND r."end" > x.s)) > 0 THEN c.held ELSE list_append(c.held, {'s': r.start, 'e': r."end", 'k': r.rk}) END FROM gsteps c JOIN grank r ON r.doc_id = c.doc_id AND r.rk = c.rk + 1)
SELECT r.doc_id, r.value AS raw, r.start, r."end", r.score, r.severity FROM grank r JOIN (SELECT doc_id, unnest(arg_max(held, rk)) AS k FROM gsteps GROUP BY 1) c ON c.doc_id = r.doc_id AND c.k.k = r.rk"""
_NAMES_OF = f"SELECT *, left(text, len(text) - len(raw)) AS before, '' AS after FROM (SELECT doc_id, text, string_split(text, ' ')[-1] AS raw FROM ({VIEWS['v_scored_lines']}))"


def _numeric() -> str:
    sql = f"SELECT doc_id, text FROM ({VIEWS['v_secret_lines']})"
    for step in learn.numeric_steps(Q):
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return f"SELECT doc_id, {', '.join(learn.NUMERIC)} FROM ({sql})"


_TRUST = f"SELECT doc_id, concat(text, CASE doc_id % 3 WHEN 0 THEN concat(' and [PWM_', doc_id % 9 + 1, ']q8Zr7Wm2Kp4T') WHEN 1 THEN concat('; token: [PWM_', doc_id % 9 + 1, ']') ELSE '' END) AS t FROM ({VIEWS['v_secret_lines']})"

ORACLES: dict[str, str] = {
    "c19_c22_vault_aware": f"WITH d AS ({_TRUST}) SELECT doc_id, type, raw, CAST(from_ AS INTEGER) AS start, CAST(to_ AS INTEGER) AS \"end\", score, severity FROM ({_scored_rows('d', scored.VAULT_DETECTORS)}) WHERE (id = 'C22') = regexp_matches(key, '^\\[PWM_[1-5]\\]$')",
    "l01_l04_candidates": _gate("SELECT * FROM asked", "strict"),
    "d12_u03_verdicts": _gate(_VERDICTS, "enterprise").replace(" , said AS", ", said AS"),
    "a11_pipe_tables": "SELECT s_suppkey AS doc_id, 'aws account' AS label, CAST(s_suppkey + 100000000000 AS VARCHAR) AS value, 57 AS start FROM supplier UNION ALL SELECT s_suppkey, 'e mail', s_name, 87 FROM supplier",
    "a12_json_objects": "SELECT s_suppkey AS doc_id, 4 AS start, 'tenant id' AS label, md5(s_name) AS value FROM supplier UNION ALL SELECT s_suppkey, 92, 'owner', s_name FROM supplier",
    "a09_html_rows": "SELECT s_suppkey AS doc_id, 1 AS row_no, 'tenant co' AS label, concat(s_name, ' <x>') AS value FROM supplier",
    "d11_h03_merged_findings": judged(("pattern", "registry", "assignment", "email")) + """, s AS (SELECT *, CASE WHEN source IN ('registry', 'email') THEN 0 ELSE 1 END AS scan FROM judged WHERE why IS NULL)
SELECT doc_id, start, "end", raw, min(scan) AS scan, max(score) FILTER (scan = m) AS score FROM (SELECT *, min(scan) OVER (PARTITION BY doc_id, start, "end", raw) AS m FROM s) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY doc_id, start, \"end\", raw"),
    "d14_site_status": f"WITH {_URLS}, o AS (SELECT request_id, CASE WHEN scheme <> '' THEN concat(scheme, '://', host, CASE WHEN port <> '' THEN ':' || port ELSE '' END) ELSE '' END AS origin FROM u), f AS (SELECT origin, min(request_id) AS first FROM o WHERE origin <> '' GROUP BY 1) SELECT request_id, o.origin, CASE WHEN first % 3 = 0 THEN 'builtin' WHEN first % 2 = 0 THEN 'user' ELSE 'none' END AS status FROM o LEFT JOIN f ON f.origin = o.origin",
    "c25_c40_metadata": _metadata(_META, "SELECT * FROM f"),
    "c25_c40_documents": _metadata(f"SELECT doc_id, text FROM documents UNION ALL SELECT page_id, html FROM pages UNION ALL {_META}", "SELECT detector, type, count(*) AS n, count(DISTINCT raw) AS n_raw FROM f GROUP BY ALL"),
    "f07_f10_ids_and_places": judged(("registry",)) + """, f AS (SELECT DISTINCT doc_id, start, "end", raw FROM judged WHERE why IS NULL), k AS (SELECT *, 'f_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", raw) AS VARCHAR), 4, '0') AS id FROM f),
p AS (SELECT *, '[' || upper(id) || ']' AS placeholder FROM k), q AS (SELECT *, CAST(start + coalesce(sum(len(placeholder) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS new_start FROM p) SELECT *, CAST(new_start + len(placeholder) AS INTEGER) AS new_end FROM q""",
    "d01_d02_d15_interval_joins": judged(("registry", "assignment")) + """, f AS (SELECT doc_id, source, start, "end" FROM judged WHERE why IS NULL), o AS (SELECT * FROM f WHERE source = 'assignment'), r AS (SELECT * FROM f WHERE source = 'registry')
SELECT 'overlap' AS kind, doc_id, start, "end" FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND r.start < o."end" AND r."end" > o.start) UNION ALL
SELECT 'longer', doc_id, start, "end" FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND r.start < o."end" AND r."end" > o.start AND r."end" - r.start >= o."end" - o.start) UNION ALL
SELECT 'inside', doc_id, start, "end" FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND r.start <= o.start AND r."end" >= o."end")""",
    "g02_natural_order": f"""WITH t AS (SELECT DISTINCT session_id, doc_id % 4 AS f, doc_id % 30 + 1 AS k FROM ({VIEWS['v_secret_lines']})), o AS (SELECT session_id, concat(['[PWM_', '[NET_', '[NET_1_SUB_', '[PUB_HOST_'][f + 1], k, ']') AS token, [0, 1, 1, 2][f + 1] AS g, CASE WHEN f = 2 THEN [1, k] ELSE [k] END AS n FROM t)
SELECT session_id, token, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY g, n, token) AS rank FROM o) WHERE rank <= 8""",
    "b53_g09_previews": f"""WITH l AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, regexp_replace(unnest(l), '\\r$', '') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)), d AS (SELECT * FROM l WHERE contains(t, '@')), m AS ({_spans('t', detect.EMAIL, 'i', keys='doc_id, line_no')})
SELECT doc_id, line_no, CAST(start AS INTEGER) AS start, CASE WHEN len(t) <= 180 THEN t ELSE substr(t, CAST(greatest(0, least(start - floor((180 - ("end" - start)) / 2), len(t) - 180)) AS INTEGER) + 1, 180) END AS preview, CAST(least(len(t), 100) AS INTEGER) AS n_short FROM m""",
    "r11_r15_trust_and_flags": f"WITH {_SEEN}, i AS (SELECT session_id, CAST(regexp_extract(token, '_([0-9]+)', 1) AS BIGINT) AS k FROM seen), c AS (SELECT session_id, max(k) - 2 AS m FROM i GROUP BY 1) SELECT 'trust' AS kind, i.session_id AS key, count(*) FILTER (k BETWEEN 1 AND m) AS n, count(*) AS \"of\" FROM i JOIN c ON c.session_id = i.session_id GROUP BY 2 UNION ALL SELECT 'flags', CAST(c_nationkey AS VARCHAR), count(*) FILTER (c_custkey % 3 <> 0 OR c_custkey % 4 = 0), count(*) FILTER (c_custkey % 3 = 0) FROM customer GROUP BY 2",
    "c12_c14_adjacent_lines": """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS k, md5(c_name) AS h FROM customer)
SELECT doc_id, 'C12' AS detector, 'API_KEY' AS type, concat('sk-proj-', h) AS raw, 20 AS start, 60 AS "end", 90 AS score FROM c WHERE k = 0 UNION ALL SELECT doc_id, 'C13', 'AWS_SECRET_KEY', concat(h, left(h, 8)), 22, 62, 98 FROM c WHERE k = 2
UNION ALL SELECT doc_id, 'C13', 'AWS_KEY', concat('AKIA', upper(left(h, 16))), 20, 40, 94 FROM c WHERE k = 3 UNION ALL SELECT doc_id, 'C14', 'AWS_SECRET_KEY', concat(h, left(h, 8)), 21, 61, 97 FROM c WHERE k = 4""",
    "u07_sql_functions": _columns(f"({VIEWS['v_secret_lines']})", entropy=S.entropy(Q, "text"), variety=S.variety(Q, "text"), alphabet=S.alphabet(Q, "text"), ctx=S.context_score(Q, "lower(text)"), key_type=S.key_type(Q, "text")),
    "c09_c38_scored_lines": _scored(VIEWS["v_scored_lines"], "SELECT * FROM f"),
    "b40_b52_name_tests": _columns(f"({_NAMES_OF})", parts=scored.token_score(Q, "raw"), prefixed=scored.token_score(Q, "raw", True), infra=scored.infrastructure(Q), provider=scored.provider(Q), person=scored.identity(Q), path=scored.path_like(Q, "raw"), lone=scored.bare_password(Q, "raw"), ipv6=scored.ipv6(Q, "raw"), gap=scored.ipv6(Q, "concat('2001:db8::', length(raw))")),
    "l05_numeric_features": _numeric(),
    "e12_e13_vocabulary": f"WITH w AS (SELECT concat(' ', w, ' ') AS w FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM ({VIEWS['v_secret_lines']})) WHERE w <> ''), g AS (SELECT substr(w, i, n) AS gram FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (3), (4), (5)) x(n) WHERE len(w) >= n)) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 2048",
    "l10_l11_upgrades": f"""WITH r AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 100 AS INTEGER) AS score, ['SECRET', 'NOT_SECRET', 'UNSURE'][o_custkey % 3 + 1] AS risk, (o_orderkey % 21) / 20 AS c FROM orders), s AS (SELECT *, {S.severity("score")} AS severity FROM r)
SELECT doc_id, 'upgrade' AS flow, CASE WHEN severity = 'medium' AND risk = 'SECRET' AND c >= 0.85 THEN greatest(score, 80) ELSE score END AS score, CASE WHEN severity = 'medium' AND risk = 'SECRET' AND c >= 0.85 THEN 'high' ELSE severity END AS severity, CASE WHEN severity = 'medium' AND risk = 'SECRET' AND c >= 0.85 THEN 'pattern,ai-assist' WHEN severity = 'medium' AND risk = 'SECRET' AND c >= 0.6 THEN 'pattern,ai-assist-warning' ELSE 'pattern' END AS method FROM s
UNION ALL SELECT doc_id, 'gate', score, CASE WHEN risk = 'SECRET' THEN 'high' ELSE 'medium' END, '' FROM r WHERE (risk = 'SECRET' AND c >= 0.8) OR (risk = 'UNSURE' AND score >= 60)""",
    "j01_chunked_spans": f"WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL), m AS ({_spans('t', detect.EMAIL, 'i')}) SELECT doc_id AS stream_id, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", raw FROM m",
    "j03_stream_status": "SELECT doc_id AS stream_id, len(text) AS size, least(len(text), 4096) AS largest, CASE WHEN len(text) > 52428800 THEN 'blocked' ELSE 'ok' END AS status FROM documents WHERE text IS NOT NULL",
    "a01_not_blank": "SELECT lang, count(*) AS n_docs, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\\s\\x0B\\x{00a0}]') GROUP BY lang",
    "c06_c24_candidates": judged() + " SELECT doc_id, source, name, type, category, raw, start, \"end\", score, severity, array_to_string(method, ',') AS method, coalesce(why, '') AS why FROM judged",
    "c06_c24_documents": judged(("pattern", "registry", "email"), "SELECT doc_id, text FROM documents") + " SELECT source, name, type, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, count(DISTINCT doc_id) AS n_docs FROM judged WHERE why IS NULL GROUP BY ALL",
    "e04_f11_findings": resolved('SELECT doc_id, type, raw, start, "end", score, severity FROM final'),
    "b36_suppression_reasons": judged() + " SELECT source, coalesce(why, 'kept') AS why, count(*) AS n FROM judged GROUP BY ALL",
    "b38_allow_list": judged(("assignment",), allow=("Vault1!Horse", "Vault4!Horse")) + " SELECT coalesce(why, 'kept') AS why, count(*) AS n FROM judged GROUP BY ALL",
    "b09_b12_token_features": _columns(_TOKENS, v="v", entropy=S.entropy(Q, "v"), variety=S.variety(Q, "v"), alphabet=S.alphabet(Q, "v"), structured=S.structured_secret(Q, "v")),
    "b18_b28_key_tests": _KEYS,
    "b32_b39_value_tests": _VALUES,
    "b13_b15_entropy_decision": _ENTROPY,
    "b04_f06_lines": "WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM a), c AS (SELECT *, CAST(coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, regexp_replace(line, '\\r$', '') AS cut FROM b) SELECT doc_id, line_no, start, CAST(start + len(cut) AS INTEGER) AS \"end\", md5(cut) AS line_md5 FROM c",
    "b05_line_column": f"WITH d AS (SELECT doc_id, text AS t FROM documents WHERE contains(text, '@')), m AS ({_spans('t', detect.EMAIL, 'i')}) SELECT doc_id, raw, start, CAST(len(regexp_extract_all(left(t, start), '\\r\\n|\\r|\\n')) + 1 AS INTEGER) AS line_no, CAST(len(regexp_split_to_array(left(t, start), '\\r\\n|\\r|\\n')[-1]) + 1 AS INTEGER) AS col_no FROM m",
    "b07_b08_context": f"SELECT doc_id, w, {S.context_score(Q, 'w')} AS ctx FROM (SELECT doc_id, lower(right(concat(text, ' '), 64)) AS w FROM ({VIEWS['v_secret_lines']}))",
    "b16_b17_severity": f"SELECT o_orderkey, score, {S.severity('score')} AS severity FROM (SELECT o_orderkey, {S.bounded('o_totalprice % 140 - 20')} AS score FROM orders)",
    "b48_b49_tokens": _B48,
    "c41_d08_network_tokens": _net("SELECT * EXCLUDE (seq) FROM n"),
    "d09_closest_parent": _net("SELECT session_id, canonical, prefix, parent FROM p", tree=True),
    "f08_network_placeholders": _net("SELECT session_id, canonical, parent, concat('[', body, ']') AS placeholder FROM names", "is_public", names=True),
    "r04_network_modes": _net("SELECT 'hide_public' AS mode, kind, count(*) AS n FROM n WHERE is_public GROUP BY ALL UNION ALL SELECT 'hide_all', kind, count(*) FROM n GROUP BY ALL"),
    "f01_f02_e05_vault": _vault("SELECT session_id, family, sha256(concat(session_id, chr(0), family, chr(0), raw)) AS fingerprint, placeholder, index FROM v", used=True),
    "e05_counters": f"WITH {_SEEN} SELECT session_id, family, last FROM used",
    "d04_trusted_tokens": _vault("SELECT CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.session_id = seen.session_id AND v.placeholder = seen.token) THEN 'trusted' ELSE 'unknown' END AS kind, session_id, count(*) AS n FROM seen GROUP BY ALL"),
    "d05_reveal": _vault("SELECT seen.session_id, doc_id, token, CASE WHEN seen.session_id <> 's1' THEN v.raw END AS raw FROM seen LEFT JOIN v ON v.session_id = seen.session_id AND v.placeholder = seen.token"),
    "d03_known_value_reuse": _vault("""SELECT doc_id, session_id, placeholder, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM (SELECT e.*, bool_or(o."end" - o.start > e."end" - e.start) AS worse FROM e LEFT JOIN e o ON o.doc_id = e.doc_id AND o.start < e."end" AND o."end" > e.start GROUP BY ALL) WHERE NOT worse""").replace("concat('[PWM_', index, ']') AS placeholder FROM vault) SELECT", """concat('[PWM_', index, ']') AS placeholder FROM vault),
again AS (SELECT doc_id, session_id, concat('again: ', text) AS text FROM docs), q AS (SELECT a.doc_id, a.session_id, v.raw, v.placeholder, string_split(a.text, v.raw) AS g FROM again a JOIN v ON v.session_id = a.session_id WHERE len(v.raw) >= 8 AND contains(a.text, v.raw)),
w AS (SELECT *, unnest(range(1, len(g))) AS j FROM q), e AS (SELECT doc_id, session_id, placeholder, list_sum(list_transform(g[1:j], lambda z: len(z))) + (j - 1) * len(raw) AS start, list_sum(list_transform(g[1:j], lambda z: len(z))) + j * len(raw) AS "end" FROM w) SELECT"""),
    "r10_segments": f"WITH a AS (SELECT doc_id, regexp_extract_all(text, {_TOKEN}) AS t, string_split_regex(text, {_TOKEN}) AS g FROM ({VIEWS['v_secret_lines']})), b AS (SELECT doc_id, 2 * i AS o, 'text' AS type, g[i] AS value FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM a) UNION ALL SELECT doc_id, 2 * i + 1, 'secret', t[i] FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM a)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS part, type, value FROM b WHERE value <> ''",
    "flagship_documents": _flagship(),
    "c06_c07_rule_lines": judged(docs=VIEWS["v_rule_lines"]) + " SELECT doc_id, source, name, type, category, raw, start, \"end\", score, severity, array_to_string(method, ',') AS method, coalesce(why, '') AS why FROM judged",
    "h01_r02_rule_lines": resolved("", docs=VIEWS["v_rule_lines"], more=_redacted("spans") + _SPLICE.replace("{keys}", "docs.doc_id, docs.session_id")),
    "c02_c11_assigned_lines": _scored(VIEWS["v_assigned_lines"], "SELECT * FROM f WHERE detector IN ('C02', 'C05', 'C09', 'C10', 'C11')"),
    "h01_r02_assigned_lines": resolved("", docs=VIEWS["v_assigned_lines"], more=_redacted("spans") + _SPLICE.replace("{keys}", "docs.doc_id, docs.session_id")),
    "h01_r02_login_lines": resolved("", docs=VIEWS["v_login_lines"], more=_redacted("spans") + _SPLICE.replace("{keys}", "docs.doc_id, docs.session_id")),
    "c01_c04_c20_login_lines": _scored(VIEWS["v_login_lines"], "SELECT * FROM f WHERE detector IN ('C01', 'C04', 'C15', 'C20', 'C21')"),
    "r03_transform": _R03,
    "r02_redact_odd_rows": _R02,
    "r08_network_findings": _net("SELECT doc_id, CASE WHEN is_host THEN 'PUBLIC_IP' ELSE 'PUBLIC_SUBNET' END AS type, raw, start, \"end\", 90 AS score, 'high' AS severity FROM n WHERE is_public"),
    "r07_transform_networks": _R07,
    "e01_e02_report": resolved("""SELECT doc_id, sum(n)::BIGINT AS findings, sum(h)::BIGINT AS high, sum(m)::BIGINT AS medium, sum(l)::BIGINT AS low, concat('{', string_agg(concat('"', category, '":', n), ',' ORDER BY category), '}') AS categories FROM (SELECT doc_id, category, count(*) AS n, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM final GROUP BY ALL) GROUP BY doc_id"""),
    "r18_sanitized": resolved('SELECT doc_id, type, category, start, "end", len(raw) AS length, sha256(raw) AS raw_sha256, score, severity FROM final'),
    "r19_verification": judged(("registry",)) + f""", s AS (SELECT doc_id, concat(text, chr(10), '[PWM_7]', repeat(chr(10), 4), 'end') AS redacted FROM docs),
w AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'gone' WHEN 1 THEN redacted WHEN 2 THEN replace(redacted, chr(10), ' ') WHEN 3 THEN replace(redacted, chr(10), chr(13) || chr(10)) ELSE concat('[PWM_7] ', redacted) END AS actual FROM s),
k AS (SELECT w.doc_id, count(DISTINCT raw) AS n FROM w JOIN judged j ON j.doc_id = w.doc_id WHERE why IS NULL AND severity = 'high' AND contains(actual, raw) GROUP BY 1),
x AS (SELECT w.*, coalesce(n, 0) AS n_leaked, {_NORMAL.format(x="redacted")} AS e, {_NORMAL.format(x="actual")} AS a FROM w LEFT JOIN k ON k.doc_id = w.doc_id)
SELECT doc_id, n_leaked, CASE WHEN n_leaked > 0 THEN 'leak' WHEN NOT list_has_all({_SETS.format(x="a")}, {_SETS.format(x="e")}) THEN 'tokens_missing' WHEN len(e) - len(replace(e, chr(10), '')) >= 2 AND (len(a) - len(replace(a, chr(10), ''))) * 2 < len(e) - len(replace(e, chr(10), '')) THEN 'lines_collapsed' ELSE 'ok' END AS status,
  CASE WHEN redacted = actual THEN 'exact' WHEN e = a THEN 'normalized' WHEN {_SETS.format(x="e")} = {_SETS.format(x="a")} THEN 'tokens' ELSE 'none' END AS match FROM x""",
    "h04_h05_token_sets": f"SELECT doc_id, {_SETS.format(x='text')} = {_SETS.format(x='other')} AS same, list_has_all({_SETS.format(x='other')}, {_SETS.format(x='text')}) AS subset, CAST(len({_SETS.format(x='other')}) AS INTEGER) AS n_tokens FROM (SELECT doc_id, text, concat('[PWM_', doc_id % 9 + 1, '] [PWM_2]') AS other FROM ({VIEWS['v_secret_lines']}))",
    "d06_first_destination": f"WITH {_URLS}, {_matched(DESTINATIONS, 'd')} SELECT request_id, m.pos, m.match, m.action FROM d",
    "r14_decisions": f"WITH {_URLS}, {_matched(DESTINATIONS, 'd')}, x AS (SELECT u.request_id, coalesce(m.action, 'block') AS action, m.match AS matched FROM u LEFT JOIN d ON d.request_id = u.request_id) SELECT request_id, action, action <> 'block' AS allowed, action = 'block' AS blocked, action = 'redact' AS requires_redaction, CASE WHEN action = 'block' AND matched IS NOT NULL THEN 'destination_blocked' WHEN action = 'block' THEN 'destination_not_approved' WHEN action = 'redact' THEN 'destination_requires_redaction' END AS reason, matched FROM x",
    "r14_block_and_approve": f"WITH {_URLS}, {_matched(BLOCKED, 'b')}, {_matched(APPROVED, 'a')}, x AS (SELECT u.request_id, b.request_id IS NOT NULL AS b, a.request_id IS NOT NULL AS a FROM u LEFT JOIN b ON b.request_id = u.request_id LEFT JOIN a ON a.request_id = u.request_id) SELECT request_id, CASE WHEN b THEN 'block' ELSE 'allow' END AS action, NOT (b OR NOT a) AS allowed, b OR NOT a AS blocked, false AS requires_redaction, CASE WHEN b THEN 'destination_blocked' WHEN NOT a THEN 'destination_not_approved' END AS reason, CAST(NULL AS VARCHAR) AS matched FROM x",
    "r17_origins": f"WITH {_URLS} SELECT request_id, CASE WHEN scheme <> '' THEN concat(scheme, '://', host, CASE WHEN port <> '' THEN ':' || port ELSE '' END) ELSE '' END AS origin, host, path FROM u",
    "r12_r13_policies": "WITH p AS (SELECT c_custkey AS tenant, c_custkey % 2 = 0 AS enterprise, c_custkey % 500 AS days, ['allow', 'redact', 'block', 'drop'][c_custkey % 4 + 1] AS action FROM customer) SELECT tenant, enterprise, action AS default_action, CAST(least(365, greatest(1, days)) AS INTEGER) AS retention_days, concat_ws(',', CASE WHEN action = 'drop' THEN 'default_action' END, CASE WHEN days < 1 OR days > 365 THEN 'retention_days' END) AS errors, enterprise AND (action = 'drop' OR days < 1 OR days > 365) AS fail_closed FROM p",
    "h06_last_rule_wins": "SELECT user_id AS site, max(event_id) AS pos, arg_max(event_type, event_id) AS action FROM events GROUP BY 1",
    "h07_policy_merge": "SELECT c_custkey AS tenant, CASE WHEN c_custkey % 6 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE c_nationkey END AS nation FROM customer",
    "f12_pauses": "WITH l AS (SELECT user_id AS session_id, max({'ts': ts, 'until': ts + to_minutes(event_id % 90)}) AS p FROM events GROUP BY 1) SELECT session_id, least(p.until, p.ts + to_minutes(60)) AS until, least(p.until, p.ts + to_minutes(60)) > TIMESTAMP '2024-01-15 00:00:00' AS paused FROM l",
    "e03_audit_summary": f"SELECT tenant, action, count(*) AS n_findings, string_agg(DISTINCT finding_type, ',' ORDER BY finding_type) AS finding_types FROM ({_A}) GROUP BY 1, 2",
    "f09_j06_audit_bound": f"WITH a AS ({_A}), f AS (SELECT * FROM a WHERE ts >= (SELECT max(ts) FROM a) - INTERVAL 20 DAY) SELECT event_id, tenant, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, event_id DESC) AS rank FROM f) WHERE rank <= 5",
    "j09_tumbling": _WINDOW.format(w="time_bucket(INTERVAL 6 HOUR, ts)", v=_A, more=""),
    "j09_sliding": _WINDOW.format(w="time_bucket(INTERVAL 3 HOUR, ts) - to_hours(k * 3)", v=_A, more=", (VALUES (0), (1)) x(k)"),
    "j09_sessions": f"WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM ({_A})), b AS (SELECT *, sum(new) OVER (PARTITION BY tenant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT tenant, min(ts) AS window_start, count(*) AS n FROM b GROUP BY tenant, k",
    "e14_latency": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
    "a10_f03_delimited": f"WITH {_CELLS} SELECT * FROM r WHERE value <> ''",
    "c03_metadata_rows": f"WITH {_CELLS}, t AS (SELECT *, CASE {' '.join(f'WHEN regexp_matches(label, {chr(39)}{a}{chr(39)}) AND regexp_matches(value, {chr(39)}{b}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, a, b in KINDS)} END AS type FROM r) SELECT doc_id, type, value, start, \"end\" FROM t WHERE type IS NOT NULL",
    "a13_f04_pairs": "SELECT s_suppkey AS doc_id, 1 AS line_no, 'aws account' AS label, CAST(s_suppkey + 100000000000 AS VARCHAR) AS value FROM supplier",
    "d10_line_memo": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, len(regexp_extract_all(line, {_rx(detect.EMAIL, 'i')})) AS n FROM l) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_emails, count(*) AS n_lines FROM h WHERE n > 0 GROUP BY 1",
    "a03_a04_file_types": "SELECT page_id, ['a.txt', '.env', 'dockerfile', 'x.pdf', 'img.png', 'noext', '.bashrc', 'b.tar.gz', 'k.tfvars', 'end.'][page_id % 10 + 1] AS name, ['txt', 'env', '', 'pdf', 'png', '', '', 'gz', 'tfvars', ''][page_id % 10 + 1] AS extension, ['text', 'text', 'text', 'document', 'image', 'unknown', 'unknown', 'unknown', 'text', 'unknown'][page_id % 10 + 1] AS family, ['supported', 'supported', 'supported', 'planned_unsupported', 'planned_unsupported', 'unsupported', 'unsupported', 'unsupported', 'supported', 'unsupported'][page_id % 10 + 1] AS status FROM pages",
    "a07_size_zones": f"SELECT CASE WHEN s <= {files.FAST} THEN 'fast' WHEN s <= {files.OPTIMIZED} THEN 'optimized' ELSE 'blocked' END AS zone, count(*) AS n FROM (SELECT trunc(l_extendedprice * 100) AS s FROM lineitem) GROUP BY 1",
    "a08_e16_batches": f"WITH b AS (SELECT l_orderkey AS batch_id, count(*) FILTER (s <= {files.OPTIMIZED}) AS n_small, count(*) FILTER (s > {files.OPTIMIZED}) AS n_large, bool_and(s <= {files.LARGEST}) AS in_limit FROM (SELECT l_orderkey, trunc(l_extendedprice * 600) AS s FROM lineitem) GROUP BY 1) SELECT *, n_small <= 20 AND n_large <= 5 AND in_limit AS admitted FROM b",
    "a05_validation": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsupported' WHEN doc_id % 4 = 0 AND 4000 * 100 >= least(65536, strlen(text) + 4000) AND strlen(text) < 61000 THEN 'binary' WHEN doc_id % 4 = 1 THEN 'invalid-utf8' ELSE 'ok' END AS code FROM documents WHERE text IS NOT NULL",
    "d13_span_boxes": f"WITH f AS (SELECT o_orderkey AS doc_id, o_orderkey % 30 AS start FROM orders), m AS (SELECT f.doc_id, f.start, min(x) AS \"left\", max(x + width) AS \"right\", count(x) AS n_boxes, bool_or(confidence = 'low') AS low FROM f LEFT JOIN ({VIEWS['v_boxes']}) b ON b.doc_id = f.doc_id AND box_start < f.start + 12 AND box_end > f.start GROUP BY 1, 2) SELECT doc_id, start, \"left\", \"right\", n_boxes, CASE WHEN n_boxes = 0 THEN 'unmapped' WHEN low THEN 'low_confidence' ELSE 'ok' END AS status FROM m",
    "e06_e07_grouping_sets": f"SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall FROM ({_rates('category')} UNION ALL {_rates('source_type')})",
    "e08_confusion": f"SELECT label, count(*) FILTER (prediction = 'SECRET') AS SECRET, count(*) FILTER (prediction = 'NOT_SECRET') AS NOT_SECRET, count(*) FILTER (prediction = 'UNSURE') AS UNSURE FROM ({_V}) GROUP BY 1",
    "e09_gates": _REPORT + " SELECT label, round(r, 9) AS recall, CAST(CASE label WHEN 'SECRET' THEN 0.98 WHEN 'NOT_SECRET' THEN 0.95 ELSE 0.8 END AS DOUBLE) AS needed, round(r, 9) >= CASE label WHEN 'SECRET' THEN 0.98 WHEN 'NOT_SECRET' THEN 0.95 ELSE 0.8 END AS passed FROM r",
    "e10_report": _REPORT + " SELECT label, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM r",
    "g08_error_samples": f"WITH e AS (SELECT concat(label, '>', prediction) AS kind, doc_id FROM ({_V}) WHERE label <> prediction), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM e) SELECT kind, CAST(rank AS INTEGER) AS rank, doc_id, greatest(total - 50, 0) AS more FROM r WHERE rank <= 50",
    "e17_class_weights": f"WITH c AS (SELECT label, count(*) AS n FROM ({_V}) GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c",
}

_REQUESTS = f"SELECT request_id, session_id, url, CASE request_id % 3 WHEN 0 THEN concat('DB_PASSWORD=Vault', request_id % 40, '!Horse for it') WHEN 1 THEN concat('see ', url, ' as jane', request_id % 50, '@corp-mail.io') ELSE 'nothing to hide' END AS text FROM ({VIEWS['v_requests']})"
_OPEN = f"SELECT request_id AS doc_id, session_id, request_id AS seq, text FROM ({_REQUESTS}) WHERE request_id IN (SELECT request_id FROM ({ORACLES['r14_decisions']}) WHERE NOT blocked)"
_HIGHER = ", most AS (SELECT * FROM final WHERE severity <> 'low')"
ORACLES["r16_served_texts"] = resolved("", docs=_OPEN, more=_HIGHER + _redacted("spans").replace("FROM final j", "FROM most j") + _SPLICE.replace("{keys}", "docs.doc_id AS request_id, docs.session_id"))
ORACLES["r16_audit"] = resolved(
    f""", n AS (SELECT doc_id, count(*) AS n_findings, string_agg(DISTINCT trim(regexp_replace(lower(type), '[^a-z0-9]+', '_', 'g'), '_'), ',' ORDER BY trim(regexp_replace(lower(type), '[^a-z0-9]+', '_', 'g'), '_')) AS finding_types FROM most GROUP BY 1), {_URLS}
SELECT u.request_id, CASE WHEN b.blocked THEN 'blocked' ELSE 'redacted' END AS action, CASE WHEN b.blocked THEN b.reason ELSE 'redacted' END AS reason, CASE WHEN scheme <> '' THEN concat(scheme, '://', host, CASE WHEN port <> '' THEN ':' || port ELSE '' END) ELSE '' END AS origin,
  coalesce(n_findings, 0) AS n_findings, coalesce(finding_types, '') AS finding_types FROM u JOIN ({ORACLES["r14_decisions"]}) b ON b.request_id = u.request_id LEFT JOIN n ON n.doc_id = u.request_id""",
    docs=_OPEN, more=_HIGHER,
)
