"""Features, key and value tests, and scores, as SQL text over a value, a key or a window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import KEYWORDS, NEGATIVE_WORDS
from .dialect import SPARK, Sql

# Placeholder tokens, template values, example markers and hosts, key lists, thresholds.
TOKEN = r"\[(?:PWM_\d+|NET_\d+(?:_SUB_\d+)*(?:_(?:HOST_\d+|GW|VIP|DNS))?|PUB_HOST_\d+(?:_(?:GW|VIP|DNS))?|[A-Z][A-Z0-9_]*_\d+)\]"
CLEAN_TOKEN = r"^\[(?:PWM_\d+|NET_\d+(?:_SUB_\d+)*(?:_(?:HOST_\d+|GW|VIP|DNS))?|PUB_HOST_\d+(?:_(?:GW|VIP|DNS))?)\]$"
TEMPLATE_I = r"^(?:REDACTED|MASKED|changeme|replace(?:_|-)?me|xxxxx+|todo)$"
TEMPLATE_START_I = r"^(?:your[_-]|(?:example|sample|dummy|fake|placeholder)(?:[_-]|\b))"
EXAMPLE_HOSTS = ("example.com", "example.org", "example.net", "test.invalid", "invalid")
SAFE_KEYS = (
    "api_version", "bearer_market", "benign_password_hint", "build_id", "commit_sha", "debug", "environment", "github_username",
    "image_tag", "jira_key", "max_token_limit", "password_hint", "public_key_label", "public_url", "region", "release_id",
    "request_id", "secret_santa", "secret_santa_enabled", "ticket_id", "token_limit", "tokenlimit", "trace_id", "url", "version",
)
CREDENTIAL_KEYS = ("api_key", "auth_header", "authorization", "client_secret", "database_url", "db_password", "mysql_url", "redis_url", "secret_key", "shared_secret", "token", "webhook_url")
INLINE_KEYS = ("api_secret", "app_secret", "auth_secret", "client_secret", "password", "secret", "signing_secret", "token", "webhook_secret")
SENSITIVE_KEY = r"(password|passwd|pwd|secret|api[_\s-]?key|token|auth|authorization|client[_\s-]?secret|shared[_\s-]?secret|webhook)"
OBFUSCATED = ("password", "passwd", "passcode", "passphrase", "pwd", "secret", "token", "apikey", "bearertoken", "authorization", "authorizationbearer", "auth", "session", "cookie")
FALSE_CONTEXT = r"\b(?:regex|regular expression|password policy|password strength|policy|validator|validation|generator|generate|generated|docs?|documentation|tutorial|example|sample|dummy|fake|template|mock|redacted|masked|sanitized|replace[_ -]?me|changeme|token limit|api version|build id|region|environment|secret santa)\b"
PROSE_CONTEXT = r"\b(?:regex|regular expression|password policy|password strength|validator|validation|generator|generate|generated|documentation|example|sample|dummy|fake|template|mock|redacted|masked|sanitized|replace[_ -]?me|changeme|secret santa)\b"
VENDOR_RULES = r"(?:openai_api_key|github_token|github_pat|aws_|stripe_|google_|sendgrid_|pypi_|npm_|jwt|bearer|basic_auth)"
VERSION = r"^(?:v?\d+\.)+\d+(?:[-+][A-Za-z0-9._-]+)?$"
LITERAL = r"^(?:true|false|null|undefined|none|yes|no|on|off)$"
REGION = r"^(?:[a-z]{2}|us-gov|global|cn)(?:-[a-z0-9]+){1,4}$"
HIGH, MEDIUM = 80, 55


def entropy(s: Sql, x: str) -> str:
    """Shannon entropy of the characters, in bits."""
    if s.spark:
        # a value is bound and split once; how often a character stands in it is what a replacement takes away
        share = "cast(length(w) - length(replace(w, d, '')) as double) / length(w)"
        return f"element_at(transform(array({x}), w -> CASE WHEN w = '' THEN 0.0D ELSE round(aggregate(transform(array_distinct(split(w, '')), d -> {share}), 0.0D, (a, p) -> a - p * log2(p)), 9) END), 1)"
    c = s.chars(x)
    n = f"greatest({s.size(c)}, 1)"
    share = f"cast({s.size(s.keep(c, 'q', 'q = d'))} as double) / {n}"
    return f"round({s.total(s.each(s.distinct(c), 'd', f'-({share}) * log2({share})'))}, 9)"


def variety(s: Sql, x: str) -> str:
    """How many of lower, upper, digit and symbol occur."""
    return "(" + " + ".join(f"cast({s.test(x, p)} as int)" for p in ("[a-z]", "[A-Z]", r"\d", "[^A-Za-z0-9]")) + ")"


def alphabet(s: Sql, x: str) -> str:
    return f"CASE WHEN {s.test(x, '^[a-fA-F0-9]+$')} THEN 'hex' WHEN {s.test(x, '^[A-Za-z0-9+/=_-]+$')} THEN 'base64ish' ELSE 'general' END"


def structured_secret(s: Sql, x: str) -> str:
    e, v = entropy(s, x), variety(s, x)
    return f"(length({x}) >= 12 AND (({e} >= 2.8 AND {v} >= 3) OR ({alphabet(s, x)} = 'base64ish' AND length({x}) >= 20 AND {e} >= 4.35 AND {v} >= 2)))"


def severity(x: str, high: int = HIGH, medium: int = MEDIUM) -> str:
    return f"CASE WHEN {x} >= {high} THEN 'high' WHEN {x} >= {medium} THEN 'medium' ELSE 'low' END"


def bounded(x: str) -> str:
    return f"cast(least(100, greatest(0, floor({x} + 0.5))) as int)"


def context_score(s: Sql, window: str, ahead: Callable[[str], str] | None = None) -> str:
    """Words in the lower-case window, within -36 and 24. ``ahead``: a test that a word has to pass before it is searched for."""
    quote = lambda w: "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in w)
    # a word is searched for as it is before its boundaries are tested: most windows hold few of them
    first = (lambda w: f"{ahead(w)} AND ") if ahead else (lambda w: "")
    held = lambda w: f"{first(w)}contains({window}, {s.text(w)}) AND {s.test(window, chr(92) + 'b' + quote(w) + chr(92) + 'b')}"
    plus = [f"CASE WHEN {held(w)} THEN 6 ELSE 0 END" for w in KEYWORDS]
    minus = [f"CASE WHEN {held(w)} THEN -14 ELSE 0 END" for w in NEGATIVE_WORDS]
    both = f"CASE WHEN {held('authorization')} AND {held('bearer')} THEN 8 ELSE 0 END"
    some = f"CASE WHEN {' OR '.join(f'({held(w)})' for w in ('env', 'environment', 'credential', 'secret', 'token', 'password'))} THEN 5 ELSE 0 END"
    return f"least(24, greatest(-36, {' + '.join([*plus, *minus, both, some])}))"


def unquoted(s: Sql, x: str) -> str:
    """Without one pair of quotes around it, and trimmed."""
    inner = f"CASE WHEN length({x}) >= 2 AND left({x}, 1) = right({x}, 1) AND {s.test(f'left({x}, 1)', chr(91) + chr(34) + chr(39) + chr(96) + chr(93))} THEN substr({x}, 2, length({x}) - 2) ELSE {x} END"
    return s.trim(f"({inner})")


def normal_key(s: Sql, k: str) -> str:
    return s.sub(f"lower({k})", r"[\s.-]+", "_")


def compact_key(s: Sql, k: str) -> str:
    return f"replace({normal_key(s, k)}, '_', '')"


def safe_key(s: Sql, k: str) -> str:
    return f"({s.among(normal_key(s, k), SAFE_KEYS)} OR {s.test(compact_key(s, k), r'(?:password|passwd|pwd|secret|token|apikey|api_key|clientsecret|privatekey)(?:field|input|element|selector|ref|name)$', 'i')})"


def credential_key(s: Sql, k: str) -> str:
    return s.among(normal_key(s, k), CREDENTIAL_KEYS)


def inline_key(s: Sql, k: str) -> str:
    return f"({s.among(normal_key(s, k), INLINE_KEYS)} AND NOT {s.among(normal_key(s, k), SAFE_KEYS)})"


def unleet(x: str) -> str:
    return f"translate({x}, '03$@', 'oesa')"


def sensitive_key(s: Sql, k: str) -> str:
    return f"(NOT {safe_key(s, k)} AND ({credential_key(s, k)} OR {s.test(unleet(normal_key(s, k)), SENSITIVE_KEY, 'i')}))"


def obfuscated_key(s: Sql, k: str) -> str:
    plain = s.sub(unleet(f"lower({k})"), r"[\u200b-\u200d\ufeff\s._$@-]+", "")
    return f"({plain} <> lower({k}) AND {s.among(plain, OBFUSCATED)})"


def template_value(s: Sql, x: str) -> str:
    bracketed = f"({s.test(x, r'^\[[A-Z0-9_ -]+\]$')} AND NOT {s.test(x, r'^\[(?:PWM_\d+|[A-Z][A-Z0-9_]*_\d+)\]$')})"
    return f"({s.test(x, r'^\$\{[^}]+\}$')} OR {s.test(x, r'^<[^>]+>$')} OR {bracketed} OR {s.test(x, TEMPLATE_I, 'i')} OR {s.test(x, TEMPLATE_START_I, 'i')})"


def clean_token(s: Sql, x: str) -> str:
    return s.test(s.trim(x), CLEAN_TOKEN)


def has_token(s: Sql, x: str) -> str:
    return s.test(x, TOKEN)


def benign_composite(s: Sql, x: str) -> str:
    """A token with nothing but harmless parts around it."""
    part = r"^(?:[A-Za-z_][A-Za-z0-9_.-]{0,80}\s*[:=]|(?i:https?):\/\/[^\s]+|:\/\/[^\s]+|\.[A-Za-z0-9._-]+|\\+|(?i:[a-z]{2}|us-gov|global|cn)(?i:-[a-z0-9]+){1,4})$"
    cut = s.sub(x, TOKEN, chr(1))
    parts = f"split({cut}, '{chr(1)}')" if s.spark else f"string_split({cut}, '{chr(1)}')"
    odd = s.keep(parts, "p", f"{s.trim('p')} <> '' AND NOT {s.test(s.trim('p'), part)}")
    return f"({has_token(s, x)} AND {s.size(odd)} = 0)"


def example_like(s: Sql, x: str) -> str:
    return s.test(f"lower({x})", r"^(?:example|sample|dummy|placeholder|changeme|replace_me|replace-me|your_)|(?:^|[._\-\/])(?:example|sample|dummy|placeholder|changeme|replace_me|replace-me|your_)")


def template_marker(s: Sql, x: str) -> str:
    return s.test(f"lower({x})", r"^(?:example|sample|dummy)|placeholder|replace_me|replace-me|changeme")


def example_host(s: Sql, x: str) -> str:
    host = s.extract(f"lower({x})", r"^[a-z][a-z0-9+.-]*:\/\/(?:[^\/?#]*@)?([^\/?#:@]+)", 1)
    return s.among(host, EXAMPLE_HOSTS)


def credential_value(s: Sql, x: str) -> str:
    t = s.trim(x)
    return (
        f"(length({t}) >= 8 AND NOT {clean_token(s, t)} AND NOT {template_value(s, t)} AND NOT {s.test(t, LITERAL, 'i')} AND NOT {s.test(t, r'^\d+$')}"
        f" AND NOT {s.test(t, VERSION)} AND NOT {s.test(t, REGION, 'i')} AND {s.test(t, '[A-Za-z]')}"
        f" AND ({s.test(t, r'\d')} OR {s.test(t, '[^A-Za-z0-9]')} OR {s.test(t, '(?:secret|token|pass|key|bearer)', 'i')}))"
    )


def vendor_hex(s: Sql, k: str, x: str) -> str:
    """Hex values of vendors whose keys aren't told from digests."""
    return f"({s.test(k, 'twilio|mailchimp', 'i')} AND {s.test(x, '^(?:[a-f0-9]{24,}|[a-f0-9]{24,}-[a-z0-9]{2,6})$', 'i')})"


def provider_token(s: Sql, k: str, x: str) -> str:
    t = s.trim(x)
    return f"({s.test(normal_key(s, k), '(?:^|_)key$')} AND {s.test(t, r'^sk-(?:proj|live|test|org|svcacct|admin)-[A-Za-z0-9_-]{6,}$')})"


def key_boost(s: Sql, k: str, x: str) -> str:
    low = f"lower({k})"
    rules = (
        (credential_key(s, k), 18),
        (s.test(k, "^[A-Z0-9_]+$"), 4),
        (s.test(low, r"session(?:_id|_secret)?|cookie|token|secret|private[_-]?key|account[_-]?key"), 8),
        (s.test(low, "webhook"), 10),
        (s.test(low, "azure|storage"), 8),
        (f"{s.test(low, 'openai')} AND {s.test(x, '^sk-')}", 12),
        (f"{s.test(low, r'\bjwt\b')} AND {s.test(x, '^eyJ')}", 10),
        (f"{s.test(low, 'stripe')} AND {s.test(x, '^sk_(?:live|test)_')}", 12),
        (f"{s.test(low, 'npm')} AND {s.test(x, '^npm_[A-Za-z0-9]{36}$')}", 12),
        (f"{s.test(low, 'account[_-]?key')} AND {s.test(x, '^[A-Za-z0-9+/]{40,}={0,2}$')}", 10),
    )
    return "(" + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in rules) + ")"


def db_uri_key(s: Sql, k: str) -> str:
    names = r"(?:database|db|jdbc|mysql|postgres(?:ql)?|mariadb|mongodb|mongo|redis|amqp|rabbitmq|mssql|sqlserver)"
    return f"({s.test(normal_key(s, k), rf'\b{names}_(?:url|uri)\b')} OR {s.test(compact_key(s, k), rf'{names}(?:url|uri)\b')})"


def connection_key(s: Sql, k: str) -> str:
    packed = s.sub(f"lower({k})", "[._-]", "")
    return f"({normal_key(s, k)} = 'azurewebjobsstorage' OR contains({normal_key(s, k)}, 'conn_string') OR contains({packed}, 'connectionstring') OR contains({packed}, 'connstring'))"


def key_type(s: Sql, k: str) -> str:
    v = f"lower({k})"
    has = lambda *w: " OR ".join(f"contains({v}, '{x}')" for x in w)
    cases = (
        (s.test(v, r"\b(?:database|db|mysql|postgres(?:ql)?|mariadb|mongodb|mongo|redis|amqp|rabbitmq|mssql|sqlserver)[_-]?(?:url|uri)\b"), "DB_URI"),
        (f"{v} = 'azurewebjobsstorage' OR {has('connection_string', 'connectionstring', 'conn_string')}", "CONNECTION_STRING"),
        (has("aws_secret_access_key"), "AWS_SECRET_KEY"),
        (has("private_key", "private-key"), "PRIVATE_KEY"),
        (f"{has('password', 'passwd')} OR {s.ends(v, chr(39) + 'pwd' + chr(39))}", "PASSWORD"),
        (has("openai"), "API_KEY"),
        ("contains(" + v + ", 'webhook') AND contains(" + v + ", 'secret')", "SECRET"),
        (has("webhook"), "WEBHOOK"),
        (has("jwt", "cookie", "session", "token", "auth"), "TOKEN"),
        (has("secret"), "SECRET"),
        (has("access_key", "access-key"), "AWS_KEY"),
        (f"contains({v}, 'api') AND contains({v}, 'key')", "API_KEY"),
        (has("connection"), "CONNECTION_STRING"),
    )
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in cases) + " ELSE 'SECRET' END"


def disclosure_type(s: Sql, label: str) -> str:
    v = f"lower({label})"
    cases = (
        (r"(?:api\s*key|apikey|openai|\bagain\s+same\s+key\b|\bsame\s+key\b)", "API_KEY"),
        (r"(?:password|passwd|passcode|passphrase|pwd)", "PASSWORD"),
        (r"(?:token|bearer|authorization)", "TOKEN"),
        (r"(?:private\s*key)", "PRIVATE_KEY"),
        (r"(?:webhook)", "WEBHOOK"),
    )
    return "CASE " + " ".join(f"WHEN {s.test(v, p)} THEN '{t}'" for p, t in cases) + " ELSE 'SECRET' END"


def entropy_allowed(s: Sql, x: str, after: str) -> str:
    """Why a high-entropy token is harmless, or ''. ``after``: the text behind it."""
    lower_words = s.test(x, "^[a-z]+(?:_[a-z]+)+$")
    cases = (
        (f"{x} = ''", "empty"),
        (f"{s.test(x, '=$')} AND {s.test(after, '^[A-Za-z0-9/:]')}", "allowlisted-key"),
        (s.test(x, "^[A-Za-z]{4,24}$"), "allowlisted-word"),
        (s.test(x, "^[A-Z][A-Z0-9_]{2,64}$"), "allowlisted-id"),
        (f"{lower_words} OR {s.test(x, '^[a-z]+(?:-[a-z]+)+$')}", "allowlisted-word"),
        (f"{s.test(x, '^[A-Za-z_][A-Za-z0-9_.-]{0,80}$')} AND {s.test(f'left({after}, 6)', '^[\"' + chr(39) + ']?' + chr(92) + 's*[:=]')}", "allowlisted-key"),
        (s.test(x, r"^\d{2,5}\/[A-Za-z0-9._-]+$"), "allowlisted-url"),
        (clean_token(s, x), "allowlisted-placeholder"),
        (s.test(x, "^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "i"), "allowlisted-uuid"),
        (s.test(x, r"^\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$", "i"), "allowlisted-timestamp"),
        (s.test(x, r"^(?:https?|wss?|ftp|sftp):\/\/[^@]*$", "i"), "allowlisted-url"),
        (s.test(x, r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$", "i"), "allowlisted-domain"),
        (f"{template_value(s, x)} OR {example_like(s, x)} OR {template_marker(s, x)}", "allowlisted-template"),
        (s.test(x, LITERAL, "i"), "allowlisted-literal"),
        (s.test(x, VERSION), "allowlisted-version"),
        (f"{s.test(x, r'^(?:[A-Za-z]+-){1,4}\d{4}(?:-\d{2}){1,2}$', 'i')} OR {s.test(x, REGION, 'i')}", "allowlisted-id"),
    )
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in cases) + " ELSE '' END"


SECRET_CONTEXT = r"(?:password|passwd|pwd|token|secret|api[_\s-]?key|api-key|apikey|access[_\s-]?key|private[_\s-]?key|client[_\s-]?secret|bearer|authorization|connection\s+string|connection[_-]string|dsn|database[_\s-]?url|postgres(?:ql)?|mysql|mongodb|redis)"
EXPLICIT_CONTEXT = SECRET_CONTEXT + r"\s*(?:=|:|is|equals|set\s+to|should\s+be|becomes|->|→)?\s*$"


def explicit_context(s: Sql, before: str) -> str:
    return s.test(before, EXPLICIT_CONTEXT, "i")


def key_before(s: Sql, before: str, length: str, sign: str) -> str:
    """The key that is assigned right before the place, or ''."""
    key = s.extract(before, rf"([A-Za-z_][A-Za-z0-9_.-]{length})\s*{sign}\s*$", 1)
    # the search for a key tries each place of the line as its start: only lines that end with a sign are searched
    return f"CASE WHEN NOT {s.test(before, rf'{sign}\s*$')} THEN '' ELSE {key} END" if s.spark else key


def secret_context(s: Sql, before: str, window: str, beyond: str = "false") -> str:
    """A secret-like label on the line before, or near, unless another key is being assigned. ``beyond``: whether one stands further ahead on the line."""
    key = key_before(s, before, "{1,80}", "=")
    spaced = f"concat({normal_key(s, key)}, ' ', {s.sub(key, '[_-]+', ' ')})"
    label = rf"\b{SECRET_CONTEXT}\b"
    return f"(({key} = '' OR {s.test(spaced, label, 'i')}) AND ({s.test(f'concat({before}, {chr(39)} {chr(39)}, {window})', label, 'i')} OR {beyond}))"


def entropy_reason(s: Sql, x: str, explicit: str, context: str) -> str:
    a = alphabet(s, x)
    return (
        f"CASE WHEN length({x}) < 8 THEN 'below-context-min-length' WHEN ({explicit} OR {context}) AND {a} = 'hex' THEN 'hex-context-high-entropy'"
        f" WHEN {explicit} OR {context} THEN 'secret-context-entropy' WHEN length({x}) < 20 THEN 'entropy-only-short-token-block'"
        f" WHEN {a} = 'hex' THEN 'hex-without-context' WHEN {a} = 'base64ish' THEN 'base64ish-high-entropy' ELSE 'general-high-entropy' END"
    )


def entropy_redact(s: Sql, x: str, reason: str, explicit: str) -> str:
    e, v = entropy(s, x), variety(s, x)
    return (
        f"CASE {reason} WHEN 'hex-context-high-entropy' THEN {explicit} AND length({x}) >= 32 AND {e} >= 3.45"
        f" WHEN 'secret-context-entropy' THEN ({e} >= 2.8 AND {v} >= 2) OR (length({x}) >= 12 AND {e} >= 3.0)"
        f" WHEN 'base64ish-high-entropy' THEN {e} >= 4.35 AND {v} >= 2 WHEN 'general-high-entropy' THEN {e} >= 4.2 AND {v} >= 3 ELSE false END"
    )


def column(text: str) -> Column:
    """The Spark column of a scalar text."""
    return F.expr(text)


def fnv1a(text: str | Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of ASCII text."""
    text = F.col(text) if isinstance(text, str) else text
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(4294967296))
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(2166136261).cast("long"), step)


__all__ = [n for n in dir() if not n.startswith("_")] + ["SPARK"]
