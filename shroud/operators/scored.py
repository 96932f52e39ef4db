"""Detectors whose candidates are kept by a test and a score over the value and its line: headers and cookies, assignments and connection strings, logins in URLs, disclosures in prose, keys written to be overlooked, identities,
passwords that stand alone, enterprise and cloud names. ``matcher`` finds candidates; tests and scores are scalar SQL over raw, key, before, after.

``PROFILE`` detectors belong to the enterprise profile, which a caller may leave out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import words as W
from ..functions.dialect import SPARK as Q
from ..functions.dialect import Sql
from .matcher import Entry, matched
from .spans import fenced, piecewise


class Scored(NamedTuple):
    id: str
    type: Callable[[Sql], str]
    category: str
    regex: str
    flags: str
    groups: tuple[int, ...]
    markers: tuple[str, ...]
    keep: Callable[[Sql], str]
    score: Callable[[Sql], str]
    least: int = 0
    key: int = 0
    #: Where the detector stands in the order of all, which breaks ties.
    place: int = 15
    methods: tuple[str, ...] = ("heuristic",)
    inner: tuple[str, str, tuple[int, ...], int] | None = None
    worth: str = ""
    decoded: bool = False
    #: Whether the value ends where another key begins in it.
    cut: bool = False
    #: Expressions of key and value, of which one pair matches what ``keep`` keeps.
    asks: tuple[tuple[str, str], ...] = ()


# Token sets, context words, shapes and expressions.
ENVIRONMENTS = ("prod", "prd", "production", "dev", "development", "test", "tst", "qa", "uat", "stage", "staging", "stg", "int", "integration", "sandbox", "sbx", "preprod", "ppd", "nonprod")
LOCATIONS = ("eu", "weu", "neu", "de", "uk", "us", "ch", "in", "kos", "ber", "fra", "mun", "lon", "zur", "pri", "westeurope", "northeurope", "eastus", "westus", "centralus", "uksouth", "germanywestcentral", "switzerlandnorth", "eu-central-1", "eu-west-1", "us-east-1", "us-west-2", "eu-de", "eu-nl")
SERVICES = ("vpc", "vnet", "subnet", "snet", "sg", "nsg", "firewall", "fw", "route", "rt", "peer", "peering", "endpoint", "private-endpoint", "network", "identity", "sec", "security", "files", "file", "storage", "backup", "aks", "sql", "app", "core", "shared", "hub", "spoke", "dns", "pe", "pep", "kv", "keyvault", "pl", "sss", "share", "nic", "logic", "aa", "vm", "appgw", "law", "db", "bastion", "jump", "ecs", "ec2", "compute", "server", "instance", "volume", "disk", "evs", "ebs", "bucket", "obs", "s3", "blob", "rds", "database", "eks", "gke", "cce", "cluster", "k8s", "elb", "alb", "nlb", "lb", "gateway", "zone", "kms", "iam", "role", "policy", "secret", "vault", "eip", "keypair", "image", "flavor", "nat", "vpn")
HOST_ROLES = ("dc", "srv", "sql", "fs", "file", "print", "jump", "bastion", "vpn", "rdp", "ssh", "aks", "vm", "web", "app", "db")
INFRASTRUCTURE = r"\b(?:resource\s*group|azure|cloud|tenant|subscription|vnet|subnet|private\s*endpoint|storage\s*account|azure\s*files|file\s*share|smb|kerberos|hostname|computername|device\s*name|server|fqdn|rdp|ssh|winrm|intune|entra|ad|ldap)\b"
PROVIDERS = r"\b(?:azure|aws|amazon\s+web\s+services|gcp|google\s+cloud|otc|open\s+telekom\s+cloud|t\s*cloud\s+public|t-systems\s+cloud|openstack|kubernetes|k8s|kubeconfig|project|tenant|domain|arn|iam|account|obs|ecs|evs|vpc|cce|rds|elb|s3|gcs|bucket)\b"
IDENTITIES = r"\b(?:user|username|login|owner|created\s+by|assigned\s+to|upn|samaccountname|email|entra|ad|ldap|identity|account)\b"
SHARES = r"\b(?:share|file\s*share|azure\s*files|smb|migration|migrate|managed\s*folder|folder\s*owner|ntfs|acl|rbac|storage\s*account|gfs|ngfs)\b"
ACCOUNTS = r"\b(?:storage\s*account|azure\s*files|file\s*share|smb|private\s*endpoint|kerberos|account\s*name)\b"
ADDRESS = r"^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$"
PRIVATE = r"^0*(?:10|172\.0*(?:1[6-9]|2[0-9]|3[01])|192\.0*168)\."
OCTETS = r"^(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)){3}(?:\/(?:3[0-2]|[012]?\d))?$"
PATH = r"[A-Za-z0-9._@%+\-~\/\\:]"
PATHS = (r"^(?:\/|~\/|\.{1,2}\/|[A-Za-z]:[\\\/])[A-Za-z0-9._@%+\-~\\\/]+$", r"^(?:\/)?[A-Za-z0-9._@%+\-~]+(?:\/[A-Za-z0-9._@%+\-~]+){2,}(?:\.[A-Za-z0-9_-]{1,8})?$")
PASSWORD_WORD = r"(?:^|[_\-\s])(?:secret|password|passwd|passcode|passphrase|pwd)(?:$|[_\-\s]|\d)"
BUILD = r"^(?:[A-Za-z]+-){1,4}\d{4}(?:-\d{2}){1,2}$"
MARKER = r"^DUPLICATE_CHECK_(?:BEGIN|END)_\d+$"
KNOWN_PLACEHOLDER = r"\[(?:PWM|NET|PUB_HOST|[A-Z][A-Z0-9_]*)_\d+"
SAFE_SERVICE = (r"\b(?:service|deployment|module|component|job|pod|runbook)\b.{0,80}\b(?:named|called|creates|uses|references|mentions|explains)\b", r"\b(?:named|called|creates|uses|references|mentions|explains)\b.{0,80}\b(?:service|deployment|module|component|job|pod|runbook)\b")


def window(radius: int) -> str:
    return f"lower(concat(right(before, {radius}), ' ', left(after, {radius})))"


def points(*cases: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in cases)


def name_parts(s: Sql, x: str) -> str:
    return f"split(lower({x}), '[-_.]+')" if s.spark else f"regexp_split_to_array(lower({x}), '[-_.]+')"


def token_score(s: Sql, x: str, prefixed: bool = False) -> str:
    """Points of the parts of a name: environments, places, services and numbers."""
    one = points((s.among("p", ENVIRONMENTS), 14), (s.among("p", LOCATIONS), 12), (s.among("p", SERVICES), 10), (s.test("p", r"^\d{2,7}$"), 4))
    all_ = f"cast({s.total(s.each(name_parts(s, x), 'p', f'cast({one} as double)'))} as int)"
    first = s.among(s.extract(f"lower({x})", "^[^-_.]+"), ENVIRONMENTS)
    return f"({all_} - CASE WHEN {first} THEN 6 ELSE 0 END)" if prefixed else all_


def infrastructure(s: Sql) -> str:
    return s.test(window(96), INFRASTRUCTURE, "i")


def provider(s: Sql) -> str:
    return s.test(window(128), PROVIDERS, "i")


def identity(s: Sql) -> str:
    return s.test(window(96), IDENTITIES, "i")


def path_like(s: Sql, x: str) -> str:
    """Part of a file path: what stands around the value belongs to it."""
    token = f"concat({s.extract('before', PATH + '*$')}, {x}, {s.extract('after', '^' + PATH + '*')})"
    return f"(NOT {s.test(token, ':' + chr(92) + '/' + chr(92) + '/')} AND ({s.test(token, PATHS[0])} OR {s.test(token, PATHS[1])}))"


def bare_password(s: Sql, x: str) -> str:
    """A token that looks made up as a password: letters, digits and symbols, no address, digest, version, label or path."""
    keyword = s.test(x, PASSWORD_WORD, "i")
    no = (s.test(x, r"\s"), S.has_token(s, x), S.example_like(s, x), S.template_marker(s, x), S.template_value(s, x), s.test(x, ADDRESS, "i"), s.test(x, r"^(?:https?|wss?|ftp|sftp|mailto):", "i"), s.test(x, r"^(?:\d{1,3}\.){3}\d{1,3}(?:\/\d{1,2})?$"), s.test(x, "^[a-f0-9]{32,}$", "i"), s.test(x, "^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "i"), s.test(x, S.VERSION), s.test(x, BUILD, "i"), s.test(x, MARKER, "i"), path_like(s, x))
    mixed = f"{s.test(x, '[a-z]')} AND {s.test(x, '[A-Z]')} AND length({x}) >= 14"
    enough = f"{s.test(x, '[A-Za-z]')} AND {s.test(x, '[0-9]')} AND ({s.test(x, '[^A-Za-z0-9]')} OR ({mixed}) OR {keyword})"
    readable = f"({keyword} OR length({x}) >= 20 OR {s.test(x, '[A-Za-z]{5,}')})"
    return f"(length({x}) BETWEEN 10 AND 128 AND NOT ({' OR '.join(no)}) AND {readable} AND ({S.variety(s, x)} >= 3 OR {keyword}) AND {enough} AND ({S.entropy(s, x)} >= 3.1 OR ({keyword} AND {S.entropy(s, x)} >= 2.6)))"


def ipv6(s: Sql, x: str) -> str:
    """Eight groups, or fewer around one gap."""
    plain = s.sub(x, r"%\w+$", "")
    group = "[0-9A-Fa-f]{1,4}"
    return f"(length({x}) <= 64 AND ({s.test(plain, f'^(?:{group}:){{7}}{group}$')} OR ({s.test(plain, f'^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$')} AND length({plain}) - length(replace({plain}, ':', '')) <= 7)))"


def username_like(s: Sql, x: str) -> str:
    return f"({s.test(x, '^[A-Za-z0-9._@-]{3,64}$')} AND NOT {s.test(x, r'^\d+$')})"


def _no_placeholder(s: Sql) -> str:
    return f"NOT {s.test('raw', KNOWN_PLACEHOLDER)}"


def _identity_ok(s: Sql) -> str:
    bad = (S.has_token(s, "raw"), S.example_like(s, "raw"), S.template_marker(s, "raw"), S.template_value(s, "raw"), s.test("raw", r"@example\.(?:com|org|net)$", "i"), s.test("raw", S.LITERAL, "i"))
    return f"NOT ({' OR '.join(bad)}) AND ({s.test('raw', ADDRESS, 'i')} OR {username_like(s, 'raw')})"


def _is(value: str) -> Callable[[Sql], str]:
    return lambda s: f"'{value}'"


def _email_or_user(s: Sql) -> str:
    return f"CASE WHEN {s.test('raw', ADDRESS, 'i')} THEN 'EMAIL' ELSE 'USERNAME' END"


def _identity_score(s: Sql) -> str:
    mail, key = s.test("raw", ADDRESS, "i"), S.normal_key(s, "key")
    some = points((s.test(key, "email|mail"), 10), (s.test(key, "username|login|user"), 8), (mail, 8), (f"{mail} AND {s.among(key, ('email', 'e_mail', 'mail'))}", 18), (s.test("raw", "[._-]"), 3), (s.test("raw", "[0-9]"), 2), (s.test(window(96), r"\b(?:password|secret|token|auth|credential)\b", "i"), 8))
    return f"CASE WHEN {mail} THEN 52 ELSE 48 END + {some} + greatest(-8, ctx)"


def _bare_score(s: Sql) -> str:
    some = points((s.test("raw", "[^A-Za-z0-9]"), 12), (f"{s.test('raw', '[A-Z]')} AND {s.test('raw', '[a-z]')}", 8), (s.test("raw", "[0-9]"), 8), ("length(raw) >= 14", 6), (s.test("raw", PASSWORD_WORD, "i"), 20), (f"{S.entropy(s, 'raw')} >= 3.6", 8))
    return f"54 + {some} + greatest(-6, ctx)"


def _bearer_keep(s: Sql) -> str:
    fake = f"({s.test('raw', '^fake[-_]', 'i')} AND length(raw) >= 16 AND {s.test('raw', '(?:bearer|token|secret|key|pass|[0-9])', 'i')})"
    return f"NOT {s.test('before', '[?&][A-Za-z0-9_.-]*[^' + chr(92) + 'S' + chr(92) + 'r' + chr(92) + 'n]*[:=][^' + chr(92) + 'n]*$')} AND NOT {S.safe_key(s, 'key')} AND {s.test(S.normal_key(s, 'key'), '(?:bearer|token|auth|authorization)', 'i')} AND length(raw) >= 8 AND ({S.credential_value(s, 'raw')} OR {fake})"


def _hostname_keep(s: Sql) -> str:
    return f"{_no_placeholder(s)} AND NOT {s.test('raw', r'\.(?:com|org|net|io|dev|co|edu|gov)$', 'i')} AND NOT {s.test('right(before, 4)', '(?:@|:' + chr(92) + '/' + chr(92) + '/)$')}"


def _hostname_score(s: Sql) -> str:
    roles = s.size(s.keep(name_parts(s, "raw"), "p", f"{s.among('p', HOST_ROLES)} OR {s.test('p', '^(?:dc|fs|vm|sql|srv)[0-9]+$')}"))
    return f"36 + {points((s.test('raw', r'\.(?:local|lan|corp|internal|ad|domain)$', 'i'), 24), (f'{roles} > 0', 18), (infrastructure(s), 12))} + {token_score(s, 'raw')} / 2.0"


def _person_keep(s: Sql) -> str:
    label = f"({s.test('before', chr(92) + 'bresource' + chr(92) + 's+' + chr(34) + '[^' + chr(34) + ']+' + chr(34) + chr(92) + 's+' + chr(34) + '$')} AND {s.test('after', '^' + chr(34) + chr(92) + 's*(?:' + chr(92) + '{|$)')})"
    line = "concat(before, raw, after)"
    prose = f"({s.test(line, SAFE_SERVICE[0], 'i')} OR {s.test(line, SAFE_SERVICE[1], 'i')})"
    ends = s.test("raw", r"\.(?:local|lan|corp|internal|com|org|net|io|dev|js|ts|jsx|tsx|json|md|txt|pdf|docx|xlsx|png|jpg|jpeg|gif|css|html)$", "i")
    domain = "contains(raw, chr(92))"
    file = f"({s.test('right(before, 1)', '[' + chr(92) + chr(92) + chr(92) + '/]')} OR {s.test('left(after, 1)', '[' + chr(92) + chr(92) + chr(92) + '/]')} OR {s.test('raw', '[.][A-Za-z0-9]{1,8}$')})"
    dotted = s.test("raw", "^[a-z]{2,32}[.][a-z]{2,32}$")
    return f"{_no_placeholder(s)} AND NOT {label} AND NOT {prose} AND NOT {ends} AND ({domain} OR NOT {file}) AND NOT ({dotted} AND (left(after, 1) = '@' OR right(before, 1) = '@' OR NOT {identity(s)}))"


def _person_score(s: Sql) -> str:
    return f"54 + {points(('contains(raw, chr(92))', 24), (s.test('raw', '^(?:svc|sa|adm|admin|robot|automation)[-_]', 'i'), 22), (s.test('raw', '^[a-z]{2,32}[.][a-z]{2,32}$'), 14), (identity(s), 10))}"


def _account_score(s: Sql) -> str:
    v = "lower(raw)"
    return f"38 + {points((s.test(v, '^st(?:de|us|uk|ch|in|eu|weu|neu|ber|fra|chi|lon)'), 18), (s.test(v, '(?:prod|prd|dev|test|tst|stage|stg|uat|qa|int|sandbox)'), 16), (s.test(v, '(?:file|files|storage|core|backup|share)'), 12), (s.test(v, '[0-9]{3,7}$'), 8), (s.test(window(96), ACCOUNTS, 'i'), 16))}"


def _stack_type(s: Sql) -> str:
    k = "lower(key)"
    return f"CASE WHEN contains({k}, 'project') THEN 'OPENSTACK_PROJECT_ID' WHEN contains({k}, 'tenant') THEN 'OPENSTACK_TENANT_ID' WHEN contains({k}, 'domain') THEN 'OPENSTACK_DOMAIN_ID' WHEN contains({k}, 'user') THEN 'OPENSTACK_USER_ID' ELSE 'OPENSTACK_RESOURCE_ID' END"


# Headers, URL schemes, labels and connectors of disclosures, keys of encoded values.
HEADERS = ("authorization", "x-api-key", "api-key", "x-auth-token", "x-access-token", "x-session-token", "ocp-apim-subscription-key")
COOKIES = ("cookie", "set-cookie")
SCHEMES = ("postgres", "postgresql", "mysql", "mariadb", "mongodb", "mongodb+srv", "redis", "amqp", "mssql", "sqlserver", "https", "http", "ftp", "sftp", "smtp")
DATABASES = SCHEMES[:10]
_LABEL_OF_HOST = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_HOST = rf"(?:\[[0-9A-Fa-f:.]+\](?::\d{{1,5}})?|{_LABEL_OF_HOST}(?:\.{_LABEL_OF_HOST})*\.?(?::[^\/?#\s'\"`<>:@]*)?)"
#: scheme://user (1), scheme (2), user (3), password up to the last @ of the authority (4).
LOGIN = rf"\b(([A-Za-z][A-Za-z0-9+.-]*):\/\/([^\/?#\s'\"`<>:]*)):([^\/?#\s'\"`<>]+)@{_HOST}(?=[\/?#\s'\"`<>]|$)"
PLAIN_PASSWORDS = r"^(?:password|secret|token|test|demo|example|sample|dummy|fake)$"
PLAIN_USERS = r"^(?:demo|example|sample|dummy|fake|test|user|username)$"
_KINDS_OF_SECRET = r"(?:password|passwd|pwd|passcode|passphrase|secret|api\s*key|apikey|token|access\s+token|refresh\s+token|bearer\s+token|client\s+secret|private\s+key|webhook\s+secret)"
_INTRO = r"(?:this\s+is\s+my|here\s+is\s+my|here\s+is\s+the|here'?s\s+my|my|the|our|use\s+this)"
LABELS = rf"(?:real|actual)\s+(?:(?:db|database)\s+)?{_KINDS_OF_SECRET}\s+value|(?:{_INTRO}\s+)?(?:(?:real|actual|prod(?:uction)?|live)\s+)?(?:(?:db|database)\s+)?{_KINDS_OF_SECRET}|(?:again\s+(?:the\s+)?)?same\s+(?:key|token|password|secret)|real\s+value|actual\s+value"
CONNECTORS = r"\s*(?:(?:is|equals|set\s+to|should\s+be|becomes)\s*)?(?:=|:|->|→)?\s*"
DISCLOSURE = rf"""\b((?:{LABELS}){CONNECTORS})(?:"([^"\r\n]{{6,}})"|'([^'\r\n]{{6,}})'|`([^`\r\n]{{6,}})`|([^\s,;"'`]{{6,}}))"""
INTRODUCED = r"\b(?:this\s+is\s+my|here\s+is\s+my|here\s+is\s+the|here's\s+my|my|the|our|use\s+this|real|actual|prod(?:uction)?|live|same|again)\b|\bvalue\s*$"
CONNECTED = r"(?:\s(?:is|equals|set\s+to|should\s+be|becomes)\s*(?:=|:|->|→)?|=|:|->|→)\s*$"
VENDOR_TOKEN = "^(?:eyJ|gh[pousr]_|github_pat_|glpat-|xox|npm_|pypi-)"
_APART = r"[\u200b-\u200d\ufeff\s._$@-]"
#: A key whose letters may stand apart, where no other word runs into it.
DISGUISED = rf"""(?:^|[^A-Za-z0-9$@\s._\u200b-\u200d\ufeff-]){_APART}*([A-Za-z](?:{_APART}*[A-Za-z0-9$@]){{1,24}})\s*[:=]\s*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s\r\n]+))"""
ENCODED_KEY = r"(?:^|[_\-.])(?:encoded|base64|b64|secret|token|password|credential)(?:$|[_\-.])"
SECRET_WORDS = r"(?:password|passwd|secret|token|api[_ -]?key|credential|auth)"
# Keys, values and attributes of assignments and connection strings.
_KEY = r"([A-Za-z_][A-Za-z0-9_.-]{0,80})[^\S\r\n]*[:=][^\S\r\n]*"
#: A value up to its quote or the end of the line, or up to a delimiter.
DELIMITED = r"""(?:"([^\["\r\n][^"\r\n]*)|'([^\['\r\n][^'\r\n]*)|`([^\[`\r\n][^`\r\n]*)|([^\[\s,;"'`}\]][^\s,;"'`}\]]*))"""
INLINE = r"(?:^|[^A-Za-z0-9_.?&@/:-])((?:(?:api|app|auth|client|signing|webhook)[\s._-]+)?secret|password|token)[^\S\r\n]*[:=][^\S\r\n]*" + DELIMITED
DB_SCHEMES = r"(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp|mssql|sqlserver)"
DB_PASSWORD = rf"^{DB_SCHEMES}:\/\/[^\/?#\s'\"`<>:]*:([^\/?#\s'\"`<>{{}}\[\]]+)@{_HOST}(?:[\/?#\s'\"`<>]|$)"
CONNECTION = r"^(?:DefaultEndpointsProtocol=https;AccountName=[^;\r\n]+;AccountKey=[^;\r\n]+;EndpointSuffix=[^\s;]+|Endpoint=sb:\/\/[^\s;]+;SharedAccessKeyName=[^;\s]+;SharedAccessKey=[^;\s]+(?:;EntityPath=[^;\s]+)?|[^=\s;]+=[^;\r\n]+(?:;[^=\s;]+=[^;\r\n]+){2,})"
SQL_SERVER = r"\b(?:jdbc:sqlserver|sqlserver|mssql):\/\/[^\s'\"`<>{}\[\]]*"
SQL_SERVER_PASSWORD = r"(?:^|;)(password|pwd)\s*=\s*([^;\s'\"`<>{}\[\]]+)"
ADO_PASSWORD = r"\b(?:Server|Data Source|Address|Addr|Network Address)\s*=[^;\r\n]+;[^\r\n]*?;\s*(password|pwd)\s*=\s*([^;\r\n'\"`<>{}\[\]]+)"
EXAMPLE_SEGMENT = r"(?:^|[;=:/_.-])(?:example|sample|dummy)[A-Za-z0-9_-]*(?:$|[;=:/_.-])"


#: Values that a credential's tests may keep: eight characters, a letter among them.
_EIGHT = r"^(?=[\s\S]*[A-Za-z])[\s\S]{8}"


def _apart(word: str) -> str:
    """The letters of a word with marks between them that a key's normal form leaves out."""
    return r"[\s._-]*".join({"o": "[o0]", "e": "[e3]", "s": "[s$]", "a": "[a@]"}.get(c, c) for c in word)


#: Keys that name a credential once their marks and letters are in normal form, keys of URLs, connections and identities, and those that C15 looks at.
_CREDENTIAL_KEYS = "|".join(map(_apart, ("pass", "pwd", "secret", "key", "token", "auth", "webhook", "url")))
_URL_KEYS = "|".join(map(_apart, ("url", "uri")))
_CONNECTION_KEYS = "|".join(map(_apart, ("connstring", "connectionstring", "azurewebjobsstorage")))
_DISGUISED_KEYS = r"^[\u200b-\u200d\ufeff\s._-]*(?:" + "|".join(_apart(w).replace(r"[\s._-]*", r"[\u200b-\u200d\ufeff\s._-]*") for w in S.OBFUSCATED) + r")[\u200b-\u200d\ufeff\s._-]*$"
_LABELS_END = r"(?:\s|=|:|>|→)$"


def unsuppressed(s: Sql) -> str:
    """No template, token or example, and no context that speaks against it; key or value of a credential outweigh the last two."""
    closed = f"(NOT {S.template_marker(s, 'raw')} AND ({S.credential_key(s, 'key')} OR {S.credential_value(s, 'raw')}))"
    soft = f"({S.example_like(s, 'raw')} OR ctx <= -14 OR {s.test('lower(concat(before, raw, after))', S.FALSE_CONTEXT, 'i')} OR ((far & 1) <> 0))"
    return f"(NOT {S.template_value(s, 'raw')} AND NOT {S.clean_token(s, 'raw')} AND NOT ({S.has_token(s, 'raw')} AND {S.benign_composite(s, 'raw')}) AND ({closed} OR NOT {soft}))"


def embedded_cut(s: Sql, x: str) -> str:
    """The value up to another key that begins in it, unless the key is part of a URL."""
    head = s.extract(x, r"^(.*?(?:[^A-Za-z0-9_.?&\/:-]|[^A-Za-z0-9_.-][0-9.-]+)|[0-9.-]+)[A-Za-z_][A-Za-z0-9_.-]{1,80}\s*[:=]", 1)
    return f"coalesce(nullif({head}, ''), {x})"


def _quiet(s: Sql) -> str:
    """Neither a template nor an example, and nothing ahead on the line speaks of examples."""
    return f"open AND NOT ({s.test('before', S.FALSE_CONTEXT, 'i')} OR ((far & 2) <> 0))"


def _tail_of(s: Sql, pattern: str) -> str:
    """Whether the pattern stands right before the key of an assignment."""
    return s.test("before", pattern + r"[A-Za-z_][A-Za-z0-9_.-]{0,80}[^\S\r\n]*[:=][^\S\r\n]*[\"'`]?$", "i")


def _inline_keep(s: Sql) -> str:
    """An exact key. One that is a plain word needs a sign of data ahead: the line's start, a quote, bracket or delimiter, or another assignment."""
    cue = s.test("before", r"(?:^\s*|[\"'`{\[,;]\s*|[:=][^\s]*\s+)(?:password|secret|token)[^\S\r\n]*[:=][^\S\r\n]*[\"'`]?$", "i")
    bare = s.test(S.normal_key(s, "key"), "^(?:password|secret|token)$")
    generic = f"({S.normal_key(s, 'key')} = 'secret' AND {s.test('raw', '[A-Za-z]')} AND {s.test('raw', '[0-9]')} AND {s.test('raw', '(?:secret|token|pass|key|bearer)', 'i')})"
    server = _tail_of(s, r"(?:sqlserver|mssql):\/\/[^\n]*;")
    return f"length(raw) >= 8 AND {S.inline_key(s, 'key')} AND (NOT {bare} OR {cue}) AND NOT {server} AND {S.credential_value(s, 'raw')} AND NOT {S.vendor_hex(s, 'key', 'raw')} AND NOT {S.benign_composite(s, 'raw')} AND ({generic} OR ({_quiet(s)}))"


def _explicit_keep(s: Sql) -> str:
    """A key that names a credential, or any key of a provider's token."""
    k = S.normal_key(s, "key")
    short = f"({s.test(k, '^(?:cookie|session)$')} AND length(raw) < 16 AND NOT {s.test('raw', '(?:secret|token|auth|session|jwt|bearer)', 'i')})"
    bearer = f"({s.test(k, '^(?:auth(?:_?header)?|authorization)$')} AND {s.test('raw', '^bearer[ ]+', 'i')})"
    no = (_tail_of(s, "[?&]"), S.safe_key(s, "key"), S.db_uri_key(s, "key"), S.connection_key(s, "key"), S.vendor_hex(s, 'key', 'raw'), S.benign_composite(s, "raw"), short, bearer)
    provider_value = f"({S.provider_token(s, 'key', 'raw')} AND NOT {S.template_value(s, 'raw')})"
    return f"NOT ({' OR '.join(no)}) AND (({S.sensitive_key(s, 'key')} AND {S.credential_value(s, 'raw')}) OR {provider_value}) AND {_quiet(s)}"


def _explicit_type(s: Sql) -> str:
    return f"CASE WHEN {S.provider_token(s, 'key', 'raw')} THEN 'API_KEY' ELSE {S.key_type(s, 'key')} END"


def _explicit_score(s: Sql) -> str:
    return f"62 + CASE WHEN {S.credential_key(s, 'key')} THEN 12 ELSE 4 END + {points((S.provider_token(s, 'key', 'raw'), 16), (f'{S.entropy(s, "raw")} >= 3.6', 4), (f'{S.variety(s, "raw")} >= 3', 2))}"


def _full_score(s: Sql) -> str:
    return f"99 + CASE WHEN {S.entropy(s, 'raw')} >= 3.8 THEN 2 ELSE 0 END + greatest(0, ctx)"


def _connection_keep(s: Sql) -> str:
    return f"length(raw) >= 8 AND {S.connection_key(s, 'key')} AND NOT {S.db_uri_key(s, 'key')} AND open AND NOT ({S.example_host(s, 'raw')} OR {S.template_marker(s, 'raw')} OR {s.test('raw', EXAMPLE_SEGMENT, 'i')})"


def _attribute_keep(s: Sql) -> str:
    return f"length(raw) >= 8 AND NOT {S.clean_token(s, 'raw')} AND NOT {S.benign_composite(s, 'raw')} AND {_quiet(s)}"


def _ado_keep(s: Sql) -> str:
    """A password attribute of a connection that names user and database as well."""
    line = "concat(before, raw, after)"
    return f"{s.test(line, r'\b(?:User\s+Id|UID|User)\s*=', 'i')} AND {s.test(line, r'\b(?:Database|Initial Catalog)\s*=', 'i')} AND {_attribute_keep(s)}"


def _header_keep(s: Sql) -> str:
    scheme = f"(lower(key) = 'authorization' AND {s.test('raw', '^(?:bearer|basic)[ \t]+[^,;]', 'i')})"
    pairs = f"({s.among('lower(key)', COOKIES)} AND {s.test('raw', r'(?:^|;\s*)[^=;\s]+=')})"
    return f"length(raw) >= 8 AND NOT {scheme} AND NOT {pairs} AND ({S.credential_value(s, 'raw')} OR {S.structured_secret(s, 'raw')} OR ({s.test('raw', '[A-Za-z]')} AND {s.test('raw', '[0-9]')} AND {S.entropy(s, 'raw')} >= 2.6)) AND open"


def _header_type(s: Sql) -> str:
    return f"CASE WHEN {s.test('lower(key)', 'auth|cookie|-token$')} THEN 'TOKEN' ELSE 'API_KEY' END"


def _cookie_keep(s: Sql) -> str:
    name = s.sub("lower(key)", "[._-]+", "")
    return f"({name} = 'sid' OR {s.test(name, 'session|auth|token|jwt')}) AND length(raw) >= 8 AND ({S.credential_value(s, 'raw')} OR {S.structured_secret(s, 'raw')} OR {s.test('raw', '^[A-Za-z0-9%._~-]{16,}$')}) AND open"


def url_password(s: Sql, x: str) -> str:
    """Made up as a password of a URL: no template, version or plain word."""
    no = (S.has_token(s, x), S.example_like(s, x), S.template_marker(s, x), S.template_value(s, x), s.test(x, PLAIN_PASSWORDS, "i"), s.test(x, S.VERSION))
    return f"(length({x}) BETWEEN 8 AND 128 AND NOT ({' OR '.join(no)}) AND {s.test(x, '[A-Za-z]')} AND {s.test(x, '[^A-Za-z]')})"


def _scheme_in(s: Sql, schemes: tuple[str, ...]) -> str:
    return s.among(s.extract("lower(key)", r"^([^:]*):", 1), schemes)


def _url_known(s: Sql, password: str) -> str:
    """A supported scheme, and no sample login of a sample host. ``password``: the text of the password at the span."""
    url = f"concat(key, ':', {password}, {s.extract('after', "^[^ \t\n'`<>]*")})"
    user = s.extract("key", r":\/\/(.*)$", 1)
    generic = f"({S.template_marker(s, 'raw')} OR {s.test('raw', PLAIN_PASSWORDS, 'i')} OR {s.test(user, PLAIN_USERS, 'i')})"
    return f"{_scheme_in(s, SCHEMES)} AND NOT ({S.example_host(s, url)} AND {generic} AND NOT {url_password(s, 'raw')})"


def _login_keep(s: Sql) -> str:
    tail = s.test("raw", rf"^(?:{S.TOKEN})[^\s,;:=\])}}]+$")
    return f"{_url_known(s, 'raw')} AND NOT {S.clean_token(s, 'raw')} AND NOT {tail}"


def _login_type(s: Sql) -> str:
    return f"CASE WHEN {_scheme_in(s, DATABASES)} THEN 'DB_URI' WHEN {s.test('key', '://.*(?:token|oauth)', 'i')} THEN 'TOKEN' ELSE 'PASSWORD' END"


def _user_keep(s: Sql) -> str:
    host = s.extract("after", r"@([^@\/?#\s:'`<>]+)(?:[:\/?#\s'`<>]|$)", 1)
    return f"{_scheme_in(s, SCHEMES)} AND NOT {_scheme_in(s, DATABASES)} AND NOT {S.clean_token(s, 'raw')} AND NOT ({s.among(f'lower({host})', S.EXAMPLE_HOSTS)} AND {s.test('raw', PLAIN_USERS, 'i')})"


def suffix_secret(s: Sql, x: str) -> str:
    """What is glued behind a token and looks like the rest of a secret."""
    no = (s.test(x, r"\s"), s.test(x, r"^[.:\/\\]+"), S.has_token(s, x), S.example_like(s, x), S.template_marker(s, x), S.template_value(s, x), s.test(x, "^(?:https?|wss?|ftp|sftp|mailto):", "i"), s.test(x, S.VERSION), s.test(x, BUILD), s.test(x, S.REGION, "i"))
    digits = s.test(x, r"^\d+$")
    strong = f"(CASE WHEN {digits} THEN length({x}) >= 12 AND {S.entropy(s, x)} >= 2.0 ELSE {S.entropy(s, x)} >= 3.0 AND {S.variety(s, x)} >= 2 END)"
    near = f"(length({x}) >= 10 AND ctx > 0 AND ({digits} OR ({s.test(x, '[A-Za-z]')} AND {s.test(x, '[0-9]')} AND {S.variety(s, x)} >= 2 AND {S.entropy(s, x)} >= 2.6)))"
    return f"(length({x}) BETWEEN 8 AND 128 AND NOT ({' OR '.join(no)}) AND ({strong} OR {near}))"


def _suffix_score(s: Sql) -> str:
    some = points(("length(raw) >= 12", 6), ("length(raw) >= 20", 6), (s.test("raw", r"^\d+$"), 4), (f"{S.variety(s, 'raw')} >= 2", 5), (f"{S.variety(s, 'raw')} >= 3", 5), (f"{S.entropy(s, 'raw')} >= 3.2", 4), (f"{S.entropy(s, 'raw')} >= 3.8", 4))
    return f"70 + {some} + greatest(0, ctx)"


def disclosed(s: Sql, x: str, kind: str) -> str:
    """A value that prose gives as a secret of the kind."""
    numbers = f"CASE {kind} WHEN 'PASSWORD' THEN length({x}) >= 6 WHEN 'SECRET' THEN length({x}) >= 8 WHEN 'TOKEN' THEN length({x}) >= 10 ELSE false END"
    no = (f"length({x}) < 8", S.clean_token(s, x), S.template_value(s, x), S.example_like(s, x), S.template_marker(s, x), s.test(x, S.LITERAL, "i"), s.test(x, S.VERSION), s.test(x, S.REGION, "i"), s.test(x, BUILD), path_like(s, x))
    vendor = f"({kind} = 'API_KEY' AND {s.test(x, '^sk[-_]', 'i')}) OR ({kind} = 'TOKEN' AND {s.test(x, VENDOR_TOKEN, 'i')})"
    entropy = f"({S.entropy_allowed(s, x, 'after')} = '' AND {S.entropy_redact(s, x, S.entropy_reason(s, x, 'true', 'true'), 'true')})"
    mixed = f"{s.test(x, '[A-Za-z]')} AND {s.test(x, '[^A-Za-z]')}"
    plain = f"CASE WHEN {kind} = 'PASSWORD' THEN {mixed} AND {S.entropy(s, x)} >= 2.6 ELSE length({x}) >= CASE WHEN {kind} = 'SECRET' THEN 8 ELSE 10 END AND {mixed} AND {S.variety(s, x)} >= 2 AND {S.entropy(s, x)} >= 2.8 END"
    return f"(length({x}) <= 256 AND CASE WHEN {s.test(x, r'^\d+$')} THEN {numbers} ELSE NOT ({' OR '.join(no)}) AND ({vendor} OR {entropy} OR {S.structured_secret(s, x)} OR {bare_password(s, x)} OR {plain}) END)"


def _disclosure_keep(s: Sql) -> str:
    said = f"({s.test('key', CONNECTED, 'i')} OR {s.test('key', INTRODUCED, 'i')})"
    apart = f"{s.test('key', r'(?:\s|=|:|>|→)$')} AND NOT {s.test('key', r'^[A-Z0-9_]+\s*[:=]\s*$')}"
    return f"{said} AND {apart} AND NOT (ctx <= -14 AND NOT {S.credential_value(s, 'raw')}) AND {disclosed(s, 'raw', S.disclosure_type(s, 'key'))} AND NOT {s.test('lower(before)', S.PROSE_CONTEXT, 'i')} AND ((far & 4) = 0) AND open"


def decoded_secret(s: Sql, x: str) -> str:
    """Base64 of a text that names a secret or looks like a password."""
    valid = f"({s.test(x, '^[A-Za-z0-9+/]{11,}={0,2}$')} AND length({x}) % 4 = 0 AND length({x}) <= 344)"
    plain = f"coalesce(try_validate_utf8(cast(try_to_binary({x}, 'base64') as string)), '')" if s.spark else f"coalesce(TRY(decode(from_base64({x}))), '')"
    text = f"CASE WHEN {valid} THEN {plain} ELSE '' END"
    readable = s.test("d", r"^[\x20-\x7e\t\r\n]{8,256}$")
    body = f"({readable} AND ({s.test('d', SECRET_WORDS, 'i')} OR {bare_password(s, 'd')}))"
    return f"element_at(transform(array({text}), d -> {body}), 1)" if s.spark else f"list_transform([{text}], lambda d: {body})[1]"


def _disguised(s: Sql) -> tuple[str, str, str]:
    return S.obfuscated_key(s, "key"), f"({s.test('key', ENCODED_KEY, 'i')} AND {decoded_secret(s, 'raw')})", f"({s.test('key', 'ipv6', 'i')} AND {ipv6(s, 'raw')})"


def _disguised_keep(s: Sql) -> str:
    short = f"({s.test(S.normal_key(s, 'key'), '^(?:cookie|session)$')} AND length(raw) < 16 AND NOT {s.test('raw', '(?:secret|token|auth|session|jwt|bearer)', 'i')})"
    return f"length(raw) >= 8 AND NOT {S.safe_key(s, 'key')} AND NOT {short} AND ({' OR '.join(_disguised(s))}) AND open"


def _disguised_of(values: tuple[str, str, str]) -> Callable[[Sql], str]:
    return lambda s: f"CASE WHEN {_disguised(s)[0]} THEN {values[0]} WHEN {_disguised(s)[1]} THEN {values[1]} ELSE {values[2]} END"


_LINE = r"(?:^|\n)[^\S\n]*({names})[^\S\n]*:[^\S\n]*"
_LINE_VALUE = r"(\S(?:[^\n]*\S)?)"
DETECTORS: tuple[Scored, ...] = (
    Scored("C01", _header_type, "credential", _LINE.format(names="authorization") + r"(?:bearer|basic)[^\S\n]+([^\s,;]+)", "i", (2,), ("authorization",), _header_keep, lambda s: "100", key=1, place=1, methods=("http-header", "full-value")),
    Scored("C01", _header_type, "credential", _LINE.format(names="|".join((*HEADERS, *COOKIES))) + _LINE_VALUE, "i", (2,), (*HEADERS, "cookie"), _header_keep, lambda s: "100", key=1, place=1, methods=("http-header", "full-value")),
    Scored("C01", _is("TOKEN"), "credential", _LINE.format(names="|".join(COOKIES)) + _LINE_VALUE, "i", (2,), ("cookie",), _cookie_keep, lambda s: "100", place=1, methods=("http-header", "cookie-value", "full-value"), inner=(r"(?:^|;\s*)([^=;\s]+)=([^;\r\n]*)", "", (2,), 1)),
    Scored("C04", _is("USERNAME"), "identity", LOGIN, "", (3,), ("://",), lambda s: f"raw <> '' AND {_user_keep(s)}", lambda s: "96", key=1, place=4, methods=("url-credentials", "username"), decoded=True),
    # one more than its like elsewhere: a rule that ends a password at the first @ must not win
    Scored("C04", _login_type, "credential", LOGIN, "", (4,), ("://",), _login_keep, lambda s: "100", key=1, place=4, methods=("url-credentials", "full-value"), decoded=True),
    Scored("C04", _is("PASSWORD"), "credential", LOGIN, "", (4,), ("://",), lambda s: f"{_scheme_in(s, SCHEMES)} AND NOT {s.test('raw', '^@')} AND {suffix_secret(s, 'raw')}", lambda s: "99", key=1, place=4, methods=("url-credentials", "placeholder-tail"), inner=(rf"^(?:{S.TOKEN})([^\s,;:=\])}}]+)$", "", (1,), 0), decoded=True),
    Scored("C21", _is("PASSWORD"), "credential", rf"\b[a-z][a-z0-9+.-]*:\/\/(?:{S.TOKEN}):(?:{S.TOKEN})(@[^@\s\/]+)@[^\s]+", "i", (1,), ("://",), lambda s: url_password(s, "raw"), lambda s: "99", place=21, methods=("url-credentials", "extra-at", "trusted-placeholder-uri")),
    Scored("C15", lambda s: f"CASE WHEN {_disguised(s)[0]} THEN {S.key_type(s, 'key')} WHEN {_disguised(s)[1]} THEN 'SECRET' ELSE 'IP_ADDRESS' END", "credential", DISGUISED, "i", (2, 3, 4, 5), (":", "="), _disguised_keep, _disguised_of(("94", "88", "86")), key=1, place=15, methods=("assignment", "adversarial"), asks=((_DISGUISED_KEYS, r"[\s\S]{8}"), (ENCODED_KEY, r"[A-Za-z0-9+/]{11,}"), ("ipv6", ":"))),
    Scored("C20", lambda s: S.disclosure_type(s, "key"), "credential", DISCLOSURE, "i", (2, 3, 4, 5), ("pass", "pwd", "secret", "key", "token", "value"), _disclosure_keep, lambda s: f"84 + CASE WHEN {S.entropy(s, 'raw')} >= 3.4 THEN 4 ELSE 0 END + greatest(0, ctx)", key=1, place=20, methods=("natural-language",), asks=((rf"^(?=[\s\S]*{_LABELS_END})(?=[\s\S]*(?:{CONNECTED}|{INTRODUCED}))", ""),)),
    Scored("C09", _is("TOKEN"), "credential", r"""([A-Za-z_][A-Za-z0-9_.-]{0,80})[ \t]*[:=][ \t]*Bearer[ \t]+([^\s,;"'`}\]]+)""", "i", (2,), ("bearer",), _bearer_keep, lambda s: f"98 + CASE WHEN {S.entropy(s, 'raw')} >= 3.6 THEN 2 ELSE 0 END", key=1, place=9, cut=True),
    Scored("C17", _email_or_user, "identity", r"""([A-Za-z_][A-Za-z0-9_.-]{0,80})\s*[:=]\s*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s]+))""", "i", (2, 3, 4, 5), ("user", "login", "mail"), lambda s: f"NOT {S.safe_key(s, 'key')} AND {s.test(S.normal_key(s, 'key'), '(?:^|_)(?:username|user(?:_?name)?|login|email|e_mail|mail)(?:$|_)')} AND length(raw) BETWEEN 3 AND 256 AND {_identity_ok(s)}", _identity_score, 55, 1, place=17, asks=((r"(?:^|[\s._-])(?:user|login|e[\s._-]*mail|mail)", r"[\s\S]{3}"),)),
    Scored("C18", _email_or_user, "identity", r'"((?:user|username|user_name))"\s*:\s*"([^"\r\n]{3,256})"', "i", (2,), ('"user',), _identity_ok, lambda s: f"CASE WHEN {s.test('raw', ADDRESS, 'i')} THEN 70 ELSE 64 END", key=1, place=18),
    Scored("C23", _is("PASSWORD"), "credential", r"(?:^|\n)([^\n]+)", "", (1,), (), lambda s: f"NOT {s.test('trim(found)', '[=:,' + chr(92) + 't]|' + chr(92) + 's{2,}')} AND NOT {s.test('trim(found)', '^<' + chr(92) + '/?[a-z][^>]*>|<' + chr(92) + '/[a-z][^>]*>' + chr(92) + 's*$', 'i')} AND {bare_password(s, 'raw')} AND ctx > -14", _bare_score, place=23, worth=r"""^\s*["'`]?\s*\S{10,130}\s*["'`]?\s*$""", asks=(("", r"^[^=:,\t]*$"),)),
    Scored("C27", _is("PRIVATE_CIDR"), "internal_metadata", r"\b(?:\d{1,3}\.){3}\d{1,3}\/\d{1,2}\b", "", (), ("/",), lambda s: f"{s.test('raw', OCTETS)} AND {s.test('raw', PRIVATE)}", lambda s: "99"),
    Scored("C27", _is("PRIVATE_IP"), "internal_metadata", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "", (), (".",), lambda s: f"{s.test('raw', OCTETS)} AND {s.test('raw', PRIVATE)} AND left(after, 1) <> '/'", lambda s: "82"),
    Scored("C28", _is("FILE_SHARE"), "internal_metadata", r"\b(?:FSA\d{7}|FSB\d{7}|FS\d{7})\b", "", (), ("fs",), lambda s: s.test(window(80), SHARES, "i"), lambda s: "78"),
    Scored("C29", _is("AD_GROUP"), "internal_metadata", r"\bAD\d{3}-SH\d{3}-FILE-[LG]-(?:ST|RBAC|BLOB|MF)(?:FSA\d{7}|FSB\d{7}|FS\d{7})[RC]\b", "", (), ("-file-",), lambda s: "true", lambda s: "94"),
    Scored("C30", _is("AZURE_RG"), "internal_metadata", r"\b(?:rg[-_][a-z0-9][a-z0-9_-]{4,62}|rgrp-[a-z0-9][a-z0-9-]{4,62}|resource-group-[a-z0-9][a-z0-9-]{4,62})\b", "i", (), ("rg-", "rg_", "rgrp-", "resource-group-"), _no_placeholder, lambda s: f"42 + {token_score(s, 'raw', True)} + 18 + CASE WHEN {infrastructure(s)} THEN 10 ELSE 0 END", 72),
    Scored("C31", _is("CLOUD_RESOURCE"), "internal_metadata", r"\b(?:vnet|snet|pep|pl|rt|peer|sss|share|kv|nic|nsg|logic|aa|vm|aks|appgw|law|sql|db|dns|bastion|st)-[a-z0-9][a-z0-9-]{4,62}\b", "i", (), ("-",), _no_placeholder, lambda s: f"44 + {token_score(s, 'raw')} + CASE WHEN {infrastructure(s)} THEN 8 ELSE 0 END", 70),
    Scored("C32", _is("STORAGE_ACCOUNT"), "internal_metadata", r"\bst[a-z0-9]{6,22}\b", "", (), ("st",), lambda s: f"NOT {s.test('raw', '^(?:state|status|static|station|street|string|strong|student|studio|story|store)$', 'i')}", _account_score, 70),
    Scored("C33", _is("HOSTNAME"), "internal_metadata", r"\b(?:(?:[a-z0-9][a-z0-9-]{1,40}\.)+(?:local|lan|corp|internal|ad|domain)|[a-z0-9]+(?:-[a-z0-9]+){1,5}-\d{1,4}|(?:dc|srv|sql|fs|vm|web|app|db)\d{2,4})\b", "i", (), (), _hostname_keep, _hostname_score, 68),
    Scored("C34", _is("USERNAME"), "identity", r"\b(?:[A-Z][A-Z0-9]{1,30}\\[A-Za-z][A-Za-z0-9._-]{2,63}|(?:svc|sa|adm|admin|robot|automation)[-_][A-Za-z0-9][A-Za-z0-9._-]{2,63}|[a-z]{2,32}\.[a-z]{2,32})\b", "", (), (), _person_keep, _person_score, 68, worth=r"\\|^(?!.*[.][a-z0-9]{1,8}$)"),
    Scored("C38", lambda s: f"CASE WHEN {s.test('raw', '^obs-', 'i')} THEN 'OBS_BUCKET' WHEN {provider(s)} THEN 'OTC_RESOURCE' ELSE 'OPENSTACK_RESOURCE' END", "internal_metadata", r"\b(?:(?:otc-)?(?:ecs|evs|vpc|subnet|sg|security-group|obs|cce|rds|elb|eip|keypair|image|flavor|as|nat|vpn)|otc)-[a-z0-9][a-z0-9-]{4,62}\b", "i", (), ("-",), lambda s: "true", lambda s: f"46 + {token_score(s, 'raw')} + {points((provider(s), 14), (infrastructure(s), 8))}", 70),
    Scored("C38", _stack_type, "internal_metadata", r"""\b(project_id|projectId|tenant_id|tenantId|domain_id|domainId|user_id|userId|server_id|serverId|instance_id|instanceId|volume_id|volumeId|image_id|imageId|flavor_id|flavorId|vpc_id|vpcId|subnet_id|subnetId|security_group_id|securityGroupId|router_id|routerId|network_id|networkId|port_id|portId)\b\s*[:=]\s*["']?([0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})["']?""", "i", (2,), ("id",), lambda s: "true", lambda s: "88", key=1),
    Scored("C38", lambda s: "CASE WHEN contains(raw, '.obs.') THEN 'OTC_ENDPOINT' ELSE 'CLOUD_ENDPOINT' END", "internal_metadata", r"\b[a-z0-9][a-z0-9.-]{1,100}\.(?:obs\.(?:eu-de|eu-nl)\.otc\.t-systems\.com|otc\.t-systems\.com)\b", "i", (), ("t-systems.com",), lambda s: "true", lambda s: "88"),
    Scored("C02", _is("DB_URI"), "credential", _KEY + r"""(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s]+))""", "i", (2, 3, 4, 5), ("url", "uri"), lambda s: f"length(raw) >= 8 AND {S.db_uri_key(s, 'key')} AND open", _full_score, key=1, place=2, methods=("assignment", "db-uri-password"), inner=(DB_PASSWORD, "i", (1,), 0), asks=((_URL_KEYS, ""),)),
    Scored("C02", _is("CONNECTION_STRING"), "connection_string", _KEY + r"""(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s]+))""", "i", (2, 3, 4, 5), ("conn", "azurewebjobsstorage"), _connection_keep, _full_score, key=1, place=2, methods=("assignment", "full-value"), inner=(CONNECTION, "i", (), 0), asks=((_CONNECTION_KEYS, ""),)),
    Scored("C05", _is("PASSWORD"), "credential", SQL_SERVER, "i", (), ("sqlserver://", "mssql://"), _attribute_keep, lambda s: f"99 + CASE WHEN {S.entropy(s, 'raw')} >= 3.8 THEN 1 ELSE 0 END", place=5, methods=("sqlserver-connection-string", "password-attribute"), inner=(SQL_SERVER_PASSWORD, "i", (2,), 1)),
    Scored("C05", _is("PASSWORD"), "credential", ADO_PASSWORD, "i", (2,), ("database", "initial catalog"), _ado_keep, lambda s: f"99 + CASE WHEN {S.entropy(s, 'raw')} >= 3.8 THEN 1 ELSE 0 END", key=1, place=5, methods=("sqlserver-connection-string", "password-attribute")),
    Scored("C10", lambda s: S.key_type(s, "key"), "credential", INLINE, "i", (2, 3, 4, 5), ("secret", "password", "token"), _inline_keep, lambda s: "100", key=1, place=10, methods=("assignment", "exact-key"), asks=(("", _EIGHT),)),
    Scored("C11", _explicit_type, "credential", _KEY + r"""(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s,;"'`}]+))""", "i", (2, 3, 4, 5), ("pass", "pwd", "p4ss", "secret", "s3cr", "key", "k3y", "token", "t0k", "tok3", "auth", "webhook", "w3bh", "webh0"), _explicit_keep, _explicit_score, key=1, place=11, methods=("assignment", "explicit-key"), asks=((_CREDENTIAL_KEYS, _EIGHT),)),
)
SENSITIVE_LABEL = r"(?:password|passwd|passcode|passphrase|pwd|secret|api\s*key|apikey|token|access\s+token|refresh\s+token|bearer|authorization|client\s+secret|private\s+key|webhook\s+secret|db\s+password|database\s+password|real\s+value)\s*(?:is|=|:|->|→|equals|set\s+to|should\s+be|becomes)?\s*$"
_GLUED = "[A-Za-z0-9._-]"


def _unknown_keep(s: Sql) -> str:
    apart = f"NOT {s.test('before', _GLUED + '$')} AND NOT {s.test('after', '^' + _GLUED)}"
    return f"{apart} AND {s.test('lower(before)', SENSITIVE_LABEL)} AND NOT {s.test('lower(concat(before, raw, after))', S.FALSE_CONTEXT, 'i')} AND ((far & 1) = 0)"


def _tail_keep(s: Sql) -> str:
    return f"NOT ({s.test('raw', '^[A-Za-z_][A-Za-z0-9_.-]{0,80}$')} AND {s.test('after', '^[:=]')}) AND {suffix_secret(s, 'raw')} AND NOT {S.template_value(s, 'raw')} AND ctx > -14"


#: Detectors that need to know what a session gave out: tokens that nobody knows where a secret is expected, and what is glued to known ones. ``key`` is the token.
VAULT_DETECTORS = (
    Scored("C19", lambda s: S.disclosure_type(s, window(96)), "credential", f"({S.TOKEN})", "", (), ("[",), _unknown_keep, lambda s: "92 + greatest(0, ctx)", key=1, place=19, methods=("placeholder-trust", "context")),
    Scored("C22", _is("SECRET"), "credential", rf"({S.TOKEN})([^\s,;:=@\])}}]+)", "", (2,), ("[",), _tail_keep, _suffix_score, key=1, place=22, methods=("placeholder-suffix", "heuristic")),
)
#: Detectors of the enterprise profile.
PROFILE = ("C27", "C28", "C29", "C30", "C31", "C32", "C33", "C34", "C38")


def steps(s: Sql, detectors: tuple[Scored, ...]) -> list[dict[str, str]]:
    """Columns to add, step by step, to candidates (rule, found, key, start, end, before, after, far), before ``kept`` is tested."""
    each = lambda f, other: "CASE rule " + " ".join(f"WHEN {k} THEN {f(d)}" for k, d in enumerate(detectors)) + f" ELSE {other} END"
    as_is = " OR ".join(["false", *(f"rule = {k}" for k, d in enumerate(detectors) if d.decoded)])
    cut = " OR ".join(["false", *(f"rule = {k}" for k, d in enumerate(detectors) if d.cut)])
    listed = lambda d: ("array" if s.spark else "") + ("(" if s.spark else "[") + ", ".join(f"'{m}'" for m in d.methods) + (")" if s.spark else "]")
    return [
        {"raw": f"CASE WHEN {as_is} THEN found WHEN {cut} THEN {S.unquoted(s, embedded_cut(s, 'found'))} ELSE {S.unquoted(s, 'found')} END"},
        {"ctx": S.context_score(s, window(64))},
        {"open": unsuppressed(s)},
        {"kept": f"raw <> '' AND {each(lambda d: f'({d.keep(s)})', 'false')}"},
        {"points": f"CASE WHEN kept THEN {each(lambda d: f'({d.score(s)})', '0')} ELSE 0 END"},
        {
            "type": each(lambda d: d.type(s), "''"), "id": each(lambda d: f"'{d.id}'", "''"), "category": each(lambda d: f"'{d.category}'", "''"), "least": each(lambda d: str(d.least), "0"), "place": each(lambda d: str(d.place), "0"),
            "method": each(listed, "null"), "score": S.bounded("points"), "from_": f"CASE WHEN {as_is} THEN start ELSE start + instr(found, raw) - 1 END",
        },
        {"severity": S.severity("score"), "to_": f'CASE WHEN {as_is} THEN {"end" if s.spark else chr(34) + "end" + chr(34)} ELSE from_ + length(raw) END'},
    ]


def quick_steps(detectors: tuple[Scored, ...]) -> list[dict[str, str]]:
    """``steps`` for Spark: the same values, with each test behind the words that it needs, and context only for detectors that ask for it."""
    first, context, is_open, *more = steps(Q, detectors)
    asking = lambda names: ", ".join(["-1", *(str(k) for k, d in enumerate(detectors) if re.search(rf"\b(?:{names})\b", d.keep(Q) + " " + d.score(Q)))])
    whole = f"(words & {W.EDGE}L) = 0 AND NOT ({' OR '.join(['false', *(f'rule = {k}' for k, d in enumerate(detectors) if d.cut)])})"
    # the words of a value that loses its quotes or its end may run into those around it
    first = {"raw": f"CASE WHEN {whole} THEN found ELSE {first['raw']} END", "words": f"CASE WHEN {whole} THEN words ELSE {W.ALL}L END"}
    assert context["ctx"] == S.context_score(Q, window(64))
    context = {"ctx": f"CASE WHEN {piecewise('rule', 'r', f'r IN ({asking("ctx|open")})')} THEN {S.context_score(Q, window(64), lambda w: W.says(W.of(w)))} ELSE 0 END"}
    is_open = {"open": f"{piecewise('rule', 'r', f'r IN ({asking("open")})')} AND {W.guarded(is_open['open'])}"}
    return [first, context, is_open, *({k: W.guarded(v) for k, v in step.items()} for step in more)]


def entries(detectors: tuple[Scored, ...]) -> list[Entry]:
    return [Entry("scored", k, d.regex, d.flags, d.groups, d.markers, d.key, d.inner, d.worth, d.decoded, d.asks) for k, d in enumerate(detectors)]


def judge(found: DataFrame, detectors: tuple[Scored, ...], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept candidates: id (of the detector), rule, key, place, order, type, category, raw, start, end, score, severity, method."""
    out = found.withColumnRenamed("raw", "found")
    for step in quick_steps(detectors):
        out = fenced(out.withColumns({k: F.expr(v) for k, v in step.items()}))
        # what follows is found for kept candidates alone
        out = out.where("kept") if "kept" in step else out
    columns = ("id", "rule", "key", "place", "order", "type", "category", "raw", F.col("from_").cast("int").alias("start"), F.col("to_").cast("int").alias("end"), "score", "severity", "method", "kept", "points", "least")
    return out.where("kept AND points >= least").select(*keep, *columns).drop("kept", "points", "least")


def scan(docs: DataFrame, ids: Iterable[str] | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Findings: detector, type, category, raw, start, end, score, severity. ``ids``: of the detectors; all if none are named. One pass over the texts."""
    wanted = DETECTORS if ids is None else tuple(d for d in DETECTORS if d.id in set(ids))
    out = judge(matched(docs, entries(wanted), text_col, keep, quick=True), wanted, keep)
    return out.select(*keep, F.col("id").alias("detector"), "type", "category", "raw", "start", "end", "score", "severity")
