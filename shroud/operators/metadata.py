"""Detectors of headers, URL logins, and enterprise and cloud metadata: spans with a fixed kind and score."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matcher import Entry, matched


class Kind(NamedTuple):
    id: str
    type: str
    category: str
    score: int
    group: int
    flags: str
    regex: str
    markers: tuple[str, ...]


# Expressions, types and scores.
KINDS = (
    Kind("C25", "FILE_SHARE", "internal_metadata", 99, 0, "", r"\\\\[A-Za-z0-9][A-Za-z0-9.-]{0,62}\\[A-Za-z0-9$._-]+(?:\\[A-Za-z0-9$._-]+)*", ("\\\\",)),
    Kind("C26", "LDAP_DN", "internal_metadata", 100, 0, "", r"\b(?:CN|OU|DC)=[^,=\s][^,=\n]*(?:,\s*(?:CN|OU|DC)=[^,=\s][^,=\n]*)+", ("=",)),
    Kind("C26", "SPN", "internal_metadata", 100, 0, "", r"\b(?:HTTP|HOST|LDAP|CIFS|MSSQLSvc|TERMSRV|WSMAN|DNS|GC|RestrictedKrbHost)\/[A-Za-z0-9][A-Za-z0-9.-]+(?::\d{1,5})?", ("/",)),
    Kind("C35", "AZURE_TENANT_ID", "internal_metadata", 90, 1, "i", r"\btenant[_ -]?id\b[\"']?\s*[:=,]\s*[\"']?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", ("tenant",)),
    Kind("C35", "AZURE_SUBSCRIPTION_ID", "internal_metadata", 90, 1, "i", r"\bsubscription[_ -]?id\b[\"']?\s*[:=,]\s*[\"']?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", ("subscription",)),
    Kind("C36", "AWS_ARN", "internal_metadata", 94, 0, "", r"\barn:aws[a-z-]*:[a-z0-9-]+:[a-z0-9-]*:\d{0,12}:[A-Za-z0-9\/_:.*-]+", ("arn:aws",)),
    Kind("C36", "AWS_ACCOUNT_ID", "internal_metadata", 82, 1, "i", r"\baws[ _-]?account(?:[ _-]?id)?[\"']?\s*[:=,]\s*[\"']?(\d{12})\b", ("account",)),
    Kind("C36", "S3_BUCKET", "internal_metadata", 88, 1, "", r"\bs3:\/\/([a-z0-9][a-z0-9.-]{1,61}[a-z0-9])", ("s3://",)),
    Kind("C37", "GCP_SERVICE_ACCOUNT", "internal_metadata", 90, 0, "", r"\b[a-z][a-z0-9-]{4,28}@[a-z][a-z0-9-]{4,28}\.iam\.gserviceaccount\.com\b", ("gserviceaccount",)),
    Kind("C37", "GCS_BUCKET", "internal_metadata", 88, 1, "", r"\bgs:\/\/([a-z0-9][a-z0-9._-]{1,61}[a-z0-9])", ("gs://",)),
    Kind("C39", "K8S_NAMESPACE", "internal_metadata", 84, 1, "i", r"\b(?:kubernetes|k8s)[ _-]namespace[\"']?\s*[:=,]\s*[\"']?([a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)", ("namespace",)),
    Kind("C40", "INTERNAL_ENDPOINT", "internal_metadata", 84, 0, "i", r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:internal|corp|local|lan|intra)\b", (".internal", ".corp", ".local", ".lan", ".intra")),
    Kind("C15", "IP_ADDRESS", "network", 86, 1, "i", r"\bipv6[\"']?\s*[:=]\s*[\"']?((?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)", ("ipv6",)),
)


#: Headers and URL logins as metadata alone sees them; the scan of all detectors has its own (``scored``).
LOGINS = (
    Kind("C01", "TOKEN", "credential", 100, 1, "i", r"\bauthorization\s*:\s*(?:bearer|basic)\s+([A-Za-z0-9._~+\/=-]{8,})", ("authorization",)),
    Kind("C01", "TOKEN", "credential", 100, 1, "i", r"\b(?:x-api-key|x-auth-token|api-key)\s*:\s*([^\s,;]{8,})", ("x-api-key", "x-auth-token", "api-key")),
    Kind("C04", "PASSWORD", "credential", 99, 1, "i", r"\b(?:https?|wss?|ftps?|sftp|ssh|git):\/\/[^\/\s:@]+:([^\/\s@]+)@[^\s\/]+", ("://",)),
    Kind("C04", "DB_URI", "credential", 99, 1, "i", r"\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp|mssql|sqlserver):\/\/[^\/\s:@]*:([^\/\s@]+)@[^\s\/]+", ("://",)),
)
ALL = LOGINS + KINDS


def entries(kinds: tuple[Kind, ...] = KINDS) -> list[Entry]:
    return [Entry("metadata", k, d.regex, d.flags, (d.group,) if d.group else (), d.markers) for k, d in enumerate(kinds)]


def judge(found: DataFrame, kinds: tuple[Kind, ...] = KINDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidates with what their kind says of them."""
    pick = lambda f: F.element_at(F.array(*(F.lit(f(k)) for k in kinds)), F.col("rule") + 1)
    return found.select(*keep, "rule", "order", pick(lambda k: k.id).alias("detector"), pick(lambda k: k.type).alias("type"), pick(lambda k: k.category).alias("category"), "raw", "start", "end", pick(lambda k: k.score).alias("score"))


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = ALL, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Spans of the kinds: detector, type, category, raw, start, end, score. One pass over the texts, no shuffle."""
    return judge(matched(docs, entries(kinds), text_col, keep), kinds, keep).drop("rule", "order")
