"""Destination policies over tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY_FIELDS = "enterprise boolean, strict_failure boolean, default_action string, retention_days int, allow_reveal boolean, approved array<string>, blocked array<string>"

#: Patterns of one list, at most.
MOST = 10_000


def url_parts(url: str = "url") -> dict[str, Column]:
    """scheme, host, path and origin of a URL; null and empty if it isn't one."""
    rx = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#:@]+)(?::(\d+))?([^?#]*)(\?[^#]*)?"
    part = lambda g: F.regexp_extract(url, rx, g)
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3))).otherwise("")
    origin = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), port)).otherwise("")
    return {"scheme": F.lower(part(1)), "host": F.lower(part(2)), "path": F.when(part(4) == "", "/").otherwise(part(4)), "query": part(5), "origin": origin}


def compiled(patterns: DataFrame) -> DataFrame:
    """Match patterns (pos, match, action) with columns to match by; those that aren't patterns go."""
    rx = r"^(\*|https?)://([^/]+)(/.*)$"
    quoted = F.regexp_replace(F.regexp_extract("match", rx, 3), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return patterns.where(F.col("match").rlike(rx)).select("pos", "match", "action", F.regexp_extract("match", rx, 1).alias("p_scheme"), F.lower(F.regexp_extract("match", rx, 2)).alias("p_host"), F.concat(F.lit("\\A"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("\\z")).alias("p_path"))


def first_match(requests: DataFrame, patterns: DataFrame, key: str = "request_id") -> DataFrame:
    """request, pos, match, action of the first pattern in the list that its URL matches; requests without one are left out.

    ``patterns`` is one tenant's list of some dozens of lines; its size is checked (``MOST``) before it is broadcast, and a longer one is an error.
    """
    if patterns.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} patterns in one list")
    asked = requests.select(key, "url").withColumns(url_parts())
    host_ok = F.expr("p_host = '*' OR (startswith(p_host, '*.') AND endswith(host, substr(p_host, 2))) OR host = p_host")
    path_ok = F.expr("regexp_like(concat(path, query), p_path) OR regexp_like(path, p_path)")
    met = asked.join(F.broadcast(compiled(patterns)), F.expr("p_scheme = '*' OR p_scheme = scheme") & host_ok & path_ok)
    return met.groupBy(key).agg(F.min(F.struct("pos", "match", "action")).alias("m")).select(key, "m.*")


def decide(requests: DataFrame, destinations: DataFrame, approved: DataFrame, blocked: DataFrame, enterprise: bool = True, strict_failure: bool = False, default: str | None = None, key: str = "request_id") -> DataFrame:
    """One row a request: action, allowed, blocked, requires_redaction, reason, matched pattern.

    Order: a policy that could not be loaded, the destination list, the block list, the list of approved ones.
    """
    default = default or ("block" if enterprise else "allow")
    listed, has_approved = not destinations.isEmpty(), not approved.isEmpty()
    out = requests.select(key, "url").join(first_match(requests, destinations, key).select(key, "match", "action"), key, "left")
    out = out.join(first_match(requests, blocked, key).select(key, F.lit(True).alias("b")), key, "left").join(first_match(requests, approved, key).select(key, F.lit(True).alias("a")), key, "left")
    b, a = F.coalesce("b", F.lit(False)), F.coalesce("a", F.lit(not has_approved))
    action = F.coalesce("action", F.lit(default)) if listed else F.when(b, "block").otherwise("allow")
    out = out.withColumn("action", action)
    if enterprise and strict_failure:
        reason = F.lit("policy_fail_closed")
    elif listed:
        reason = F.when(F.col("action") == "block", F.when(F.col("match").isNotNull(), "destination_blocked").otherwise("destination_not_approved")).when(F.col("action") == "redact", "destination_requires_redaction")
    else:
        reason = F.when(b, "destination_blocked").when(F.lit(enterprise and has_approved) & ~a, "destination_not_approved")
    out = out.withColumn("reason", reason).withColumn("blocked", F.coalesce(F.col("reason").isin("policy_fail_closed", "destination_blocked", "destination_not_approved"), F.lit(False)))
    return out.select(key, "action", (~F.col("blocked")).alias("allowed"), "blocked", F.coalesce(F.col("reason") == "destination_requires_redaction", F.lit(False)).alias("requires_redaction"), "reason", F.col("match").alias("matched"))


def validated(policies: DataFrame, tenant: str = "tenant", body: str = "policy") -> DataFrame:
    """JSON policies, one a tenant: typed fields with defaults, and the list of what is wrong."""
    p = policies.select(tenant, F.from_json(body, POLICY_FIELDS).alias("p"), body)
    broken = F.col(f"p.{'enterprise'}").isNull() & ~F.col(body).rlike(r"^\s*\{")
    days = F.col("p.retention_days")
    errors = F.array_compact(
        F.array(
            F.when(broken, "not-json"),
            F.when(~F.coalesce(F.col("p.default_action"), F.lit("allow")).isin("allow", "redact", "block"), "default_action"),
            F.when((days < 1) | (days > 365), "retention_days"),
            F.when(F.exists(F.coalesce("p.approved", F.array()), lambda x: ~x.rlike(r"^(\*|https?)://[^/]+/")), "approved"),
            F.when(F.exists(F.coalesce("p.blocked", F.array()), lambda x: ~x.rlike(r"^(\*|https?)://[^/]+/")), "blocked"),
        )
    )
    enterprise = F.coalesce("p.enterprise", F.lit(False))
    return p.select(tenant, enterprise.alias("enterprise"), F.coalesce("p.default_action", F.when(enterprise, "block").otherwise("allow")).alias("default_action"), F.least(F.lit(365), F.greatest(F.lit(1), F.coalesce(days, F.lit(30)))).alias("retention_days"), errors.alias("errors"), (enterprise & (F.size(errors) > 0)).alias("fail_closed"))


def merged(base: DataFrame, override: DataFrame, fields: tuple[str, ...], key: str = "tenant") -> DataFrame:
    """Defaults with a tenant's own values on top. A null in the tenant's row deletes the default; tenants without a row keep all defaults."""
    o = override.select(key, F.lit(True).alias("_own"), *(F.col(f).alias(f"_{f}") for f in fields))
    return base.join(o, key, "left").select(key, *(F.when(F.col("_own"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def last_wins(rules: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One rule for each key, the last."""
    others = [c for c in rules.columns if c not in keys]
    return rules.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def pauses(events: DataFrame, now: Column, longest_minutes: int, enforced: Column | None = None, session: str = "session_id") -> DataFrame:
    """The latest pause of each session and whether it still holds."""
    last = events.groupBy(session).agg(F.max(F.struct("ts", "until")).alias("p")).select(session, F.col("p.ts").alias("ts"), F.col("p.until").alias("until"))
    end = F.least(F.col("until"), F.col("ts") + F.make_dt_interval(mins=F.lit(longest_minutes)))
    return last.select(session, end.alias("until"), ((end > now) & ~(F.lit(False) if enforced is None else enforced)).alias("paused"))
