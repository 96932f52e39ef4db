"""Secrets in texts, told apart by who owns them. DataFrame functions only.

Three base kinds (assignments to secret-like names, access keys, long hex runs) and one that the method adds: opaque tokens
of mixed letters and digits. Every candidate value is hashed, the hashes are counted over the whole corpus by distinct
repository and owner (first by (hash, repository, owner), so a value that a third of the rows share is one row a task in
the shuffle), and a value that few owners hold and that looks random counts as live. A value that many owners hold is a copied
example. Base spans are always reported; opaque tokens are added only where they are live.

One scan reads the texts and leaves only hashes and offsets; ownership is joined to those. Null texts count as
empty, null repositories as one unnamed repository; repeated rows each get their result; empty tables give an
empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running
from ..operators.spans import let
from .base import cut

#: The patterns of the base kinds, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
GATES = (r"(?i)password|passwd|secret|token|api_?key", "AKIA[A-Z0-9]{12}", HEX, OPAQUE)
#: A value held by more distinct owners than this is a copied example.
FEW_OWNERS = 2
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """SQL text of leftmost matches with offsets: running sums over what lies between them and their lengths give their places."""
    rx = "r'" + pattern.replace("'", r"\x27") + "'"
    found = f"regexp_extract_all({text}, {rx}, 0)"
    parts = f"filter(arrays_zip({found}, slice(split({text}, {rx}, -1), 1, greatest(size({found}), 1)), regexp_extract_all({text}, {rx}, {group})), z -> z.`0` IS NOT NULL)"
    first = "at[i] + length(z.`1`)"
    made = f"transform(zs, (z, i) -> named_struct('start', {first}, 'kind', {kind}, 'end', {first} + length(z.`0`), 'value', z.`2`))"
    out = let(parts, "zs", let("transform(zs, z -> cast(length(z.`0`) + length(z.`1`) as bigint))", "n", let(running("n"), "at", made)))
    return f"filter({out}, s -> length(s.value) >= {least})" if least else out


def alone(base: str, more: str) -> str:
    """SQL text of all spans by start, without those of kind 3 that a base span overlaps: what ends before and what starts after is swept once."""
    far = str(2**62) + "L"
    ends = "transform(xs, s -> CASE WHEN s.kind < 3 THEN s.end ELSE 0L END)"
    starts = f"transform(reverse(xs), s -> CASE WHEN s.kind < 3 THEN s.start ELSE {far} END)"
    kept = "filter(xs, (s, i) -> s.kind < 3 OR (before[i] <= s.start AND after[size(xs) - 1 - i] >= s.end))"
    before = running("e", lambda a, b: f"greatest({a}, {b})")
    after = running("r", lambda a, b: f"least({a}, {b})", far)
    return let(f"array_sort(concat({base}, {more}))", "xs", let(ends, "e", let(before, "before", let(starts, "r", let(after, "after", kept)))))


def looks_random(value: Column) -> Column:
    """Many different characters for its length: what a made key has and a word or a filler hasn't."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (distinct >= 8) & (distinct * 4 >= F.least(F.length(value), F.lit(40)))


def candidates(docs: DataFrame, repo_col: str, owner: Column, text_col: str) -> DataFrame:
    """One row a document: row, doc_id, repo, owner, found (spans with hash and looks, no values)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(repo_col), F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"), t.alias("t"))
    gated = lambda gate, body: f"CASE WHEN {gate} THEN {body} ELSE cast(array() as {_SPAN}) END"
    has = lambda k: f"regexp_like(t, r'{GATES[k]}')"
    base = [gated(has(0), spans("t", ASSIGN, 0, group=2, least=8)), gated(f"contains(t, 'AKIA') AND {has(1)}", spans("t", ACCESS, 1)), gated(has(2), spans("t", HEX, 2))]
    opaque = gated(has(3), f"filter({spans('t', OPAQUE, 3)}, s -> regexp_like(s.value, '[0-9]') AND regexp_like(s.value, '[a-z]') AND regexp_like(s.value, '[A-Z]'))")
    rows = rows.withColumns({"base": F.expr(f"concat({', '.join(base)})"), "opaque": F.expr(opaque)})
    rows = rows.withColumn("found", F.expr(f"CASE WHEN size(base) + size(opaque) = 0 THEN cast(array() as {_SPAN}) ELSE {alone('base', 'opaque')} END"))
    hashed = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), looks_random(s["value"]).alias("random")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", F.array_sort(hashed).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_seen over the corpus; ``found``: one row a candidate."""
    held = found.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_seen"))


def _joined(spans_: Column, names: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repo_col: str = "source", owner: Column | None = None, text_col: str = "text", few_owners: int = FEW_OWNERS) -> DataFrame:
    """One row a document: n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live_spans.

    ``owner``: of the repository; by default what stands before a slash in its name.
    """
    owner = F.substring_index(F.col(repo_col), "/", 1) if owner is None else owner
    rows = cut(candidates(docs, repo_col, owner, text_col), "secrets")
    each = rows.where(F.size("found") > 0).select("row", "doc_id", "repo", "owner", F.explode("found").alias("s")).select("row", "doc_id", "repo", "owner", "s.*")
    owned = each.join(cut(ownership(each), "owners"), "hash").withColumn("live", F.col("random") & (F.col("n_owners") <= few_owners))
    some = owned.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", (F.col("n_owners") > few_owners).alias("copied")))).alias("found"))
    shape = some.schema["found"].dataType.simpleString()
    none = rows.where(F.size("found") == 0).select("row", "doc_id", F.expr(f"cast(array() as {shape})").alias("found"))
    names = F.array(*map(F.lit, KINDS))
    out = some.unionByName(none).withColumn("base", F.filter("found", lambda s: s["kind"] < 3))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    live = F.filter("found", lambda s: s["live"])
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base"), names), 256).alias("base_sha256"),
        _joined(F.filter("found", lambda s: (s["kind"] < 3) | s["live"]), names).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.size(F.filter("base", lambda s: s["copied"])).cast("long").alias("n_copied"),
        _joined(live, names).alias("live_spans"),
    )
