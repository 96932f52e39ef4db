"""Findings of all detectors together: one pass over the texts, the best of each span, overlaps resolved.

Candidates of all detectors come from one pass, are written once, and are judged by the three families (general, scored, metadata) where they lie; only candidates and findings are shuffled.
The order of the detectors, which breaks ties, is ``place`` (of the family's entries) and then the rule and its match in the text. Detectors of the enterprise profile may be left out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import settle
from . import detect, metadata, scored, structured
from .matcher import matched
from .rules import Rule
from .spans import best_per_span, resolve_overlaps

#: Families besides the general detectors.
MORE = ("scored", "metadata", "adjacent")
ALL = (*detect.DETECTORS, *MORE)
COLUMNS = ("seq", "source", "type", "category", "raw", "start", "end", "score", "severity", "method")
#: Where metadata kinds stand in the order, and how the rules of the families are told apart there.
METADATA_PLACE, METADATA_RULE = 15, 1000


def _fixed(found: DataFrame, source: str, place: object, rule: object, order: object, keep: tuple[str, ...]) -> DataFrame:
    seq = F.struct(F.lit(place).alias("detector") if isinstance(place, int) else place.alias("detector"), rule.cast("int").alias("rule"), order.cast("int").alias("order"))
    return found.select(*keep, seq.alias("seq"), F.lit(source).alias("source"), "type", "category", "raw", "start", "end", "score", F.expr(S.severity("score")).alias("severity"), F.array(F.lit(source)).alias("method"))


def found(docs: DataFrame, rules: Iterable[Rule] = detect.RULES, detectors: Iterable[str] = ALL, allow: Iterable[str] = (), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", profile: bool = True, trust: DataFrame | None = None) -> DataFrame:
    """Every finding of every detector, before overlaps are resolved: ``keep`` and ``COLUMNS``. ``profile``: with the detectors of the enterprise profile. ``trust``: ``keep`` and token, the
    tokens that may stand in each text; with it, unknown tokens and what is glued to known ones are found too (source ``vault``)."""
    rules, wanted, allow = tuple(rules), set(detectors), tuple(allow)
    some = tuple(d for d in scored.DETECTORS if profile or d.id not in scored.PROFILE) if "scored" in wanted else ()
    kinds = metadata.KINDS if profile and "metadata" in wanted else ()
    entries = [*detect.entries(rules, wanted), *scored.entries(some), *metadata.entries(kinds)]
    candidates = matched(docs, entries, text_col, keep, quick=True)
    families = [bool(wanted & set(detect.DETECTORS)), bool(some), bool(kinds)]
    if sum(families) > 1:
        candidates = settle(candidates, "candidates")
    parts = []
    if families[0]:
        parts.append(detect.judge(candidates.where("source NOT IN ('scored', 'metadata')"), rules, allow, keep).where("why is null").select(*keep, *COLUMNS))
    if some:
        own = scored.judge(candidates.where("source = 'scored'"), some, keep)
        own = own.where(~F.col("raw").isin(list(allow))) if allow else own
        parts.append(own.select(*keep, F.struct(F.col("place").alias("detector"), "rule", "order").alias("seq"), F.lit("scored").alias("source"), *COLUMNS[2:]))
    if kinds:
        own = metadata.judge(candidates.where("source = 'metadata'"), kinds, keep)
        parts.append(_fixed(own, "metadata", METADATA_PLACE, F.col("rule") + METADATA_RULE, F.col("order"), keep))
    if trust is not None:
        parts.append(vault_aware(docs, trust, keep, text_col))
    if "adjacent" in wanted:
        own = structured.adjacent(docs.withColumn("text", F.col(text_col)), keep).withColumn("category", F.lit("credential"))
        parts.append(_fixed(own, "adjacent", F.substring("detector", 2, 2).cast("int"), F.lit(0), F.col("start"), keep))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vault_aware(docs: DataFrame, trust: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Findings that depend on what a session gave out: tokens that aren't trusted where a secret is expected, and tails glued to trusted ones. ``trust``: ``keep`` and token."""
    own = settle(scored.judge(matched(docs, scored.entries(scored.VAULT_DETECTORS), text_col, keep, quick=True), scored.VAULT_DETECTORS, keep), "tokens")
    known = trust.select(*keep, F.col("token").alias("key")).distinct()
    out = own.where("id = 'C19'").join(known, [*keep, "key"], "left_anti").unionByName(own.where("id = 'C22'").join(known, [*keep, "key"], "left_semi"))
    return out.select(*keep, F.struct(F.col("place").alias("detector"), "rule", "order").alias("seq"), F.lit("vault").alias("source"), *COLUMNS[2:])


def scan(docs: DataFrame, rules: Iterable[Rule] = detect.RULES, detectors: Iterable[str] = ALL, allow: Iterable[str] = (), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", profile: bool = True, trust: DataFrame | None = None) -> DataFrame:
    """Findings of the documents: ``keep``, seq, source, type, category, raw, start, end, score, severity, method."""
    return resolve_overlaps(best_per_span(found(docs, rules, detectors, allow, keep, text_col, profile, trust), keep), keep)
