"""What reports need of spans: identifiers, places after replacement, order of tokens, short views, trust by count; and interval joins of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest line in a preview, longest text of one.
LINE, TEXT = 180, 4000


def outside(spans: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("doc_id",), longer: bool = False, inside: bool = False) -> DataFrame:
    """Spans that no range overlaps. ``longer``: only ranges of at least the span's length count; ``inside``: only ranges that hold the whole span."""
    r = ranges.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = F.expr(" AND ".join(f"{k} = _{k}" for k in keys) + (" AND start >= _start AND end <= _end" if inside else " AND start < _end AND end > _start"))
    if longer:
        met = met & F.expr("_end - _start >= end - start")
    return spans.join(r, met, "left_anti")


def numbered(findings: DataFrame, keys: tuple[str, ...] = ("doc_id",), prefix: str = "f", order: tuple[str, ...] = ("start", "end", "raw")) -> DataFrame:
    """``findings`` with an id in the order of their text."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("id", F.format_string(f"{prefix}_%04d", k))


def shifted(replacements: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Replacements with their places in the replaced text: a running sum of what earlier ones added."""
    grown = F.length("placeholder") - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(grown).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = replacements.withColumn("new_start", (F.col("start") + before).cast("int"))
    return out.withColumn("new_end", (F.col("new_start") + F.length("placeholder")).cast("int"))


def natural(token: str) -> list[Column]:
    """Order of tokens: secrets by number, then networks, then public hosts, each level by its numbers, then as text."""
    family = F.regexp_extract(token, r"^\[(PWM|NET|PUB_HOST)", 1)
    rank = F.when(family == "PWM", 0).when(family == "NET", 1).when(family == "PUB_HOST", 2).otherwise(3)
    return [rank, F.transform(F.regexp_extract_all(F.col(token), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("long")), F.col(token)]


def preview(line: Column, at: Column, size: Column, most: int = LINE) -> Column:
    """A line of at most ``most`` characters around what stands at a place in it."""
    first = F.greatest(F.lit(0), F.least(at - F.floor((most - size) / 2), F.length(line) - most))
    return F.when(F.length(line) <= most, line).otherwise(F.substr(line, (first + 1).cast("int"), F.lit(most)))


def short(text: Column, most: int = TEXT) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def trusted_by_count(tokens: DataFrame, counts: DataFrame, session: str = "session_id") -> DataFrame:
    """Tokens with whether their number is within what their session has given out. ``counts``: session, n."""
    return tokens.join(counts.select(session, "n"), session, "left").withColumn("trusted", F.col("index").between(1, F.coalesce("n", F.lit(0)))).drop("n")


def flags(policies: DataFrame) -> DataFrame:
    """Policies (enterprise, allow_pause) with enforced and pausable: what an enterprise enforces can only be paused if its policy says so."""
    enforced = F.coalesce("enterprise", F.lit(False))
    return policies.withColumn("enforced", enforced).withColumn("pausable", ~enforced | F.coalesce("allow_pause", F.lit(False)))
