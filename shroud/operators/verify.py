"""Checks of redacted text against what it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import java
from ..functions.scalars import TOKEN


def normal_text(x: Column) -> Column:
    """Line breaks to LF, hard blanks to blanks, zero-width characters out, no blanks at line ends, at most two breaks in a row."""
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.replace(x, F.lit("\u00a0"), F.lit(" "))
    x = F.regexp_replace(x, "[\u200b-\u200d\ufeff]", "")
    x = F.regexp_replace(x, "[ \t]+\n", "\n")
    return F.regexp_replace(x, "\n{3,}", "\n\n")


def distinct_tokens(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(java(TOKEN)), F.lit(0))))


def same_tokens(a: Column, b: Column) -> Column:
    return distinct_tokens(a) == distinct_tokens(b)


def has_tokens(expected: Column, actual: Column) -> Column:
    return F.size(F.array_except(distinct_tokens(expected), distinct_tokens(actual))) == 0


def in_order(expected: Column, actual: Column) -> Column:
    """The expected tokens stand in the text in their order, others between them or not."""
    want, have = (F.regexp_extract_all(x, F.lit(java(TOKEN)), F.lit(0)) for x in (expected, actual))
    met = F.aggregate(have, F.lit(0), lambda i, t: F.when(F.get(want, i) == t, i + 1).otherwise(i))
    return met == F.size(want)


def collapsed(expected: Column, actual: Column) -> Column:
    """At least two line breaks were expected and less than half are there, while the tokens stand in their order."""
    n = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    return (n(expected) >= 2) & (n(actual) * 2 < n(expected)) & in_order(expected, actual)


def leaks(redacted: DataFrame, findings: DataFrame, expected: str = "redacted", actual: str = "actual") -> DataFrame:
    """Status of each document: leak, tokens_missing, lines_collapsed or ok, and how it matched.

    ``findings``: doc_id, raw, severity; joined by document, so only texts with high findings meet their values.
    """
    high = findings.where("severity = 'high'").groupBy("doc_id").agg(F.collect_set("raw").alias("_raws"))
    e, a = normal_text(F.col(expected)), normal_text(F.col(actual))
    out = redacted.join(high, "doc_id", "left").withColumn("n_leaked", F.size(F.filter(F.coalesce("_raws", F.array().cast("array<string>")), lambda r: F.contains(F.col(actual), r))).cast("long"))
    status = F.when(F.col("n_leaked") > 0, "leak").when(~has_tokens(e, a), "tokens_missing").when(collapsed(e, a), "lines_collapsed").otherwise("ok")
    match = F.when(F.col(expected) == F.col(actual), "exact").when(e == a, "normalized").when(same_tokens(e, a), "tokens").otherwise("none")
    return out.select("doc_id", "n_leaked", status.alias("status"), match.alias("match"))


def safe_label(x: Column) -> Column:
    """The label if it is a plain short name, else null."""
    return F.when(x.rlike(r"\A[A-Za-z0-9][A-Za-z0-9 ._-]{0,63}\z") & ~x.rlike(r"(?i)://|[/\\@]|sk-|akia|token|password|secret"), x)
