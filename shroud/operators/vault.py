"""Session-scoped placeholders: numbering, reuse, trust, reveal, and the vault table that alone holds raw values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import java, python
from ..functions.scalars import CLEAN_TOKEN, TOKEN, fnv1a
from ..sources.scratch import settle
from .spans import matches_sql, replace_spans

ALIAS_OFFSET = 1_000_000
#: Characters of the known values in one automaton, and of the texts that pass it in one group.
BLOCK, PIECE = 2_000_000, 16_000_000


def canonical_token(token: Column) -> Column:
    """Older typed tokens get a number from their hash; current ones stay."""
    alias = F.concat(F.lit("[PWM_"), F.lit(ALIAS_OFFSET) + fnv1a(token), F.lit("]"))
    return F.when(token.rlike(java(CLEAN_TOKEN)), token).when(token.rlike(java(r"^\[[A-Z][A-Z0-9_]*_\d+\]$")), alias).otherwise(token)


def canonical_text(text: str) -> Column:
    """The text with every token in its current form."""
    found = F.expr(matches_sql(text, TOKEN))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), canonical_token(m["raw"]).alias("placeholder")))
    return F.when(F.size(found) == 0, F.col(text)).otherwise(replace_spans(F.col(text), spans))


def tokens_of(text: str) -> Column:
    """All tokens of the text, in order, in their current form."""
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(java(TOKEN)), F.lit(0)), canonical_token)


def visible_tokens(docs: DataFrame, keep: tuple[str, ...] = ("session_id",), text_col: str = "text") -> DataFrame:
    """One row a token: family and index parsed from it."""
    each = docs.select(*keep, F.explode(tokens_of(text_col)).alias("token"))
    return each.select(
        *keep, "token",
        F.regexp_extract("token", r"^\[(PUB_HOST|[A-Z]+)", 1).alias("family"),
        F.regexp_extract("token", r"^\[(?:PUB_HOST|[A-Z]+)_(\d+)", 1).cast("long").alias("index"),
    )


def counters(tokens: DataFrame, session: str = "session_id") -> DataFrame:
    """Highest visible index of each session and family; aliases of old tokens don't count."""
    return tokens.where(F.col("index") < ALIAS_OFFSET).groupBy(session, "family").agg(F.max("index").alias("last"))


def fingerprint(session: str, family: str, raw: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.col(session), F.col(family), F.col(raw)), 256)


def number(findings: DataFrame, used: DataFrame | None = None, session: str = "session_id", order: tuple[str, ...] = ("seq", "doc_id", "start")) -> DataFrame:
    """The vault: a token for each new (session, family, raw), numbered by first appearance after the used indexes.

    Values are reduced to one row each before they are numbered, so a session with many repeats shuffles few rows; and a sort by ranges numbers them, so
    one session with most of the values isn't one task.
    """
    firsts = findings.groupBy(session, "family", "raw").agg(F.min(F.struct(*order)).alias("first"))
    placed = settle(firsts.repartitionByRange(session, "family", "first", "raw").sortWithinPartitions(session, "family", "first", "raw").withColumn("_id", F.monotonically_increasing_id()), "numbered")
    # rows of a partition are numbered as they lie; how many of their group lie in earlier partitions is one row for each group and partition
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy(F.coalesce(session, F.lit("")).alias("_s"), F.col(session).isNull().alias("_null"), F.col("family").alias("_f"), "_part").agg(F.min("_id").alias("_lo"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_s", "_null", "_f").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumnRenamed("_part", "_p")
    same = F.expr(f"coalesce({session}, '') = _s AND ({session} IS NULL) = _null AND family = _f AND _part = _p")
    firsts = placed.join(parts, same).withColumn("_k", F.col("_id") - F.col("_lo") + F.col("_before") + 1)
    if used is not None:
        last = used.select(F.col(session).alias("_us"), F.col("family").alias("_uf"), "last")
        firsts = firsts.join(last, F.col(session).eqNullSafe(F.col("_us")) & (F.col("family") == F.col("_uf")), "left")
    else:
        firsts = firsts.withColumn("last", F.lit(0).cast("long"))
    out = firsts.withColumn("index", F.coalesce("last", F.lit(0)) + F.col("_k"))
    return out.select(session, "family", "raw", fingerprint(session, "family", "raw").alias("fingerprint"), F.concat(F.lit("["), "family", F.lit("_"), "index", F.lit("]")).alias("placeholder"), "index")


def public_state(vault: DataFrame, session: str = "session_id") -> DataFrame:
    """The vault without raw values."""
    return vault.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("family", F.lit(1))))).alias("families"), F.array_sort(F.collect_set("placeholder")).alias("known"))


def trusted(tokens: DataFrame, vault: DataFrame, session: str = "session_id") -> DataFrame:
    """Tokens that the session's vault knows."""
    return tokens.join(vault.select(session, F.col("placeholder").alias("token")), [session, "token"], "left_semi")


def untrusted(tokens: DataFrame, vault: DataFrame, session: str = "session_id") -> DataFrame:
    return tokens.join(vault.select(session, F.col("placeholder").alias("token")), [session, "token"], "left_anti")


def occurrences(docs: DataFrame, vault: DataFrame, session: str = "session_id", least: int = 8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Literal occurrences of known values in the texts of the session, outside tokens and where they aren't a URL's scheme. Only values of at least ``least`` characters; shorter ones are left to
    detectors. A session's values are dealt into blocks of about ``BLOCK`` characters and its texts into pieces of about ``PIECE``; where a piece meets a block, the block's values are one
    automaton that each text passes once, so a text's cost doesn't grow with the values of a block."""
    same = F.col(session).eqNullSafe(F.col("_s"))
    values = vault.where(F.length("raw") >= least).select(F.col(session).alias("_s"), "raw", "placeholder")
    texts = docs.where("text IS NOT NULL").select(*keep, session, "text")
    blocks = values.groupBy("_s").agg(F.ceil(F.sum(F.length("raw")) / BLOCK).alias("_blocks"))
    pieces = texts.groupBy(session).agg(F.ceil(F.sum(F.length("text")) / PIECE).alias("_pieces")).where("_pieces > 0")
    sizes = settle(pieces.join(blocks, same).select("_s", "_pieces", "_blocks"), "sizes")
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    asked = texts.join(sizes, same).withColumn("_piece", deal(F.col("_pieces"), "text", *keep)).select(F.struct(*keep).alias("_keep"), session, "_piece", every(F.col("_blocks")).alias("_block"), F.lit(True).alias("_asked"), F.col("text").alias("_text"), F.lit(None).cast("string").alias("_token"))
    known = values.join(sizes.withColumnRenamed("_s", "_o"), F.col("_s").eqNullSafe(F.col("_o"))).withColumn("_block", deal(F.col("_blocks"), "raw"))
    known = known.select(F.lit(None).cast(asked.schema["_keep"].dataType).alias("_keep"), F.col("_s").alias(session), every(F.col("_pieces")).alias("_piece"), "_block", F.lit(False).alias("_asked"), F.col("raw").alias("_text"), F.col("placeholder").alias("_token"))
    # in each group the values come before the texts
    group = [session, "_piece", "_block"]
    met = known.union(asked).repartition(*group).sortWithinPartitions(*group, "_asked")
    found = T.StructType([met.schema["_keep"], met.schema[session], T.StructField("raw", T.StringType()), T.StructField("placeholder", T.StringType()), T.StructField("start", T.IntegerType())])
    each = met.mapInArrow(_searched, found).select("_keep.*", session, "raw", "placeholder", "start")
    return each.withColumn("end", F.col("start") + F.length("raw"))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the texts of a group hold its values: _keep, session, raw, placeholder, start. Places of one value don't overlap."""
    import ahocorasick

    group, machine = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        at, out = [], []
        for row, (*own, asked, text, token) in enumerate(zip(*columns, strict=True)):
            if own != group:
                group, machine = own, ahocorasick.Automaton()
            if not asked:
                machine.add_word(text, (text, (*machine.get(text, (text, ()))[1], token)))
                continue
            if not len(machine):
                continue
            if machine.kind == ahocorasick.TRIE:
                machine.make_automaton()
            tokens, ends = None, {}
            for last, (raw, placeholders) in machine.iter(text):
                end, start = last + 1, last + 1 - len(raw)
                if start < ends.get(raw, 0):
                    continue
                ends[raw] = end
                if tokens is None:
                    tokens = [m.span() for m in python(TOKEN).finditer(text)]
                if text.startswith("://", end) or any(a < end and b > start for a, b in tokens):
                    continue
                at += [row] * len(placeholders)
                out += [(raw, p, start) for p in placeholders]
        taken = pa.array(at, pa.int64())
        raws, placeholders, starts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(raws, pa.string()), pa.array(placeholders, pa.string()), pa.array(starts, pa.int32())], names=["_keep", batch.schema.names[1], "raw", "placeholder", "start"])


def reuse(docs: DataFrame, vault: DataFrame, session: str = "session_id", least: int = 8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``occurrences``, the longest where they overlap."""
    each = occurrences(docs, vault, session, least, keep)
    longer = each.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = " AND ".join(f"{c} = _{c}" for c in keep)
    return each.join(longer, F.expr(f"{same} AND start < _end AND end > _start AND _end - _start > end - start"), "left_anti")


def reveal(tokens: DataFrame, vault: DataFrame, allowed: Column | None = None, session: str = "session_id") -> DataFrame:
    """Tokens with their raw value; null if the session doesn't know it or the policy doesn't allow it."""
    held = vault.select(session, F.col("placeholder").alias("token"), F.col("raw").alias("_raw"))
    out = tokens.join(held, [session, "token"], "left")
    return out.withColumn("raw", F.when(F.lit(True) if allowed is None else allowed, F.col("_raw"))).drop("_raw")


def segments(text: str) -> Column:
    """Alternating text and token parts."""
    tokens = F.concat(F.regexp_extract_all(F.col(text), F.lit(java(TOKEN)), F.lit(0)), F.array(F.lit("")))
    pairs = F.arrays_zip(F.split(F.col(text), java(TOKEN), -1).alias("plain"), tokens.alias("token"))
    parts = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit("text").alias("type"), p["plain"].alias("value")), F.struct(F.lit("secret").alias("type"), p["token"].alias("value")))))
    return F.filter(parts, lambda p: p["value"] != "")
