"""Spans of matches: extraction with offsets, best of equals, overlap resolution and replacement.

A span is a struct with code-point ``start`` and ``end`` (exclusive). All of it is expressions on one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import running
from ..functions.dialect import java

MATCH = "array<struct<start:int,end:int,raw:string,first:int,last:int,matched:string>>"


def let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``value`` bound to ``name``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fenced(df: DataFrame) -> DataFrame:
    """The same rows, computed here: what is built on them doesn't repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def piecewise(value: str, name: str, body: str) -> str:
    """SQL text of a test ``body`` of a value bound to ``name``. A step with one is compiled in pieces: Spark would make a step of plain expressions one method, and the JVM runs
    methods beyond some size uncompiled; a step that holds a higher-order function is left out of that."""
    return f"exists(array({value}), {name} -> {body})"


def matches_sql(text: str, pattern: str, flags: str = "", groups: tuple[int, ...] = ()) -> str:
    """Leftmost non-overlapping matches of a column, as SQL text. ``raw`` is the first non-empty group, ``start`` its first
    place inside the match; ``first`` and ``last`` bound the whole match. Texts without a match cost one search."""
    rx = "r'" + java(pattern, flags).replace("'", r"\x27") + "'"
    picked = [f"regexp_extract_all({text}, {rx}, {g})" for g in groups]
    return f"CASE WHEN regexp_like({text}, {rx}) THEN {_located(text, rx, picked)} ELSE cast(array() as {MATCH}) END"


def matches_of_sql(text: str, rx: str, groups: str, most: int) -> str:
    """The same with an expression and its groups (an array of at most ``most``) that are values of the row. The text is known to match."""
    picked = [f"CASE WHEN size({groups}) > {n} THEN regexp_extract_all({text}, {rx}, {groups}[{n}]) ELSE cast(array() as array<string>) END" for n in range(most)]
    return _located(text, rx, picked)


def _located(text: str, rx: str, picked: list[str]) -> str:
    whole = f"regexp_extract_all({text}, {rx}, 0)"
    raw = "coalesce(" + "".join(f"nullif(z.`{k + 2}`, ''), " for k in range(len(picked))) + "z.`0`)" if picked else "z.`0`"
    first = "cast(at[i] as int) + length(z.`1`)"
    start = f"{first} + instr(z.`0`, {raw}) - 1" if picked else first
    one = f"named_struct('start', {start}, 'end', {start} + length({raw}), 'raw', {raw}, 'first', {first}, 'last', {first} + length(z.`0`), 'matched', z.`0`)"
    zipped = f"filter(arrays_zip({whole}, slice(split({text}, {rx}, -1), 1, greatest(size({whole}), 1)){''.join(', ' + p for p in picked)}), z -> z.`0` IS NOT NULL)"
    sizes = "transform(zs, z -> cast(length(z.`0`) + length(z.`1`) as bigint))"
    return let(zipped, "zs", let(sizes, "n", let(running("n"), "at", f"transform(zs, (z, i) -> {one})")))


def matches(text: str, pattern: str, flags: str = "", groups: tuple[int, ...] = ()) -> Column:
    return F.expr(matches_sql(text, pattern, flags, groups))


#: Long texts are cut into chunks of this many characters, since a place in a text is found by walking to it.
CHUNK = 4096
SHORT = 2 * CHUNK


def chunks_sql(text: str) -> str:
    """Chunks of a long text; of a short one none."""
    return f"CASE WHEN length({text}) > {SHORT} THEN regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0) ELSE cast(array() as array<string>) END"


def line_before_sql(text: str, chunks: str, at: str) -> str:
    """What stands on the line before the place."""
    k = f"({at} div {CHUNK})"
    near = f"concat(coalesce(get({chunks}, {k} - 1), ''), left(coalesce(get({chunks}, {k}), ''), {at} % {CHUNK}))"
    whole = f"substring_index(substr({text}, 1, {at}), '\\n', -1)"
    tail = let(near, "near", f"CASE WHEN contains(near, '\\n') OR {at} < {SHORT} THEN substring_index(near, '\\n', -1) ELSE {whole} END")
    return f"CASE WHEN size({chunks}) = 0 THEN {whole} ELSE {tail} END"


def line_after_sql(text: str, chunks: str, at: str) -> str:
    """What stands on the line after it, without a carriage return at its end."""
    k = f"({at} div {CHUNK})"
    near = f"concat(substr(coalesce(get({chunks}, {k}), ''), {at} % {CHUNK} + 1), coalesce(get({chunks}, {k} + 1), ''))"
    whole = f"substring_index(substr({text}, {at} + 1), '\\n', 1)"
    head = let(near, "near", f"CASE WHEN contains(near, '\\n') OR {k} + 2 >= size({chunks}) THEN substring_index(near, '\\n', 1) ELSE {whole} END")
    return f"regexp_replace(CASE WHEN size({chunks}) = 0 THEN {whole} ELSE {head} END, r'\\r\\z', '')"


def lines(text: str) -> Column:
    """Lines with their offsets; ends leave a carriage return out."""
    one = "named_struct('line', regexp_replace(x, r'\\r\\z', ''), 'start', cast(at[i] as int), 'end', cast(at[i] + length(regexp_replace(x, r'\\r\\z', '')) as int))"
    return F.expr(let(f"split({text}, '\\n', -1)", "xs", let("transform(xs, x -> cast(length(x) + 1 as bigint))", "n", let(running("n"), "at", f"transform(xs, (x, i) -> {one})"))))


def best_per_span(findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One finding for each (start, end, raw): highest score, then most methods, then first; it takes the place of the first."""
    span = [*keys, "start", "end", "raw"]
    by_rank = Window.partitionBy(*span).orderBy(F.desc("score"), F.desc(F.size("method")), "seq")
    firsts = Window.partitionBy(*span)
    ranked = findings.withColumn("_first", F.min("seq").over(firsts)).withColumn("_rank", F.row_number().over(by_rank))
    return ranked.where("_rank = 1").withColumn("seq", F.col("_first")).drop("_rank", "_first")


def clusters(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``spans`` with ``_cluster``: one sweep by start; spans of different clusters of a text don't overlap."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", F.when(before > F.col("start"), 0).otherwise(1)).withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chosen(spans: DataFrame, order: list[Column], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Greedy choice in the order, which goes by the smallest; what overlaps a chosen span goes. The choice is made inside each cluster, so a text's cost grows
    with its spans and not with their square."""
    columns = spans.columns
    one = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.col("start").alias("s"), F.col("end").alias("e"), F.struct(*[c for c in columns if c not in keys]).alias("row"))
    grouped = clusters(spans, keys).groupBy(*keys, "_cluster").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kind = grouped.schema["all"].dataType.simpleString()

    def take(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: (x["s"] < y["e"]) & (x["e"] > y["s"])), acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", F.expr(f"cast(array() as {kind})"), take))
    return grouped.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.row.*").select(*columns)


def resolve_overlaps(findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Greedy choice in the order score, full value, exact key, length, start, seq; what overlaps a chosen span goes."""
    has = lambda m: F.array_contains("method", m).cast("int")
    return chosen(findings, [-F.col("score"), -has("full-value"), -has("exact-key"), F.col("start") - F.col("end"), F.col("start"), F.col("seq")], keys)


def replace_spans(text: Column, spans: Column) -> Column:
    """Text with each span (start, end, placeholder; apart from each other) replaced. Pieces are read from chunks and joined once."""
    cut = F.when(F.length(text) > SHORT, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(text))
    made = F.struct(cut.alias("c"), F.array_sort(spans).alias("spans"), F.when(F.length(text) > SHORT, F.lit(CHUNK)).otherwise(F.lit(SHORT + 1)).alias("n"), F.length(text).alias("length"))

    def part(x: Column, a: Column, b: Column) -> Column:
        """The characters from a to b."""
        i, j = F.floor(a / x["n"]).cast("int"), F.floor(b / x["n"]).cast("int")
        at = lambda k: F.coalesce(F.get(x["c"], k), F.lit(""))
        within = F.substr(at(i), (a % x["n"] + 1).cast("int"), (b - a).cast("int"))
        across = F.concat(F.substr(at(i), (a % x["n"] + 1).cast("int")), F.array_join(F.slice(x["c"], i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.left(at(j), (b % x["n"]).cast("int")))
        return F.when(i == j, within).otherwise(across)

    def build(x: Column) -> Column:
        end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["spans"], i - 1)["end"])
        pieces = F.transform(x["spans"], lambda s, i: F.concat(part(x, end(i), s["start"]), s["placeholder"]))
        return F.concat(F.array_join(pieces, ""), part(x, end(F.size(x["spans"])), x["length"]))

    return F.element_at(F.transform(F.array(made), build), 1)


def spliced(text: Column, spans: Column) -> Column:
    """Text with spans replaced that may overlap: from the last start to the first, each on what the later ones have left."""
    last_first = F.reverse(F.array_sort(spans))
    return F.aggregate(last_first, text, lambda acc, s: F.concat(F.left(acc, s["start"]), s["placeholder"], F.substr(acc, s["end"] + 1)))
