"""Rows out of delimited, piped and paired text: entity, label and value with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import running
from .spans import let, lines, matches

# Label and value tests in order.
GUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
KINDS = (
    ("AZURE_TENANT_ID", r"\b(?:tenant|directory)\b", f"(?i)^{GUID}$"),
    ("AZURE_SUBSCRIPTION_ID", r"\bsubscription\b", f"(?i)^{GUID}$"),
    ("AWS_ACCOUNT_ID", r"\baws\b.*\baccount\b|\baccount id\b", r"^\d{12}$"),
    ("K8S_NAMESPACE", r"\b(?:kubernetes|k8s)\b.*\bnamespace\b|^namespace$", r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"),
    ("EMAIL", r"\b(?:email|mail|upn)\b", r"(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"),
    ("USERNAME", r"\b(?:user|username|login|account name)\b", r"^[A-Za-z0-9._@\\-]{3,64}$"),
)


def label(x: Column) -> Column:
    """Lower case, separators to blanks, no other punctuation; camel case is parted."""
    x = F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")
    x = F.regexp_replace(F.lower(x), "[_-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]+", " "), " +", " "))


def line_rows(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a line with its number and offsets."""
    return docs.select(*keep, F.posexplode(lines("text")).alias("line_no", "l")).select(*keep, "line_no", "l.line", "l.start", "l.end")


def cells(line: str, delimiter: str) -> Column:
    """Cells of a line with offsets in it; quotes may hold the delimiter, doubled quotes stand for one."""
    d = {"\t": r"\t", "|": r"\|"}.get(delimiter, delimiter)
    tokens = f"regexp_extract_all(concat({line}, '{delimiter}'), r'(?:\"(?:[^\"]|\"\")*\"|[^{d}])*{d}', 0)"
    raw = "left(t, length(t) - 1)"
    quoted = f"regexp_like(trim({raw}), '^\".*\"$')"
    value = f"CASE WHEN {quoted} THEN replace(regexp_replace(trim({raw}), '^\"|\"$', ''), '\"\"', '\"') ELSE trim({raw}) END"
    start = f"cast(at[i] + length({raw}) - length(ltrim({raw})) + CASE WHEN {quoted} THEN 1 ELSE 0 END as int)"
    return F.expr(let(tokens, "ts", let("transform(ts, t -> cast(length(t) as bigint))", "n", let(running("n"), "at", f"transform(ts, (t, i) -> named_struct('value', {value}, 'start', {start}))"))))


def delimited(docs: DataFrame, delimiter: str = ",", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label and value of table rows. A line with a name-like and a value column heads the lines below it until an empty line."""
    rows = line_rows(docs, keep).withColumn("cells", cells("line", delimiter)).withColumn("names", F.transform("cells", lambda c: label(c["value"])))
    named = F.exists("names", lambda n: n == "value") & F.exists("names", lambda n: n.isin("type", "name", "key"))
    order = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("header", F.when(named, F.col("names"))).withColumn("block", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(order))
    inside = Window.partitionBy(*keep, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.last("header", ignorenulls=True).over(inside)).where("head is not null and header is null and trim(line) <> ''")
    value_at = F.array_position("head", "value")
    label_at = F.coalesce(*(F.nullif(F.array_position("head", n), F.lit(0)) for n in ("type", "name", "key")))
    rows = rows.withColumn("v", F.try_element_at("cells", value_at.cast("int"))).withColumn("n", F.try_element_at("cells", label_at.cast("int"))).where("v is not null and n is not null and v.value <> ''")
    return rows.select(*keep, "line_no", label(F.col("n.value")).alias("label"), F.col("v.value").alias("value"), (F.col("start") + F.col("v.start")).cast("int").alias("start"), (F.col("start") + F.col("v.start") + F.length("v.value")).cast("int").alias("end"))


def paired(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``Value:`` lines with the label of the line just before."""
    rows = line_rows(docs, keep)
    order = Window.partitionBy(*keep).orderBy("line_no")
    name = F.regexp_extract("line", r"(?i)^\s*(?:type|key|name)\s*:\s*(.+)$", 1)
    value = F.regexp_extract("line", r"(?i)^\s*value\s*:\s*(.+)$", 1)
    rows = rows.withColumn("label", F.lag(name).over(order)).withColumn("value", value)
    return rows.where("value <> '' and label <> ''").select(*keep, "line_no", label(F.col("label")).alias("label"), "value")


def classified(rows: DataFrame) -> DataFrame:
    """Rows whose label and value fit a kind; the first that fits."""
    kind = F.coalesce(*(F.when(F.col("label").rlike(a) & F.col("value").rlike(b), F.lit(k)) for k, a, b in KINDS))
    return rows.withColumn("type", kind).where("type is not null").withColumn("score", F.lit(99))


def piped(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label and value of pipe tables; lines that part the header from the rows are skipped."""
    return delimited(docs, "|", keep).where(~F.col("value").rlike(r"\A:?-{2,}:?\z"))


def json_objects(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label and value of flat JSON objects in text: the first of type, key or name, and value."""
    field = lambda names: F.regexp_extract("m.raw", rf'(?i)"(?:{names})"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    rows = docs.select(*keep, F.explode(matches("text", r"\{[^{}]*\}")).alias("m"))
    rows = rows.select(*keep, F.col("m.start").alias("start"), label(field("type|key|name")).alias("label"), field("value").alias("value"))
    return rows.where("label <> '' and value <> ''")


def html_rows(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Label and value of HTML table rows; a row with a name-like and a value cell heads the rows below it."""
    rows = docs.select(*keep, F.posexplode(matches("text", r"<tr\b[^>]*>[\s\S]*?<\/tr>", "i")).alias("row_no", "m")).select(*keep, "row_no", "m.raw")
    plain = F.transform(F.regexp_extract_all("raw", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(unescaped(F.regexp_replace(c, "<[^>]*>", ""))))
    rows = rows.withColumn("cells", plain).withColumn("names", F.transform("cells", label))
    named = F.exists("names", lambda n: n == "value") & F.exists("names", lambda n: n.isin("type", "name", "key"))
    before = Window.partitionBy(*keep).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("header", F.when(named, F.col("names"))).withColumn("head", F.last("header", ignorenulls=True).over(before)).where("head is not null and header is null")
    at = lambda n: F.nullif(F.array_position("head", n), F.lit(0))
    value = F.try_element_at("cells", F.array_position("head", "value").cast("int"))
    name = F.try_element_at("cells", F.coalesce(at("type"), at("name"), at("key")).cast("int"))
    return rows.select(*keep, "row_no", label(name).alias("label"), value.alias("value")).where("value <> '' and label <> ''")


def unescaped(x: Column) -> Column:
    """The five named entities; the ampersand last, so nothing is decoded twice."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# Labels and values of credentials that stand on lines of their own.
PROVIDER_LABEL = r"(?i)(?:api[ _-]?key|apikey|key)[^\r\n]*:[ \t]*$"
PROVIDER_VALUE = r"(?i)^[ \t]*(sk-(?:proj|live|test|org|svcacct|admin)-[A-Za-z0-9_-]{6,})"
AWS_LABEL = r"(?i)\bAWS[ \t]+(?:Secret[ \t]+(?:Access[ \t]+)?Key|Access[ \t]+Key(?:[ \t]+ID)?)"
AWS_KEY = r"^[ \t]*((?:AKIA|ASIA)[A-Z0-9]{16})[ \t]*$"
AWS_SECRET = r"^[ \t]*([A-Za-z0-9/+=]{40})[ \t]*$"
EXAMPLES = r"(?i)\b(?:example|sample|dummy|fake|template|mock|placeholder|replace[_ -]?me|changeme)\b"


def adjacent(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Credentials whose label, or whose other half, stands on the line before: detector, type, raw, start, end, score."""
    rows = line_rows(docs, keep).withColumn("before", F.lag("line").over(Window.partitionBy(*keep).orderBy("line_no"))).where("before is not null")
    label, line = F.col("before"), F.col("line")
    secret = label.rlike(AWS_LABEL) & label.rlike(r"(?i)\bsecret\b")
    cases = (
        ("C12", "API_KEY", 90, label.rlike(PROVIDER_LABEL) & ~label.rlike(EXAMPLES), PROVIDER_VALUE),
        ("C13", "AWS_SECRET_KEY", 98, secret, AWS_SECRET),
        ("C13", "AWS_KEY", 94, label.rlike(AWS_LABEL) & ~secret, AWS_KEY),
        ("C14", "AWS_SECRET_KEY", 97, label.rlike(AWS_KEY), AWS_SECRET),
    )
    one = lambda d, t, n, ok, rx: F.when(ok & line.rlike(rx), F.struct(F.lit(d).alias("detector"), F.lit(t).alias("type"), F.regexp_extract(line, rx, 1).alias("raw"), F.lit(n).alias("score")))
    rows = rows.select(*keep, "line", "start", F.explode(F.array_compact(F.array(*(one(*c) for c in cases)))).alias("f"))
    at = (F.col("start") + F.expr("instr(line, f.raw)") - 1).cast("int")
    return rows.select(*keep, "f.detector", "f.type", "f.raw", at.alias("start"), (at + F.length("f.raw")).cast("int").alias("end"), "f.score")
