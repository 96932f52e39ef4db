"""Queries of the corpus operators over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, licenses, near_dedup, packing, pii, quality, secrets, sharding, substring, tokens, topk, variants
from .base import cut, table

#: A deployment passes its own key; this one makes results repeatable.
PII_KEY = "pseudonym-key-of-the-registered-query"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2).drop("text_key")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where("vec_id % 20 = 0"), vectors)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.documents(tokens.write(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.runs(table(spark, sf_dir, "documents"))
    words = cut(variants.vocabulary(runs.select(variants.planted(runs).alias("word"))), "vocabulary")
    return variants.forms(words).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_secrets, op4_substring_dedup, op5_exact_topk, op6_licenses, op7_packing, op8_quality, op9_pii, op10_sharding, op11_conversations, op12_token_files, op13_spelling_variants)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_RUN = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS near FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY 1),
k AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS k FROM s GROUP BY 1),
m AS (SELECT doc_id, count(*) OVER (PARTITION BY k) AS n_copies FROM k)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept, coalesce(m.n_copies, 1) AS n_copies
FROM n JOIN c ON c.doc_id = n.doc_id LEFT JOIN m ON m.doc_id = n.doc_id
"""

_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM v),
x AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, sizes WHERE len(w) >= size),
h AS (SELECT x.doc_id, v.item_id, x.k, v.size FROM x JOIN v ON v.size = x.size AND v.g = array_to_string(x.w[x.k:x.k + x.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _secret_spans(kind: int, pattern: str, group: int, least: int) -> str:
    rx = pattern.replace("'", "''")
    return f"""SELECT doc_id, owner, repo, kind, start, start + len(m) AS "end", v FROM (
  SELECT doc_id, owner, repo, {kind} AS kind, m[j] AS m, v[j] AS v, coalesce(list_sum(list_transform(g[1:j], lambda z: len(z))), 0) + coalesce(list_sum(list_transform(m[1:j - 1], lambda z: len(z))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, owner, repo, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {group}) AS v, string_split_regex(t, '{rx}') AS g FROM d WHERE regexp_matches(t, '{rx}')))
) WHERE len(v) >= {least}"""


_OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS repo, coalesce(string_split(source, '/')[1], '') AS owner, coalesce(text, '') AS t FROM documents),
base AS ({_secret_spans(0, secrets.ASSIGN, 2, 8)} UNION ALL {_secret_spans(1, secrets.ACCESS, 0, 0)} UNION ALL {_secret_spans(2, secrets.HEX, 0, 0)}),
opaque AS (SELECT * FROM ({_secret_spans(3, secrets.OPAQUE, 0, 0)}) o WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o."end" AND b."end" > o.start)),
f AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
o AS (SELECT v, count(DISTINCT owner) AS owners FROM f GROUP BY 1),
a AS (SELECT f.*, owners, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS s,
  owners <= {secrets.FEW_OWNERS} AND len(list_distinct(string_split(f.v, ''))) >= 8 AND len(list_distinct(string_split(f.v, ''))) * 4 >= least(len(f.v), 40) AS live FROM f JOIN o ON o.v = f.v),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3 OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (kind < 3 AND owners > {secrets.FEW_OWNERS}) AS n_copied, coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (live), '') AS live_spans FROM a GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_BLANK}'), []) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS k, w FROM d WHERE len(w) >= 35),
y AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS g FROM x),
z AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY g) AS n FROM y) WHERE n > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS j FROM z),
l AS (SELECT doc_id, list(j) AS gone, count(*) AS n_removed FROM r GROUP BY 1),
u AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
q AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.j = u.j WHERE r.j IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def _crc32(x: str) -> str:
    """The CRC of an ASCII or Latin text's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(1, octet_length(encode({x})) + 1), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i - 1, 2) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {bits}), 4294967295)"


def _conversation_sql() -> str:
    states = (("e", "e"), ("s", "s"), ("u", "u"), ("a", "a"))
    free = {"e": "u", "s": "u", "u": "a", "a": "u"}
    keep = {"e": "su", "s": "u", "u": "a", "a": "u"}
    role = {"u": "user", "a": "assistant"}
    best = lambda options: "list_min(list_filter([" + ", ".join(options) + "], lambda o: o.c IS NOT NULL))"

    def option(cost: str, edit: str, line: str | None, rest: str, when: str = "true") -> str:
        own = "[]" if line is None else f"[{line}]"
        return f"{{'c': CASE WHEN {when} THEN {cost} + {rest}.c END, 'a': '{edit}' || {rest}.a, 'l': {own} || {rest}.l}}"

    base = {}
    for q, _ in states:
        stays = "NOT gone"
        options = [option("2", "D", None, f"r.{q}"), option("1 + more", "R", f"'{role[free[q]]}:' || text", f"r.{free[q]}", stays)]
        options += [option("more", "K", "role || ':' || text", f"r.{x}", f"{stays} AND role[1] = '{x}'") for x in keep[q]]
        base[q] = best(options)
    inserted = lambda q, own, rest: f"list_min([{own}, {{'c': 5 + {rest}.c, 'a': 'I' || {rest}.a, 'l': ['{role[free[q]]}:'] || {rest}.l}}])"
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k FROM x),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open_end,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair FROM n),
g AS (SELECT *, blank OR again AS gone, CASE WHEN open_end THEN 5 ELSE 0 END AS more, max(k) OVER (PARTITION BY conv_id) AS m FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (open_end AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1),
r AS (SELECT DISTINCT conv_id, m + 1 AS k, {{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}} AS e, {{'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']}} AS s, {{'c': 5, 'a': 'I', 'l': ['assistant:']}} AS u, {{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}} AS a FROM g
  UNION ALL SELECT conv_id, k, {inserted("e", "e", "u")} AS e, {inserted("s", "s", "u")} AS s, u, a FROM (
    SELECT conv_id, k, e, s, {inserted("u", "u", "a")} AS u, {inserted("a", "a", "u")} AS a FROM (
      SELECT g.conv_id, g.k, {", ".join(f"{base[q]} AS {q}" for q, _ in states)} FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.k = r.k - 1))),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(r.e.c, 0) AS BIGINT) AS cost, coalesce(r.e.a, '') AS audit, sha256(coalesce(array_to_string(r.e.l, chr(10)), '')) AS repaired_sha256
FROM o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.k = 1
"""


_OP13 = rf"""
WITH RECURSIVE o AS (SELECT doc_id, {_LOWER_RUN} AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT *, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM o),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
e AS (SELECT word, n, k, left(word, k - 1) AS head, substr(word, k + 1) AS tail FROM d),
p AS (SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = head || tail UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = head || tail),
b AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.near END AS form, CASE WHEN -best.less >= 10 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM f JOIN r ON r.word = f.word JOIN f t ON t.word = r.root AND t.form IS NULL
"""


def _license_sql() -> str:
    def canonical(x: str) -> str:
        out = f"lower({x})"
        for line in licenses.COPYRIGHT:
            out = f"regexp_replace({out}, '{line.format(alnum='[:alnum:]')}', ' ', 'g')"
        out = f"regexp_replace(regexp_replace({out}, '{licenses.sentences()}', 'copyright' || chr(1) || ' \\1', 'g'), '{licenses.NAMED.format(alnum='[:alnum:]', letters=chr(92) + 'p{L}')}', ' ', 'g')"
        out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for a, b in licenses.SPELLINGS:
            out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
        return out

    rows = ", ".join(f"('{a}', '{t.replace(chr(39), chr(39) * 2)}')" for a, _, t in licenses.KNOWN)
    long = ", ".join(f"('{a}', '{d}')" for a, _, d in licenses.DIGESTS)
    marked = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in licenses.MARKERS) + ")"
    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({canonical("t")}) AS digest FROM (VALUES {rows}) x(license, t) UNION ALL SELECT * FROM (VALUES {long}) y(license, digest)) GROUP BY 1),
u AS (SELECT doc_id, 'document' AS kind, text AS x FROM documents WHERE {marked("text")}
  UNION ALL SELECT * FROM (SELECT doc_id, 'line', unnest(regexp_split_to_array(text, '\\r?\\n')) AS x FROM documents WHERE contains(text, chr(10))) WHERE {marked("x")}
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\\n(?:[ \\t\\r]*\\n)+')) AS x FROM documents WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')) WHERE {marked("x")} AND contains(trim(x), chr(10))),
f AS (SELECT doc_id, kind, license FROM u JOIN k ON k.digest = sha256({canonical("x")})),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_units, max(license) FILTER (kind = 'document') AS whole_text FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_units, 0) AS n_units, whole_text FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""


ORACLES: dict[str, str] = {"op1_near_dedup": _OP1, "op2_decontamination": _OP2, "op3_secrets": _OP3, "op4_substring_dedup": _OP4, "op5_exact_topk": _OP5, "op6_licenses": _license_sql(), "op11_conversations": _conversation_sql(), "op13_spelling_variants": _OP13}
