"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.dialect import SPARK as Q
from ..functions.register import register
from ..operators import audit, detect, evaluate, findings, gate, learn, metadata, network, policy, report, scored, spans, structured, vault, verify
from ..sources import files
from ..sources.scratch import settle, spread
from ..streaming import chunks
from . import requests, transform
from .views import table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Destination list, block list and approved list of the policy queries.
DESTINATIONS = ((1, "*://*.example.com/*", "redact"), (2, "http://*/*", "block"), (3, "*://*/1*", "allow"), (4, "https://*/*", "redact"))
BLOCKED = ((1, "*://*/3*", "block"), (2, "http://*.org/*", "block"))
APPROVED = ((1, "https://*/*", "allow"),)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _list(spark: SparkSession, rows: tuple) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(m).alias("match"), F.lit(a).alias("action")) for p, m, a in rows))).alias("r")).select("r.*")


# ---- scans and detectors


@query
def a01_not_blank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where(F.coalesce("text", F.lit("")).rlike(r"[^\s\u00a0]"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query
def c06_c24_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of all rules with score and reason of suppression."""
    out = detect.judged(view(spark, sf, "v_secret_lines"))
    return out.select("doc_id", "source", "name", "type", "category", "raw", "start", "end", "score", "severity", F.concat_ws(",", "method").alias("method"), F.coalesce("why", F.lit("")).alias("why"))


@query
def c06_c07_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate in lines that each rule matches or just misses."""
    out = detect.judged(view(spark, sf, "v_rule_lines"))
    return out.select("doc_id", "source", "name", "type", "category", "raw", "start", "end", "score", "severity", F.concat_ws(",", "method").alias("method"), F.coalesce("why", F.lit("")).alias("why"))


@query
def h01_r02_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines redacted by all detectors."""
    out, _ = transform.transform(view(spark, sf, "v_rule_lines"), "raw")
    return out.select("doc_id", "session_id", "redacted", "n_replaced")


@query
def c06_c24_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Kept candidates in the documents themselves, counted by rule and type."""
    out = detect.judged(table(spark, sf, "documents"), detectors=("pattern", "registry", "email")).where("why is null")
    return out.groupBy("source", "name", "type").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.countDistinct("doc_id").alias("n_docs"))


@query
def e04_f11_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Best finding of each span, then overlaps resolved."""
    return findings.scan(view(spark, sf, "v_secret_lines")).select("doc_id", "type", "raw", "start", "end", "score", "severity")


@query
def c01_c04_c20_login_lines(spark: SparkSession, sf: str) -> DataFrame:
    """URL logins, headers and cookies, disclosures and disguised keys: what their detectors keep, with places."""
    return scored.scan(view(spark, sf, "v_login_lines"), ("C01", "C04", "C15", "C20", "C21"))


@query
def h01_r02_login_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines redacted by all detectors."""
    out, _ = transform.transform(view(spark, sf, "v_login_lines"), "raw")
    return out.select("doc_id", "session_id", "redacted", "n_replaced")


@query
def c02_c11_assigned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments, connection strings and their attributes: what their detectors keep, with places."""
    return scored.scan(view(spark, sf, "v_assigned_lines"), ("C02", "C05", "C09", "C10", "C11"))


@query
def h01_r02_assigned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines redacted by all detectors."""
    out, _ = transform.transform(view(spark, sf, "v_assigned_lines"), "raw")
    return out.select("doc_id", "session_id", "redacted", "n_replaced")


def _by_rule(rows: DataFrame) -> DataFrame:
    """A classifier that SQL can follow: sure of digits among letters, unsure of what is short."""
    sure = F.col("text").rlike("[0-9]") & F.col("text").rlike("[A-Z]")
    return rows.withColumns({"risk": F.when(sure, "SECRET").when(F.length("text") < 40, "UNSURE").otherwise("NOT_SECRET"), "confidence": F.when(F.length("text") > 30, 0.9).otherwise(0.7)})


def _leftover(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = view(spark, sf, "v_secret_lines").select("doc_id", "text").union(view(spark, sf, "v_login_lines").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    return docs, settle(findings.scan(docs, detectors=("registry", "email")).select("doc_id", "start", "end"), "found")


@query
def c19_c22_vault_aware(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that a session doesn't know, and tails glued to those that it does: only the first five are trusted."""
    docs = view(spark, sf, "v_secret_lines").select("doc_id", F.expr("concat(text, CASE doc_id % 3 WHEN 0 THEN concat(' and [PWM_', doc_id % 9 + 1, ']q8Zr7Wm2Kp4T') WHEN 1 THEN concat('; token: [PWM_', doc_id % 9 + 1, ']') ELSE '' END)").alias("text"))
    trust = docs.select("doc_id", F.explode(F.array(*(F.lit(f"[PWM_{k}]") for k in range(1, 6)))).alias("token"))
    return findings.vault_aware(docs, trust).select("doc_id", "type", "raw", "start", "end", "score", "severity")


@query
def l01_l04_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What vendor rules and addresses leave: candidates of the six families with score and masked context."""
    return gate.candidates(*_leftover(spark, sf), mode="strict")


@query
def d12_u03_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Findings that a classifier adds to those."""
    docs, found = _leftover(spark, sf)
    return gate.leftover(docs, found, _by_rule, "enterprise").select("doc_id", "raw", "start", "end", "score", "severity")


@query
def b36_suppression_reasons(spark: SparkSession, sf: str) -> DataFrame:
    out = detect.judged(view(spark, sf, "v_secret_lines"))
    return out.groupBy("source", F.coalesce("why", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


@query
def b38_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """Values on an allow-list are dropped before anything else."""
    out = detect.judged(view(spark, sf, "v_secret_lines"), detectors=("assignment",), allow=("Vault1!Horse", "Vault4!Horse"))
    return out.groupBy(F.coalesce("why", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


# ---- scalar tests


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_secret_lines").select("doc_id", F.expr("element_at(split(text, '[ =]'), -1)").alias("v"), F.regexp_extract("text", r"^([A-Za-z_]+)[=:]", 1).alias("k"))


@query
def b09_b12_token_features(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("doc_id", "v", F.expr(S.entropy(Q, "v")).alias("entropy"), F.expr(S.variety(Q, "v")).alias("variety"), F.expr(S.alphabet(Q, "v")).alias("alphabet"), F.expr(S.structured_secret(Q, "v")).alias("structured"))


@query
def b18_b28_key_tests(spark: SparkSession, sf: str) -> DataFrame:
    tests = {"key_type": S.key_type(Q, "k"), "normal": S.normal_key(Q, "k"), "compact": S.compact_key(Q, "k"), "safe": S.safe_key(Q, "k"), "exact": S.credential_key(Q, "k"), "inline_secret": S.inline_key(Q, "k"), "sensitive": S.sensitive_key(Q, "k"), "obfuscated": S.obfuscated_key(Q, "k"), "value_like": S.credential_value(Q, "v"), "provider": S.provider_token(Q, "k", "v"), "boost": S.key_boost(Q, "k", "v"), "db_uri": S.db_uri_key(Q, "k"), "connection": S.connection_key(Q, "k"), "prose_type": S.disclosure_type(Q, "k")}
    return _tokens(spark, sf).select("doc_id", *(F.expr(v).alias(k) for k, v in tests.items()))


@query
def b32_b39_value_tests(spark: SparkSession, sf: str) -> DataFrame:
    tests = {"template": S.template_value(Q, "v"), "example": S.example_like(Q, "v"), "marker": S.template_marker(Q, "v"), "host": S.example_host(Q, "v"), "token": S.has_token(Q, "v"), "clean": S.clean_token(Q, "v"), "benign": S.benign_composite(Q, "v"), "unquoted": S.unquoted(Q, "v")}
    return _tokens(spark, sf).select("doc_id", *(F.expr(v).alias(k) for k, v in tests.items()))


@query
def b13_b15_entropy_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_secret_lines").select("doc_id", F.expr("element_at(split(text, '[ =]'), -1)").alias("v"), "text").withColumn("b", F.expr("substr(text, 1, length(text) - length(v))")).withColumn("w", F.expr("lower(concat(right(b, 96), ' '))"))
    rows = rows.withColumn("ex", F.expr(S.explicit_context(Q, "b"))).withColumn("near", F.expr(S.secret_context(Q, "b", "w"))).withColumn("allowed", F.expr(S.entropy_allowed(Q, "v", "''"))).withColumn("reason", F.expr(S.entropy_reason(Q, "v", "ex", "near")))
    return rows.select("doc_id", "ex", "near", "allowed", "reason", F.expr(S.entropy_redact(Q, "v", "reason", "ex")).alias("redact"))


@query
def b04_f06_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = structured.line_rows(table(spark, sf, "documents"))
    return rows.select("doc_id", "line_no", "start", "end", F.md5("line").alias("line_md5"))


@query
def b05_line_column(spark: SparkSession, sf: str) -> DataFrame:
    """Line and column of each e-mail address in the documents."""
    found = table(spark, sf, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", "text", F.explode(spans.matches("text", detect.EMAIL, "i")).alias("m"))
    before = F.expr("substr(text, 1, m.start)")
    line = F.regexp_count(before, F.lit("\r\n|\r|\n")) + 1
    return found.select("doc_id", F.col("m.raw").alias("raw"), F.col("m.start").alias("start"), line.alias("line_no"), (F.length(F.element_at(F.split(before, "\r\n|\r|\n", -1), -1)) + 1).alias("col_no"))


@query
def b07_b08_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_secret_lines").select("doc_id", F.expr("lower(right(concat(text, ' '), 64))").alias("w"))
    return rows.select("doc_id", "w", F.expr(S.context_score(Q, "w")).alias("ctx"))


@query
def b16_b17_severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") % 140 - 20).alias("s"))
    return rows.withColumn("score", F.expr(S.bounded("s"))).select("o_orderkey", "score", F.expr(S.severity("score")).alias("severity"))


@query
def b48_b49_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of texts that hold current and older ones, canonical and in text."""
    old = F.concat("text", F.lit(" and [API_KEY_"), F.col("doc_id") % 50, F.lit("] [NET_1_SUB_2]"))
    rows = view(spark, sf, "v_secret_lines").select("doc_id", old.alias("text"))
    return rows.select("doc_id", F.concat_ws(",", vault.tokens_of("text")).alias("tokens"), vault.canonical_text("text").alias("canonical"))


# ---- reports


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return detect.judged(view(spark, sf, "v_secret_lines"), detectors=("registry", "assignment")).where("why is null").select("doc_id", "source", "start", "end", "raw", "score")


@query
def f07_f10_ids_and_places(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of vendor rules with an id, and where their tokens stand after replacement."""
    found = _found(spark, sf).where("source = 'registry'").select("doc_id", "start", "end", "raw").distinct()
    return report.shifted(report.numbered(found).withColumn("placeholder", F.concat(F.lit("["), F.upper("id"), F.lit("]"))))


@query
def d01_d02_d15_interval_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments that no vendor finding overlaps, that none of their length or more does, and that lie inside none."""
    found = _found(spark, sf)
    own, ranges = found.where("source = 'assignment'").drop("source"), found.where("source = 'registry'")
    kinds = {"overlap": report.outside(own, ranges), "longer": report.outside(own, ranges, longer=True), "inside": report.outside(own, ranges, inside=True)}
    out = [df.select(F.lit(k).alias("kind"), "doc_id", "start", "end") for k, df in kinds.items()]
    return out[0].union(out[1]).union(out[2])


@query
def g02_natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first tokens of each session in their natural order."""
    rows = view(spark, sf, "v_secret_lines").select("session_id", F.expr("concat(CASE doc_id % 4 WHEN 0 THEN '[PWM_' WHEN 1 THEN '[NET_' WHEN 2 THEN '[NET_1_SUB_' ELSE '[PUB_HOST_' END, doc_id % 30 + 1, ']')").alias("token")).distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(*report.natural("token")))).where("rank <= 8")


@query
def b53_g09_previews(spark: SparkSession, sf: str) -> DataFrame:
    """A short view around each e-mail address of the documents' lines."""
    lines = structured.line_rows(table(spark, sf, "documents")).where("contains(line, '@')")
    found = lines.select("doc_id", "line_no", "line", F.explode(spans.matches("line", detect.EMAIL, "i")).alias("m"))
    return found.select("doc_id", "line_no", F.col("m.start").alias("start"), report.preview(F.col("line"), F.col("m.start"), F.col("m.end") - F.col("m.start")).alias("preview"), F.length(report.short(F.col("line"), 100)).alias("n_short"))


@query
def r11_r15_trust_and_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens within what their session gave out, and policies that may be paused."""
    seen = vault.visible_tokens(view(spark, sf, "v_secret_lines"), ("session_id", "doc_id"))
    counts = seen.groupBy("session_id").agg((F.max("index") - 2).alias("n"))
    a = report.trusted_by_count(seen, counts).groupBy("session_id").agg(F.count_if("trusted").alias("n"), F.count("*").alias("of")).select(F.lit("trust").alias("kind"), F.col("session_id").alias("key"), "n", "of")
    rows = table(spark, sf, "customer").select((F.col("c_custkey") % 3 == 0).alias("enterprise"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 4 == 0).alias("allow_pause"), "c_nationkey")
    b = report.flags(rows).groupBy("c_nationkey").agg(F.count_if("pausable").alias("n"), F.count_if("enforced").alias("of")).select(F.lit("flags").alias("kind"), F.col("c_nationkey").cast("string").alias("key"), "n", "of")
    return a.union(b)


@query
def c12_c14_adjacent_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and halves of credentials on neighbouring lines, one kind a customer."""
    h = "md5(c_name)"
    texts = (
        f"concat('our api key for it:', chr(10), 'sk-proj-', {h})", f"concat('the sample api key:', chr(10), 'sk-proj-', {h})", f"concat('AWS Secret Access Key', chr(10), {h}, left({h}, 8))",
        f"concat('AWS Access Key ID', chr(10), '  AKIA', upper(left({h}, 16)))", f"concat('AKIA', upper(left({h}, 16)), chr(10), {h}, left({h}, 8), chr(10), 'end')", f"concat('AKIA', upper(left({h}, 16)), chr(10), chr(10), {h}, left({h}, 8))",
    )
    cases = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts))
    return structured.adjacent(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(f"CASE c_custkey % {len(texts)} {cases} END").alias("text")))


@query
def u07_sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Registered functions in a statement."""
    register(spark)
    return spark.sql("SELECT doc_id, shannon_entropy(text) AS entropy, char_variety(text) AS variety, token_alphabet(text) AS alphabet, context_score(text) AS ctx, type_of_key(text) AS key_type FROM {lines}", lines=view(spark, sf, "v_secret_lines"))


# ---- networks


def _nets(spark: SparkSession, sf: str) -> DataFrame:
    return network.tokens(view(spark, sf, "v_net_lines"), ("doc_id", "session_id", "seq"))


@query
def c41_d08_network_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _nets(spark, sf).drop("seq")


@query
def d09_closest_parent(spark: SparkSession, sf: str) -> DataFrame:
    nodes = settle(network.objects(network.in_mode(_nets(spark, sf), "hide_all")), "networks")
    return network.with_parents(nodes).select("session_id", "canonical", "prefix", "parent")


@query
def f08_network_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return network.placeholders(network.objects(network.in_mode(_nets(spark, sf))))


@query
def r04_network_modes(spark: SparkSession, sf: str) -> DataFrame:
    nets = _nets(spark, sf)
    parts = [network.in_mode(nets, m).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "kind", "n") for m in ("hide_public", "hide_all", "raw")]
    return parts[0].union(parts[1]).union(parts[2])


# ---- vault


def _secrets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = view(spark, sf, "v_secret_lines")
    found = detect.judged(docs, detectors=("registry",)).where("why is null")
    return docs, found.join(docs.select("doc_id", "session_id", F.col("seq").alias("place")), "doc_id").select("session_id", F.col("place").alias("seq"), "doc_id", "start", "raw", F.lit("PWM").alias("family"))


@query
def f01_f02_e05_vault(spark: SparkSession, sf: str) -> DataFrame:
    docs, found = _secrets(spark, sf)
    used = vault.counters(vault.visible_tokens(docs))
    return vault.number(found, used).drop("raw")


@query
def e05_counters(spark: SparkSession, sf: str) -> DataFrame:
    return vault.counters(vault.visible_tokens(view(spark, sf, "v_secret_lines")))


@query
def d04_trusted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs, found = _secrets(spark, sf)
    v, seen = vault.number(found), vault.visible_tokens(docs, ("session_id", "doc_id"))
    a = vault.trusted(seen, v).groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit("trusted").alias("kind"), "session_id", "n")
    return a.union(vault.untrusted(seen, v).groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("kind"), "session_id", "n"))


@query
def d05_reveal(spark: SparkSession, sf: str) -> DataFrame:
    docs, found = _secrets(spark, sf)
    seen = vault.visible_tokens(docs, ("session_id", "doc_id")).select("session_id", "doc_id", "token")
    return vault.reveal(seen, vault.number(found), F.col("session_id") != "s1")


@query
def d03_known_value_reuse(spark: SparkSession, sf: str) -> DataFrame:
    docs, found = _secrets(spark, sf)
    again = docs.select(F.col("doc_id"), "session_id", F.concat(F.lit("again: "), "text").alias("text"))
    return vault.reuse(again, vault.number(found)).select("doc_id", "session_id", "placeholder", "start", "end")


@query
def r10_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_secret_lines").select("doc_id", F.posexplode(vault.segments("text")).alias("part", "s"))
    return rows.select("doc_id", "part", "s.type", "s.value")


# ---- pipeline, reports, verification


@query
def r03_transform(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "v_secret_lines")
    return transform.transform(docs, rules=detect.REGISTRY, detectors=("registry", "email"))[0].select("doc_id", "session_id", "redacted", "n_replaced")


@query
def r07_transform_networks(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "v_net_lines")
    return transform.transform(docs, rules=(), detectors=("email",))[0].select("doc_id", "redacted", "n_replaced")


@query
def r02_redact_odd_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without an id, ids of several rows, rows without a session."""
    out, _ = transform.transform(view(spark, sf, "v_odd_rows"), "raw", detectors=("pattern", "registry", "email"))
    return out.select("session_id", "text", "redacted", "n_replaced")


@query
def r08_network_findings(spark: SparkSession, sf: str) -> DataFrame:
    return transform.network_findings(view(spark, sf, "v_net_lines")).select("doc_id", "type", "raw", "start", "end", "score", "severity")


@query
def flagship_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    out, _ = transform.transform(docs)
    return out.select("doc_id", "session_id", F.length("redacted").alias("n_chars"), "n_replaced", F.md5("redacted").alias("redacted_md5"))


@query
def e01_e02_report(spark: SparkSession, sf: str) -> DataFrame:
    out = transform.report(findings.scan(view(spark, sf, "v_secret_lines")))
    return out.select("doc_id", "findings", "high", "medium", "low", F.to_json("categories").alias("categories"))


@query
def r18_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return transform.sanitized(findings.scan(view(spark, sf, "v_secret_lines")))


@query
def r19_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written by a sink that loses some of the redaction, held against what was expected."""
    docs = view(spark, sf, "v_secret_lines")
    found = detect.judged(docs, detectors=("registry",)).where("why is null")
    sent = docs.select("doc_id", F.concat("text", F.lit("\n[PWM_7]\n\n\n\nend")).alias("redacted"))
    wrote = F.expr("CASE doc_id % 5 WHEN 0 THEN 'gone' WHEN 1 THEN redacted WHEN 2 THEN replace(redacted, chr(10), ' ') WHEN 3 THEN replace(redacted, chr(10), concat(chr(13), chr(10))) ELSE concat('[PWM_7] ', redacted) END")
    return verify.leaks(sent.withColumn("actual", wrote), found)


@query
def h04_h05_token_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_secret_lines").select("doc_id", "text", F.expr("concat('[PWM_', doc_id % 9 + 1, '] [PWM_2]')").alias("other"))
    return rows.select("doc_id", verify.same_tokens(F.col("text"), F.col("other")).alias("same"), verify.has_tokens(F.col("text"), F.col("other")).alias("subset"), F.size(verify.distinct_tokens(F.col("other"))).alias("n_tokens"))


# ---- policy and audit


@query
def d06_first_destination(spark: SparkSession, sf: str) -> DataFrame:
    return policy.first_match(view(spark, sf, "v_requests"), _list(spark, DESTINATIONS))


@query
def r14_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return policy.decide(view(spark, sf, "v_requests"), _list(spark, DESTINATIONS), _list(spark, APPROVED), _list(spark, BLOCKED))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    text = "CASE request_id % 3 WHEN 0 THEN concat('DB_PASSWORD=Vault', request_id % 40, '!Horse for it') WHEN 1 THEN concat('see ', url, ' as jane', request_id % 50, '@corp-mail.io') ELSE 'nothing to hide' END"
    return view(spark, sf, "v_requests").select("request_id", "session_id", "url", F.expr(text).alias("text"))


@query
def r16_served_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the requests that may go out, redacted."""
    return requests.serve(_requests(spark, sf), _list(spark, DESTINATIONS), _list(spark, APPROVED), _list(spark, BLOCKED), mode="raw").texts


@query
def r16_audit(spark: SparkSession, sf: str) -> DataFrame:
    """One audit row a request, blocked or redacted, without values."""
    out = requests.serve(_requests(spark, sf), _list(spark, DESTINATIONS), _list(spark, APPROVED), _list(spark, BLOCKED), mode="raw").audit
    return out.withColumn("finding_types", F.concat_ws(",", "finding_types"))


@query
def r14_block_and_approve(spark: SparkSession, sf: str) -> DataFrame:
    return policy.decide(view(spark, sf, "v_requests"), _list(spark, DESTINATIONS).where("false"), _list(spark, APPROVED), _list(spark, BLOCKED))


@query
def r17_origins(spark: SparkSession, sf: str) -> DataFrame:
    p = policy.url_parts()
    return view(spark, sf, "v_requests").select("request_id", p["origin"].alias("origin"), p["host"].alias("host"), p["path"].alias("path"))


@query
def r12_r13_policies(spark: SparkSession, sf: str) -> DataFrame:
    """One policy a customer, some of them wrong."""
    body = F.concat(F.lit('{"enterprise": '), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.lit(', "retention_days": '), (F.col("c_custkey") % 500).cast("string"), F.lit(', "default_action": "'), F.element_at(F.array(*map(F.lit, ("allow", "redact", "block", "drop"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit('"}'))
    out = policy.validated(table(spark, sf, "customer").select(F.col("c_custkey").alias("tenant"), body.alias("policy")))
    return out.withColumn("errors", F.concat_ws(",", "errors"))


@query
def h06_last_rule_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("pos"), F.col("event_type").alias("action"))
    return policy.last_wins(rows, ("site",), "pos")


@query
def h07_policy_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("tenant"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    own = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("tenant"), F.when(F.col("c_custkey") % 2 == 0, "own").alias("segment"), F.lit(99).alias("nation"))
    return policy.merged(base, own, ("segment", "nation"))


@query
def f12_pauses(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("until"))
    return policy.pauses(e, F.lit("2024-01-15 00:00:00").cast("timestamp"), 60)


@query
def e03_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.summary(view(spark, sf, "v_audit"), "tenant", "action")
    return out.withColumn("finding_types", F.concat_ws(",", "finding_types"))


@query
def f09_j06_audit_bound(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "v_audit")
    last = events.agg(F.max("ts").alias("now"))
    now = events.join(F.broadcast(last))
    return audit.bounded(now, F.col("now"), days=20, newest=5).select("event_id", "tenant", "rank")


@query
def j09_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return audit.windowed(view(spark, sf, "v_audit"), "6 hours", None, "action").drop("window_end")


@query
def j09_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return audit.windowed(view(spark, sf, "v_audit"), "6 hours", "3 hours", "action").drop("window_end")


@query
def j09_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return audit.sessions(view(spark, sf, "v_audit"), "4 hours", "tenant").select("tenant", "window_start", "n")


@query
def e14_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.latency(table(spark, sf, "events"), "value", "event_type")
    return out.withColumn("mean", F.round("mean", 6))


# ---- structured text


@query
def a10_f03_delimited(spark: SparkSession, sf: str) -> DataFrame:
    return structured.delimited(view(spark, sf, "v_kv_blocks"))


@query
def c03_metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    return structured.classified(structured.delimited(view(spark, sf, "v_kv_blocks"))).select("doc_id", "type", "value", "start", "end")


@query
def a13_f04_pairs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("Type: AWS-account\nValue: "), F.col("s_suppkey") + 100000000000, F.lit("\nplain\nValue: lost\nName: "), "s_name", F.lit("\n\nValue: far")).alias("text"))
    return structured.paired(docs)


@query
def d10_line_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lines of the corpus scanned once and joined back to each place."""
    lines = structured.line_rows(table(spark, sf, "documents"))
    once = lines.select("line").distinct()
    hits = once.select("line", F.size(spans.matches("line", detect.EMAIL, "i")).alias("n")).where("n > 0")
    return lines.join(hits, "line").groupBy("doc_id").agg(F.sum("n").alias("n_emails"), F.count("*").alias("n_lines"))


# ---- files


@query
def a03_a04_file_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("C:\\data/"), F.expr("element_at(array('a.TXT', '.env', 'Dockerfile', 'x.pdf', 'img.PNG', 'noext', '.bashrc', 'b.tar.gz', 'k.tfvars', 'end.'), cast(page_id % 10 + 1 as int))")).alias("path"))
    return files.classified(rows).select("page_id", "name", "extension", "family", "status")


@query
def a07_size_zones(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * 100).cast("long").alias("size"))
    return rows.groupBy(files.size_zone(F.col("size")).alias("zone")).agg(F.count("*").alias("n"))


@query
def a08_e16_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), (F.col("l_extendedprice") * 600).cast("long").alias("length"))
    return files.batches(rows)


@query
def a05_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: some with NULs, some with bytes that are no UTF-8."""
    content = F.expr("CASE doc_id % 4 WHEN 0 THEN cast(concat(text, repeat(chr(0), 4000)) as binary) WHEN 1 THEN concat(cast(text as binary), X'C328') ELSE cast(text as binary) END")
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.expr("concat('f', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.exe' ELSE '.txt' END)").alias("path"), content.alias("content"))
    return files.validated(rows.withColumn("length", F.octet_length("content"))).select("doc_id", "code")


# ---- boxes and evaluation


@query
def d13_span_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that each order's finding overlaps, merged; one low-confidence box fails the document."""
    boxes = view(spark, sf, "v_boxes")
    found = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 30).alias("start"), (F.col("o_orderkey") % 30 + 12).alias("end"))
    met = found.join(boxes, (boxes["doc_id"] == found["doc_id"]) & (F.col("box_start") < F.col("end")) & (F.col("box_end") > F.col("start")), "left").select(found["doc_id"], "start", "end", "x", "y", "width", "height", "confidence")
    out = met.groupBy("doc_id", "start", "end").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"), F.count("x").alias("n_boxes"), F.bool_or(F.col("confidence") == "low").alias("low"))
    return out.select("doc_id", "start", "left", "right", "n_boxes", F.when(F.col("n_boxes") == 0, "unmapped").when(F.col("low"), "low_confidence").otherwise("ok").alias("status"))


@query
def e06_e07_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.secret_rates(view(spark, sf, "v_eval"), "category", "source_type")


@query
def e08_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(view(spark, sf, "v_eval"))


@query
def e09_gates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gates(view(spark, sf, "v_eval"), {"SECRET": 0.98, "NOT_SECRET": 0.95, "UNSURE": 0.8})


@query
def e10_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(view(spark, sf, "v_eval"))


@query
def g08_error_samples(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.errors(view(spark, sf, "v_eval"))


@query
def e17_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.balanced_weights(view(spark, sf, "v_eval"))


# ---- metadata detectors, learning, chunks


def _metadata_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with headers, logins and cloud names, one a supplier and kind."""
    lines = (
        "concat('Authorization: Basic ', md5(s_name))", "concat('x-api-key: ', md5(s_name), ', ok')", "concat('clone https://bot', s_suppkey, ':pw', s_suppkey, 'x@git.acme.org/r')",
        "concat('open \\\\\\\\files', s_suppkey, '\\\\team$\\\\a now')", "concat('CN=svc', s_suppkey, ',OU=apps,DC=acme')", "concat('MSSQLSvc/db', s_suppkey, '.acme.org:1433')", "concat('arn:aws:iam::', 100000000000 + s_suppkey, ':role/r', s_suppkey)",
        "concat('aws account id: ', 100000000000 + s_suppkey)", "concat('see s3://bucket-', s_suppkey, '/k and gs://gb-', s_suppkey, '/k')", "concat('k8s namespace=prod-', s_suppkey)", "concat('host n', s_suppkey, '.eu.internal up')", "concat('ipv6=2001:db8::', s_suppkey)",
    )
    each = table(spark, sf, "supplier").select("s_suppkey", F.posexplode(F.array(*map(F.expr, lines))).alias("k", "text"))
    return each.select((F.col("s_suppkey") * 100 + F.col("k")).alias("doc_id"), "text")


@query
def c25_c40_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.scan(_metadata_lines(spark, sf))


@query
def c25_c40_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").union(table(spark, sf, "pages").select("page_id", "html")).union(_metadata_lines(spark, sf))
    return metadata.scan(docs).groupBy("detector", "type").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("n_raw"))


@query
def c09_c38_scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Identities, lone passwords, enterprise and cloud names in lines that each detector keeps or drops."""
    return scored.scan(view(spark, sf, "v_scored_lines"))


@query
def b40_b52_name_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of names, and the tests of lone passwords, paths and addresses, of the last word of each line."""
    words = view(spark, sf, "v_scored_lines").select("doc_id", "text", F.expr("element_at(split(text, ' '), -1)").alias("raw"))
    words = words.withColumn("before", F.expr("left(text, length(text) - length(raw))")).withColumn("after", F.lit(""))
    tests = {"parts": scored.token_score(Q, "raw"), "prefixed": scored.token_score(Q, "raw", True), "infra": scored.infrastructure(Q), "provider": scored.provider(Q), "person": scored.identity(Q), "path": scored.path_like(Q, "raw"), "lone": scored.bare_password(Q, "raw"), "ipv6": scored.ipv6(Q, "raw"), "gap": scored.ipv6(Q, "concat('2001:db8::', length(raw))")}
    return words.select("doc_id", *(F.expr(v).alias(k) for k, v in tests.items()))


@query
def l05_numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    return learn.numeric(spread(view(spark, sf, "v_secret_lines").select("doc_id", "text"))).select("doc_id", *learn.NUMERIC)


@query
def e12_e13_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return learn.vocabulary(spread(view(spark, sf, "v_secret_lines").select("text")))


@query
def l10_l11_upgrades(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with given verdicts, upgraded; and leftover candidates gated."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 100).cast("int").alias("score"), F.expr("element_at(array('SECRET', 'NOT_SECRET', 'UNSURE'), cast(o_custkey % 3 + 1 as int))").alias("risk"), ((F.col("o_orderkey") % 21) / 20).alias("confidence"))
    found = learn.upgraded(rows.withColumn("severity", F.expr(S.severity("score"))).withColumn("method", F.array(F.lit("pattern"))))
    a = found.select("doc_id", F.lit("upgrade").alias("flow"), "score", "severity", F.array_join("method", ",").alias("method"))
    b = learn.gated(rows.drop("severity"), "enterprise").select("doc_id", F.lit("gate").alias("flow"), "score", "severity", F.lit("").alias("method"))
    return a.unionByName(b)


@query
def l07_l09_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Trained on lines whose label follows from their kind, applied to the held-out lines; counts by label and verdict."""
    lines = view(spark, sf, "v_secret_lines").select("doc_id", "text", F.expr("CASE WHEN doc_id % 12 IN (7, 8, 11) THEN 'NOT_SECRET' WHEN doc_id % 12 = 9 THEN 'UNSURE' ELSE 'SECRET' END").alias("label"))
    train, test = learn.split(spread(lines))
    return learn.predict(learn.train(train), test).groupBy("label", "risk").agg(F.count("*").alias("n"))


@query
def j01_chunked_spans(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses of documents that come in chunks of 512 characters: the same as in whole texts."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("stream_id"), "text")
    parts = chunks.with_overlap(chunks.chunked(docs, 512), 256)
    found = parts.select("*", F.explode(spans.matches("text", detect.EMAIL, "i")).alias("m")).select("stream_id", "at", "own", "text_at", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.raw").alias("raw"))
    return chunks.owned(found).select("stream_id", "start", "end", "raw")


@query
def j03_stream_status(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("stream_id"), "text")
    return chunks.stream_status(chunks.chunked(docs, 4096))


# ---- more structured text, joins of findings, sites


@query
def a11_pipe_tables(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("| Type | Value | Notes |\n|---|:---:|---|\n| AWS account | "), F.col("s_suppkey") + 100000000000, F.lit(" | x |\n| e-mail | "), "s_name", F.lit(" | |"))
    return structured.piped(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))).select("doc_id", "label", "value", "start")


@query
def a12_json_objects(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('log {"Type": "tenant_id", "Value": "'), F.md5("s_name"), F.lit('"} and {"other": 1} and {"value":"'), "s_name", F.lit('","name":"Owner"}'))
    return structured.json_objects(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))


@query
def a09_html_rows(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("<table><TR><th>Name</th><th>Value</th></TR>\n<tr><td><b>Tenant&amp;Co</b></td><td>"), "s_name", F.lit(" &lt;x&gt;</td></tr><tr><td>empty</td><td> </td></tr></table>"))
    return structured.html_rows(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))


@query
def d11_h03_merged_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of two scans, one for each (document, start, end, raw), the first scan's where both have it."""
    docs = view(spark, sf, "v_secret_lines")
    scans = [detect.judged(docs, detectors=d).where("why is null").select("doc_id", "start", "end", "raw", F.lit(k).alias("scan"), "score") for k, d in enumerate((("registry", "email"), ("pattern", "registry", "assignment")))]
    both = scans[0].unionByName(scans[1])
    return both.groupBy("doc_id", "start", "end", "raw").agg(F.min("scan").alias("scan"), F.max(F.struct(-F.col("scan"), "score"))["score"].alias("score"))


@query
def d14_site_status(spark: SparkSession, sf: str) -> DataFrame:
    """Origin of each request, whether a built-in or else a user rule protects it."""
    p = policy.url_parts()
    asked = view(spark, sf, "v_requests").select("request_id", p["origin"].alias("origin"))
    known = asked.where("origin <> ''").groupBy("origin").agg(F.min("request_id").alias("first"))
    builtin = known.where("first % 3 = 0").select("origin", F.lit("builtin").alias("b"))
    user = known.where("first % 2 = 0").select("origin", F.lit("user").alias("u"))
    return asked.join(builtin, "origin", "left").join(user, "origin", "left").select("request_id", "origin", F.coalesce("b", "u", F.lit("none")).alias("status"))
