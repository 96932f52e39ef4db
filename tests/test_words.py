"""Tests behind the words that they need have the results that they have alone."""

from pyspark.sql import functions as F

from shroud.functions import words as W
from shroud.functions.dialect import SPARK as Q
from shroud.operators import detect, scored
from shroud.operators.matcher import matched
from shroud.operators.spans import fenced
from shroud.plans.views import view

TEXTS = (
    'password=exam"ple" and secret', "token: 'Zx91kfLq0aPw'", "api Zx91kfLq0aPwQ8rT key", "demo\nDB_PASSWORD=Vault12!Horse\nexample", "EXAMPLE: my password is Forest12!x", "see Key pwd=Zx91kfLq0aPw", "password=[PWM_3]x", "client_secret= `Qx 81 Zz`",
    "mail a.b@corp-mail.io to the sample", "region eu " + "x" * 700 + " token=Zx91kfLq0aPwQ8rT " + "y" * 700 + " template", "postgres://app:Pw12x!9@example.com:5432/app", "postgres://app:Pw12x!9@db.corp:5432/app", "SECRET\tZx91kfLq0aPwQ8rTyU3m", "replace_me token=replace-me-Zx91", 'token="changeme1" policy',
)


def test_judged_as_without_words(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(2)
    found = detect.candidates(docs)
    plain = found.drop("words").withColumn("_rule", detect._rule_columns(detect.RULES))
    plain = plain.withColumns({k: F.col(f"_rule.{k}") for k in detect.RULE_COLUMNS})
    for step in detect.score_steps(Q):
        plain = fenced(plain.withColumns({k: F.expr(v) for k, v in step.items()}))
    plain = fenced(plain.withColumn("why", F.expr(detect.suppress_sql(Q))))
    columns = ["doc_id", "source", "name", "type", "raw", "start", "end", "score", "severity", "method", "why"]
    got, expected = (sorted(map(repr, df.select(*columns).collect())) for df in (detect.judge(found), plain))
    assert got == expected
    assert len(got) > 20


def test_words_of_a_line():
    held = W.held("our api zx key")
    assert held & W.of("api key") == W.of("api key")
    assert not held & W.FALSE and held & W.SECRET
    assert not W.held("plain text") & (W.FALSE | W.SECRET | W.EXAMPLE)


def test_entropy_is_found_once():
    """Steps behind the entropy found it again, up to six times a candidate."""
    steps = detect.quick_steps()
    assert not any("log2" in v for step in steps[2:] for v in step.values())
    assert "log2" not in detect.known(detect.suppress_sql(Q))


def _lines(spark, sf_dir):
    own = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for k, name in enumerate(("v_scored_lines", "v_login_lines", "v_assigned_lines", "v_rule_lines")):
        own = own.union(view(spark, sf_dir, name).where("doc_id < 400").selectExpr(f"doc_id * 4 + {k}", "text"))
    return own.repartition(4)


def test_scored_as_without_words(spark, sf_dir):
    """Steps behind words and the rows left out by their key, value or line keep what plain steps keep of all rows."""
    docs, some = _lines(spark, sf_dir), scored.DETECTORS
    plain = matched(docs, scored.entries(some)).drop("words").withColumnRenamed("raw", "found")
    worth = " OR ".join(f"(rule = {k} AND NOT {Q.test('found', d.worth)})" for k, d in enumerate(some) if d.worth)
    plain = plain.where(f"NOT ({worth})")
    for step in scored.steps(Q, some):
        plain = fenced(plain.withColumns({k: F.expr(v) for k, v in step.items()}))
    plain = plain.where("kept AND points >= least").withColumns({"start": F.col("from_").cast("int"), "end": F.col("to_").cast("int")})
    columns = ["doc_id", "id", "rule", "order", "type", "raw", "start", "end", "score", "severity", "method"]
    quick = scored.judge(matched(docs, scored.entries(some), quick=True), some)
    got, expected = (sorted(map(repr, df.select(*columns).collect())) for df in (quick, plain))
    assert got == expected
    assert len({r.split("id='")[1][:3] for r in got}) > 15


def test_rows_left_out_are_dropped_later(spark, sf_dir):
    """The scan judged each key and token of a line, most of which no test could keep."""
    docs = _lines(spark, sf_dir)
    kept = [detect.judge(detect.candidates(docs, quick=q)).where("why IS NULL").drop("seq") for q in (False, True)]
    kept[0] = kept[0].where(f"source <> 'entropy' OR {Q.test('raw', detect.NO_PLAIN_WORD, 'i')}")
    everything, quick = (sorted(map(repr, df.collect())) for df in kept)
    assert everything == quick
    line = spark.createDataFrame([(1, "request_id=abcdefgh12 plain_name: value12345 aaaaaaaa1 1111111112")], "doc_id long, text string")
    assert matched(line, [*detect.entries(), *scored.entries(scored.DETECTORS)], quick=True).where("source = 'entropy' OR rule IN (7, 30)").count() == 0
