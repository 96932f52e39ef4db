"""Steps whose work may grow no faster than their input, and whole jobs of queries."""

import random

from pyspark.sql import functions as F

from shroud.functions import scalars as S
from shroud.functions.dialect import SPARK as Q
from shroud.operators import learn, network, vault
from shroud.plans.queries import QUERIES
from shroud.plans.views import view


def test_occurrences_over_pieces_and_blocks(spark, monkeypatch):
    """Texts and values of a session meet in many groups; places of one value don't overlap, values may."""
    monkeypatch.setattr(vault, "BLOCK", 40)
    monkeypatch.setattr(vault, "PIECE", 60)
    rng = random.Random(7)
    sessions = ["a", "b", None]
    values = [(s, "".join(rng.choice("xyé") for _ in range(rng.choice([8, 9, 12]))), f"[PWM_{k}]", k) for k in range(60) for s in sessions[k % 3 :][:1]]
    values += [("a", "xyxyxyxy", "[PWM_900]", 900), ("a", "xyxyxyxy", "[NET_1]", 1), ("a", "short", "[PWM_901]", 901), ("a", "PWM_7777", "[PWM_902]", 902)]
    held = [v[1] for v in values]
    texts = [(k, sessions[k % 3], rng.choice(held) + "".join(rng.choice("xyé ") for _ in range(20)) + rng.choice(held)) for k in range(90)]
    texts += [(900, "a", "xyxyxyxyxyxyxyxy xyxyxyxy://h [PWM_7777]"), (901, "a", None), (902, "c", held[0])]
    df = spark.createDataFrame(texts, "doc_id long, session_id string, text string")
    got = sorted((r.doc_id, r.raw, r.placeholder, r.start, r.end) for r in vault.occurrences(df, spark.createDataFrame(values, "session_id string, raw string, placeholder string, index long")).collect())
    expected = []
    for doc, session, text in texts:
        for s, raw, placeholder, _ in values:
            at = text.find(raw) if text is not None and s == session and len(raw) >= 8 else -1
            while at >= 0:
                if not text.startswith("://", at + len(raw)) and raw != "PWM_7777":
                    expected.append((doc, raw, placeholder, at, at + len(raw)))
                at = text.find(raw, at + len(raw))
    assert got == sorted(expected)
    assert len(got) > 50


def test_entropy_splits_a_value_once():
    """It split the value four times for each of its characters before."""
    sql = S.entropy(Q, "v")
    assert sql.count("split(") + sql.count("regexp_extract_all(") == 1


def test_entropy_of_odd_values(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("aé😀\n",), (None,)], "v string")
    assert [r[0] for r in df.select(F.expr(S.entropy(Q, "v"))).collect()] == [0.0, 0.0, 1.0, 2.0, None]


def test_metadata_queries_find_headers_and_logins(spark, sf_dir):
    """Their SQL and code had lost four kinds."""
    got = {(r.detector, r.type) for r in QUERIES["c25_c40_metadata"](spark, sf_dir).select("detector", "type").distinct().collect()}
    assert {("C01", "TOKEN"), ("C04", "PASSWORD"), ("C25", "FILE_SHARE"), ("C40", "INTERNAL_ENDPOINT")} <= got


def test_metadata_documents_count_headers_and_logins(spark, sf_dir):
    got = {(r.detector, r.type) for r in QUERIES["c25_c40_documents"](spark, sf_dir).collect()}
    assert {("C01", "TOKEN"), ("C04", "PASSWORD"), ("C25", "FILE_SHARE")} <= got


def test_classifier_finds_features_once(spark):
    """Each row's features were found again for the vocabulary, the summary and the regression, all of them in one task of a small file."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    records = learn.generated(spark, 300).withColumn("text", read.asNondeterministic()("text")).coalesce(1)
    model = learn.train(records)
    assert seen.value == 300
    words = learn.vocabulary(learn.generated(spark, 300)).collect()
    assert model.stages[1].vocabulary == [r.gram for r in words]


def test_small_tables_are_dealt_to_all_cores(spark, sf_dir):
    """One row group was one task for features and network tokens."""
    cores = spark.sparkContext.defaultParallelism
    nets = view(spark, sf_dir, "v_net_lines")
    assert nets.rdd.getNumPartitions() < cores
    assert network.tokens(nets).rdd.getNumPartitions() >= cores
    assert QUERIES["l05_numeric_features"](spark, sf_dir).rdd.getNumPartitions() >= cores


def test_tokens_that_entropy_drops_are_no_candidates(spark):
    """Hex without a label right before it, tokens of few bits and names with a short last part aren't handed to SQL; what is kept is the same."""
    from shroud.operators import detect, scored
    from shroud.operators.matcher import matched

    hexes, even = "0123456789abcdef" * 2, "0123456789abcdefghijklmnopqrstuvwxyz"
    texts = [f"password is {hexes}", f"redis near a {hexes}", f"secret {hexes[:24]}", f"secret {'ab12' * 8}", f"build {even}A", "build " + "1234klmnopqr" * 3, "token of 9qxz71mk28vb", "by jane.roe and jane.abcdefghi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = matched(df, [*detect.entries((), ("entropy",)), *scored.entries(tuple(d for d in scored.DETECTORS if d.id == "C34"))], quick=True).collect()
    assert sorted((r.doc_id, r.raw) for r in rows if r.source == "entropy") == [(0, hexes), (4, even + "A"), (6, "9qxz71mk28vb")]
    assert [(r.doc_id, r.raw) for r in rows if r.source == "scored"] == [(7, "jane.abcdefghi")]
    kept = lambda quick: {(r.doc_id, r.start, r.score) for r in detect.judged(df, detectors=("entropy",), quick=quick).where("why is null").collect()}
    assert kept(True) == kept(False) != set()
