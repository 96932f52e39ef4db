"""The pipeline against a plain version of each stage."""

import re

import corpus_pipeline
from shroud.llm import decontam, packing, pii, quality
from shroud.llm.queries import PII_KEY

from .test_near_dedup import brute
from .test_operators import brute_contamination, check_packing


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    good = {r.doc_id: r.text for r in quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).where("predicted = 1").collect()}
    same = brute([(i, re.sub(r"[\t\n\v\f\r]", " ", t or "")) for i, t in good.items()], size=5)
    single = {i: t for i, t in good.items() if same[i][1] == i}
    clean = {i: t for (i, t), x in zip(single.items(), brute_contamination(single.values(), bench)) if not x[4]}
    hidden = {i: pii.Cipher(PII_KEY.encode()).text(t)[0] for i, t in clean.items()}
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(hidden)
    check_packing(out, hidden)
    assert 0 < len(clean) < len(single) <= len(good) < docs.count()


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and decontam.WINDOW == 13 and packing.CAPACITY == 2048
