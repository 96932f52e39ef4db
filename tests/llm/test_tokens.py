"""Wavelet matrices against plain arrays, and the token files against the tokenizer."""

import zlib

import numpy as np
import pytest

from shroud.llm import tokens
from shroud.llm.queries import op12_token_files

from .test_operators import ODD, SCHEMA


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 1), (1, 40_000), (511, 7), (512, 49_407), (513, 2), (5_000, 49_407), (20_000, 3)])
def test_matrix(n, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), most).astype(np.uint32)
    shard = tokens.Shard.from_bytes(tokens.Shard(np.zeros(1, np.int64), np.zeros(1, bool), np.array([0, n]), tokens.Matrix.of(ids)).to_bytes())
    m = shard.matrix
    assert (m.decode() == ids).all() and m.n == n
    at = rng.integers(0, n, 300) if n else np.zeros(0, np.int64)
    assert (m.access(at) == ids[at]).all()
    for t in {0, 1, 2, most, most + 1, 1 << 20}:
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(t) == (ids == t).sum() and m.count(t, a, b) == (ids[a:b] == t).sum()
        assert (m.locate(t) == np.flatnonzero(ids == t)).all() and (m.locate(t, a, b) == np.flatnonzero(ids[a:b] == t) + a).all()


def plain(rows):
    """Rows of the contract, by the tokenizer alone."""
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(tokens.tokenizer_path()), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(op12_token_files(spark, sf_dir)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_small_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    files = tokens.write(docs, shard=3_000)
    want = plain(rows)
    assert files.count() > 20 and got(tokens.documents(files)) == want
    assert got(tokens.documents(files).join(tokens.starts(files, group=2).groupBy().count().drop("count"))) == want
    ids = {r.doc_id: r.ids for r in tokens.read(files).collect()}
    assert {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids.items()} == {d: (n, c) for d, _, n, c in want}
    flat = [t for x in ids.values() for t in x]
    assert {r.token: r.n for r in tokens.counts(files, [2, 267, 320, 60_000]).collect()} == {t: flat.count(t) for t in (2, 267, 320, 60_000)}
    places = sorted((r.doc_id, r.place) for r in tokens.occurrences(files, 267).collect())
    assert places == sorted((d, k) for d, x in ids.items() for k, t in enumerate(x) if t == 267)
    firsts = [sorted((r.part, r.shard, r.first) for r in tokens.starts(files, group).collect()) for group in (1, 2, 1000)]
    assert firsts[0] == firsts[1] == firsts[2]


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert got(tokens.documents(tokens.write(odd))) == plain([(r[1], r[2]) for r in ODD])
    assert got(tokens.documents(tokens.write(odd.limit(0)))) == []
    texts = [
        "It's  HERE,don't stop  now #1 ## <|endoftext|>x<|startoftext|> y", "<|startoftext|>", "é ́a İI ΣΑΣ Ａ\tß\x1c\x85z", "日本語 テキスト 12345 ½ 👍🏽 a‍b", "�퟿ \U0010ffff", " ", "'s 't'll",
        "x" * 5_000 + " " + "no space " * 20_000,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert got(tokens.documents(tokens.write(df))) == plain(list(enumerate(texts)))
