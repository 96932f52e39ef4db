"""Spelling variants against all pairs compared, with partitions of every size."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from shroud.llm import variants
from shroud.llm.queries import op13_spelling_variants

from .test_operators import ODD, SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether two different words are one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def neighbours(words):
    """The near words of each word, by trying every deletion."""
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    out = {w: set() for w in words}
    for (head, tail), same in holes.items():
        for a, b in itertools.permutations(same, 2):
            out[a].add(b)
        if head + tail in out:
            for a in same:
                out[a].add(head + tail)
                out[head + tail].add(a)
    return out


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2 and len(w) >= 7}
    around, form = neighbours(n), {}
    for w, found in around.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, root(w), n[w], len(around[w]), form[w] and n[form[w]], form[w]) for w in n)


def got(df):
    return sorted((r.word, r.root, r.n, r.n_near, r.form_n, r.form) for r in df.collect())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(x[5] for x in want) and got(op13_spelling_variants(spark, sf_dir)) == want


def sample(rng):
    """Words with few letters, so that many are near, some long and some of repeated letters."""
    words = {"".join(rng.choices("abé÷", k=rng.choice([7, 7, 8, 9, 10]))) for _ in range(1_500)}
    words |= {"a" * k for k in range(7, 40)} | {"ab" * 300 + x for x in ("", "a", "b", "bb")} | {"z" * 9_000, "z" * 9_001, "z" * 4_000 + "y" + "z" * 5_000}
    return sorted(words)


@pytest.mark.parametrize("bound", [20_000, 300, 40, 3])
def test_pairs_at_every_bound(spark, bound):
    words = sample(random.Random(7))
    want = {(a, b) for a, found in neighbours(words).items() for b in found if a < b}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    parts = variants.partitions(df, bound=bound)
    if bound == 40:
        # what still is large can't be parted: one open place
        assert all(r["s"] > 0 and min(r["hi"], r["s"] + 1) - r["a"] <= 1 for r in parts.groupBy("s", "a", "hi", "b", "key").count().where(f"count > {bound}").collect())
    found = [tuple(sorted((r.word, r.near))) for r in variants.near_pairs(df, bound=bound).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_composition_alone():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(120)})
    acceptor = variants.Acceptor(words)
    left, right = acceptor.pairs(1 << 30)
    found = [tuple(sorted((words[i], words[j]))) for i, j in zip(left, right)]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)}
    # minimal: one state for each distinct set of rests
    rests = {tuple(sorted(w[k:] for w in words if w.startswith(p))) for p0 in words for k in range(len(p0) + 1) for p in [p0[:k]]}
    assert len(acceptor.arcs) == len(rests)
    left, right = acceptor.pairs(2)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert {tuple(sorted((words[i], words[j]))) for i, j in zip(left, right)} == {p for p in found if shared(*p) < 2}


def test_chains_and_ties(spark):
    counts = {"gardene": 1, "gardener": 10, "gardeners": 100, "garxeners": 100, "lonelyw": 5, "tiedone": 3, "tiedona": 30, "tiedonb": 30, "tiedonz": 29}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: (r.form, r.form_n, r.root, r.n_near) for r in variants.forms(df).collect()}
    assert found["gardene"] == ("gardener", 10, "gardeners", 1) and found["gardener"] == ("gardeners", 100, "gardeners", 2)
    assert found["gardeners"] == (None, None, "gardeners", 2) and found["lonelyw"] == (None, None, "lonelyw", 0)
    assert found["tiedone"] == ("tiedona", 30, "tiedona", 3)


def test_odd_rows(spark):
    texts = ["Wonderful wonderful WONDERFUL wonderfull wonderfull Àèìòùáé àèìòùáé Àèìòùáé", "wonderful×÷ñ wonderful×÷ñ", "wonderful wonderfl wonderfl", "straße-straßen straßen_straßen", "日本語wonderful語", "x" * 30_000 + " " + "x" * 30_000]
    rows = [*ODD, *(("q", k, t, 0.0, "s") for k, t in enumerate(texts)), *(("q", 7, "wonderful day", 0.0, "s") for _ in range(60)), ("q", None, "wonderful ordinary ordinary", 0.0, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = variants.runs(df)
    words = variants.vocabulary(found.select(variants.planted(found).alias("word")))
    assert got(variants.forms(words)) == plain([(r[1], r[2]) for r in rows])
    assert got(variants.variants(df.limit(0))) == [] and len(got(variants.variants(df))) > 5
