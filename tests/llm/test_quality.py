"""Kneser-Ney model against plain Python, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

FOLDER = "/root/testdata/sf0.01"


def brute_model(texts):
    """Probability function of an interpolated modified Kneser-Ney model over symbol tuples."""
    counts = [Counter() for _ in range(5)]
    for t in texts:
        s = [0, 0, 0, *(int(quality.CLASS[b]) for b in t.encode())]
        counts[4].update(tuple(s[i: i + 4]) for i in range(len(s) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    stats = {}
    for n in range(1, 5):
        c = Counter(counts[n].values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [i - (i + 1) * y * b / a if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d = [min(max(x, 0.05), i) for i, x in zip((1, 2, 3), d)]
        total, left = defaultdict(int), defaultdict(float)
        for g, k in counts[n].items():
            total[g[:-1]] += k
            left[g[:-1]] += d[min(k, 3) - 1]
        stats[n] = (d, total, left)

    def p(g):
        if not g:
            return 1 / 32
        d, total, left = stats[len(g)]
        if not total.get(g[:-1]):
            return p(g[1:])
        k = counts[len(g)].get(g, 0)
        return (max(k - d[min(k, 3) - 1], 0) if k else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def surprise(p, text):
    s = [0, 0, 0, *(int(quality.CLASS[b]) for b in text.encode())]
    return [-math.log(p(tuple(s[i - 3: i + 1]))) for i in range(3, len(s))]


def folds(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "doc long")
    return {r.doc: r.f for r in df.select("doc", quality.fold_of(F.col("doc")).alias("f")).collect()}


def test_model_is_kneser_ney(spark):
    texts = ["The cat sat on the mat. 12 cats!", "a cat, a hat and a bat", "été à la mer", "x", "more cats on mats", "the end, at last"]
    fold = folds(spark, range(6))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 3)) for i in range(6)], "doc_id long, quality int, toxic int")
    table = quality.train(docs, labels)
    p = {f: brute_model([t for i, t in enumerate(texts) if i != 3 and fold[i] != f]) for f in (0, 1)}
    for f in (0, 1):
        for g in [(0, 0, 0, 20), (20, 8, 5, 0), (0, 3, 1, 20), (27, 27, 27, 27), (31, 31, 0, 1), (9, 9, 9, 9)]:
            code = sum(x << (5 * (3 - i)) for i, x in enumerate(g))
            assert table[f, code] == pytest.approx(-math.log(p[f](g)), rel=1e-5)
    sums = np.exp(-table.astype(float)).reshape(-1, 32).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)  # every context is a distribution
    for r in quality.judge(docs, labels).collect():
        want = np.mean(surprise(p[fold[r.doc_id]], texts[r.doc_id]))
        assert r.n_symbols == len(texts[r.doc_id].encode()) and math.log(r.perplexity) == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 2 = 0")
    rows = quality.judge(docs, known).select("doc_id", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    poor = [not r.kept for r in rows if r.quality == 0]
    assert len(good) > 100 and np.mean(good) > 0.98
    assert len(poor) > 20 and np.mean(poor) > 0.85


def test_long_text_in_parts_and_odd_rows(spark):
    long = "The quick brown fox. " * 60_000
    rows = [(1, long, "en", "k"), (2, None, "en", None), (3, "", None, "k"), (None, "words and words", "xx", "k"), (2, "again the fox", "en", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, surprise string")
    fold = folds(spark, range(100, 200))
    more = [next(k for k in fold if fold[k] == f) for f in (0, 1)]
    docs = docs.unionByName(spark.createDataFrame([(k, "a fox is a fox " * 9, "en", "m") for k in more], docs.schema))
    labels = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (None, 1, 0), (9, None, None), *((k, 1, 0) for k in more)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    assert out.columns == ["doc_id", "text", "lang", "surprise", "n_symbols", "perplexity", "deviation", "kept"]
    got = out.collect()
    assert len(got) == 7 and all(r.kept and r.perplexity is None for r in got if not r.text)
    trained = [(1, long), (2, "again the fox"), *((k, "a fox is a fox " * 9) for k in more)]
    fold |= folds(spark, [1, 2])
    p = brute_model([t for k, t in trained if fold[k] != fold[1]])
    one = next(r for r in got if r.doc_id == 1)
    assert one.n_symbols == len(long) and math.log(one.perplexity) == pytest.approx(np.mean(surprise(p, long[:42_000])), rel=1e-3)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in quality.judge(docs, labels.limit(0)).collect())


def rejected(spark, folder="/root/testdata/sf0.1"):
    """Share of labelled documents rejected: trusted, poor and toxic ones (of good quality otherwise)."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kinds = labels.select("doc_id", F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("trusted").alias("kind"))
    rows = quality.judge(docs.select("doc_id", "text", "lang"), labels).join(kinds, "doc_id").groupBy("kind").agg(F.avg((~F.col("kept")).cast("int")).alias("share"))
    return {r.kind: r.share for r in rows.collect()}


def test_limits_at_the_stated_rate(spark):
    share = rejected(spark)
    assert 0 < share["trusted"] < 0.005 and share["poor"] > 0.955 and share["toxic"] > 0.45
