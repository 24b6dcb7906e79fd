"""Byte n-gram model against plain Python, and what byte classes cannot tell apart."""

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_quality import folds

import corpus_pipeline
from tidemark.llm import ngrams, queries


def symbols(text, order=4):
    return [*[0] * (order - 1), *re.sub("[0-9]", "0", text).encode()]


def brute_model(texts, order=4):
    """Probability function of an interpolated modified Kneser-Ney model over tuples of bytes."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = symbols(t, order)
        counts[order].update(tuple(s[i: i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    stats = {}
    for n in range(1, order + 1):
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
            return 1 / 256
        d, total, left = stats[len(g)]
        if not total.get(g[:-1]):
            return p(g[1:])
        k = counts[len(g)].get(g, 0)
        return ((k - d[min(k, 3) - 1] if k else 0) + left[g[:-1]] * p(g[1:])) / total[g[:-1]]

    return p


def surprise(p, text):
    s = symbols(text)
    return np.mean([-math.log(p(tuple(s[i - 3: i + 1]))) for i in range(3, len(s))])


def test_against_brute_force(spark):
    texts = ["The cat sat on the mat. 12 cats!", "a cat, a hat and a bat", "\u00e9t\u00e9 \u00e0 la mer", "x", "more cats on mats", "the end, at last", "", None,
             "The cats of 1999. " * 30_000]  # read in parts
    rows = [*enumerate(texts), (None, "no key"), (2, "again the cat")]
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in rows], "doc_id long, text string, lang string, surprise long")
    labels = spark.createDataFrame([(i, 1, int(i == 3)) for i in range(9)], "doc_id long, quality int, toxic int")
    fold = folds(spark, range(9))
    p = {f: brute_model([t or "" for i, t in rows if i not in (3, None) and fold[i] != f]) for f in (0, 1)}
    out = ngrams.judge(docs, labels)
    assert out.columns == [*docs.columns, "n_symbols", "perplexity", "deviation", "kept"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text, r.surprise) for r in got), key=str) == sorted(((i, t, i) for i, t in rows), key=str)
    for r in got:
        assert r.n_symbols == len((r.text or "").encode())
        if not r.text:
            assert r.kept and r.perplexity is None
        elif r.doc_id is not None:
            assert math.log(r.perplexity) == pytest.approx(surprise(p[fold[r.doc_id]], r.text[:18 * 500]), rel=1e-9 if r.doc_id < 8 else 1e-3)
    assert ngrams.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept and r.perplexity is None for r in ngrams.judge(docs, labels.limit(0)).collect())


def prose_and_junk(spark, folder):
    """Tables of Cyrillic words, and of random letters under keys from 100 on: runs of one byte class both."""
    rnd = np.random.default_rng(4)
    words = ["\u0434\u043e\u043c", "\u0440\u0435\u043a\u0430", "\u043b\u0435\u0441", "\u043c\u043e\u0440\u0435", "\u0433\u043e\u0440\u0430"]
    letters = [chr(c) for c in range(0x430, 0x450)]
    rows = [(i, " ".join(rnd.choice(words, 40)), "ru") for i in range(60)]
    junk = [(100 + i, "".join(c if c == " " else str(rnd.choice(letters)) for c in rows[i][1]), "ru") for i in range(5)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_words_beyond_ascii_are_learned(spark, tmp_path):
    prose_and_junk(spark, tmp_path)
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == 65 and not any(got[100 + i].kept for i in range(5)) and sum(got[i].kept for i in range(60)) >= 57


def test_pipeline_stage_learns_words(spark, tmp_path):
    prose_and_junk(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()}
    assert max(kept) < 100 and len(kept) >= 57


def random_words(spark, folder, n=3000, size=1000):
    """Texts that pack badly and yet have few n-grams; returns their bytes."""
    rnd = np.random.default_rng(9)
    rows = [(i, bytes(rnd.choice(np.frombuffer(b"abcdefgh ", np.uint8), size)).decode(), "en") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return n * size


def test_texts_are_shuffled_once_and_not_stored(spark, tmp_path, monkeypatch, capsys):
    size = random_words(spark, tmp_path)
    kept, cut = [], ngrams.cut

    def watched(df):
        kept.append(df)
        return cut(df)

    monkeypatch.setattr(ngrams, "cut", watched)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    out = queries.op9_quality_classifier(spark, str(tmp_path))
    assert sum(p.stat().st_size for p in shared.rglob("*") if p.is_file()) - before < 0.4 * size
    scored = next(df for df in kept if "surprise" in df.columns and "rows" in df.columns)
    capsys.readouterr()
    scored.explain()
    told = capsys.readouterr().out.split("Initial Plan")[0]
    assert "isFinalPlan=true" in told and "ReusedExchange" in told
    assert out.count() == 3000 and out.where("perplexity is null or n_symbols <> 1000").count() == 0


def test_with_and_without_texts(spark, tmp_path):
    random_words(spark, tmp_path, 80, 200)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, "en"), (7, "", None)], docs.schema))
    whole, narrow = ngrams.judge(docs, labels), ngrams.judge(docs, labels, with_text=False)
    assert narrow.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(str, whole.drop("text").collect())) == sorted(map(str, narrow.collect()))
    assert sorted(map(str, whole.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert ngrams.judge(docs, labels.limit(0), with_text=False).columns == narrow.columns


def test_answers_to_other_questions_are_an_error():
    rows = pa.RecordBatch.from_pydict({"doc": [1], "fold": [0], "text": ["abcd"]})
    (_, key), = ngrams._slabs([rows])
    asked = ngrams._blob(pa.RecordBatch.from_pydict({"key": np.diff(key, prepend=0)}))

    def scored(keys):
        told = {"rows": [ngrams._blob(rows)], "asked": [asked], "keys": [keys], "surprises": [keys and [1.0] * len(keys)]}
        types = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(told.values(), types)], [*told])
        return next(ngrams._scored([batch], ["doc"]))

    assert scored(key.tolist()[::-1]).column("surprise").to_pylist() == [[1.0]]
    for wrong in (key.tolist()[1:], [*key.tolist(), 5], None):
        with pytest.raises(ValueError, match="answers"):
            scored(wrong)


def test_limits_at_the_stated_rate(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kind = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("trusted")
    rows = ngrams.judge(docs.select("doc_id", "text", "lang"), labels).join(labels.select("doc_id", kind.alias("kind")), "doc_id")
    share = {r.kind: r.share for r in rows.groupBy("kind").agg(F.avg((~F.col("kept")).cast("int")).alias("share")).collect()}
    assert 0 < share["trusted"] < 0.005 and share["poor"] > 0.955 and share["toxic"] > 0.45
