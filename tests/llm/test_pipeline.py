"""The pipeline against brute-force versions of its stages, and what is registered."""

import hashlib
import re

import numpy as np
import public_tokenizers
from test_neardup import brute
from test_repeats import brute_words
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


def test_all_eleven_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns

    quality, near, passages, clean, tokens = results.values()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([d in quality for d in good]) > 0.98 and np.mean([d in quality for d, r in labels.items() if r.quality == 0]) < 0.15

    groups = brute([(d, r.text) for d, r in quality.items()], 5)
    assert set(near) == {d for d, (_, _, kept) in groups.items() if kept} and len(near) < len(quality)

    want = brute_words([(d, r.text) for d, r in near.items()], 50)
    assert set(passages) == set(near)
    for d, r in passages.items():
        kept = " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert hashlib.sha256(kept.encode()).hexdigest() == want[d][2] and r.n_chars == len(r.text)
    assert any(w[1] for w in want.values())

    def words(t):
        return re.findall(r"[^\W\d_]+", t.lower())

    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = set()
    for d, r in passages.items():
        w = words(r.text)
        grams = {tuple(w[k: k + 5]) for k in range(len(w) - 4)}
        if any(np.mean([tuple(x[k: k + 5]) in grams for k in range(len(x) - 4)]) >= 0.5 for x in items):
            leaks.add(d)
    assert leaks and set(clean) == set(passages) - leaks

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert set(tokens) == set(clean)
    for r in tokens.values():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
