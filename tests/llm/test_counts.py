"""Token counts against the libraries."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import counts

TEXTS = [
    "", " ", "  \n\n\t x", "Hello world, it's 1234567 o'clock", "naïve café 東京タワー 😀😀", "<|endoftext|>a<|endoftext|> <|startoftext|>",
    "a" * 5000, " " * 3000 + "b", "!?" * 900, "é" * 700, "x\x00y\x7f▁z", "﻿​  　 end", "ÀÉ ß ﬁ ① Ⅳ",
]


def texts(n=200):
    r = random.Random(4)
    alphabet = "aaaabcdeEFt  \n'’.,-019éßд中😀<|>"
    return TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_tokenizers(name):
    path = str(public_tokenizers.path(name))
    own, library = counts.counter(path), Tokenizer.from_file(path)
    for t in texts():
        assert own(t) == len(library.encode(t, add_special_tokens=False).ids), t[:80]


def test_counts_equal_sentencepiece():
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    own, library = counts.counter(path), SentencePieceProcessor(model_file=path)
    for t in texts():
        assert own(t) == len(library.encode(t)), t[:80]


def test_merges_take_least_rank_then_leftmost():
    pairs = {("a", "a"): (0, "aa"), ("aa", "a"): (1, "aaa"), ("b", "aa"): (2, "baa")}
    assert counts.merged(list("aaaaa"), pairs) == ["aa", "aaa"]
    assert counts.merged(list("baab"), pairs) == ["baa", "b"]
    assert counts.merged([], pairs) == [] and counts.merged(["b"], pairs) == ["b"]


def test_table_rules(spark, rows):
    long = "word " * 30000
    data = [(1, None, 7), (2, "", 7), (None, "hi there", 8), (2, "", 7), (3, long, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens int")
    out = counts.count_tokens(docs, limit=1)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    found = rows(out.select("doc_id", "n_bytes", "n_tokens", "over_limit"))
    assert found == [(None, 8, 2, True), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 150000, 30001, True)]
    assert out.where("text is null").count() == 1
    assert counts.count_tokens(docs.limit(0)).count() == 0
