"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(text):
    return np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist()


def test_mixed_texts(library):
    r = random.Random(1)
    pool = [chr(i) for i in [*range(1, 0x300), 0x85, 0x2028, 0x180E, 0x200B, 0x3000, 0xFEFF, 0x4E00, 0x1F600, 0x660, 0x2160]]
    words = ["the", "ing", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "aaaa", "%%%", "123", "été"]
    for _ in range(1500):
        s = "".join(r.choice(pool) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(0, 40)))
        assert ids(s) == library.encode(s, add_special_tokens=False).ids, s
        assert "".join(bpe.codec(PATH).decode([ids(s)])) == library.decode(ids(s), skip_special_tokens=False) == s


def test_long_pieces_stream(library):
    r = random.Random(2)
    for alphabet in ("ab", "theing", "aeiourstln", "=-", "a", "é", "ationing", "ABCdef"):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(3000, 9000)))
        assert ids(s) == library.encode(s, add_special_tokens=False).ids, alphabet


def test_long_texts_are_cut_where_pieces_end(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 17)
    r = random.Random(3)
    s = "".join(r.choice(["word", " ", "  ", "\n", " \t x", "123", "!!", "'s"]) for _ in range(2000))
    assert ids(s) == library.encode(s, add_special_tokens=False).ids


def test_emits_early_with_a_small_window():
    m = bpe.codec(PATH).merges
    fed, out = 0, m.transduce(iter_bytes := (b"ationing" for _ in range(10_000)))
    assert m.lookahead < 1000
    first = next(out)
    fed = sum(1 for _ in iter_bytes)
    assert first and fed > 9000  # most of the piece was still unread


def test_any_ids_decode(library):
    r = random.Random(4)
    for _ in range(200):
        x = [r.randrange(50257) for _ in range(20)]
        assert "".join(bpe.codec(PATH).decode([x[:7], x[7:]])) == library.decode(x, skip_special_tokens=False)


def test_lookahead_of_a_chain():
    # ab | bc | cd ...: a token's border can hang on bytes far to its right, one merge each
    tokens = {i: bytes([97 + i]) for i in range(8)} | {100 + i: bytes([97 + i, 98 + i]) for i in range(7)}
    m = bpe.Merges(tokens, [(i, i + 1, 100 + i) for i in reversed(range(7))])
    assert m.lookahead == 7
    for n in range(2, 9):
        text = bytes(range(97, 97 + n))
        assert list(m.transduce([text[i: i + 1] for i in range(n)])) == m.window(text)


def test_rows(spark, library):
    rows = [(1, "a text", "x"), (1, "a text", "y"), (None, None, None), (4, "", "z"), (5, "b<|endoftext|>", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert sorted(str(r.text) for r in bpe.decode(out.select("ids")).collect()) == sorted(r[1] or "" for r in rows)
    assert bpe.encode(df.limit(0)).count() == 0
