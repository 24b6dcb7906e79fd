"""Alignment of two tokenizers against brute force."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import align, bpe

A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts(n=80):
    r = random.Random(9)
    words = ["unbelievable", "tokenisation", "é", "中文字", "😀", "12345", "  ", "\n", "<|endoftext|>", "</s>", "don't", "a", "the", "zzzzqqq"]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(n)]


def brute(rows):
    """Every contract column by comparing all ends and expanding every link."""
    a_own, b_own = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_own.encode_special_tokens = True
    names = bpe._byte_names()
    vocabulary = {i: bytes(names[c] for c in t) if i != 50256 else t.encode() for t, i in json.load(open(A))["model"]["vocab"].items()}
    docs = {}
    for d, text in rows:
        a, b = a_own.encode(" " + (text or ""), add_special_tokens=False).ids, b_own.encode(text or "")
        ab = [vocabulary[i] for i in a]
        bb = [bytes([int(b_own.id_to_piece(i)[3:5], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if text and b"".join(ab) == b"".join(bb) == (" " + text).encode():
            i = j = 0
            group, ends = ([], []), [0, 0]
            while i < len(a) or j < len(b):
                if ends[0] <= ends[1] and i < len(a):
                    group[0].append(a[i])
                    ends[0] += len(ab[i])
                    i += 1
                else:
                    group[1].append(b[j])
                    ends[1] += len(bb[j])
                    j += 1
                if ends[0] == ends[1]:
                    groups.append(group)
                    group = ([], [])
        else:
            a = b = []
        docs[d] = (a, b, groups, Counter((x, y) for p, q in groups for x in p for y in q))
    held = Counter(p for *_, links in docs.values() for p in links)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d, (a, b, groups, links) in docs.items():
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((d, len(a), len(b), len(groups), links.total(), sum(n for p, n in links.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def test_groups(monkeypatch):
    for window in (1 << 16, 2, 3):
        monkeypatch.setattr(align, "WINDOW", window)
        for a, b, sizes in (([1, 2, 3], [3, 1, 2], ([2, 1], [1, 2])), ([], [], ([], [])), ([4], [1, 1, 1, 1], ([1], [4])), ([2, 2, 9], [1, 3, 9], ([2, 1], [2, 1]))):
            assert tuple(x.tolist() for x in align.groups(np.cumsum(a), np.cumsum(b))) == sizes


def test_links_against_counter(monkeypatch):
    monkeypatch.setattr(align, "LINKS", 7)
    rows = pa.table({
        "a_ids": pa.array([[1, 1, 2], [], [5], [1, 2, 1, 2], [1, 2] * 20], pa.list_(pa.int32())), "b_ids": pa.array([[7, 7, 8], [], [9], [7, 8, 8], [7, 8, 8] * 10], pa.list_(pa.int32())),
        "a_sizes": pa.array([[2, 1], [], [1], [4], [40]], pa.list_(pa.int32())), "b_sizes": pa.array([[1, 2], [], [1], [3], [30]], pa.list_(pa.int32()))})
    got = Counter()
    for row, pair, n in align.links(rows.slice(0, 5)):
        for r, p, k in zip(row.tolist(), pair.tolist(), n.tolist(), strict=True):
            got[r, p >> 32, p & 0xFFFFFFFF] += k
    assert got == {(0, 1, 7): 2, (0, 2, 7): 1, (0, 2, 8): 1, (2, 5, 9): 1, (3, 1, 7): 2, (3, 1, 8): 4, (3, 2, 7): 2, (3, 2, 8): 4, **{(4, x, y): 200 * (y - 6) for x in (1, 2) for y in (7, 8)}}


def test_linked_against_brute_force(spark, rows):
    data = [(i, t) for i, t in enumerate([*texts(), None, "", " ", "x▁y", "a" * 3000, " " * 12000 + "b", "日" * 400, "!" * 999])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert rows(align.linked(docs), *COLS) == sorted(brute(data))


def test_blocks_split(spark, rows):
    data = [(i, t) for i, t in enumerate(texts(40))]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    assert rows(align.linked(docs, block=500), *COLS) == rows(align.linked(docs), *COLS)


def test_table_rules(spark, rows):
    docs = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (3, None, 2)], "doc_id long, text string, n_a int")
    out = align.linked(docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [r[1:5] for r in rows(out)] == [(2, 2, 2, 2), (2, 2, 2, 2), (0, 0, 0, 0)]
    assert [r.count_sum for r in out.orderBy("doc_id").collect()] == [4, 4, 0]
    assert align.linked(docs.limit(0)).count() == 0
    full = align.align(docs)
    assert full.columns == ["doc_id", "text", "n_a", "n_b", "a_ids", "b_ids", "a_sizes", "b_sizes"]
    assert full.where("text is null").first().a_ids == []


def test_same_ids_as_the_library():
    own, library = align.side(A), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    some = [*texts(), "!" * 300_000, "7" * 100_000, "\n" * 30_000 + "x", "a" * 100_000]
    assert [list(own.encode(t)) for t in some] == [library.encode(" " + t, add_special_tokens=False).ids for t in some]
