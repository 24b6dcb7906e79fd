"""Repeated bytes and words against brute force."""

import hashlib
import random
import re

import pytest

from tidemark.llm import factors, suffixes


def brute_bytes(rows, width):
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            seen.setdefault(b[i: i + width], (d, i))
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i: i + width]] < (d, i):
                gone[i: i + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, width):
    seen, out = {}, {}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i: i + width]), d)
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i: i + width])] < d:
                gone[i: i + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(base)
            w = t.split(" ")
            a = r.randint(0, len(w))
            parts.append(r.choice([" ".join(w[a:]), t, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))]))
        rows.append((i * 3, r.choice([" ", "\n", "  "]).join(parts)))
    return [*rows, (1, None), (2, ""), (4, "a" * 700), (5, "ab " * 300), (7, "ab " * 300), (8, "\n \t")]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("batch", [7, 10000])
def test_bytes(spark, seed, batch):
    rows = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated_bytes(df, 100, 32).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("batch", [7, 10000])
def test_words(spark, seed, batch):
    rows = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = factors.remove_repeated_words(df, 50, 16).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, 50)
    for r in got:  # the kept text has the kept words
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest() == r.kept_sha256


def test_odd_tables(spark):
    rows = [(None, "x " * 60, "p"), (3, "x " * 60, "q"), (3, "x " * 60, "q"), (3, "other", "r"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    for f, left in ((suffixes.remove_repeated_bytes, "found"), (factors.remove_repeated_words, "found")):
        out = f(df)
        assert left in out.columns and out.count() == 5 and f(df.limit(0)).count() == 0
    got = sorted((str(r.doc_id), r.n_removed, r.found) for r in factors.remove_repeated_words(df).collect())
    assert got == [("3", 0, "r"), ("3", 60, "q"), ("3", 60, "q"), ("9", 0, None), ("None", 0, "p")]


def test_blocks_of_one_anchor_are_told_apart(spark, rows):
    """Two texts that share 32 bytes only, whose blocks once had equal 40-bit hashes."""
    one = "vthslifzxjljnnyqxjwfhknksdpgrqiuwtrjwothocuqfefbrjauwdiuuygmkpbzjorvghiohabcncmmtheiuaeqhzuehhzflphcrbuyueyrzvdntidfogco"
    two = "pfcfolvjdecxaeqymqzjaotjqqkhvlnrefcdeeemnhkvfefbrjauwdiuuygmkpbzjorvghiohabcxvwxvysngodfxrwwbnvnxtyhdwjqkzncfzbwclcjukkp"
    out = suffixes.remove_repeated_bytes(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"))
    assert rows(out, "doc_id", "n_removed") == [(1, 0), (2, 0)]
