"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import runs


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least=6, exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digests(doc, words):
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    keep = [True] * len(words)
    for s, n, q in found:
        keep[s + q: s + n] = [False] * (n - q)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for w, k in zip(words, keep, strict=True) if k))]
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def plant(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def corpus(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < r.randint(0, 60):
            unit = [r.choice("abc") for _ in range(r.randint(1, 6))]
            words += unit * r.choice([1, 1, 2, 4, 5, 7]) + unit[: r.randint(0, len(unit))]
        out.append(words)
    return out


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (9, 3)])
def test_runs_against_brute_force(least, exponent):
    texts = corpus(1, 400) + [["a"] * 300, ["a", "b"] * 100 + ["a"], [], ["x"]] + [[r for r in "abaab" * 20]]
    hashes = np.array([ord(w) for t in texts for w in t], np.uint64)
    at = np.cumsum([0, *map(len, texts)])
    found = runs.find_runs(hashes, at, least, exponent)
    for i, t in enumerate(texts):
        assert found.get(i, []) == sorted(brute(t, least, exponent), key=lambda r: (r[0], r[2])), (i, t)


def test_suffix_array_and_prefixes():
    texts = corpus(2, 30)
    at = np.cumsum([0, *map(len, texts)])
    codes, doc, _ = runs.coded(np.array([ord(w) for t in texts for w in t], np.uint64), at)
    order, ranks = runs.suffix_array(codes, doc)
    ends = np.append(np.flatnonzero(codes < 0), len(codes))
    suffixes = [(doc[i], tuple(codes[i: ends[np.searchsorted(ends, i)] + 1])) for i in range(len(codes))]
    assert order.tolist() == sorted(range(len(codes)), key=suffixes.__getitem__)
    assert (ranks[-1][order] == np.arange(len(order))).all()
    for k, n in list(enumerate(runs.shared_prefixes(order, ranks)))[1:]:
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        same = 0
        while a[0] == b[0] and a[1][same] == b[1][same]:
            same += 1
        assert n == same


def test_long_and_hot_texts():
    n = 200_000
    words = np.zeros(n, np.uint64)
    assert runs.find_runs(words, np.array([0, n])) == {0: [(0, n, 1)]}
    unit = np.random.default_rng(1).integers(0, 1 << 40, 999).astype(np.uint64)
    assert runs.find_runs(np.tile(unit, 100), np.array([0, 99900])) == {0: [(0, 99900, 999)]}


def test_table_rules_and_query_digests(spark, rows):
    texts = [" ".join(t) for t in corpus(3, 120)] + [None, "", " \t ", "é é é\né é é é x", "a b\t" * 9]
    data = [(i * 7, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, start int")
    out = runs.run_digests(runs.planted(docs.select("doc_id", "text")))
    cols = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert rows(out, *cols) == rows(spark.createDataFrame(
        [digests(d, plant(d, split(t))) for d, t, _ in data],
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"), *cols)
    full = runs.collapse_runs(docs)
    assert full.columns == ["doc_id", "text", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    got = {r.doc_id: r for r in full.collect()}
    assert got[120 * 7].text is None and got[120 * 7].n_runs == 0 and got[120 * 7].collapsed == "" and got[120 * 7].start is None
    assert got[123 * 7].collapsed == "é x" and got[124 * 7].collapsed == "a b"
    assert full.limit(0).count() == 0
    twice = spark.createDataFrame([(None, "a a a a a a a"), (None, "a a a a a a a")], "doc_id long, text string")
    assert rows(runs.collapse_runs(twice), "n_runs", "length") == [(1, 7), (1, 7)]
