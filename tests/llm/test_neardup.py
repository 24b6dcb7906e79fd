"""Near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import graph, minhash, neardup


def brute(rows, size, share=(80, 100)):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and share[1] * both >= share[0] * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcDÉ") for _ in range(5)) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, " \n ")]
    d = 10
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 20, 80, 300]))]
        for _ in range(r.choice([1, 2, 20])):  # copies with few or many changes: chains and stars
            w = list(base)
            for i in range(len(w)):
                if r.random() < r.choice([0, 0.004, 0.02]):
                    w[i] = r.choice(vocabulary)
            if r.random() < 0.3:
                w += [r.choice(vocabulary) for _ in range(len(w) // 8)]
            rows.append((d, " ".join(w)))
            d += 7
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_groups(spark, seed, size):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicate_ids(df, size).collect()}
    assert got == brute(rows, size)


def test_copies_of_a_missing_base(spark):
    # all are near a base that comes last, few near each other
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    rows = [(10**6, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in r.sample(range(400), 20):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicate_ids(df, 4).collect()}
    assert got == brute(rows, 4)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", "p"), (7, "A b c d e f", "q"), (7, "A b c d e f", "q"), (8, "quite other words are here", None), (9, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long_".replace("long_", "string"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicate_ids(df).collect())
    assert got == [("7", 2, "None", False), ("7", 2, "None", False), ("8", 1, "8", True), ("9", 0, "9", True), ("None", 2, "None", True)]
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.component) for r in kept.collect()) == ["None", "p", "z"]
    assert neardup.near_duplicate_ids(df.limit(0)).count() == 0


def test_different_texts_of_one_document(spark):
    one, two, three = "a b c d e f", "k l m n o p", "q r s t u v"
    rows = [(3, one), (7, one), (7, two), (8, two), (9, three), (9, "x y z x y z"), (9, ""), (12, three), (20, ""), (20, one), (21, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicate_ids(df).collect()}
    assert got == {(3, 3, True), (7, 3, False), (8, 3, False), (9, 9, True), (12, 9, False), (20, 3, False), (21, 21, True)}
    kept = sorted((r.doc_id, r.text or "") for r in neardup.drop_near_duplicates(df).collect())
    assert kept == sorted([(3, one), (9, three), (9, "x y z x y z"), (9, ""), (21, "")])


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 320)] + [(5, r.randint(6, 90)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 200 for i in range(200, 321)) and {v for k, v in got.items() if k < 100} == {5}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_resemblance():
    r = np.random.default_rng(0)
    for share in (0.3, 0.8):
        found = []
        for _ in range(60):
            n, same = 500, int(1000 * share / (1 + share))
            v = r.integers(0, 2**63, 2 * n - same).astype(np.uint64)
            rows = np.concatenate([np.sort(v[:n]), np.sort(np.concatenate([v[:same], v[n:]]))])
            s = minhash.super_minhash(rows, np.array([0, n, 2 * n]), 112)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - share) < 0.02 and np.std(found) < (share * (1 - share) / 112) ** 0.5
