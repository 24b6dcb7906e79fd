"""Fingerprints against whole sets."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import sketch


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", ["1", "5", "64"])
def test_whole_texts_and_edits(spark, parts):
    r = random.Random(int(parts))
    words = [f"w{i}é" for i in range(400)]
    rows = [(i * 7 - 40, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40, 120, 900])))) for i in range(120)]
    rows += [(10_000 + i, rows[5][1]) for i in range(4)] + [(20_000, None), (-500, "")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {x.doc_id: x for x in sketch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        x = got[d]
        assert x.n_chars == n and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for have, other in ((x.near_edited, edited), (x.near_next, nxt)):
            want = likeness(shingle_set(t), shingle_set(other))
            assert abs(have - want) < (1e-9 if len(shingle_set(t) | shingle_set(other)) <= 256 else 0.15)
    assert len({got[10_000 + i].fingerprint for i in range(4)} | {got[rows[5][0]].fingerprint}) == 1


def test_estimates_and_merging():
    r = np.random.default_rng(1)
    whole = np.unique(r.integers(0, 2**48, 30_000).astype(np.uint64))
    r.shuffle(whole)
    a, b = whole[:20_000], whole[10_000:]
    sa, sb = sketch._least(a, 256), sketch._least(b, 256)
    assert list(sa) == sorted(a)[:256] and list(sketch.from_string(sketch.to_string(sa))) == list(sa)
    assert abs(sketch.resemblance(sa, sb) - 1 / 3) < 0.1 and abs(sketch.containment(sa, sb) - 0.5) < 0.12
    assert abs(sketch.distinct(sketch.merge(sa, sb)) / len(whole) - 1) < 0.2
    assert list(sketch.merge(sa, sb)) == sorted(whole)[:256]
    assert sketch.resemblance(sa[:0], sa[:0]) == 1.0 and sketch.resemblance(sa, sa[:0]) == 0.0


def test_merged_by_source(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "cold", None]), " ".join(f"w{r.randint(0, 30)}" for _ in range(60))) for _ in range(80)] + [("none", ""), ("none", None)]
    got = {x.source: x for x in sketch.merged_fingerprints(spark.createDataFrame(rows, "source string, text string").repartition(5), "source").collect()}
    assert set(got) == {"hot", "cold", None}
    for s, x in got.items():
        whole = " ".join(t or "" for k, t in rows if k == s)
        n = len(set().union(*(shingle_set(t) for k, t in rows if k == s)))
        assert abs(x.n_distinct / n - 1) < 0.25 and whole
        found = sketch.merge(*(sketch.sketches(*sketch.text_buffer(sketch.pa.array([t])), 5, 256)[0] for k, t in rows if k == s))
        assert list(sketch.from_string(x.fingerprint)) == list(found)


def test_odd_tables(spark):
    rows = [(None, "a b", "x"), (3, "c d", "y"), (3, "e f", "z"), (3, "e f", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    out = sketch.fingerprint(df)
    assert out.columns == ["doc_id", "text", "bucket", *sketch.OWN] and out.count() == 4
    assert sketch.fingerprint(df.limit(0)).count() == 0 and sketch.fingerprint(df.limit(1)).first().near_next == 1.0
