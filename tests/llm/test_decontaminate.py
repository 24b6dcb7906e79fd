"""Benchmark items in documents."""

import random
import re

from tidemark.llm import decontaminate as D

ITEM = "Every morning the clever baker sold 12 loaves to Anna and 30 kg of flour to Peter before lunch. How many loaves did Anna buy from the clever baker in 7 days?"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.matches(d, b).collect()}


def test_templates(spark):
    df = spark.createDataFrame([(ITEM,), ("3kg of X2 IS Big. The end",)], "text string").select(
        D.template(D.F.col("text")).alias("t"), D.raw_words(D.F.col("text")).alias("r"))
    for t, r in df.collect():
        assert t[0] == r[0] == "" and len([x for x in t if x]) == len([x for x in r if x])
    t = df.collect()[0].t[1:]
    assert t[:9] == ["every", "morning", "the", "clever", "baker", "sold", D.NUMBER, "loaves", "to"] and t[9] == D.NAME and t[11:13] == [D.NUMBER, D.UNIT]


def test_verbatim_changed_and_clean(spark):
    r = random.Random(1)
    filler = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(200)]

    def around(x):
        words = [r.choice(filler) for _ in range(120)]
        return " ".join(words[:60]) + ". " + x + " " + " ".join(words[60:])

    exchanged = ITEM.replace("12", "45").replace("Anna", "Maria").replace("Peter", "Hans").replace("30 kg", "8 miles").replace("7 days", "9 weeks")
    broken = ITEM.replace("Anna and", "Maria and").replace("12", "45").replace("did Anna", "did Olga").replace("Peter", "Hans")
    one_word = ITEM.replace("flour", "sugar")
    docs = [(1, around(ITEM)), (2, around(ITEM.upper())), (3, around(exchanged)), (4, around(one_word)), (5, around("")),
            (6, around(ITEM[:40])), (7, None), (8, ""), (9, ITEM), (10, around(re.sub(" ", "\n", ITEM)))]
    items = [(1, ITEM), (2, "the of"), (3, None), (1, ITEM), (4, "short item here")]
    got = found(spark, docs, items)
    assert {1, 3, 4, 9, 10} <= {d for d, i in got if i == 1} and not {5, 6, 7, 8} & {d for d, _ in got}
    assert got[1, 1].share == 1 and got[3, 1].share == 1 and got[3, 1].agreeing == 1 and got[3, 1].slots == 8
    assert {i for _, i in got} == {1}
    # the same template with values that don't go together is another text
    many = "Anna pays Peter then Anna pays Peter then Anna pays Peter while Anna waits and waits"
    other = "Anna pays Maria then Olga pays Hans then Eve pays Paul while Kurt waits and waits"
    got = found(spark, [(1, "so " + many), (2, "so " + other), (3, "so " + many.replace("Anna", "Eve").replace("Peter", "Kurt"))], [(1, "so " + many)])
    assert {d for d, _ in got} == {1, 3} and broken


def test_many_items_take_the_shuffle(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    once = sorted(map(tuple, D.matches(docs, items).collect()))
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert sorted(map(tuple, D.matches(docs, items).collect())) == once and once


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()}

    def words(t):
        return re.findall(r"[^\W\d_]+", t.lower())

    want = set()
    inside = {i: words(t) for i, t in ((r.item_id, r.text) for r in items.collect())}
    for r in docs.collect():
        text = words(r.text)
        grams = {tuple(text[k: k + 5]) for k in range(len(text) - 4)}
        for i, w in inside.items():
            mine = [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
            if sum(g in grams for g in mine) >= 0.8 * len(mine):
                want.add((r.doc_id, i))
    assert got == want and len(want) > 10


def test_odd_rows(spark):
    rows = [(None, ITEM, "a"), (1, ITEM, "b"), (1, ITEM, "b"), (2, "nothing here at all", None), (3, None, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item string")
    b = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in D.matches(d, b).collect()) == ["1", "None"]
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns and sorted(str(r.item) for r in left.collect()) == ["None", "c"]
    assert D.matches(d.limit(0), b).count() == 0 and D.drop_contaminated(d, b.limit(0)).count() == 5


def test_short_items_and_capitals_at_a_start(spark):
    items = ["What is 12 + 35?", "Compute 12 * 34 + 56 - 7.", "Who wrote Hamlet?", "What is 15% of 240?", "Where was Albert Einstein born?", "Anna has 3 apples left."]
    other = ["What is 13 + 35?", "Compute 12 * 34 + 56 - 8.", "Who wrote Faust?", "What is 15% off 240?", "Where was Albert Einstein buried?", "Anna has 3 pears left."]
    docs = [(10 * i + j, before + x) for i, x in enumerate(items) for j, before in enumerate(["", "Q: ", "the question ", "Again. ", "so, "])]
    docs += [(100 + i, "Q: " + x) for i, x in enumerate(other)] + [(200, "Bob has 9 apples left."), (201, "Now then. Bob has 9 apples left."), (202, "bob has 9 apples left.")]
    got = set(found(spark, docs, list(enumerate(items))))
    assert got == {(10 * i + j, i) for i in range(6) for j in range(5)} | {(200, 5), (201, 5)}


def test_every_alignment_is_judged(spark):
    many = "so Anna pays Peter then Anna pays Peter then Anna pays Peter while Anna waits and waits"
    other = "so Anna pays Maria then Olga pays Hans then Eve pays Paul while Kurt waits and waits"
    got = found(spark, [(1, many + ". And " + other), (2, other + ". And " + many), (3, other + ". And " + other)], [(1, many)])
    assert {d for d, _ in got} == {1, 2} and got[1, 1].agreeing == got[2, 1].agreeing == got[1, 1].share == 1
    words = ("the slow train needs 40 minutes from the old harbour up to the green valley while the bus needs 25 minutes for a longer road "
             "and the boat takes 40 minutes when the wind blows hard or 90 minutes when nothing moves on that wide water").split()
    half = len(words) // 2
    inserted = " ".join(words[:half] + ["really"] + words[half:])  # an alignment before it and one behind, neither with half the windows
    random_fill = inserted.replace("40", "7", 1).replace("25", "40").replace("90", "40")
    long = " ".join(words)
    got = found(spark, [(1, inserted), (2, "well " + inserted + " " + random_fill), (3, long.replace("40", "33"))], [(7, long)])
    assert set(got) == {(1, 7), (2, 7), (3, 7)} and got[1, 7].agreeing == 1 and got[1, 7].share >= 0.8
