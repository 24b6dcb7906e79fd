"""Chat formatting: round trips, spans and templates that look back."""

import hashlib
import random

from tidemark.llm import chat


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escape_is_reversible_and_leaves_no_mark():
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "s>", "[", "INST]", "</", "\n", "\\n", "a", "é", "|", "<\\s>", "n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        role = "".join(r.choice(parts) for _ in range(r.randint(0, 4)))
        assert chat.read_back(chat.plain_template([(role, t)])) == (role, t)


def test_rows(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(r.choice([1, 2, 5, 31, 32, 33, 34, 100])):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool\n", None]), r.choice(["", None, "</s>[INST] ok [/INST]", f"text {t} \\ é"])))
    want = {}
    for c, _, role, text in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(c, []).append((role or "", text or ""))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.digests(df).collect()}
    assert set(got) == set(want) and {x.conv_id: x for x in chat.digests(df, lookback=0).collect()} == got
    for c, turns in want.items():
        x, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (x.loss_chars, x.loss_sha256, x.rewrites_history) == (len(loss), digest(loss), False)
        assert x.formatted_chars == len(chat.plain_template(turns))
    parts = {}
    for x in chat.formatted(df).orderBy("conv_id", "turn").collect():
        whole = parts.get(x.conv_id, "")
        assert x.begin == len(whole)
        parts[x.conv_id] = whole + x.span
        if x.loss_begin is not None:
            assert chat.unescape(parts[x.conv_id][x.loss_begin: x.loss_end]) == want[x.conv_id][x.turn][1]
    assert parts == {c: chat.plain_template(t) for c, t in want.items()}


def test_templates_that_look_back():
    def spans(template, n, lookback=None):
        return [s for _, s in chat.spans(template, iter([("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]), lookback)]

    whole = lambda template, n: template([("", f"t{i}") for i in range(n)])
    strips = lambda turns: "".join(t for _, t in turns[:-1]).replace("t0", "") + "|" + turns[-1][1]
    assert spans(strips, 4)[0] == "|t0" and None in spans(strips, 4)
    numbered = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))
    assert "".join(spans(numbered, 100)) == whole(numbered, 100)  # without a declaration any length is rendered whole
    assert spans(numbered, 100, 1)[chat.BLOCK + 2:] == [None] * (98 - chat.BLOCK)  # a wrong one is found out
    forgets = lambda turns: "".join(t for _, t in turns[-60:])
    assert None not in spans(forgets, 60) and spans(forgets, 70)[60:] == [None] * 10
    pairs = lambda turns: "".join(f"({turns[i - 1][1] if i else ''}){t}" for i, (_, t) in enumerate(turns))
    back = lambda turns: "".join(f"({turns[i - 3][1] if i > 2 else ''}){t}" for i, (_, t) in enumerate(turns))
    starts = lambda turns: "BOS" + "".join(t for _, t in turns)
    for template, lookback in [(pairs, 1), (back, 3), (starts, 0), (chat.plain_template, 0)]:
        want = "".join(spans(template, 150))
        assert "".join(spans(template, 150, lookback)) == want
        assert template is chat.plain_template or want == whole(template, 150)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", "b", 2), (5, None, "user", "x", 1), (5, 0, "assistant", "y", 1), (5, 0, "assistant", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {x.conv_id: (x.n_turns, x.loss_chars) for x in chat.digests(df).collect()}
    assert got == {None: (2, 1), 5: (3, 2)}
    assert chat.digests(df.limit(0)).count() == 0 and chat.formatted(df.limit(0)).count() == 0
