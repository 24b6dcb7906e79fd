"""Chat formatting by incremental rendering of a black-box template.

The template is any function from a list of (role, text) turns to a string.
Successive prefixes of a conversation are rendered; what a prefix adds to the
one before is its last turn's span.  A template whose output for a prefix is not
the beginning of the next one rewrites history: such conversations are marked,
since no loss mask by spans is right for them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

BLOCK = 32  # turns rendered together for a template that declares how far it looks back; see ``spans``
# Strings that models take for marks of turns.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_FIND = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_BACK = re.compile(r"\\(\\?)")
_ROLE_BACK = re.compile(r"\\([\\n]?)")
OPEN, MIDDLE, CLOSE = "<s>", "\n", "</s>\n"


def escape(text: str) -> str:
    """Text in which no control string stands: a backslash goes behind its first character; backslashes are doubled."""
    return _FIND.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def plain_template(turns: Sequence[Turn]) -> str:
    """``<s>role``, the text on the next line, ``</s>``; both escaped, a role also on one line."""
    return "".join(f"{OPEN}{_role(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def read_back(formatted: str) -> Turn:
    """Role and text of one turn's span of ``plain_template``."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE)):
        raise ValueError("not one turn")
    role, _, text = formatted[len(OPEN): -len(CLOSE)].partition(MIDDLE)
    return _ROLE_BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(text)


def spans(template: Template, turns: Iterator[Turn], lookback: int | None = None) -> Iterator[tuple[Turn, str | None]]:
    """Each turn and the text it adds to the output, or None from where the template rewrites history.

    Without ``lookback`` every prefix is rendered whole, whatever its length, so
    numbering, first turns and late rewrites are seen; the work grows with the
    square of the turns and the conversation is held in memory.

    ``lookback`` declares that what a turn adds depends on that many turns before
    it and nothing else.  Then conversations go on in blocks that begin with the
    last turns of the block before; the last of them must add the same text as
    it did there, else the declaration is wrong and the rest is None.  The work
    grows with the turns and a block is held.
    """
    kept = None if lookback is None else max(lookback, 1) + 1
    block: list[Turn] = []
    before = ""  # output for the block so far
    known: str | None = None
    broken = False
    for turn in turns:
        if broken:
            yield turn, None
            continue
        if kept is not None and len(block) == BLOCK + kept:
            block = block[-kept:]
            first, before = template(block[:-1]), template(block)
            if not before.startswith(first) or before[len(first):] != known:
                broken = True
                yield turn, None
                continue
        block.append(turn)
        after = template(block)
        if not after.startswith(before):
            broken = True
            yield turn, None
            continue
        known, before = after[len(before):], after
        yield turn, known


class _Digest:
    """What is told of one conversation, built turn by turn."""

    def __init__(self, key):
        self.key, self.n, self.loss, self.size, self.rewrites = key, 0, 0, 0, False
        self.turns, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, turn: Turn, span: str | None, trained: Sequence[str], parse) -> None:
        self.n += 1
        if span is None:
            self.rewrites = True
            return
        self.size += len(span)
        role, text = parse(span)
        self.turns.update(f"{role}\n{text}\n".encode())
        if role in trained:
            self.loss += len(text)
            self.trained.update(text.encode())

    def row(self):
        return self.key, self.n, self.turns.hexdigest(), self.loss, self.trained.hexdigest(), self.size, self.rewrites


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations of rows in order, each read as a stream."""
    rows = ((k, r or "", t or "") for b in batches for k, r, t in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    ahead = next(rows, None)

    def own(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            now = ahead
            ahead = next(rows, None)
            yield now[1:]

    while ahead is not None:
        key = ahead[0]
        turns = own(key)
        yield key, turns
        for _ in turns:  # in case the reader stopped early
            pass


def _digests(batches, template, trained, parse, lookback):
    out = []
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
    for key, turns in _conversations(batches):
        d = _Digest(key)
        for turn, span in spans(template, turns, lookback):
            d.add(turn, span, trained, parse)
        out.append(d.row())
        if len(out) == 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
            out = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)


def _formatted(batches, template, trained, lookback):
    """One row per turn: its span, where it begins in the output, and whether it is trained on."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("begin", pa.int64()), ("span", pa.string()),
                        ("loss_begin", pa.int64()), ("loss_end", pa.int64())])
    out = []
    for key, turns in _conversations(batches):
        begin = 0
        for i, ((role, text), span) in enumerate(spans(template, turns, lookback)):
            inside = (None, None)
            if span is not None and role in trained:
                at = span.rfind(escape(text)) if text else -1
                inside = (begin + at, begin + at + len(escape(text))) if at >= 0 else (None, None)
            out.append((key, i, begin, span, *inside))
            begin += len(span or "")
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                out = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows of a conversation side by side, by turn (null first), ties by role and text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(turns: DataFrame, template: Template = plain_template, trained: Sequence[str] = ("assistant",),
              lookback: int | None = None) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text): where it stands in the formatted conversation.

    Columns: conv_id, turn (0, 1, ... in order), begin (character of the output),
    span (the text the turn adds; null from where the template rewrites
    history), loss_begin and loss_end (the characters of a trained turn's text).
    The formatted conversation is its spans in order.  Rules as in ``digests``.
    """
    return _in_order(turns).mapInArrow(partial(_formatted, template=template, trained=tuple(trained), lookback=lookback),
                                       "conv_id long, turn long, begin long, span string, loss_begin long, loss_end long")


def digests(turns: DataFrame, template: Template = plain_template, parse: Callable[[str], Turn] = read_back,
            trained: Sequence[str] = ("assistant",), lookback: int | None = None) -> DataFrame:
    """One row per conversation of ``turns``, read back from the template's output.

    Columns: conv_id, n_turns, turns_sha256 (of role, newline, text, newline of
    each turn), loss_chars and loss_sha256 (of the texts of ``trained`` roles),
    formatted_chars and rewrites_history.  Each task reads its conversations
    turn by turn.  ``lookback`` is what the template declares (see ``spans``; 0
    for ``plain_template``): with it a task holds a block of turns and one
    conversation may be long, without it whole prefixes are rendered.

    Null roles and texts are empty; rows of a null conv_id are one conversation.
    Turns go by number (null first), equal ones by role and text, and repeated
    rows are turns of their own.  An empty table gives an empty table; further
    columns are ignored.
    """
    return _in_order(turns).mapInArrow(partial(_digests, template=template, trained=tuple(trained), parse=parse, lookback=lookback), DIGEST)
