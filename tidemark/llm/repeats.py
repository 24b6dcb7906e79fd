"""Repeated windows of a fixed number of symbols, found without moving every window.

Windows of ``width`` symbols are grouped into blocks: the run of neighbouring
windows that share their anchor, the ``gram`` symbols with the least hash in
the window.  The anchor depends on the window's content alone, so equal windows
always lie in blocks of the same anchor.  A block row is

    head   hash of the anchor's symbols
    body   hash of the whole block (first to last symbol, anchor's place, size)
    doc    the document's key
    at     the row's tag, first window, anchor, number of windows and kind, packed

Kinds: PENDING blocks are still to be compared with those of other tasks,
SETTLED ones are known to repeat an earlier block as a whole, OPEN ones share
their anchor with a different block, so that their windows must be compared one
by one, and a TOKEN tells other tasks that an anchor has several blocks.
Of each (head, body) a task passes on its earliest rows only, and of a head
with several bodies one token, so that no group grows beyond the task count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import COMBINE, carried, key_column
from .symbols import SLICE, Spans, U, mix, row_groups, text_buffer

PENDING, SETTLED, OPEN, TOKEN = range(4)
KIND_BITS, SIZE_BITS, ANCHOR_BITS, PLACE_BITS, TAG_BITS = 2, 7, 7, 31, 16
STEP = 8  # neighbouring windows of an open block compared together
NO_KEY = -(1 << 63)  # stands for a null key
ROW = "head long, body long, doc long, at long"
_PLACE = (1 << 21) - 1


def packed(tag, place, anchor, size, kind):
    return ((((tag << PLACE_BITS | place) << ANCHOR_BITS | anchor) << SIZE_BITS | size) << KIND_BITS) | kind


def unpacked(at: np.ndarray):
    """(tag, first window, anchor's distance from it, number of windows, kind) of packed places."""
    out = []
    for bits in (KIND_BITS, SIZE_BITS, ANCHOR_BITS, PLACE_BITS):
        out.append(at & ((1 << bits) - 1))
        at = at >> bits
    return at, *out[::-1]


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1: w - 1 + n])


def blocks(values: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Blocks of all texts of a batch: (text, first window, anchor's distance, windows, head, body)."""
    out = [[np.empty(0, np.int64)] * 4 + [np.empty(0, U)] * 2]
    for a, b in row_groups(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        for lo in range(begin, end, SLICE):
            hi = min(lo + SLICE + width - 1, end)
            edges = np.clip(offsets[a: b + 1], lo, hi) - lo
            count = np.maximum(np.diff(edges) - width + 1, 0)
            if not count.any():
                continue
            spans = Spans(values[lo:hi])
            hashes = spans.windows(gram)
            least = _sliding_least(hashes & U(~_PLACE & (2**64 - 1)) | np.arange(len(hashes), dtype=U), width - gram + 1)
            text = np.repeat(np.arange(b - a), count)
            window = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + edges[text]
            anchor = (least[window] & U(_PLACE)).astype(np.int64)
            new = np.ones(len(text), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            run = np.flatnonzero(new)
            size = np.diff(np.append(run, len(text)))
            first, anchor, text = window[run], anchor[run], text[run]
            body = mix(spans.hash(first, first + size - 1 + width) + (anchor - first).astype(U) * U(0x9E3779B97F4A7C15) + size.astype(U))
            out.append([text + a, first + lo - offsets[a + text], anchor - first, size, hashes[anchor], body])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short spans of one text's symbols."""
    out = np.empty(len(start), U)
    for lo in range(0, len(values), SLICE):
        here = np.flatnonzero((start >= lo) & (start < lo + SLICE))
        if len(here):
            out[here] = Spans(values[lo: max(lo + SLICE, int(end[here].max()))]).hash(start[here] - lo, end[here] - lo)
    return out


def pieces(values: np.ndarray, first, anchor, size, width: int, step: int):
    """Open blocks of one text cut into pieces of ``step`` neighbouring windows.

    Pieces are aligned on the anchor, so that equal windows fall into pieces of
    one place.  A piece's head is the hash of the symbols that all its windows
    share: where two heads differ, no window of the two pieces is equal.  Its
    body is the hash of all its symbols.
    """
    window = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    mark = np.repeat(first + anchor, size)
    order = np.lexsort((window, mark))
    window, mark = window[order], mark[order]
    slot = (mark - window) // step
    new = np.ones(len(window), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (slot[1:] != slot[:-1])
    run = np.flatnonzero(new)
    low, count, mark, slot = window[run], np.diff(np.append(run, len(window))), mark[run], slot[run]
    head = _span_hashes(values, mark - slot * step, mark - slot * step - step + 1 + width)
    body = _span_hashes(mix(values + U(0xA0761D6478BD642F)), low, low + count - 1 + width)
    return low, mark - low, count, head, mix(body + (mark - low).astype(U) * U(0x9E3779B97F4A7C15) + count.astype(U))


def settle(head, body, doc, at, by_doc: bool):
    """Sort rows and sort out what can be told from them alone.

    Returns the sorted rows and, for each, whether an earlier row has the same
    head and body, and whether its head has several bodies.  Earlier means a
    smaller document, or with ``by_doc`` unset also a smaller place in it.
    """
    order = np.lexsort((at, doc, body, head))
    head, body, doc, at = head[order], body[order], doc[order], at[order]
    same_head = np.zeros(len(head), bool)
    same_head[1:] = head[1:] == head[:-1]
    same = same_head.copy()
    same[1:] &= body[1:] == body[:-1]
    if by_doc:
        least = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))] if len(doc) else doc
        later = same & (doc > least)
    else:
        later = same.copy()
        later[1:] &= (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])  # a repeated row isn't later than itself
    group = np.cumsum(~same_head) - 1
    bodies = np.bincount(group[~same], minlength=group[-1] + 1 if len(group) else 0)
    return head, body, doc, at, later, bodies[group] > 1 if len(group) else same


def _batch(head, body, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x).astype(np.int64, copy=False).view(np.int64)) for x in (head, body, doc, at)], ["head", "body", "doc", "at"])


def combined(head, body, doc, at, by_doc: bool, open_windows: bool) -> pa.RecordBatch:
    """One task's rows for the shuffle: what is settled here leaves the comparison.

    Rows that are done travel under a hash of their own place.
    """
    head, body, doc, at, later, several = settle(head.view(np.int64), body.view(np.int64), doc, at, by_doc)
    if not len(head):
        return _batch(head, body, doc, at)
    if not open_windows:
        several = np.zeros(len(head), bool)
    done = later | several
    kind = np.where(later, SETTLED, np.where(several, OPEN, PENDING))
    spread = mix(at.view(U) + mix(doc.view(U))).view(np.int64)
    token = several.copy()
    token[1:] &= head[1:] != head[:-1]
    token = head[token]
    return _batch(
        np.concatenate([np.where(done, spread, head), token]), np.concatenate([np.where(done, 0, body), np.full(len(token), NO_KEY)]),
        np.concatenate([doc, np.full(len(token), NO_KEY)]), np.concatenate([at | kind, np.full(len(token), TOKEN)]))


def resolve(batches: Iterable[pa.RecordBatch], by_doc: bool) -> Iterator[pa.RecordBatch]:
    """Settle rows that come sorted by (head, body, doc, at), in constant memory.

    Yields (doc, at, number of windows) of SETTLED and OPEN rows.  A SETTLED row
    of size 0 has its number of windows as body.  Between batches only the last
    anchor's state is kept: its hash, the class being read, the class's first
    place, whether several classes were seen, and rows of the first class that
    wait for a second one (the first document's own, one row but for ``by_doc``).
    """
    head = body = first = None
    several, waiting = False, []

    def rows(doc, at, size=None):
        own = at >> KIND_BITS & ((1 << SIZE_BITS) - 1)
        size = own if size is None else np.where(own, own, size)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, at, size)], ["doc", "at", "size"])

    def found(out):
        both = np.array(out, np.int64).reshape(-1, 2)
        return rows(both[:, 0], both[:, 1])

    for batch in batches:
        h, b, d, a = (np.asarray(batch.column(i)) for i in range(4))
        kind = a & 3
        done = (kind == SETTLED) | (kind == OPEN)
        if done.any():
            yield rows(d[done], a[done], b[done])
            h, b, d, a, kind = (x[~done] for x in (h, b, d, a, kind))
        if not len(h):
            continue
        # anchors with one row in this batch and none beside it need no look
        alone = np.ones(len(h), bool)
        alone[1:] &= h[1:] != h[:-1]
        alone[:-1] &= h[1:] != h[:-1]
        alone[0] &= h[0] != head if head is not None else True
        alone[-1] = False
        keep = ~alone
        out = []
        for hh, bb, dd, aa, kk in zip(*(x[keep].tolist() for x in (h, b, d, a, kind)), strict=True):
            if hh != head:
                head, body, first, several, waiting = hh, None, None, False, []
            if kk == TOKEN:
                several = True
                continue
            if bb != body:
                if body is not None:
                    several = True
                body, first = bb, (dd, aa)
            elif dd > first[0] if by_doc else (dd, aa) != first:
                out.append((dd, aa | SETTLED))
                continue
            waiting.append((dd, aa | OPEN))
            if several:
                out += waiting
                waiting = []
        if out:
            yield found(out)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [first, last) spans; touching spans join."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    return first[new], last[np.append(np.flatnonzero(new)[1:], len(first)) - 1]


def _block_rows(batches, symbols, width, gram, by_doc):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        doc, tag = np.asarray(batch.column("doc")), np.asarray(batch.column("tag"))
        for a, b in row_groups(offsets, COMBINE):
            out = []
            for c, d in row_groups(offsets[a: b + 1]):
                c, d = a + c, a + d
                values, at = symbols(raw[offsets[c]: offsets[d]], offsets[c: d + 1] - offsets[c])
                part = blocks(values, at, width, gram)
                out.append([part[0] + c, *part[1:]])
            text, first, anchor, size, head, body = (np.concatenate(x) for x in zip(*out, strict=True))
            yield combined(head, body, doc[text], packed(tag[text], first, anchor, size, 0), by_doc, True)


def _piece_rows(batches, symbols, width, by_doc, step):
    """Open blocks in pieces of ``step`` windows; settled stretches joined, a row of size 0 with its windows as body."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        docs, tags = np.asarray(batch.column("doc")), np.asarray(batch.column("tag"))
        starts, first_, size_, anchor_, open_ = findings(batch.column("found"))
        rows, settled, held = [], [], 0
        for i in np.flatnonzero(np.diff(starts)).tolist():
            first, size, anchor, todo = (x[starts[i]: starts[i + 1]] for x in (first_, size_, anchor_, open_))
            done = ~todo
            s, e = merged(first[done], (first + size)[done])
            settled.append((np.full(len(s), docs[i]), packed(int(tags[i]), s, 0, 0, SETTLED), e - s))
            if todo.any():
                values, _ = symbols(raw[offsets[i]: offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                low, mark, count, head, body = pieces(values, first[todo], anchor[todo], size[todo], width, step)
                rows.append((head, body, np.full(len(low), docs[i]), packed(int(tags[i]), low, mark, count, 0)))
                held += len(low)
            if held > COMBINE // 16:
                yield combined(*(np.concatenate(x) for x in zip(*rows, strict=True)), by_doc, step > 1)
                rows, held = [], 0
        if rows:
            yield combined(*(np.concatenate(x) for x in zip(*rows, strict=True)), by_doc, step > 1)
        if settled:
            doc, at, size = (np.concatenate(x) for x in zip(*settled, strict=True))
            yield _batch(mix((at ^ doc).view(U)), size, doc, at)


def _with_found(docs: DataFrame, rows: DataFrame, by_doc: bool) -> DataFrame:
    """``docs`` with the findings among ``rows``, compared with rows of the same head side by side and in order.

    A finding is one long: its first window, and in the lower half its number
    of windows, or for an open block a set bit, the anchor and the number.
    """
    keyed = rows.repartition("head").sortWithinPartitions("head", "body", "doc", "at")
    found = keyed.mapInArrow(partial(resolve, by_doc=by_doc), "doc long, at long, size long")
    place = F.shiftrightunsigned("at", ANCHOR_BITS + SIZE_BITS + KIND_BITS)
    first = F.shiftleft(place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), 32)
    block = F.shiftrightunsigned("at", KIND_BITS).bitwiseAND(F.lit((1 << (ANCHOR_BITS + SIZE_BITS)) - 1))
    lower = F.when(F.col("at").bitwiseAND(F.lit(3)) == OPEN, block + (1 << 31)).otherwise(F.col("size"))
    found = found.select("doc", F.shiftrightunsigned(place, PLACE_BITS).alias("tag"), (first + lower).alias("item"))
    return docs.join(found.groupBy("doc", "tag").agg(F.collect_set("item").alias("found")), ["doc", "tag"], "left")


def findings(found: pa.Array) -> list[np.ndarray]:
    """Offsets by row, and each finding's first window, number of windows, anchor and whether it is open."""
    starts, item = np.asarray(found.offsets), np.asarray(found.flatten())
    lower = item & ((1 << 32) - 1)
    open_ = lower >= 1 << 31
    size = np.where(open_, lower & ((1 << SIZE_BITS) - 1), lower)
    return [starts - starts[0] if len(starts) else np.zeros(1, np.int64), item >> 32, size, lower >> SIZE_BITS & ((1 << ANCHOR_BITS) - 1), open_]


def with_repeats(docs: DataFrame, symbols, width: int, gram: int, by_doc: bool) -> DataFrame:
    """``docs`` (text, doc, tag and others) with ``found``: runs of windows that repeat an earlier one.

    ``symbols(raw, offsets)`` gives the symbols of a batch of texts and their
    offsets.  ``found`` (read it with ``findings``) is null where nothing was
    found; windows first .. first + size - 1 of the document are repeats.  The
    documents are shuffled once; all joins read that same shuffle.
    """
    if not gram + STEP <= width < gram + (1 << SIZE_BITS):
        raise ValueError(f"width must exceed gram by {STEP} to {(1 << SIZE_BITS) - 1}")
    rows = docs.select("doc", "tag", "text").mapInArrow(partial(_block_rows, symbols=symbols, width=width, gram=gram, by_doc=by_doc), ROW)
    for step in (STEP, 1):
        opened = _with_found(docs, rows, by_doc).where("found is not null")
        rows = opened.mapInArrow(partial(_piece_rows, symbols=symbols, width=width, by_doc=by_doc, step=step), ROW)
    return _with_found(docs, rows, by_doc)


def keyed_documents(df: DataFrame) -> DataFrame:
    """doc (key, null first), tag, text, and the other columns as ``rest``."""
    text = F.col("text")
    tag = F.xxhash64(text).bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    return df.select(key_column(df).alias("doc"), tag.alias("tag"), text, carried(df, "text").alias("rest"))

