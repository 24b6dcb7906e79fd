"""Periodic runs of words, found in enhanced suffix arrays.

A run is a stretch of words with smallest period q, at least ``least`` words and
``exponent`` periods long, that neither neighbouring word extends.  The
documents of a batch share one suffix array; each ends in a separator of its own
and comes under its own first key, so suffixes of different documents never share
a prefix.  The array is sorted by prefix doubling, and only suffixes that are not
yet alone take part in a pass.

Branching tandem test: an LCP interval of depth d holds the suffixes that begin
with one string w of d words.  Where suffix i and suffix i+d both lie in it, ww
starts at i; and where they lie in different children of the interval, the word
after ww breaks the period, so ww ends its run.  Of each interval only the
suffixes outside its largest child are tried, once as the first w (is ISA[i+d]
inside?) and once as the second (is ISA[i-d]?), n log n tests in all.  Intervals
are kept as bounds and splits on a stack; no tree is built.

A square found is rotated to the left as long as the word before it has the
period, which gives the run; squares of multiples of a run's period fall on that
run and are merged into it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, released, schema_of
from .symbols import row_groups, text_buffer, word_hashes, words

LEAST, EXPONENT = 6, 4  # words, and periods, that a run has at least
GROUP = 1 << 20  # bytes of text whose documents share a suffix array; a longer text stands alone
OWN = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
TYPES = ("long", "long", "long", "long", "long", "array<struct<start:long,length:long,period:long>>", "string")
Run = tuple[int, int, int]  # start, length, period


def coded(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as dense numbers, with a separator after each document.

    ``hashes``: one per word; ``at``: word offsets by document.  Returns the
    numbers (a separator is -1 - document), each place's document, and each
    document's first place.
    """
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at) + 1)
    first = at[:-1] + np.arange(n)
    codes = np.empty(len(doc), np.int64)
    inside = np.ones(len(doc), bool)
    inside[at[1:] + np.arange(n)] = False
    codes[~inside] = -1 - np.arange(n)
    codes[inside] = np.unique(hashes, return_inverse=True)[1]
    return codes, doc, first


def suffix_array(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order (by document, then words), and the ranks by the first 1, 2, 4, ... words.

    A rank is the place of the first suffix with that prefix; the last ranks are the inverse suffix array.
    """
    order = np.argsort(codes, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    place = np.arange(len(order))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    ranks, width = [rank], 1
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, ranks
        rank = ranks[-1].copy()
        some = order[open_]
        one, two = rank[some], rank[some + width]  # a document's separator makes a suffix alone before it could reach past it
        by = np.lexsort((two, one))
        some, one, two = some[by], one[by], two[by]
        order[open_] = some
        fresh = np.ones(len(some), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new[open_] = fresh
        rank[some] = np.maximum.accumulate(np.where(fresh, open_, 0))
        ranks.append(rank)
        width *= 2


def shared_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the one before it in the array (the first: 0)."""
    lcp = np.zeros(len(order), np.int64)
    left, right = order[:-1], order[1:]
    at = np.flatnonzero(ranks[0][left] == ranks[0][right])
    a, b, n = left[at].copy(), right[at].copy(), np.zeros(len(at), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][a] == ranks[level][b]
        step = same.astype(np.int64) << level
        a, b, n = a + step, b + step, n + step
    lcp[at + 1] = n
    return lcp


def _needed(depth: int, least: int, exponent: int) -> int:
    """Words that two suffixes of the interval share at least if a long enough run of period ``depth`` ends in it."""
    return (max(least, exponent * depth) // depth - 1) * depth


def _squares(order, isa, codes, lcp, lo: int, hi: int, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """(i, d) of the branching squares of 2d words whose LCP interval lies in order[lo:hi] and can end a run."""

    def tests(depth, begin, splits, end):
        edges = [begin, *splits, end]
        sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        largest = sizes.index(max(sizes))
        for child, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if child != largest:
                for i in order[a:b].tolist():
                    j = i + depth
                    if begin <= isa[j] < end and not a <= isa[j] < b:
                        yield i, depth
                    j = i - depth
                    # the other suffix may lie in the largest child, or in one that has found the pair already
                    if j >= 0 and begin <= isa[j] < end and not a <= isa[j] < b:
                        yield j, depth

    stack: list[list] = []  # depth, first place, places where a new child begins, most words shared inside
    for at in range(lo + 1, hi + 1):
        depth = int(lcp[at]) if at < hi else 0
        begin, most = at - 1, 0
        while stack and stack[-1][0] > depth:
            d, begin, splits, inner = stack.pop()
            most = max(inner, d, most)
            if most >= _needed(d, least, exponent):
                yield from tests(d, begin, splits, at)
            if stack:
                stack[-1][3] = max(stack[-1][3], most)
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(at)
        elif depth:
            stack.append([depth, begin, [at], most])


def _merged(squares: list[tuple[int, int]], codes: np.ndarray, first: int, least: int, exponent: int) -> list[Run]:
    """Runs of one document (its first place given) from its branching squares."""
    found: list[Run] = []
    by_end: dict[int, list[tuple[int, int]]] = {}
    for i, d in sorted(set(squares), key=lambda x: (x[1], x[0])):
        end = i + 2 * d
        known = by_end.setdefault(end, [])
        if any(d % q == 0 and start <= i for start, q in known):
            continue  # a multiple of the run's period
        start, step = i, 64
        while start > first:  # rotate, in growing strides
            low = max(first, start - step)
            differ = np.flatnonzero(codes[low:start] != codes[low + d: start + d])
            if len(differ):
                start = low + int(differ[-1]) + 1
                break
            start, step = low, 2 * step
        known.append((start, d))
        if end - start >= max(least, ceil(exponent * d)):
            found.append((start - first, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(hashes: np.ndarray, at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> dict[int, list[Run]]:
    """Runs by document, for documents that have any; words as hashes, ``at`` their offsets by document."""
    codes, doc, first = coded(hashes, at)
    if not len(codes):
        return {}
    order, ranks = suffix_array(codes, doc)
    lcp = shared_prefixes(order, ranks)
    isa = ranks[-1]
    # stretches of suffixes with one first word; a run needs one in which two share this many words
    shallow = min(_needed(q, least, exponent) for q in range(1, least + 1))
    begins = np.flatnonzero(lcp == 0)
    deep = np.flatnonzero(np.maximum.reduceat(lcp, begins) >= shallow)
    ends = np.append(begins[1:], len(lcp))
    squares: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in zip(begins[deep].tolist(), ends[deep].tolist(), strict=True):
        squares.setdefault(int(doc[order[lo]]), []).extend(_squares(order, isa, codes, lcp, lo, hi, least, exponent))
    found = {d: _merged(x, codes, int(first[d]), least, exponent) for d, x in squares.items()}
    return {d: runs for d, runs in found.items() if runs}


def _with_runs(batches, least, exponent):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = [pa.int64()] * 5 + [kind, pa.string()]
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        out: dict[str, list] = {c: [] for c in OWN}
        for a, b in row_groups(offsets, GROUP):
            part = raw[offsets[a]: offsets[b]]
            begin, end, at = words(part, offsets[a: b + 1] - offsets[a])
            runs = find_runs(word_hashes(part, begin, end), at, least, exponent)
            text = part.tobytes()
            for i in range(b - a):
                own = runs.get(i, [])
                lo, hi = int(at[i]), int(at[i + 1])
                keep = np.ones(hi - lo, bool)
                for start, length, period in own:
                    keep[start + period: start + length] = False
                kept = zip(begin[lo:hi][keep].tolist(), end[lo:hi][keep].tolist(), strict=True)
                best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                out["n_runs"].append(len(own))
                for c, x in zip(("start", "length", "period"), best, strict=True):
                    out[c].append(x)
                out["exponent_milli"].append(1000 * best[1] // best[2] if own else None)
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                out["collapsed"].append(b" ".join([text[x:y] for x, y in kept]).decode())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(out[c], t) for c, t in zip(OWN, types, strict=True))], [*batch.schema.names, *OWN])


def collapse_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with their periodic runs and the text without the runs' repetitions.

    Words are runs of characters other than space and 0x09-0x0D, numbered from 0
    and compared unchanged.  A run is a stretch of words with smallest period q
    (words q apart are identical) and at least max(``least``, ``exponent`` * q)
    words that no neighbouring word extends keeping the period.  Columns added:
    n_runs; start, length, period and exponent_milli (1000 * length / period,
    rounded down) of the longest run (ties: smallest start, then period; null
    without a run); runs, all of them by start and period; collapsed, the words
    that no run contains after its first period, joined by one space.

    A null or empty text has no runs and is collapsed to the empty string; the
    text stays null.  Rows are independent, so repeated rows and keys, null keys
    and empty tables need no rule.  A text is worked on whole, in about 8 bytes a
    word and doubling of its longest repeat.  A column of the input that has the
    name of an added one is replaced.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select("text", carried(docs, "text").alias("rest"))
    out = rows.mapInArrow(lambda it: _with_runs(it, least, exponent), schema_of(rows, **dict(zip(OWN, TYPES, strict=True))))
    return released(out, docs.columns, OWN)


def run_digests(docs: DataFrame, **options) -> DataFrame:
    """``collapse_runs`` with runs_sha256 (every run's ``start,length,period`` and LF) and collapsed_sha256 in place of runs and collapsed."""
    found = collapse_runs(docs, **options)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("runs_sha256", F.sha2(F.concat_ws("", lines), 256)).withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth document by its key's checksum repeats its words from some place on.

    Let h = crc32(decimal doc_id) and g = h div 10.  If h mod 10 = 0 and the text
    has n > 0 words, each word i >= a becomes word a + (i - a) mod p of the
    original, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  Words are
    then joined by one space.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(x):  # x: words, g
        own, g = x["words"], x["g"]
        n = F.size(own)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    # a one-element array, so that the words are split once
    text = F.transform(F.array(F.struct(split.alias("words"), g.alias("g"))), repeated)[0]
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.size(split) > 0), text).otherwise(F.col("text")))
