"""Two tokenizers' tokens of one text, aligned at the byte offsets where both end a token.

Each side's cumulative byte ends go into a dictionary from end to index.  The
intersection of the two key sets, sorted, gives the places where both sides end
a token; consecutive ones slice both id lists into groups.  A group links every
A token in it with every B token in it, expanded slice by slice.

Counting links over a corpus: rows of single links would be as many as its
tokens.  Instead each document keeps its distinct id pairs as arrays, documents
are written in blocks, and of a block each distinct pair leaves as one row with
the number of the block's documents that hold it.  The rows are summed by pair,
compared with the best pair of their A id, and go back to their block, where they
meet its documents again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .bpe import PATTERN, _byte_names, _public
from .frames import carried, released, schema_of
from .symbols import row_groups, text_buffer

BLOCK = 1 << 21  # distinct pairs of documents in a block; a document with more is a block by itself
LINKS = 1 << 19  # links expanded at once
BATCH = 1 << 20  # bytes of text whose rows leave together
WINDOW = 1 << 16  # bytes whose ends are compared at once
OWN = ["n_a", "n_b", "a_ids", "b_ids", "a_sizes", "b_sizes"]
TYPES = ("long", "long", "array<int>", "array<int>", "array<int>", "array<int>")
FOUND = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_a", "pair_b", "times"]
FOUND_TYPES = ("long", "long", "long", "long", "string", "array<int>", "array<int>", "array<int>")
COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Spelled:
    """The bytes of many short strings, side by side."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The strings of ``ids`` one after another."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Side:
    """A tokenizer, and the bytes of each of its ids."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode, self.spelled = encode, Spelled(token_bytes)

    def __call__(self, text: str, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text and their byte ends, or nothing where their bytes aren't ``whole``."""
        ids = np.array(self.encode(text), np.int32)
        ends = np.cumsum(self.spelled.sizes[ids])
        if not len(ends) or ends[-1] != len(whole):
            return None
        for lo in range(0, len(ids), WINDOW):
            hi = min(lo + WINDOW, len(ids))
            if not np.array_equal(self.spelled.joined(ids[lo:hi]), whole[ends[lo] - self.spelled.sizes[ids[lo]]: ends[hi - 1]]):
                return None
        return ids, ends


def _json_side(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; it gets a space before each text, special strings are plain text."""
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names, vocabulary = _byte_names(), spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(names[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    library = []  # loaded when it is first needed

    def slow(text):
        if not library:
            library.append(Tokenizer.from_file(path))
            library[0].encode_special_tokens = True
        return library[0].encode(text, add_special_tokens=False).ids

    # where ids are the merges' ranks, a faster library gives the same ids, but can't split very long runs of white space
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    split = spec["pre_tokenizer"]
    same = [vocabulary[m] for m in merges] == list(range(256, 256 + len(merges))) and not spec["normalizer"] and split["type"] == "ByteLevel" and split["use_regex"]
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
    blank = regex.compile(r"\s{10000}")

    def encode(text):
        text = " " + text
        return fast.encode_to_numpy(text) if fast and (len(text) < 10_000 or not blank.search(text)) else slow(text)

    token_bytes = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for t, i in ranks.items():
        token_bytes[i] = t
    for t, i in special.items():
        token_bytes[i] = t.encode()
    return Side(encode, token_bytes)


def _model_side(path: str) -> Side:
    """A sentencepiece model, which adds a space before each text itself."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    ids = range(own.get_piece_size())
    token_bytes = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return Side(own.encode, token_bytes)


@cache
def side(path: str) -> Side:
    return _model_side(path) if path.endswith(".model") else _json_side(path)


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes on both sides of the groups between common ends; the dictionaries hold WINDOW bytes of text at a time."""
    last = int(min(a_ends[-1], b_ends[-1])) if len(a_ends) and len(b_ends) else 0
    cuts: tuple[list[int], list[int]] = ([0], [0])
    for lo in range(0, last, WINDOW):
        index = []
        for ends in (a_ends, b_ends):
            i, j = np.searchsorted(ends, [lo, lo + WINDOW], side="right").tolist()  # ends in (lo, lo + WINDOW]
            index.append(dict(zip(ends[i:j].tolist(), range(i + 1, j + 1), strict=True)))
        common = sorted(filter(index[1].__contains__, index[0]))
        for cut, at in zip(cuts, index, strict=True):
            cut += map(at.__getitem__, common)
    return np.diff(np.array(cuts[0], np.int32)), np.diff(np.array(cuts[1], np.int32))


@cache
def _names(n: int) -> Spelled:
    """Decimal ids, each followed by a comma, a bar and a semicolon: entry 3 * id + sign."""
    return Spelled([b"%d%c" % (i, c) for i in range(n) for c in b",|;"])


def digest(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> str:
    """Hex digest of the groups written as ids in order, A before B; the empty string for no groups."""
    if not len(a_sizes):
        return ""
    of_a, of_b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_code, b_code = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
    a_code[a_ends - 1] += 1
    b_code[b_ends - 1] += 2
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + (b_ends - b_sizes)[of_a]] = a_code
    code[np.arange(len(b)) + a_ends[of_b]] = b_code
    names = _names(1 << int(code.max() // 3).bit_length())
    sha = hashlib.sha256()
    for lo in range(0, len(code), WINDOW):
        text = names.joined(code[lo: lo + WINDOW])
        sha.update(text if lo + WINDOW < len(code) else text[:-1])
    return sha.hexdigest()


def _list_column(lists: list[np.ndarray]) -> pa.ListArray:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(lists).astype(np.int32, copy=False)))


def _aligned(batches, a_path, b_path):
    a_side, b_side, none = side(a_path), side(b_path), np.empty(0, np.int32)
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for lo, hi in row_groups(at, BATCH):
            part = batch.slice(lo, hi - lo)
            lists: list[list[np.ndarray]] = [[], [], [], []]
            for i, text in enumerate(part.column("text"), lo):
                text = text.as_py() or ""
                whole = np.concatenate([[np.uint8(0x20)], raw[at[i]: at[i + 1]]])
                a = a_side(text, whole) if text else None
                b = b_side(text, whole) if a else None
                found = (a[0], b[0], *groups(a[1], b[1])) if a and b else (none,) * 4
                for out, x in zip(lists, found, strict=True):
                    out.append(x)
            columns = [pa.array([len(x) for x in out], pa.int64()) for out in lists[:2]]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns, *map(_list_column, lists)], [*part.schema.names, *OWN])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with both tokenizers' ids and the sizes of the groups that common byte ends cut them into.

    A: a byte-level BPE ``.json``, encoding a space and the text; B: a ``.model``
    that adds this space itself (defaults: the public files of 50,257 and 32,000
    ids).  No special tokens are added, and their strings in a text are plain
    text.  Columns added: n_a, n_b, a_ids, b_ids, and a_sizes and b_sizes, the
    number of A and of B tokens in each group.

    A null or empty text, and one whose tokens on either side don't join to the
    text's own bytes (a character that B rewrites), has no tokens and no groups;
    the text stays as it is.  Rows are independent, so repeated rows and keys,
    null keys and empty tables need no rule.  A column of the input that has the
    name of an added one is replaced.
    """
    a_path, b_path = a_path or _public("byte_bpe_50k.json"), b_path or _public("piece_bpe_32k.model")
    rows = docs.select("text", carried(docs, "text").alias("rest"))
    out = rows.mapInArrow(lambda it: _aligned(it, a_path, b_path), schema_of(rows, **dict(zip(OWN, TYPES, strict=True))))
    return released(out, docs.columns, OWN)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of int lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()), at - at[0] if len(at) else np.zeros(1, np.int64)


def _distinct(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they occur or the sums of ``n``."""
    if n is None:
        key = np.sort(key)
    else:
        by = np.argsort(key)
        key, n = key[by], n[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    if n is None:
        return key[first], np.diff(first, append=len(key))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def links(rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, pair, number of links) of all distinct pairs of each row, in runs of rows of about LINKS links.

    ``rows`` has the columns a_ids, b_ids, a_sizes and b_sizes; a pair is the A
    id above 32 bits and the B id below.  Where groups have many links, their
    distinct ids are expanded with the products of their numbers.
    """
    (a, a_at), (b, b_at), (na, at), (nb, _) = (_lists(rows.column(c)) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    a_bits, b_bits = (int(x.max()).bit_length() if len(x) else 0 for x in (a, b))
    most = 1 << (63 - a_bits - b_bits)  # rows whose number fits beside a pair
    sums = np.concatenate([[0], np.cumsum(na * nb)])
    begin, n = 0, len(at) - 1
    while begin < n:
        end = int(np.searchsorted(sums[at], sums[at[begin]] + LINKS, side="right")) - 1
        end = min(max(end, begin + 1), begin + most, n)
        row = np.repeat(np.arange(end - begin), np.diff(at[begin: end + 1]))
        sides = []
        for values, offsets, size, bits in ((a, a_at, na, a_bits), (b, b_at, nb, b_bits)):
            size, ids = size[at[begin]: at[end]], values[offsets[begin]: offsets[end]].astype(np.int64)
            group = np.repeat(np.arange(len(size)), size)
            times = None
            if sums[at[end]] - sums[at[begin]] > 4 * len(ids) + 16:
                key, times = _distinct(group << bits | ids)
                group, ids = key >> bits, key & ((1 << bits) - 1)
                size = np.bincount(group, minlength=len(size))
            sides.append((group, ids, times, size))
        (group, xa, ka, _), (_, xb, kb, held) = sides
        reps = held[group]
        first = (np.cumsum(held) - held)[group]
        place = np.repeat(first - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        key = np.repeat((row[group] << a_bits | xa) << b_bits, reps) | xb[place]
        times = None
        if ka is not None or kb is not None:
            times = (np.repeat(ka, reps) if ka is not None else 1) * (kb[place] if kb is not None else 1)
        key, times = _distinct(key, times)
        pair = key & ((1 << (a_bits + b_bits)) - 1)
        yield begin + (key >> (a_bits + b_bits)), pair >> b_bits << 32 | pair & ((1 << b_bits) - 1), times
        begin = end


def _found(batches, a_path, b_path, limit):
    """The columns FOUND and a block's number in place of the text: a task's rows in order, a new block for every ``limit`` pairs."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in _aligned(batches, a_path, b_path):
        ids = [_lists(batch.column(c)) for c in OWN[2:]]
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))] * batch.num_rows
        for row, pair, times in links(batch):
            cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)] if len(row) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pairs[row[lo]] = pair[lo:hi], times[lo:hi]
        n_links, digests, blocks = [], [], []
        for i, (pair, times) in enumerate(pairs):
            n_links.append(int(times.sum()))
            digests.append(digest(*(x[at[i]: at[i + 1]] for x, at in ids)))
            if held and held + len(pair) > limit:
                block, held = block + 1, 0
            held += len(pair)
            blocks.append(block)
        n_groups = np.diff(ids[2][1])
        lists = [_list_column(x) for x in ([p >> 32 for p, _ in pairs], [p & 0xFFFFFFFF for p, _ in pairs], [n for _, n in pairs])]
        own = [batch.column("n_a"), batch.column("n_b"), pa.array(n_groups), pa.array(n_links, pa.int64()), pa.array(digests, pa.string()), *lists]
        yield pa.RecordBatch.from_arrays([batch.column("rest"), *own, pa.array(blocks, pa.int64())], ["rest", *FOUND, "block"])


def _keys(rows) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``rows`` as one number, and their offsets by row."""
    (a, at), (b, _) = _lists(rows.column("pair_a")), _lists(rows.column("pair_b"))
    return a.astype(np.int64) << 32 | b, at


def _pairs(batches):
    """(block, A id, B id, documents) of each block's distinct pairs."""
    block, held, size = None, [], 0

    def summed():
        return _distinct(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    def done():
        pair, n = summed()
        for lo in range(0, len(pair), 1 << 16):
            p, k = pair[lo: lo + (1 << 16)], n[lo: lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), block)), pa.array((p >> 32).astype(np.int32)), pa.array((p & 0xFFFFFFFF).astype(np.int32)), pa.array(k)],
                ["block", "a", "b", "n"])

    for batch in batches:
        blocks = np.asarray(batch.column("block"))
        key, at = _keys(batch)
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if block is not None and blocks[lo] != block:
                yield from done()
                held, size = [], 0
            block = int(blocks[lo])
            held.append(_distinct(key[at[lo]: at[hi]]))
            size += len(held[-1][0])
            if size > LINKS:
                held, size = [summed()], 0
    if block is not None:
        yield from done()


def _back(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the counts of their links, from the block's slice of the counts."""
    known = np.asarray(right.column("a")).astype(np.int64) << 32 | np.asarray(right.column("b")).astype(np.int64)
    by = np.argsort(known)
    known, n, best = known[by], np.asarray(right.column("n"))[by], np.asarray(right.column("best"))[by]
    key, at = _keys(left)
    times, found = _lists(left.column("times"))[0].astype(np.int64), np.searchsorted(known, key)
    sums = [np.concatenate([[0], np.cumsum(times * x[found])]) for x in (best, n)]
    n_best, count_sum = (pa.array(x[at[1:]] - x[at[:-1]]) for x in sums)
    names = [c for c in left.column_names if c not in ("pair_a", "pair_b", "times", "block")]
    return pa.Table.from_arrays([*(left.column(c) for c in names), n_best, count_sum], [*names, "n_best", "count_sum"])


def link_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best) of all id pairs from rows (a, b, n): summed n, and whether it is the highest of its a."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy(F.col("a").alias("a_")).agg(F.max("n").alias("most"))
    # an A id has as many pairs as B has ids at most
    return counts.join(most, F.col("a") == F.col("a_")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``docs``, but for the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Links are all A-B pairs of token occurrences in one group (see ``align``).
    An id pair counts the rows of ``docs`` that hold it linked.  n_best: links
    whose count is the highest of their A id, ties included; count_sum: the sum
    of all links' counts; groups_sha256: digest of the groups written as
    ``a1,a2|b1;a3|b2``, the empty string for a document without tokens.

    Every row counts as a document of its own, repeated rows and keys too.  Null
    and empty texts have zeros; empty tables give empty tables.  The aligned
    documents are written once to the shared folder and read again in blocks of
    about ``block`` bytes; a task holds one block and its pairs.  A column of the
    input that has the name of an added one is replaced.
    """
    spark = docs.sparkSession
    a_path, b_path = a_path or _public("byte_bpe_50k.json"), b_path or _public("piece_bpe_32k.model")
    rows = docs.select("text", carried(docs, "text").alias("rest"))
    schema = schema_of(rows.drop("text"), **dict(zip(FOUND, FOUND_TYPES, strict=True)), block="long")
    folder = shared_folder(spark)
    rows.mapInArrow(lambda it: _found(it, a_path, b_path, block), schema).write.option("compression", "zstd").parquet(f"{folder}/aligned")
    rows = spark.read.schema(schema).parquet(f"{folder}/aligned")
    parts = rows.select("block", "pair_a", "pair_b").mapInArrow(_pairs, "block long, a int, b int, n long")
    slices = parts.select("block", "a", "b").join(link_counts(parts), ["a", "b"]).select("block", "a", "b", "n", "best")
    schema = schema_of(rows.drop("pair_a", "pair_b", "times", "block"), n_best="long", count_sum="long")
    out = rows.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(_back, schema)
    return released(out, [c for c in docs.columns if c != "text"], COUNTED)
