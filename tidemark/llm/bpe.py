"""Byte-level BPE as a bounded-lookahead transducer, and its inverse.

A text runs through a splitter into pieces, and each piece's bytes through a
transducer that emits a token as soon as no later byte can change it.  The
merge list itself says how many bytes that takes (``Merges.lookahead``), so a
piece of any length is encoded with a window of a few hundred bytes.  Decoding
feeds token bytes to an incremental UTF-8 machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, released, schema_of

# Fixed value: how byte-level vocabularies of this family split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 16  # characters split at once
CACHED = 1 << 19  # pieces remembered by a worker
OWN = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list, and the lookahead that makes tokens stable."""

    def __init__(self, tokens: dict[int, bytes], pairs: list[tuple[int, int, int]]):
        """``pairs``: (left, right, merged) ids, first merge first."""
        self.tokens = tokens
        self.of_byte = {b[0]: i for i, b in tokens.items() if len(b) == 1}
        self.ranks = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.merged = [c for _, _, c in pairs]
        self.lookahead = self._lookahead(pairs)

    def _lookahead(self, pairs) -> int | None:
        """Bytes after a token's end that can still change it, at most.

        Let two texts agree up to byte w.  Merges run in rank order, since a
        token's parts are made before it is used (else the answer is None and
        pieces are encoded whole).  Up to some border, w at first, both texts
        have the same tokens; the border moves left only when a merge (x, y)
        happens in one of them, x ending at the border and y starting there.
        For the next such merge (x', y') of higher rank, x must be y' or the
        left end of y', and still free, or just merged, when its right
        neighbour in y' joins it.  So the farthest border is a longest path
        over merges, found in one pass by rank.
        """
        made = {c: (r, a) for r, (a, b, c) in enumerate(pairs)}
        if len(made) < len(pairs) or any(made.get(p, (-1,))[0] >= r for r, (a, b, _) in enumerate(pairs) for p in (a, b)):
            return None
        by_left: dict[int, tuple[list[int], list[int]]] = {}
        farthest = 0
        for r, (a, b, _) in enumerate(pairs):
            best, at, bound = 0, b, r
            while True:  # y and the left ends inside it
                if at in by_left:
                    ranks, reach = by_left[at]
                    k = bisect_left(ranks, bound)
                    if k:
                        best = max(best, reach[k - 1])
                if at not in made:
                    break
                formed, left = made[at]
                at, bound = left, formed + 1
            own = len(self.tokens[a]) + best
            ranks, reach = by_left.setdefault(a, ([], []))
            ranks.append(r)
            reach.append(max(own, reach[-1] if reach else 0))
            farthest = max(farthest, own)
        return farthest

    def window(self, piece: bytes) -> list[int]:
        """All merges of a short run of bytes, least rank and then leftmost first."""
        ids, ranks, merged, never = [self.of_byte[x] for x in piece], self.ranks, self.merged, len(self.merged)
        if len(ids) < 40:
            row = [ranks.get(p, never) for p in zip(ids, ids[1:], strict=False)]
            while row and (least := min(row)) < never:
                i = row.index(least)
                ids[i: i + 2] = [merged[least]]
                del row[i]
                if i:
                    row[i - 1] = ranks.get((ids[i - 1], ids[i]), never)
                if i < len(row):
                    row[i] = ranks.get((ids[i], ids[i + 1]), never)
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = merged[ranks[a, b]], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return [x for x in ids if x >= 0]

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in chunks, each as soon as it is stable."""
        held = bytearray()
        for chunk in chunks:
            held += chunk
            if self.lookahead is None:
                continue
            while len(held) > 4 * self.lookahead:
                size = 4 * self.lookahead
                done = 0
                for token in self.window(bytes(held[:size])):
                    if done + len(self.tokens[token]) > size - self.lookahead:
                        break
                    done += len(self.tokens[token])
                    yield token
                del held[:done]
        yield from self.window(bytes(held))

    def piece(self, piece: bytes) -> list[int]:
        if len(piece) <= 4 * (self.lookahead or len(piece)):
            return self.window(piece)
        return list(self.transduce(piece[i: i + 4096] for i in range(0, len(piece), 4096)))


class _Pieces(dict):
    """Ids (little-endian 32-bit) of pieces seen; a full one starts anew."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(self.merges.piece(raw), "<u4").tobytes()
        if len(raw) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of a tokenizer file (``tokenizers`` JSON of byte-level BPE)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        names = _byte_names()
        vocabulary = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ordinary = {i: bytes(names[c] for c in t) for t, i in vocabulary.items() if t not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges(ordinary, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.bytes = ordinary | {i: t.encode() for t, i in special.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile(r"\S(?=\s)")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = _Pieces(self.merges)

    def chunks(self, text: str) -> Iterator[str]:
        """Parts of about CHUNK characters; cuts fall before white space, where pieces always end."""
        a = 0
        while len(text) - a > CHUNK:
            found = self.cut.search(text, a + CHUNK - 1)
            if not found:
                break
            yield text[a: found.end()]
            a = found.end()
        yield text[a:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        out = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for chunk in self.chunks(part):
                    out += map(self.pieces.__getitem__, self.split(chunk))
        return b"".join(out)

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids that arrive in runs; what isn't UTF-8 becomes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for run in ids:
            yield machine.decode(b"".join(map(self.bytes.__getitem__, run)))
        yield machine.decode(b"", True)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(batches, path, with_ids):
    own = codec(path)
    for batch in batches:
        column = batch.column("text")
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            n, lists, sha, back = [], [], [], []
            for text in column.slice(a, 256):
                raw = own.encode(text.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                digest = hashlib.sha256()
                for x in own.decode(ids[i: i + CHUNK].tolist() for i in range(0, len(ids), CHUNK)):
                    digest.update(x.encode())
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(digest.hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [pa.array(n, pa.int64()), *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), pa.array(sha), pa.array(back)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *(c for c in OWN if with_ids or c != "ids")])


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (unless ``with_ids`` is unset), ids_sha256 and decoded_sha256.

    ``path`` names the tokenizer file, found at that place on every executor
    (default: the public byte-level vocabulary of 50,257 ids).  Special strings
    in a text become their ids, as the tokenizers library has it.  ids_sha256 is
    the hex digest of the ids as little-endian unsigned 32-bit integers, and
    decoded_sha256 that of the text decoded from these ids.

    A null text counts as empty: no tokens, and the digests of nothing; the text
    stays null.  Rows are independent, so repeated rows and keys, null keys and
    empty tables need no rule.  A column of the input that has the name of an
    added one is replaced.
    """
    path = path or _public("byte_bpe_50k.json")
    own = [c for c in OWN if with_ids or c != "ids"]
    rows = docs.select("text", carried(docs, "text").alias("rest"))
    types = dict(zip(OWN, ("long", "array<int>", "string", "string"), strict=True))
    out = rows.mapInArrow(lambda it: _encoded(it, path, with_ids), schema_of(rows, **{c: types[c] for c in own}))
    return released(out, docs.columns, own)


def _decoded(batches, path):
    own = codec(path)
    for batch in batches:
        text = [None if x is None else "".join(own.decode(x[i: i + CHUNK] for i in range(0, len(x), CHUNK))) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with the ``text`` of its ``ids``; null ids give a null text."""
    path = path or _public("byte_bpe_50k.json")
    rows = tokens.select(F.col("ids").cast("array<int>").alias("ids"), carried(tokens, "ids").alias("rest"))
    out = rows.mapInArrow(lambda it: _decoded(it, path), schema_of(rows, text="string"))
    return released(out, tokens.columns, ["text"], ("ids",))


def _public(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
