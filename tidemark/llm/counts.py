"""Token counts by byte-pair merging with a heap and a linked list.

A piece starts as a list of symbols, each linked to its neighbours.  A heap
holds the adjacent pairs the merge list knows, least rank and then leftmost
first.  Popping a pair joins its two symbols and pushes the two pairs this makes;
pairs whose symbols are gone or changed are skipped when they come up.  A merge
shortens the list by one, so the count is the initial symbols minus the merges,
and no token ids are made or kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, PATTERN, _byte_names, _public
from .frames import carried, released, schema_of

LIMIT = 512  # tokens beyond which a document is over the limit
CACHED = 1 << 18  # pieces whose count a worker remembers, and as many of those seen before
OWN = ["n_bytes", "n_tokens", "over_limit"]

Pairs = dict[tuple[object, object], tuple[float, object]]  # (left, right): rank and joined symbol


def merged(symbols: list, pairs: Pairs) -> list:
    """The symbols left of one piece, by popping the pair of least rank until none is known."""
    heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in pairs]
    if not heap:
        return symbols
    heapq.heapify(heap)
    n, symbols = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or (symbols[i], symbols[j]) != pair:
            continue  # one of the two has merged meanwhile
        symbols[i], symbols[j] = joined, _ = pairs[pair][1], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (p := (joined, symbols[k])) in pairs:
                heapq.heappush(heap, (pairs[p][0], i, p))
        k = before[i]
        if k >= 0 and (p := (symbols[k], joined)) in pairs:
            heapq.heappush(heap, (pairs[p][0], k, p))
    return [x for x in symbols if x is not None]


class Counter(dict):
    """Counts of pieces seen; a full one keeps those of its last half."""

    def __init__(self, pieces: Callable[[str], Iterable[str]], count: Callable[[str], int]):
        self.pieces, self.count, self.old = pieces, count, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.count(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n

    def __call__(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))


def _chunks(text: str, cut) -> Iterator[str]:
    """Parts of about CHUNK characters, cut where ``cut`` matches: no piece crosses such a place."""
    a = 0
    while len(text) - a > CHUNK and (found := cut.search(text, a + CHUNK - 1)):
        yield text[a: found.end()]
        a = found.end()
    yield text[a:]


def _json_counter(path: str) -> Counter:
    """For a BPE file of the tokenizers library: byte-level, or with other normalisers, splitters and word ends."""
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
        raise ValueError(f"{path} is no plain BPE tokenizer")
    suffix = model["end_of_word_suffix"] or ""
    lists = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = {(a, b): (r, a.removesuffix(suffix) + b if suffix else a + b) for r, (a, b) in enumerate(lists)}
    special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
    at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def parts(text: str):
        return at_special.split(text) if at_special else [text]

    if not spec["normalizer"] and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not suffix:
        name = {b: c for c, b in _byte_names().items()}
        find, cut = regex.compile(PATTERN).findall, regex.compile(r"\S(?=\s)")

        def pieces(text):
            if len(text) <= CHUNK and not (at_special and at_special.search(text)):
                return find(text)
            return (p for part in parts(text) for p in ([part] if part in special else chain.from_iterable(map(find, _chunks(part, cut)))))

        def symbols(piece):
            return [name[x] for x in piece.encode()]
    else:
        own = Tokenizer.from_file(path)

        def pieces(text):
            for part in parts(text):
                if part in special:
                    yield part
                else:
                    part = own.normalizer.normalize_str(part) if own.normalizer else part
                    yield from (p for p, _ in own.pre_tokenizer.pre_tokenize_str(part))

        def symbols(piece):
            return [*piece[:-1], piece[-1] + suffix]

    return Counter(pieces, lambda p: 1 if p in special else len(merged(symbols(p), pairs)))


def _model_counter(path: str) -> Counter:
    """For a BPE model of sentencepiece with byte fallback; unknown characters count their bytes."""
    import regex
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    ids = range(own.get_piece_size())
    plain = {own.id_to_piece(i): own.get_score(i) for i in ids if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))}
    if any(s != int(s) for s in plain.values()) or not any(map(own.is_byte, ids)):
        raise ValueError(f"{path} is no BPE model with byte fallback")
    pairs = {(p[:i], p[i:]): (-s, p) for p, s in plain.items() for i in range(1, len(p))}
    # no piece has a blank inside or at its end, so none crosses the start of a word
    apart = not any(regex.search("[^▁]▁", p) for p in plain)
    find = regex.compile("▁*[^▁]+|▁+").findall if apart else (lambda text: [text])

    def count(piece):
        return sum(1 if s in plain else len(s.encode()) for s in merged(list(piece), pairs))

    return Counter(lambda text: find(own.normalize(text)) if text else [], count)


@cache
def counter(path: str) -> Counter:
    """The counter of a tokenizer file: ``.json`` (tokenizers) or ``.model`` (sentencepiece)."""
    return _model_counter(path) if path.endswith(".model") else _json_counter(path)


def _counted(batches, path):
    own = counter(path)
    for batch in batches:
        n = [own(x.as_py() or "") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n_tokens"])


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens above ``limit``).

    ``path`` names the tokenizer file, found at that place on every executor
    (default: the public byte-level vocabulary of 50,257 ids).  Counts are those
    of its library: no begin or end tokens, and special strings inside a text as
    the library's default has it.

    A null text counts as empty, 0 bytes and 0 tokens, and stays null.  Rows are
    independent, so repeated rows and keys, null keys and empty tables need no
    rule.  Texts of any length are counted whole; one run without white space is
    held as one list of symbols.  A column of the input that has the name of an
    added one is replaced.
    """
    path = path or _public("byte_bpe_50k.json")
    rows = docs.select("text", carried(docs, "text").alias("rest"))
    out = rows.mapInArrow(lambda it: _counted(it, path), schema_of(rows, n_tokens="long"))
    out = out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
    return released(out, docs.columns, OWN)
