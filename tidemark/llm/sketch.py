"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least 48-bit hashes of a set.  Sketches of parts merge to
the sketch of the whole, and two of them estimate resemblance, containment and
the number of distinct shingles.  As a string a sketch is the base64 of its
hashes in ascending order, six bytes each, so equal sets have equal strings; a
sketch of fewer than k hashes is the whole set and its estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, key_column, released, schema_of
from .symbols import SLICE, U, row_groups, shingles, text_buffer, word_hashes, words

K = 256
BITS = 48
OWN = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def sketches(raw: np.ndarray, offsets: np.ndarray, size: int, k: int) -> list[np.ndarray]:
    """The k least distinct shingle hashes of each text."""
    out = []
    for a, b in row_groups(offsets):
        part = raw[offsets[a]: offsets[b]]
        start, end, at = words(part, offsets[a: b + 1] - offsets[a])
        values, at = shingles(word_hashes(part, start, end), at, size)
        values = values >> U(64 - BITS)
        out += [_least(values[x:y], k) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """k least distinct values, ascending."""
    if len(values) > 8 * k:  # most of a long text's hashes are far too large
        at = 2 * k
        while True:
            found = np.unique(np.partition(values, at)[: at + 1])
            if len(found) >= k or at >= len(values) - 1:
                return found[:k]
            at = min(2 * at, len(values) - 1)
    return np.unique(values)[:k]


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the parts' sets."""
    return np.unique(np.concatenate(parts))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union; two empty sets are alike."""
    union = merge(a, b, k=k)
    return float(len(_both(a, b, union[-1])) / len(union)) if len(union) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's set that is in b's; an empty set is contained in any."""
    if not len(a):
        return 1.0
    union = merge(a, b, k=k)
    inside = a[a <= union[-1]]
    return len(_both(a, b, union[-1])) / len(inside) if len(inside) else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) + 1) * 2.0**BITS


def _both(a, b, top):
    both = np.intersect1d(a, b, assume_unique=True)
    return both[both <= top]


def to_string(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(U)


def _dealt(batches, bounds, last):
    """Each row to the bucket of its key, and border rows also to the bucket they follow."""
    bounds = np.array(bounds, np.int64)
    for batch in batches:
        key = np.asarray(batch.column("doc"))
        bucket = np.searchsorted(bounds, key)
        follows = np.searchsorted(bounds, key, side="right")
        extra = np.flatnonzero(follows > bucket)
        wrap = np.flatnonzero(key == last)
        for rows, into, tail in ((np.arange(len(key)), bucket, 0), (extra, follows[extra], 1), (wrap, np.zeros(len(wrap), np.int64), 1)):
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(rows)).columns, pa.array(into.astype(np.int32)), pa.array(np.full(len(rows), tail, np.int32))],
                    [*batch.schema.names, "bucket", "tail"])


def _pairs(batches) -> Iterator[pa.RecordBatch]:
    """Runs of rows with the next row's text beside them, without the tails."""
    held = None
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            rows = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks().to_batches()[0]
            n = rows.num_rows - 1
            main = pa.array(np.asarray(rows.column("tail"))[:n] == 0)
            now = rows.slice(0, n).filter(main)
            if now.num_rows:
                yield now, rows.column("text").slice(1, n).filter(main)
            held = rows.slice(n)
    # a bucket ends with its tail, so the row still held is none of the documents


def _fingerprinted(batches, size, k, names):
    for rows, following in _pairs(batches):
        texts = [x.as_py() or "" for x in rows.column("text")]
        after = [x.as_py() or "" for x in following]
        a = 0
        while a < len(texts):  # groups of bounded size
            b, load = a, 0
            while b < len(texts) and (b == a or load < SLICE):
                load += len(texts[b]) + len(after[b])
                b += 1
            own, nxt = texts[a:b], after[a:b]
            edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(own, nxt, strict=True)]
            # a following text is in most cases the next row's own
            first, second, third = (sketches(*text_buffer(pa.array(x, pa.string())), size, k) for x in (own, edited, nxt[-1:]))
            third = [*first[1:], third[0]]
            for i in range(len(own) - 1):
                if nxt[i] != own[i + 1]:
                    third[i] = sketches(*text_buffer(pa.array([nxt[i]], pa.string())), size, k)[0]
            out = [
                pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([to_string(s) for s in first]), pa.array([to_string(s) for s in second]),
                pa.array([resemblance(x, y, k) for x, y in zip(first, second, strict=True)]),
                pa.array([resemblance(x, y, k) for x, y in zip(first, third, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(a, b - a) for c in names), *out], [*names, *OWN])
            a = b


def fingerprint(docs: DataFrame, size: int = 5, k: int = K) -> DataFrame:
    """``docs`` with the fingerprint of each text and of its edited text, and their likeness.

    Words are runs of characters other than space and 0x09-0x0D; shingles have
    ``size`` words, and a text of fewer is one shingle.  The edited text has the
    last floor(n / 2) of its n code points replaced by the first as many (or
    all) of the next document in descending ``doc_id``; after the last comes
    the first.  Added: n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (estimated resemblance to the edited text and to
    the next document's text).

    Documents are dealt into ranges of ``doc_id`` at quantiles of all keys; a
    range also gets the row that follows it, so each text moves once and a task
    holds few at a time.  A null text counts as empty, and two empty texts are
    alike.  A null doc_id is the least key; rows that repeat one follow each
    other in the order of a hash of their text.  An empty table gives an empty
    table.  A column of the input that has the name of an added one is replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(key_column(docs).alias("doc"), F.xxhash64("text").alias("tag"), "text", carried(docs, "text").alias("rest"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / parts for i in range(1, parts)]
    quantiles = F.percentile_approx("doc", cuts, 100 * parts) if cuts else F.array().cast("array<long>")
    bounds, last = rows.agg(quantiles, F.max("doc")).first()
    bounds = sorted(set(bounds or []) - {last})
    dealt = rows.mapInArrow(partial(_dealt, bounds=bounds, last=last), schema_of(rows, bucket="int", tail="int"))
    placed = dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "tail", F.desc("doc"), "tag")
    types = dict(zip(OWN, ("long", "string", "string", "string", "double", "double"), strict=True))
    names = ["text", "rest"]
    out = placed.mapInArrow(partial(_fingerprinted, size=size, k=k, names=names), schema_of(rows.select(*names), **types))
    return released(out, docs.columns, OWN)


def _sketch_rows(batches, size, k, has_key):
    for batch in batches:
        found = sketches(*text_buffer(batch.column("text")), size, k)
        n = np.array([len(x) for x in found])
        key = batch.column("key").take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([*found, np.empty(0, U)]).astype(np.int64))], ["key", "hash"])


def _first_k(batches, k):
    key, last, seen = None, None, 0
    fresh = True
    for batch in batches:
        keep = []
        for i, (x, h) in enumerate(zip(batch.column("key").to_pylist(), batch.column("hash").to_pylist(), strict=True)):
            if fresh or x != key:
                key, last, seen, fresh = x, None, 0, False
            if h != last and seen < k:
                last, seen = h, seen + 1
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select(["key", "hash"])


def merged_fingerprints(docs: DataFrame, by: str, size: int = 5, k: int = K) -> DataFrame:
    """One fingerprint (with the estimated number of distinct shingles) for all texts of each value of column ``by``.

    Each text is cut down to k hashes where it is read; a value's hashes are
    merged in 32 shares by hash and then to one, in constant memory, so a value
    may hold any part of the rows.  Null is a value of its own; a value whose
    texts are all empty or null has no row.
    """
    rows = docs.select(F.col(by).alias("key"), "text")
    rows = rows.mapInArrow(partial(_sketch_rows, size=size, k=k, has_key=True), schema_of(rows.select("key"), hash="long"))
    schema = rows.schema
    share = F.col("hash").bitwiseAND(F.lit(31))
    shares = rows.repartition("key", share).sortWithinPartitions("key", share, "hash").withColumn("part", share)
    shares = shares.mapInArrow(partial(_first_of_shares, k=k), schema)
    out = shares.repartition("key").sortWithinPartitions("key", "hash").mapInArrow(partial(_first_k, k=k), schema)
    hashes = out.groupBy("key").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))  # k at most
    packed = F.array_join(F.transform("hashes", lambda h: F.lpad(F.hex(h), 12, "0")), "")
    n = F.size("hashes")
    estimate = F.when(n < k, n.cast("double")).otherwise((k - 1) / (F.element_at("hashes", -1) + 1.0) * 2.0**BITS)
    return hashes.select(F.col("key").alias(by), F.base64(F.unhex(packed)).alias("fingerprint"), estimate.alias("n_distinct"))


def _first_of_shares(batches, k):
    def cells():
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.StructArray.from_arrays([batch.column("key"), batch.column("part")], ["key", "part"]), batch.column("hash")], ["key", "hash"])

    for out in _first_k(cells(), k):
        yield pa.RecordBatch.from_arrays([out.column("key").field("key"), out.column("hash")], ["key", "hash"])
