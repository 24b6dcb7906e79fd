"""Quality classifier on byte n-grams, scored by sharded count joins.

The model is ``quality``'s interpolated modified Kneser-Ney one of order four, on
bytes of which only the digits are taken for one.  Its counts are a Spark table that grows with the trusted text.
The documents' distinct n-grams are joined, sharded by n-gram, to the counts,
contexts' totals and lower orders.  Documents are packed into slabs of some MB; a
slab asks once for each distinct n-gram of its documents, and the answers go back
to the slab, where every document's surprises are added up.  An n-gram is
requested at most once a slab and a context has at most 256 successors, so no key
is hot.  Slabs are shuffled once, and both the requests and the scores are made
from that one shuffle; texts are on disk a second time only where they are part of
the result.  Folds, limits and odd rows are as in ``quality.judge``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import released, schema_of
from .quality import FOLDS, HIGH, LOW, OWN, _judged, _limits, _rows, _unjudged, grams, kneser_ney, learned
from .symbols import row_groups, text_buffer

ORDER, WIDE = 4, 8  # symbols of context and next one; bits of a symbol
BITS = ORDER * WIDE
BYTES = np.arange(256, dtype=np.int64)
BYTES[ord("0"): ord("9") + 1] = ord("0")  # numbers and keys are as likely as any other
SLAB = 16 << 20  # bytes of text; a longer document stands alone
PART = 1 << 19  # bytes worked on at once


def _parts(column, folds):
    """Runs of rows [a, b) with the keys (fold, code) of some of their bytes and each row's edges among them."""
    raw, offsets = text_buffer(column)
    for a, b in row_groups(offsets, PART):
        for lo in range(int(offsets[a]), int(offsets[b]), PART):
            # a long text is read in parts, each after the bytes before it
            hi, before = min(lo + PART, int(offsets[b])), max(int(offsets[a]), lo - ORDER + 1)
            edges = np.clip(offsets[a: b + 1], before, hi) - before
            key = grams(raw[before:hi], edges, BYTES, ORDER, WIDE) | np.repeat(folds[a:b] << BITS, np.diff(edges))
            yield a, b, key[lo - before:], np.maximum(edges - (lo - before), 0)


def _counted(batches):
    for batch in batches:
        for _, _, key, _ in _parts(batch.column("text"), np.asarray(batch.column("fold"))):
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> BITS), pa.array(key & ((1 << BITS) - 1)), pa.array(n)], ["fold", "code", "n"])


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(blob.as_buffer())))


def _slabs(batches):
    """Rows of some MB of text with the distinct keys of their bytes, ascending."""
    for batch in batches:
        _, offsets = text_buffer(batch.column("text"))
        for a, b in row_groups(offsets, SLAB):
            rows = batch.slice(a, b - a)
            found = [np.unique(key) for _, _, key, _ in _parts(rows.column("text"), np.asarray(rows.column("fold")))]
            yield rows, np.unique(np.concatenate([np.empty(0, np.int64), *found]))


def _seen(batches):
    for _, key in _slabs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])


def _packed(batches):
    """Slabs, numbered by task and place in it, each with its keys as differences."""
    first = TaskContext.get().partitionId() << 32
    for i, (rows, key) in enumerate(_slabs(batches)):
        keys = pa.RecordBatch.from_arrays([pa.array(np.diff(key, prepend=0))], ["key"])
        yield pa.RecordBatch.from_arrays([pa.array([first + i]), pa.array([_blob(rows)], pa.binary()), pa.array([_blob(keys)], pa.binary())], ["slab", "rows", "asked"])


def _asked(blob) -> np.ndarray:
    return np.cumsum(np.asarray(_unpacked(blob).column("key")), dtype=np.int64)


def _requests(batches):
    for batch in batches:
        for slab, blob in zip(batch.column("slab"), batch.column("asked")):
            key = _asked(blob)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), slab.as_py())), pa.array(key)], ["slab", "key"])


def _scored(batches, names):
    """Each row's length and mean surprise, as lists beside columns ``names`` of the packed rows."""
    for batch in batches:
        for blob, asked, keys, values in zip(*(batch.column(c) for c in ("rows", "asked", "keys", "surprises"))):
            rows, asked = _unpacked(blob), _asked(asked)
            n, sums = np.diff(text_buffer(rows.column("text"))[1]), np.zeros(rows.num_rows)
            if len(asked):
                keys, values = (np.asarray(x.values if x.is_valid else []) for x in (keys, values))
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
                if not np.array_equal(keys, asked):
                    raise ValueError("a slab's answers are not those it asked for: the documents changed between two reads")
                for a, b, key, edges in _parts(rows.column("text"), np.asarray(rows.column("fold"))):
                    total = np.concatenate([[0.0], np.cumsum(values[np.searchsorted(keys, key)])])
                    sums[a:b] += total[edges[1:]] - total[edges[:-1]]
            mean = np.where(n > 0, sums / np.maximum(n, 1), np.nan)
            told = blob.as_py() if names == rows.schema.names else _blob(rows.select(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([told], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([mean.tolist()], pa.list_(pa.float64()))],
                ["rows", "n_symbols", "surprise"])


def _opened(scored: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` of the packed rows with n_symbols and surprise."""
    def run(batches):
        for batch in batches:
            for blob, n, mean in zip(*(batch.column(c) for c in ("rows", "n_symbols", "surprise"))):
                told = _unpacked(blob)
                yield pa.RecordBatch.from_arrays(
                    [*(told.column(c) for c in names), n.values, pa.array(np.asarray(mean.values), from_pandas=True)], [*names, "n_symbols", "surprise"])

    return scored.mapInArrow(run, schema_of(rows.select(*names), n_symbols="long", surprise="double"))


def score(rows: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """Slabs of columns ``names`` of ``rows`` (text, fold and others) with each row's n_symbols and surprise, by the model of ``counts`` (fold, code, n)."""
    seen = rows.select("text", "fold").mapInArrow(_seen, "key long").distinct()
    needed = seen.select(F.shiftright("key", BITS).alias("fold"), F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)).alias("code"))
    model = kneser_ney(counts, cut(needed), ORDER, WIDE)
    model = model.select(F.shiftleft("fold", BITS).bitwiseOR(F.col("code")).alias("key"), (-F.log("p")).alias("surprise"))
    # both uses of the slabs take all their columns, so that Spark shuffles them once for the two
    slabs = rows.mapInArrow(_packed, "slab long, rows binary, asked binary").repartition("slab")
    requests = slabs.mapInArrow(_requests, "slab long, key long")
    # a slab's lists are no longer than its text; both are filled row by row, none is null
    told = requests.join(model, "key").groupBy("slab").agg(F.collect_list("key").alias("keys"), F.collect_list("surprise").alias("surprises"))
    return cut(slabs.join(told, "slab", "left").mapInArrow(partial(_scored, names=names), "rows binary, n_symbols array<long>, surprise array<double>"))


def judge(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, with_text: bool = True) -> DataFrame:
    """``docs`` with n_symbols (bytes), perplexity (per byte), deviation and kept, as ``quality.judge`` defines them, by the model of byte n-grams.

    ``with_text=False`` leaves the text column out, and the texts are not written again beside their scores.
    """
    rows, own = _rows(docs), [*OWN, "kept"]
    columns = [c for c in docs.columns if with_text or c != "text"]
    counts = cut(learned(docs, labels, _counted))
    if counts.select("fold").distinct().count() < FOLDS:
        return released(_unjudged(rows), columns, own)
    scored = score(rows, counts, [c for c in rows.columns if with_text or c != "text"])
    limits = cut(_limits(_opened(scored, rows, ["doc", "lang"]), labels, low, high))
    told = [*["text"] * with_text, "lang", "rest"]
    return released(_judged(_opened(scored, rows, told), limits), columns, own)
