"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are 32 classes of bytes (white space, the letters a-z,
capitals, digits, two kinds of signs, bytes above 0x7F) and its order is four.
Counts are taken over all trusted documents and summed by Spark.  Each order's
table is joined, sharded by context, to its contexts' totals and to the next
lower order, which gives one probability for each of the 32^4 sequences.  That
table has a size no corpus changes (4 MB a fold), so the join of the documents'
n-grams with it runs where documents are read, and texts never move for it.
Documents fall into two folds by a hash of their key, and each is scored by the
model of the other fold's trusted documents, never by one that has read it.

A document's mean surprise is compared with its language's: the deviation,
scaled by the root of the length as a mean's is, must lie between two quantiles
of the deviations of that language's trusted documents.  Those are held out, as
each is scored by a model that has not read it, so that about ``FALSE_REJECT``
of the trusted documents are rejected.
"""

from __future__ import annotations

from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import carried, key_column, released, schema_of
from .symbols import row_groups, text_buffer

FOLDS = 2
ORDER, WIDE = 4, 5  # symbols of context and next one; bits of a symbol
SIZE = 1 << (ORDER * WIDE)
FALSE_REJECT = 0.002  # share of held-out trusted documents beyond the limits
LOW, HIGH = FALSE_REJECT / 2, 1 - FALSE_REJECT / 2  # their quantiles
TRUSTED = 1_000_000  # keys of trusted documents sent to every task (8 bytes each); more are joined by a shuffle of the texts
BROADCAST = 10_000  # languages whose limits are sent to every task; more are joined by a shuffle
OWN = ["n_symbols", "perplexity", "deviation"]

CLASS = np.full(256, 30, np.int64)  # signs and control characters
CLASS[0x80:] = 31
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[ord("a"): ord("z") + 1] = np.arange(1, 27)
CLASS[ord("A"): ord("Z") + 1] = 27
CLASS[ord("0"): ord("9") + 1] = 28
CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 29


def grams(raw: np.ndarray, offsets: np.ndarray, symbols: np.ndarray = CLASS, order: int = ORDER, wide: int = WIDE) -> np.ndarray:
    """The code of each symbol with its context; symbol 0 (of the classes: white space) stands before a text."""
    now = symbols[raw]
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    code = now.copy()
    for back in range(1, order):
        before = np.zeros(len(raw), np.int64)
        before[back:] = now[:-back]
        before[place < back] = 0
        code |= before << (wide * back)
    return code


def _counts(batches):
    total = np.zeros((FOLDS, SIZE), np.int64)
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        folds = np.asarray(batch.column("fold"))
        for a, b in row_groups(offsets, 1 << 20):
            at = offsets[a: b + 1] - offsets[a]
            code = grams(raw[offsets[a]: offsets[b]], at) + np.repeat(folds[a:b] * SIZE, np.diff(at))
            total += np.bincount(code, minlength=FOLDS * SIZE).reshape(FOLDS, SIZE)
    fold, code = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(code), pa.array(total[fold, code])], ["fold", "code", "n"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Keys of the documents that all their labels call good and not toxic."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(1))).alias("bad")).where("good = 1 and bad = 0").select("doc")


def _discounts(table: DataFrame) -> dict[int, list[float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and above in each fold, from the counts of counts."""
    found = {}
    for row in table.groupBy("fold").agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).collect():  # FOLDS rows
        fold, n1, n2, n3, n4 = (float(x) for x in row)
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        out = [i - (i + 1) * y * (b / a) if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        found[int(fold)] = [min(max(d, 0.05), float(i)) for i, d in zip((1, 2, 3), out, strict=True)]
    return found


def kneser_ney(counts: DataFrame, needed: DataFrame | None = None, top: int = ORDER, wide: int = WIDE) -> DataFrame:
    """(fold, code, p): the probability of the last symbol after the others; ``counts`` is (fold, code, n).

    For the distinct (fold, code) of ``needed``, by default for every code.
    """
    spark = counts.sparkSession
    tables = {top: cut(counts)}
    for order in range(top - 1, 0, -1):  # in how many contexts one symbol longer a sequence is seen
        shorter = F.col("code").bitwiseAND(F.lit((1 << (wide * order)) - 1))
        tables[order] = cut(tables[order + 1].groupBy("fold", shorter.alias("code")).agg(F.count("*").alias("n")))
    lower = spark.range(FOLDS).select(F.col("id").alias("fold"), F.lit(0).cast("long").alias("code"), F.lit(1.0 / (1 << wide)).alias("p"))
    for order in range(1, top + 1):
        table = tables[order].withColumn("context", F.shiftright("code", wide))
        taken = F.lit(None).cast("double")
        for fold, d in _discounts(table).items():
            taken = F.when(F.col("fold") == fold, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(taken)
        totals = table.groupBy("fold", "context").agg(F.sum("n").alias("total"), F.sum(taken).alias("left"))
        seen = table.select("fold", "code", (F.col("n") - taken).alias("kept"))
        bits = wide * order
        own = F.lit((1 << bits) - 1)
        if needed is None:
            every = spark.range(FOLDS << bits).select(F.shiftright("id", bits).alias("fold"), F.col("id").bitwiseAND(own).alias("code"))
        else:
            every = needed if order == top else needed.select("fold", F.col("code").bitwiseAND(own).alias("code")).distinct()
        under = F.col("code").bitwiseAND(F.lit((1 << (bits - wide)) - 1))
        joined = every.withColumn("below", under).withColumn("context", F.shiftright("code", wide)).join(totals, ["fold", "context"], "left")
        joined = joined.join(seen, ["fold", "code"], "left").join(
            lower.select("fold", F.col("code").alias("below"), F.col("p").alias("p_below")), ["fold", "below"])
        p = (F.coalesce("kept", F.lit(0.0)) + F.col("left") * F.col("p_below")) / F.col("total")
        lower = joined.select("fold", "code", F.when(F.col("total") > 0, p).otherwise(F.col("p_below")).alias("p"))
        if order < top:
            lower = cut(lower)
    return lower


def fold_of(doc):
    """The fold of a document; a null key is in the first."""
    return F.pmod(F.xxhash64(doc), F.lit(FOLDS)).cast("long")


def learned(docs: DataFrame, labels: DataFrame, counted=_counts) -> DataFrame:
    """(fold, code, n): counts of the trusted documents that the documents of each fold are scored by."""
    trusted = cut(trusted_ids(labels))
    trusted = F.broadcast(trusted) if trusted.count() <= TRUSTED else trusted
    texts = docs.select(key_column(docs).alias("doc"), "text").join(trusted, "doc", "left_semi")
    counts = texts.select(fold_of(F.col("doc")).alias("fold"), "text").mapInArrow(counted, "fold long, code long, n long")
    others = F.explode(F.array(*(F.pmod(F.col("fold") + i, F.lit(FOLDS)) for i in range(1, FOLDS))))
    return counts.select(others.alias("fold"), "code", "n").groupBy("fold", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Surprise (-ln p) of every code for the documents of each fold, trained on the trusted documents of the others.

    None where a fold would have nothing to learn from.
    """
    counts = learned(docs, labels)
    found = kneser_ney(counts).select((F.col("fold") * SIZE + F.col("code")).cast("int").alias("at"), F.col("p").cast("float").alias("p")).toArrow()
    out = np.empty(FOLDS * SIZE, np.float32)
    out[np.asarray(found.column("at"))] = -np.log(np.asarray(found.column("p")))
    out = out.reshape(FOLDS, SIZE)
    return None if any(np.allclose(x, x[0]) for x in out) else out  # an untrained model has one value


def _scores(batches, table, names):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        folds = np.asarray(batch.column("fold"))
        sums, n = np.zeros(batch.num_rows), np.diff(offsets)
        for a, b in row_groups(offsets):
            for lo in range(int(offsets[a]), max(int(offsets[b]), int(offsets[a]) + 1), 1 << 20):
                # a long text is read in parts, each after the symbols before it
                hi, before = min(lo + (1 << 20), int(offsets[b])), max(int(offsets[a]), lo - ORDER + 1)
                edges = np.clip(offsets[a: b + 1], before, hi) - before
                code = grams(raw[before:hi], edges) + np.repeat(folds[a:b] * SIZE, np.diff(edges))
                total = np.concatenate([[0.0], np.cumsum(table.ravel()[code], dtype=float)])
                edges = np.maximum(edges, lo - before)
                sums[a:b] += total[edges[1:]] - total[edges[:-1]]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(n), pa.array(np.where(n > 0, sums / np.maximum(n, 1), np.nan), from_pandas=True)],
            [*names, "n_symbols", "surprise"])


def _scored(rows: DataFrame, table: np.ndarray, names: list[str]) -> DataFrame:
    return rows.mapInArrow(partial(_scores, table=table, names=names), schema_of(rows.select(*names), n_symbols="long", surprise="double"))


def _limit(q, spread, n, share: float):
    """The quantile itself; where the sample is too small to hold it, the normal one if that lies further out."""
    normal = NormalDist().inv_cdf(share) * F.coalesce(spread, F.lit(0.0))
    further = F.least(q, normal) if share < 0.5 else F.greatest(q, normal)
    return F.when(n * min(share, 1 - share) >= 1, q).otherwise(further)


def _limits(scores: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    """(lang, center, least, most) from the trusted documents; lang '' stands for all together."""
    trusted = scores.where("n_symbols > 0").join(trusted_ids(labels), "doc", "left_semi").select("doc", "n_symbols", "surprise", "lang")
    both = cut(trusted.unionByName(trusted.withColumn("lang", F.lit(""))).where("lang is not null"))
    centers = both.groupBy("lang").agg((F.sum(F.col("surprise") * F.col("n_symbols")) / F.sum("n_symbols")).alias("center"))
    centers = cut(centers)
    centers = F.broadcast(centers) if centers.count() <= BROADCAST else centers  # else a language of half the rows would be one task's
    off = (F.col("surprise") - F.col("center")) * F.sqrt("n_symbols")
    q = both.join(centers, "lang").groupBy("lang", "center").agg(
        F.percentile_approx(off, [low, high], 100_000).alias("q"), F.stddev(off).alias("spread"), F.count("*").alias("n"))
    least, most = (_limit(F.col("q")[i], F.col("spread"), F.col("n"), share) for i, share in enumerate((low, high)))
    return q.select("lang", "center", least.alias("least"), most.alias("most"))


def _judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds perplexity, deviation (0 at the center, beyond -1 or 1 where rejected) and kept."""
    common = limits.where("lang = ''").select(*(F.col(c).alias(f"{c}_all") for c in ("center", "least", "most")), F.lit(1).alias("one"))
    own = limits.where("lang <> ''").withColumnRenamed("lang", "limits_of")
    own = F.broadcast(own) if limits.count() <= BROADCAST else own
    joined = scores.withColumn("one", F.lit(1)).join(own, F.col("lang") == F.col("limits_of"), "left").join(F.broadcast(common), "one", "left")
    center, least, most = (F.coalesce(c, f"{c}_all") for c in ("center", "least", "most"))
    off = (F.col("surprise") - center) * F.sqrt("n_symbols")
    deviation = F.when(off > 0, off / most).otherwise(-off / least)
    return joined.withColumn("perplexity", F.exp("surprise")).withColumn("deviation", deviation).withColumn(
        "kept", F.coalesce(F.abs("deviation") <= 1, F.lit(True)))


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    key = key_column(docs)
    return docs.select(key.alias("doc"), fold_of(key).alias("fold"), "text", lang.alias("lang"), carried(docs, "text").alias("rest"))


def _unjudged(rows: DataFrame) -> DataFrame:
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("*", n.alias("n_symbols"), *(F.lit(None).cast("double").alias(c) for c in OWN[1:]), F.lit(True).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``docs`` with n_symbols, perplexity (per byte), deviation and kept.

    ``labels`` (doc_id, quality, toxic) tells which documents are trusted: those
    with labels, all of quality 1 and toxic 0.  Limits are the ``low`` and
    ``high`` quantiles of the trusted documents of the same ``lang``, or with too
    few of them for such a quantile the normal distribution's, if further out; a
    language without trusted documents, and a null one, has the limits of all
    together.  Documents beyond are not kept.

    An empty or null text has no perplexity and is kept; so is every document
    where nothing is trusted in one of the folds.  Rows are judged one by one, repeated ones alike;
    a null doc_id is never trusted.  An empty table gives an empty table.  A
    column of the input that has the name of an added one is replaced.
    """
    rows = _rows(docs)
    table = train(docs, labels)
    own = [*OWN, "kept"]
    if table is None:
        return released(_unjudged(rows), docs.columns, own)
    limits = cut(_limits(_scored(rows.select("doc", "fold", "text", "lang"), table, ["doc", "lang"]), labels, low, high))
    return released(_judged(_scored(rows, table, ["text", "lang", "rest"]), limits), docs.columns, own)
