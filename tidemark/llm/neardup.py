"""Near-duplicate documents: SuperMinHash, banding, verification, grouping.

1. Texts become sets of word shingles, each with a SuperMinHash signature
   (``minhash``) cut into bands.  Equal sets are one class from here on.
2. Classes that share a band meet in a bucket.  In a bucket each class is
   compared with the bucket's least one, and after grouping with its best
   linked one: work grows with the bucket's rows, not with their pairs.
3. Classes of buckets that still hold several groups go through an exact
   prefix-and-position join: two sets of resemblance t share a shingle among
   the rarest few of each, with enough shingles behind it.  Pairs already
   grouped are left out.  Nothing is capped, so only a pair that shares no band
   is missed: (1 - t^rows)^bands, below one in a million at t = 0.8.
4. Every link is confirmed on the full sets; links are grouped by connected
   components (``graph``).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import carried, key_column, released
from .graph import components
from .minhash import band_hashes, distinct_by_row, super_minhash
from .symbols import LOWER, U, mix, row_groups, shingles, text_buffer, word_hashes, words

BANDS, ROWS = 28, 4
OWN = ["n_shingles", "component_id", "kept"]


def _sets(raw, offsets, size):
    raw = LOWER[raw]
    start, end, at = words(raw, offsets)
    return distinct_by_row(*shingles(word_hashes(raw, start, end), at, size))


def _signed(batches, size, bands, rows):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in row_groups(offsets):
            values, at = _sets(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], size)
            n = np.diff(at)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(values + U(s)))]) for s in (1, 0xE7037ED1A0B428DB)]
            keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]  # of a set, whatever its order
            hashes = band_hashes(super_minhash(values, at, bands * rows), rows).view(np.int64)
            full = n > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)), pa.array(hashes[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(a, b - a), batch.column("tag").slice(a, b - a), pa.array(n), *map(pa.array, keys), lists],
                ["doc", "tag", "n", "key1", "key2", "bands"])


def _full_sets(batches, size):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in row_groups(offsets):
            values, at = _sets(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))],
                ["node", "set"])


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets resemble each other enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(right, "b").join(left, "a").where(both * share[1] >= union * share[0]).select("a", "b")


def _alike_in_size(x, y, share):
    return (F.least(x, y) * share[1]) >= (F.greatest(x, y) * share[0])


def _prefix_pairs(open_: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of open classes in different groups that can reach the share: exact prefix and position filters."""
    top, bottom = share
    shingle = sets.join(open_, "node").select("node", "component", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    counts = shingle.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = shingle.join(counts, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("by_df"))
    length = F.col("n") - F.ceil(F.col("n") * top / bottom).cast("int") + 1
    prefix = ranked.select("node", "component", "n", F.posexplode(F.slice("by_df", F.lit(1), length)).alias("pos", "item"))
    prefix = prefix.where("item.df > 1").select("node", "component", "n", "pos", "item.shingle")
    x = prefix.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "component", "n", "pos")))
    y = prefix.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "pos")))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * top / (top + bottom))
    behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return x.join(y, (x.shingle == y.shingle) & (F.col("component_a") < F.col("component_b")) & _alike_in_size(F.col("n_a"), F.col("n_b"), share)
                  & (behind >= need)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members, with their groups, of the buckets that hold several groups."""
    named = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return cut(named.join(mixed, "band"))


def _with_class(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``signed`` with each row's class as ``node``; a row with an empty set is its document's own."""
    found = signed.join(classes.select("key1", "key2", "node"), ["key1", "key2"], "left")
    return found.withColumn("node", F.coalesce("node", "doc"))


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one document, where rows with different texts repeat its doc_id."""
    texts = signed.groupBy("doc").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo < hi").select("doc")
    rows = _with_class(signed.join(texts, "doc", "left_semi"), classes)
    return rows.where("node <> doc").select(F.col("node").alias("a"), F.col("doc").alias("b")).distinct()


def grouped(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc (key), tag, n_shingles, component (least key of its group)."""
    keyed = docs.select(key_column(docs).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    signed = cut(keyed.mapInArrow(partial(_signed, size=size, bands=bands, rows=rows),
                                  "doc long, tag long, n long, key1 long, key2 long, bands array<long>"))
    classes = cut(signed.where("n > 0").groupBy("key1", "key2").agg(F.min("doc").alias("node"), F.max("n").alias("n"), F.any_value("bands").alias("bands")))
    in_band = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last")
    members = cut(in_band.join(shared.select("band", "center"), "band"))

    wanted = members.select(F.col("node").alias("doc")).distinct()
    sets = cut(keyed.select("doc", "text").join(wanted, "doc", "left_semi").mapInArrow(partial(_full_sets, size=size), "node long, set array<long>"))

    sizes = members.select(F.col("node").alias("center"), F.col("n").alias("n_center")).distinct()
    pairs = members.where("node <> center").select("center", "node", "n").distinct().join(sizes, "center")
    pairs = pairs.where(_alike_in_size(F.col("n"), F.col("n_center"), share)).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(_confirmed(pairs, sets, share).unionByName(_same_document(signed, classes)))
    groups = components(links)

    left = _open_members(members, groups)
    if not left.isEmpty():
        # the best linked class of each bucket, such as the text that others were copied from
        degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
        hub = left.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node", "n", "component")).alias("hub"))
        pairs = left.join(hub, "band").where((F.col("component") != F.col("hub.component")) & _alike_in_size(F.col("n"), F.col("hub.n"), share))
        links = links.unionByName(_confirmed(pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), sets, share))
        links = cut(links)
        groups = components(links)
        left = _open_members(left.select("band", "node", "n"), groups)
    if not left.isEmpty():
        pairs = _prefix_pairs(left.select("node", "component").distinct(), sets, share)
        groups = components(links.unionByName(_confirmed(pairs, sets, share)))

    named = _with_class(signed, classes).join(groups, "node", "left")
    return named.select("doc", "tag", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


def _named(found: DataFrame) -> DataFrame:
    """Own columns from the internal keys; the key of a null doc_id turns null again."""
    none = F.lit(-(1 << 63)).cast("long")
    return found.select("*", F.nullif("component", none).alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def near_duplicate_ids(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased;
    a set holds the distinct shingles of ``size`` words.  Documents are linked
    where intersection / union >= share[0] / share[1]; component_id is the least
    doc_id reachable, and the document that bears it is kept.

    A text of fewer words is one shingle; a null, empty or blank text has an
    empty set, is linked with nothing and kept.  A null doc_id counts as the
    least key.  Rows that repeat a doc_id count as one document, linked by any
    of its texts.  An empty table gives an empty table.
    """
    none = F.lit(-(1 << 63)).cast("long")
    return _named(grouped(docs, size, share)).select(F.nullif("doc", none).alias("doc_id"), *OWN)


def drop_near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicate_ids`` keeps, with all their columns."""
    kept = _named(grouped(docs, size, share)).where("kept").select("doc", "tag").distinct()
    rows = docs.select(key_column(docs).alias("doc"), F.xxhash64("text").alias("tag"), "text", carried(docs, "text").alias("rest"))
    return released(rows.join(kept, ["doc", "tag"], "left_semi"), docs.columns, [])
