"""Benchmark decontamination by templates, in DataFrame operations alone.

A text becomes a template: a list of lower-cased words in which numbers, units
after a number and names (capitalised inside a sentence) are typed
placeholders.  A capital that may only be a sentence's first is read both ways,
as the word and as a name.  Windows of the items' templates are found in the
documents' by a hash join on each window's anchor, its longest word, followed by
an exact comparison, so documents' windows are never built as rows.  Windows of
one item at one alignment make a match; its slots, read from both raw texts,
must map the item's values to the document's consistently.  Thus questions are
found whose numbers and names were exchanged, and texts that share only the
template, filled at random, are not.  An item with too few plain words for a
window is looked for as a whole, with its own values.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import carried, key_column, released

WINDOW = 5  # words
LEAST = 3  # words of a window that are no placeholder, and words of an item
SHARE, SPREAD = 0.5, 0.8  # of an item's windows: at one alignment, or anywhere in the document
AGREE = 0.75  # of a match's slots whose values go with the item's
BROADCAST = 200_000  # windows of all items sent to every task; more are joined by a shuffle
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
# Units that count as a slot after a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yd l ml s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years usd eur dollar dollars euro euros cent cents percent degree degrees"
).split()


def _parted(text):
    """Text with spaces between digits and letters, so that both forms below cut it at the same places."""
    return F.regexp_replace(F.concat(F.lit(" "), text), r"(?<=\p{N})(?=[\p{L}\p{M}])|(?<=[\p{L}\p{M}])(?=\p{N})", " ")


def raw_words(text):
    """Words and digit runs as they stand, after one empty word."""
    return F.split(_parted(text), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{NAME}]+")


INSIDE = r"\p{Lu}(?<=[\p{L}\p{M}\p{N},;:]\s\p{Lu})\p{Ll}+(?![\p{L}\p{M}])"  # capitalised inside a sentence
ANYWHERE = r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})\p{Ll}+(?![\p{L}\p{M}])"


def template(text, names: str = INSIDE):
    """The same words with placeholders, lower-cased."""
    named = F.regexp_replace(F.concat(F.lit(" "), text), names, NAME)
    counted = F.regexp_replace(named, r"\p{N}+", f" {NUMBER} ")
    measured = F.regexp_replace(F.lower(counted), rf"(?<={NUMBER} {{1,2}})(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])", UNIT)
    return F.split(measured, rf"[^\p{{L}}\p{{M}}{NUMBER}-{NAME}]+")


def _is_slot(word):
    return word.isin(NUMBER, UNIT, NAME)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item, at, size, window, values (its raw words), first (how it reads without names at the start of sentences),
    anchor (its longest word), offset and the item's number of windows."""
    text = F.coalesce("text", F.lit(""))
    words = lambda x: F.array_remove(x, "")
    items = benchmark.select(
        F.col("item_id").alias("item"), words(template(text)).alias("words"), words(template(text, ANYWHERE)).alias("named"), words(raw_words(F.lower(text))).alias("raw"))
    items = items.where(F.size("words") >= LEAST).dropDuplicates(["item", "words"])
    size = F.least(F.lit(WINDOW), F.size("words"))
    rows = items.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    cut_out = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    rows = rows.select("item", "at", "size", cut_out("words").alias("first"), cut_out("raw").alias("values"),
                       F.explode(F.array_distinct(F.array(cut_out("words"), cut_out("named")))).alias("window"))
    plain = lambda c: F.size(F.filter(c, lambda w: ~_is_slot(w)))
    rows = rows.where(plain("window") >= LEAST)
    # an item without a window is one by itself: its raw words, without slots
    whole = items.join(rows.select("item").distinct(), "item", "left_anti").where(F.size("raw") > 0)
    whole = whole.select("item", F.lit(0).alias("at"), F.size("raw").alias("size"), *(F.col("raw").alias(c) for c in ("first", "values", "window"))).distinct()
    rows = rows.unionByName(whole)
    longest = F.array_max(F.transform("window", lambda w: F.struct(F.when(_is_slot(w), 0).otherwise(F.length(w)).alias("size"), w.alias("word"))))
    rows = rows.withColumn("anchor", longest["word"]).withColumn("offset", F.array_position("window", F.col("anchor")).cast("int") - 1)
    total = rows.groupBy("item").agg(F.count_distinct("at").alias("windows"))
    return rows.select("item", "at", "size", "window", "values", "first", F.exists("window", _is_slot).alias("open"), "anchor", "offset").join(total, "item")


def _hits(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, tag, item, windows, at, start, open, window, values, first, filled): where windows of items stand in the documents, and the words at both places."""
    n, least = windows.agg(F.count("*"), F.min(F.length("anchor"))).first()
    raw, kinds = raw_words(F.lower("text")).alias("raw"), template(F.col("text"), ANYWHERE).alias("kinds")
    words = rows.select("doc", "tag", raw, kinds)
    place = F.col("pos") - F.col("offset")
    # written out word by word, without lambdas, so that generated code does the join in one go and no exploded text is held
    at = lambda c, i: F.get(c, F.greatest(place, F.lit(0)) + i)
    word = [F.get("window", F.lit(i)) for i in range(WINDOW)]  # a window with slots has no more

    def stands(i):  # a plain word must stand there, as a name or not; a slot must be of its kind
        return (F.col("size") <= i) | F.coalesce(F.when(_is_slot(word[i]), at("kinds", i) == word[i]).otherwise(at("raw", i) == word[i]), F.lit(False))

    whole = F.slice("raw", F.greatest(place, F.lit(0)) + 1, F.col("size")) == F.col("window")
    equal = (place >= 0) & F.when(F.col("open"), reduce(and_, map(stands, range(WINDOW)))).otherwise(whole)

    filled = F.slice("raw", F.greatest(place, F.lit(0)) + 1, F.col("size")).alias("filled")
    found = ["doc", "tag", "item", "windows", "at", place.alias("start"), "open", "window", "values", "first", filled]
    if n <= BROADCAST:
        each = words.select("doc", "tag", "raw", "kinds", F.posexplode("raw").alias("pos", "anchor")).where(F.length("anchor") >= (least or 0))
        return each.join(F.broadcast(windows), "anchor").where(equal).select(*found)
    # many items: only the anchors' places meet in a shuffle, then each place is compared in its document
    each = rows.select("doc", "tag", F.posexplode(raw_words(F.lower("text"))).alias("pos", "anchor")).where(F.length("anchor") >= least)
    places = each.join(windows, "anchor").drop("anchor")
    return words.join(places, ["doc", "tag"]).where(equal).select(*found)


def _agreeing(pairs):
    """The share of slots whose item value goes with this document value."""
    def most(value):
        of = F.filter(pairs, lambda p: p["value"] == value)
        return F.array_max(F.transform(of, lambda p: F.size(F.filter(of, lambda q: q["filled"] == p["filled"]))))

    values = F.array_distinct(F.transform(pairs, lambda p: p["value"]))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.aggregate(values, F.lit(0), lambda n, v: n + most(v)) / F.size(pairs))


def _combined(first, hits):
    """``first`` (places and pairs of an alignment) and of other alignments' windows those whose slots go with it.

    A slot has one place in the document and a place one slot.
    """
    def fits(state, hit):
        clash = F.exists(hit["pairs"], lambda p: F.exists(state["pairs"], lambda q: (p["pos"] == q["pos"]) != (p["place"] == q["place"])))
        return ~F.array_contains(state["places"], hit["at"]) & ~clash & (_agreeing(F.array_union(state["pairs"], hit["pairs"])) >= AGREE)

    def add(state, hit):
        more = F.struct(F.array_append(state["places"], hit["at"]).alias("places"), F.array_union(state["pairs"], hit["pairs"]).alias("pairs"))
        return F.when(fits(state, hit), more).otherwise(state)

    return F.aggregate(hits, first, add)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it.

    Columns: doc_id, item_id, share (of the item's windows found), slots (their
    number in the match) and agreeing (the share of slots whose item value always
    goes with this document value).  A pair is found if at any alignment ``SHARE``
    of the item's windows stand and ``AGREE`` of the slots in these agree, or if
    ``SPREAD`` of the windows stand anywhere in the document: those of one
    alignment and of the others what goes with it, so that ``AGREE`` of the slots
    agree.  Of several matches the one with most windows is returned.

    Null or empty texts match nothing, items of under three words are not looked
    for, those without three plain words in a row of five only with their own
    values; repeated items and rows are found once per key.  A null doc_id is
    returned as null.  Empty tables give no rows.
    """
    return _matches(docs, benchmark).select(_doc_id(), F.col("item").alias("item_id"), "share", "slots", "agreeing").distinct()


def _doc_id():
    return F.nullif("doc", F.lit(-(1 << 63)).cast("long")).alias("doc_id")


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(key_column(docs).alias("doc"), F.xxhash64("text").alias("tag"), "text", *more)


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = _keyed(docs).where("text is not null")
    hits = _hits(rows, cut(item_windows(benchmark))).withColumn("shift", F.col("start") - F.col("at"))
    lines = hits.groupBy("doc", "tag", "item", "windows", "shift").agg(
        F.collect_set("at").alias("places"),  # at most the item's windows
        F.sort_array(F.collect_list(F.struct("at", "start", "open", "window", "values", "first", "filled"))).alias("each"))

    def pairs_of(x):  # of a capital that may start a sentence a slot is made only where another word stands
        pair = F.transform(x["window"], lambda w, i: F.struct(
            (x["at"] + i).alias("pos"), (x["start"] + i).alias("place"), F.get(x["values"], i).alias("value"), F.get(x["filled"], i).alias("filled"),
            (_is_slot(w) & (_is_slot(F.get(x["first"], i)) | (F.get(x["values"], i) != F.get(x["filled"], i)))).alias("slot")))
        return F.transform(F.filter(pair, lambda p: x["open"] & p["slot"]), lambda p: p.dropFields("slot"))

    lines = lines.withColumn("each", F.transform("each", lambda x: F.struct(x["at"].alias("at"), pairs_of(x).alias("pairs"))))
    lines = lines.withColumn("pairs", F.array_distinct(F.flatten(F.col("each")["pairs"])))
    lines = lines.select("doc", "tag", "item", "windows", F.struct(F.size("places").alias("hits"), "shift", "places", "pairs", "each").alias("line"))
    pairs = lines.groupBy("doc", "tag", "item", "windows").agg(F.sort_array(F.collect_list("line"), asc=False).alias("lines"))
    covered = F.size(F.array_distinct(F.flatten(F.col("lines")["places"])))
    wide = covered >= SPREAD * F.col("windows")
    pairs = pairs.withColumn("wide", wide).where((F.col("lines")[0]["hits"] >= SHARE * F.col("windows")) | F.col("wide"))

    judged = lambda x: F.struct(F.size(x["places"]).alias("hits"), F.size(x["pairs"]).alias("slots"), _agreeing(x["pairs"]).alias("agreeing"))
    good = lambda least: lambda x: (x["hits"] >= least * F.col("windows")) & (x["agreeing"] >= AGREE)
    alone = F.filter(F.transform(F.filter("lines", lambda x: x["hits"] >= SHARE * F.col("windows")), judged), good(SHARE))
    found = pairs.withColumn("alone", F.array_max(alone))
    # windows of several alignments: once from each alignment that differs from the others, once from none
    starts = F.array_distinct(F.transform("lines", lambda x: F.struct(x["places"].alias("places"), x["pairs"].alias("pairs"))))
    others = F.flatten(F.col("lines")["each"])
    none = F.struct(F.slice(F.col("lines")[0]["places"], 1, 0).alias("places"), F.slice(F.col("lines")[0]["pairs"], 1, 0).alias("pairs"))
    starts = F.array_append(F.filter(starts, lambda x: _agreeing(x["pairs"]) >= AGREE), none)
    spread = F.filter(F.transform(starts, lambda x: judged(_combined(x, others))), good(SPREAD))
    enough = F.col("alone").isNotNull() | ~F.col("wide")
    found = found.withColumn("best", F.when(enough, F.col("alone")).otherwise(F.array_max(spread))).where("best is not null")
    return found.select("doc", "tag", "item", (F.col("best.hits") / F.col("windows")).alias("share"), F.col("best.slots").alias("slots"), F.col("best.agreeing").alias("agreeing"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    found = _matches(docs, benchmark).select("doc", "tag").distinct()
    rows = _keyed(docs, carried(docs, "text").alias("rest"))
    return released(rows.join(found, ["doc", "tag"], "left_anti"), docs.columns, [])
