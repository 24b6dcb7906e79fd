"""Substring dedup on words by Relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks at anchors that depend on
the words alone (``repeats``): every run of ``width`` words lies in some block,
and equal runs lie in blocks of the same anchor.  Parsing a document:

* index: blocks are shuffled by their anchor; the earliest document with a block
  is its reference.  Every block is indexed, none is sampled or capped;
* greedy factors: a block found whole in an earlier document extends the
  current factor; neighbouring found blocks join to one maximal factor;
* boundaries: where a factor ends, the document's block and the reference's
  share the anchor but not all words.  There the windows of ``width`` words are
  looked up, eight neighbours at once and then each by itself, against all
  documents, so that a run is found however the factors are cut.

Factors and boundary windows, all of at least ``width`` words, are the
duplicate spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats as R
from .frames import released, schema_of
from .symbols import text_buffer, word_hashes, words

WIDTH, GRAM = 50, 16
OWN = ["text", "n_words", "n_removed", "kept_sha256"]


def word_symbols(raw: np.ndarray, offsets: np.ndarray):
    start, end, at = words(raw, offsets)
    return word_hashes(raw, start, end), at


def _removed(batches, width):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        starts, first, size, _, _ = R.findings(batch.column("found"))
        out = {c: [] for c in OWN}
        for i in range(batch.num_rows):
            own = raw[offsets[i]: offsets[i + 1]]
            text = own.tobytes()
            begin, end, _ = words(own, np.array([0, len(own)]))
            s, e = R.merged(first[starts[i]: starts[i + 1]], (first + size)[starts[i]: starts[i + 1]] + width - 1)
            gone = np.zeros(len(begin) + 1, np.int64)
            np.add.at(gone, s, 1)
            np.add.at(gone, e, -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([text[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)])
            if len(s):  # what stays is cut out with its own white space; cuts close up to one space
                parts, at = [], 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    parts.append(text[at: begin[x]].rstrip(b" \t\n\v\f\r") if x else b"")
                    at = begin[y] if y < len(begin) else len(text)
                parts.append(text[at:] if at < len(text) else b"")
                text = b" ".join(p for p in parts if p)
            left = batch.column("text")[i].as_py() if not len(s) else text.decode()
            for c, x in zip(OWN, (left, len(begin), len(begin) - int(keep.sum()), hashlib.sha256(kept).hexdigest()), strict=True):
                out[c].append(x)
        names = [c for c in batch.schema.names if c != "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(out[c], t) for c, t in zip(OWN, types, strict=True))], [*names, *OWN])


def remove_repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove every word covered by a run of ``width`` words that also starts in a document of smaller ``doc_id``.

    Words are runs of characters other than space and 0x09-0x0D, compared
    unchanged.  All runs are judged on the input.  ``text`` is replaced by what
    stays (with its own white space; one space where a span was cut out), and
    n_words, n_removed and kept_sha256 (of the kept words joined by one space)
    are added.  A text without a repeat is returned as it is.

    A null text counts as empty and stays null.  A null doc_id comes before all
    others.  Rows that share a doc_id don't make each other's words repeats.
    Empty tables give empty tables.  A column of the input that has the name of
    an added one is replaced.
    """
    rows = R.with_repeats(R.keyed_documents(docs), word_symbols, width, gram, by_doc=True)
    schema = schema_of(rows.drop("text"), text="string", n_words="long", n_removed="long", kept_sha256="string")
    out = rows.mapInArrow(lambda it: _removed(it, width), schema)
    return released(out, docs.columns, OWN[1:])
