"""Substring dedup on bytes by a depth-limited radix sort of suffixes.

Suffixes are told apart only through their first ``width`` bytes, digit by
digit from the most significant on, and a suffix leaves the sort as soon as it
is alone in its group; groups that stay equal through all digits are exactly
the repeated windows.  A digit is the hash of a stretch of the suffix:

1. the anchor, the ``gram`` bytes of least hash in the window.  Neighbouring
   windows of one anchor travel as one row, so about one suffix in 35 moves;
2. the stretch from the first of these windows to the end of the last.  Rows
   that are still equal are settled: all their windows repeat the first row's;
3. only for rows that agree in the first digit but not in the second, pieces of
   eight neighbouring windows: first the bytes all eight share, then all bytes;
4. only for pieces that agree in the former and not in the latter, each of their
   windows by itself (128 bits).

Each digit is a pass: a shuffle by the digit, a sort inside the partitions, and
a reader of constant memory.  Rows that a task can settle alone, such as those
of a line in every document, never reach the comparison; see ``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats as R
from .frames import released, schema_of
from .symbols import BYTE, text_buffer

WIDTH, GRAM = 100, 32
OWN = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def byte_symbols(raw: np.ndarray, offsets: np.ndarray):
    return BYTE[raw], offsets


def _removed(batches, width):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("text"))
        starts, first, size, _, _ = R.findings(batch.column("found"))
        out = {c: [] for c in OWN}
        for i in range(batch.num_rows):
            text = raw[offsets[i]: offsets[i + 1]].tobytes()
            s, e = R.merged(first[starts[i]: starts[i + 1]], (first + size)[starts[i]: starts[i + 1]] + width - 1)
            cuts = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            for c, x in zip(OWN, (len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[c].append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names), *(pa.array(out[c], t) for c, t in zip(OWN, types, strict=True))], [*batch.schema.names, *OWN])


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts earlier.

    Earlier: in a document of smaller ``doc_id``, or earlier in the same one.
    Strings never cross documents, overlap counts, and all are judged on the
    input.  Columns added: n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and kept (the remaining bytes, which need not be valid UTF-8).

    A null text counts as empty, and as such is returned with 0 bytes.  A null
    doc_id comes before all others.  Rows that share a doc_id are ordered by a
    hash of their text; identical rows get identical results, the text's own
    repeats removed.  Empty tables give empty tables.  A column of the input that
    has the name of an added one is replaced.
    """
    rows = R.with_repeats(R.keyed_documents(docs), byte_symbols, width, gram, by_doc=False)
    own = dict(zip(OWN, ("long", "long", "long", "string", "binary"), strict=True))
    out = rows.mapInArrow(lambda it: _removed(it, width), schema_of(rows, **own))
    return released(out, docs.columns, OWN)
