"""SuperMinHash signatures of shingle sets."""

from __future__ import annotations

import numpy as np

from .symbols import U, mix

STEP = 56  # bits of a register's fraction; the step's number stands above


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the rows' new offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(offsets) - 1))])


def super_minhash(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m registers) of rows of distinct 64-bit values.

    Each value walks through a random permutation of the registers, made one
    swap at a time (Fisher-Yates): in step j it offers register p[j] the rank
    j + fraction, and a register keeps its least offer.  The ranks of one value
    are thus correlated: every register gets exactly one of the m steps, which
    spreads the values more evenly than independent hashes.  A row stops as
    soon as no register holds a rank of a later step: long rows after one or
    two steps, a row of a single value after m.  Empty rows keep empty registers.
    """
    rows = len(offsets) - 1
    registers = np.full(rows * m, np.iinfo(np.uint64).max, U)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    place = None
    for j in range(m):
        draw = mix(values + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = j + (mix(draw + U(0xD1B54A32D192ED03)) >> U(32)).astype(np.int64) % (m - j)
        if place is None:
            to = pick
        else:
            here = np.arange(len(values))
            to = place[here, pick].astype(np.int64)
            place[here, pick] = place[:, j]
            place[:, j] = to
        np.minimum.at(registers, row * m + to, U(j << STEP) | (draw >> U(64 - STEP)))
        if j + 1 == m:
            break
        left = np.zeros(rows, bool)
        live = np.unique(row) if j else np.flatnonzero(np.diff(offsets))
        left[live] = (registers.reshape(rows, m)[live].max(axis=1) >> U(STEP)) > U(j)
        going = left[row]
        if not going.any():
            break
        values, row = values[going], row[going]
        if place is None:  # the first step's swap, for the rows that go on
            place = np.tile(np.arange(m, dtype=np.uint16), (len(values), 1))
            place[np.arange(len(values)), pick[going]] = 0
            place[:, 0] = pick[going]
        else:
            place = place[going]
    return registers.reshape(rows, m)


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One hash of each band of ``rows`` registers, different from band to band."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    out = np.broadcast_to(mix(np.arange(1, m // rows + 1, dtype=U)), (n, m // rows)).copy()
    for i in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out
