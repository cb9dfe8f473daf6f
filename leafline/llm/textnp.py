"""Vectorised word and shingle hashing over Arrow string columns.

A text column of an Arrow batch is one byte buffer with offsets. Words are found
and hashed with array operations on that buffer, a few megabytes at a time, so
no Python object is made for a word. Texts longer than a piece are cut between
words, never inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
GROUP = 1 << 20

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes outside ASCII white space 20, 09-0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters and every byte of a character above 7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, PIECE + 4096)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (shift, multiply, shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each maximal run of ``kind`` bytes in each row, A-Z lower-cased."""
    out: list[tuple[np.ndarray, ...]] = []
    lo, total = 0, len(data)
    while lo < total:
        hi = min(lo + PIECE, total)
        if hi < total:
            inside = kind[data[lo:hi]]
            cut = np.flatnonzero(~inside)
            edge = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            hi = max(lo + int(cut[-1]) + 1 if len(cut) else 0, edge)
            if hi <= lo:  # one word longer than a piece
                stop, hi = int(offsets[np.searchsorted(offsets, lo, "right")]), lo + PIECE
                while hi < stop and kind[data[hi]]:
                    hi += 1
        out.append(_piece_words(data, lo, hi, offsets, kind))
        lo = hi
    if not out:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _piece_words(data, lo, hi, offsets, kind):
    piece = LOWER[data[lo:hi]]
    inside = kind[piece]
    first = np.zeros(hi - lo + 1, dtype=bool)
    edges = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
    first[edges] = True
    first[0] = first[hi - lo] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    up, down = _powers(hi - lo)
    terms = BYTE_CODE[piece] * up[: hi - lo]
    terms[~inside] = 0
    sums = np.add.reduceat(terms, starts)
    hashes = mix(sums * down[starts] + (ends - starts).astype(np.uint64))
    starts, ends = starts + lo, ends + lo
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, row), repeats kept; a row with fewer words than ``width`` gives its whole sequence."""
    counts = np.bincount(rows, minlength=n_rows)
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(len(hashes))
    full = at + width <= begins[rows + 1] if len(hashes) else np.zeros(0, bool)
    at = at[full]
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        total += hashes[at + k] * _PLACE[k]
    out, of = mix(total), rows[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([mix(np.array([int(np.sum(hashes[begins[r] : begins[r + 1]] * _PLACE[: counts[r]], dtype=np.uint64)) ^ int(counts[r])], dtype=np.uint64))[0] for r in short], dtype=np.uint64)
        out, of = np.concatenate((out, extra)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) of values in order of row, sorted by row, then value."""
    if not len(values):
        return values, rows
    out = values.copy()
    begins = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows)).tolist()
    for a, b in zip(begins, begins[1:], strict=False):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[keep], rows[keep]
