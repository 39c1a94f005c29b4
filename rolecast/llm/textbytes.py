"""Texts of an Arrow batch as one byte array, and the words in it, without Python strings.

The operators that read whole corpora run on these arrays: numpy works on a
few megabytes at a time, so memory does not grow with the batch, and a text
is never cut (a text longer than a chunk is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Word bytes: digits, letters and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTES[_lo:_hi] = True
#: Everything but ASCII white space.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def text_column(batch: pa.RecordBatch, names: list[str], text: str) -> pa.Array:
    """The text of a batch (_doc struct, text if the struct has none)."""
    return batch.column(0).flatten()[names.index(text)] if text in names else batch.column(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets of the values); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)
            or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts of about ``size`` bytes."""
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte Latin-1 capitals."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 32
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES):
    """(starts, ends, first word of each text and the count as one offsets array)."""
    inside = kind[data]
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begin[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same for the same bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(data) + 1)[starts]
               + (ends - starts).astype(np.uint64))


def word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside each text, and the texts' offsets among them.

    A text with fewer words, but at least one, has a single shingle of all of them.
    """
    counts = np.diff(bounds)
    total = len(hashes)
    rolled = np.zeros(total, np.uint64)
    for i in range(n):
        part = np.zeros(total, np.uint64)
        part[: total - i] = hashes[i:]
        rolled = mix(rolled ^ part) + np.uint64(i + 1)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(out_counts)))
    at = np.repeat(bounds[:-1] - out_bounds[:-1], out_counts) + np.arange(out_bounds[-1])
    out = rolled[at]
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.zeros(1, np.uint64)
        for i, w in enumerate(hashes[bounds[k]: bounds[k + 1]]):
            h = mix(h ^ w) + np.uint64(i + 1)
        out[out_bounds[k]] = mix(h + np.uint64(counts[k]))[0]
    return out, out_bounds
