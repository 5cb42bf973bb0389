"""Byte-level text tools on Arrow columns: words, hashes and per-document reductions, all vectorised.

Texts of one batch are handled as one byte array with offsets. Words are runs of bytes of a class; UTF-8
bytes of 0x80 and above are all word bytes, so that classes given over code points can be tested on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK64 = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C17  # odd, 3 mod 4, so that STEP - 1 has a single factor of two
STEP_INV = pow(STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
FOLDED = np.arange(256)
FOLDED[65:91] += 32
#: Codes of bytes with A-Z read as a-z.
BYTE_CODE_FOLDED = BYTE_CODE[FOLDED]

_b = np.arange(256)
#: [^\x20\x09-\x0D]
NOT_SPACE = ~((_b == 0x20) | ((_b >= 9) & (_b <= 13)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
ALNUM_OR_HIGH = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | ((_b >= 0x41) & (_b <= 0x5A)) | (_b >= 0x80)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and STEP ** -i modulo 2 ** 64 for i up to n."""
    while len(_powers["up"]) <= n:
        size = max(2 * len(_powers["up"]), 1 << 16)
        for name, base in (("up", STEP), ("down", STEP_INV)):
            block = np.full(size, base, np.uint64)
            block[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(block)
    return _powers["up"], _powers["down"]


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes of text each (a longer text is a slice of its own)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + most_bytes, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of member bytes; a run ends with its row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    filled = np.flatnonzero(np.diff(offsets))
    rows = filled[np.searchsorted(offsets[:-1][filled], starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODE_FOLDED, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes (ascending ones), equal for equal bytes (under codes) wherever they stand.

    Spans are taken some at a time, of about `most` bytes, so a long text does not need many bytes for each of its own.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + most, "right")), a + 1)
        first, last = starts[a:b] - starts[a], ends[a:b] - starts[a]
        part = data[starts[a] : ends[b - 1]]
        up, down = powers(len(part))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(codes[part] * up[: len(part)], out=sums[1:])
            out[a:b] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        a = b
    return out


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def shingles(words: np.ndarray, per_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, row after row (a row of 1 to k-1 words is one shingle), and their number by row."""
    consts = mix(np.arange(11, 11 + k, dtype=np.uint64)) | np.uint64(1)
    first = np.cumsum(per_row) - per_row
    out_n = np.where(per_row >= k, per_row - k + 1, (per_row > 0).astype(np.int64))
    with np.errstate(over="ignore"):
        total = len(words)
        whole = np.zeros(max(total - k + 1, 0), np.uint64)
        for j in range(k):
            if len(whole):
                whole += words[j : j + len(whole)] * consts[j]
        at_out = np.cumsum(out_n) - out_n
        src = np.arange(int(out_n.sum())) - np.repeat(at_out, out_n) + np.repeat(first, out_n)
        result = np.zeros(len(src), np.uint64)
        long = np.repeat(per_row >= k, out_n)
        result[long] = whole[src[long]] + np.uint64(k)
        for r in np.flatnonzero((per_row > 0) & (per_row < k)):
            w = words[first[r] : first[r] + per_row[r]]
            result[at_out[r]] = (w * consts[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(result), out_n


def distinct_by_row(values: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, end to end, and their number by row."""
    values = values.copy()
    at = 0
    for n in per_row.tolist():
        values[at : at + n].sort()
        at += n
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = (np.cumsum(per_row) - per_row)[per_row > 0]
    keep[starts] = True
    kept = np.zeros(len(per_row), np.int64)
    if len(values):
        kept[per_row > 0] = np.add.reduceat(keep.astype(np.int64), starts)
    return values[keep], kept
