"""Words of whole Arrow string columns as numpy arrays, with rolling hashes.

The bytes of many texts are looked at as one buffer. UTF-8 bytes of 0x80 and
more belong to words in each of the patterns used here, so byte classes decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text is worked on alone.
SLICE_BYTES = 1 << 18

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first 0..8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text, and [^\x20\x09-\x0D].
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NON_SPACE = np.ones(256, bool)
NON_SPACE[9:14] = NON_SPACE[32] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 2**64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the same of its inverse, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, _inverse(base)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of rows of a string array; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + slice_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte positions of the words, and of each row the number of its first word, with the total at the end."""
    mask = inside[data]
    before = np.empty(len(mask) + 1, bool)
    before[0] = False
    before[1:] = mask
    cuts = offsets[:-1][offsets[:-1] < len(mask)]
    begins = mask & ~before[:-1]
    begins[cuts] = mask[cuts]
    starts = np.flatnonzero(begins)
    ends = before[:-1] & ~mask
    ends[cuts] = before[cuts]
    ends = np.flatnonzero(ends)
    if len(mask) and mask[-1]:
        ends = np.append(ends, len(mask))
    ends = ends[ends > 0]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z.

    A word is read as pieces of eight bytes. Each piece is mixed with its number
    before the pieces are summed up, so no pattern of bytes cancels out as it
    does in a polynomial modulo 2**64; words of up to eight bytes and equal
    length never share a hash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    pieces = (lengths + 7) >> 3
    first = np.cumsum(pieces) - pieces
    word = np.repeat(np.arange(len(starts)), pieces)
    skip = (np.arange(len(word)) - first[word]) << 3
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    x = eight[starts[word] + skip] & _FIRST[np.minimum(lengths[word] - skip, 8)]
    x = mix(x ^ mix(skip.astype(np.uint64) * _P + _Q))
    return mix(np.add.reduceat(x, first) + lengths.astype(np.uint64) * _P)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if length <= 8:
        for k in range(length):
            out += hashes[k : k + n] * np.uint64(pow(int(_Q), k, 2**64))
    else:
        up, down = powers(_Q, len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=total[1:])
        out = (total[length:] - total[:n]) * down[:n]
    return mix(out)


def lowered(data: np.ndarray, start: int, end: int) -> bytes:
    return _LOWER[data[start:end]].tobytes()
