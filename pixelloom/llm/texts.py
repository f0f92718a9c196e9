"""Words, lines and their hashes over whole Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
#: What parts words: blanks and ASCII punctuation.
_APART = bytes(b in (9, 10, 11, 12, 13, 32) or any(lo <= b < hi for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127))) for b in range(256))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    a = column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(a) else data[:0], offsets - offsets[0] if len(a) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters of two bytes."""
    low = np.frombuffer(bytearray(data.tobytes().translate(_LOWER)), np.uint8)
    if len(data) > 1:
        big = np.flatnonzero(data[:-1] == 0xC3) + 1
        big = big[(data[big] >= 0x80) & (data[big] <= 0x9E) & (data[big] != 0x97)]
        low[big] += 32
    return low


def ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, where words begin, where they end). Words are runs of bytes
    without blanks or ASCII punctuation, within a row."""
    n = len(data)
    low = fold(data)
    if n == 0:
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~np.frombuffer(low.tobytes().translate(_APART), bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    return low, starts, np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each row and their number)."""
    low, starts, ends = ranges(data, offsets)
    return hashes(low, starts, ends), np.searchsorted(starts, offsets)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges, eight bytes at a step."""
    eight = _eight(data)
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64))
    at = np.flatnonzero((length > 0) & (length <= _LONG))
    k = 0
    while len(at):
        left = length[at] - k
        h[at] = mix(h[at] ^ (eight[starts[at] + k] & _MASKS[np.minimum(left, 8)]))
        k += 8
        at = at[left > 8]
    for i in np.flatnonzero(length > _LONG):
        import xxhash

        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the byte ranges i and j are equal, pair by pair."""
    eight, length = _eight(data), ends[i] - starts[i]
    ok = length == ends[j] - starts[j]
    at, k = np.flatnonzero(ok), 0
    while len(at):
        left = length[at] - k
        eq = ((eight[starts[i[at]] + k] ^ eight[starts[j[at]] + k]) & _MASKS[np.minimum(left, 8)]) == 0
        ok[at[~eq]] = False
        k += 8
        at = at[eq & (left > 8)]
    return ok


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Strings of the byte ranges, in their order, each with a blank after it;
    first: the first range of each string and their number."""
    length = ends - starts + 1
    after = np.cumsum(length)
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    take = length - 1
    within = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
    out[np.repeat(after - length, take) + within] = data[np.repeat(starts, take) + within]
    at = np.concatenate([[0], after])[first]
    kind, size = (pa.string(), np.int32) if len(out) < 2**31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(first) - 1, [None, pa.py_buffer(at.astype(size)), pa.py_buffer(out)])
