"""Words and their hashes over whole columns of texts, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text looked at together, a longer text aside.
SLICE = 1 << 20
#: Bytes up to which a word is hashed with the others at once.
LONG = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of eight.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = np.random.default_rng(30).integers(1, 1 << 63, 8, dtype=np.uint64)
_ROOTS = tuple(int(x) | 1 for x in np.random.default_rng(20).integers(1 << 62, 1 << 63, 8, dtype=np.uint64))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `limit` bytes; a
    null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _power(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """The powers 0 to n - 1 of a lane's odd root, or of its inverse, modulo 2^64."""
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        root = pow(_ROOTS[lane], -1, 1 << 64) if inverse else _ROOTS[lane]
        have = np.full(max(n, SLICE + 1), root, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * SLICE:
            _powers[lane, inverse] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """A hash for each span values[start:end] that depends on the values and their order alone. It is a
    polynomial modulo 2^64, so long regular spans collide: a filter or a sketch, never a proof."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(lane, len(values)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _power(lane, len(values) + 1, True)[starts] + (ends - starts).astype(np.uint64))


def chained(values: np.ndarray, at: np.ndarray, n: np.ndarray | int, lane: int) -> np.ndarray:
    """A digest of the n values from each place on: one bijective step for each value, which its number
    of values begins, so that no two spans of one length collide but by chance."""
    n = np.broadcast_to(np.asarray(n, np.int64), at.shape)
    h = mixed(n.astype(np.uint64) + _SEEDS[lane])
    for k in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > k)
        h[live] = mixed((h[live] ^ values[at[live] + k]) + _SEEDS[lane])
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers, zeros after the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def bytes_hash(eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lane: int) -> np.ndarray:
    """A digest of the `sizes` bytes from each place on, by one bijective step for every eight."""
    h = mixed(sizes.astype(np.uint64) + _SEEDS[lane])
    least, most = (int(sizes.min()), int(sizes.max())) if len(sizes) else (0, 0)
    for k in range(0, most, 8):
        if least >= k + 8:
            h = mixed((h ^ eight[starts + k]) + _SEEDS[lane])
            continue
        live = np.flatnonzero(sizes > k)
        h[live] = mixed((h[live] ^ (eight[starts[live] + k] & _KEPT[np.minimum(sizes[live] - k, 8)])) + _SEEDS[lane])
    return h


@dataclass
class Lexer:
    """Words are runs of the bytes that `keep` marks; A-Z count as a-z."""

    keep: np.ndarray

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of each word; a word doesn't cross rows."""
        word = self.keep[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        full = offsets[:-1] < offsets[1:]
        firsts, lasts = offsets[:-1][full], offsets[1:][full] - 1
        begins[firsts], ends[lasts] = word[firsts], word[lasts]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """64 bits of each word; lanes 0 and 1 are 128 together. Up to LONG bytes a word is taken eight
        bytes at a time by bijective steps, a longer one by XXH3."""
        low = _LOWER[data]
        sizes = ends - starts
        h = np.zeros(len(sizes), np.uint64)
        short = np.flatnonzero(sizes <= LONG)
        h[short] = bytes_hash(eights(low), starts[short], sizes[short], lane)
        for i in np.flatnonzero(sizes > LONG).tolist():
            whole = xxhash.xxh3_128_intdigest(low[starts[i] : ends[i]].tobytes())
            h[i] = whole >> 64 * lane & 0xFFFFFFFFFFFFFFFF
        return h


def _marked(*ranges: tuple[int, int]) -> np.ndarray:
    keep = np.zeros(256, bool)
    for a, b in ranges:
        keep[a : b + 1] = True
    return keep


#: Digits, letters and all that isn't ASCII, as in [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
LETTERS = Lexer(_marked((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
