"""Words of many texts at once, by numpy over their UTF-8 bytes.

Words are runs of bytes outside 0x20 and 0x09-0x0D; since UTF-8 uses no such byte inside a character, that is the
pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in groups of about so many bytes, so temporary arrays stay small whatever a batch holds.
GROUP_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a word that are mixed block by block; a longer word is known by a digest.
BLOCKED = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on beside others after its batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        return


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one little-endian number (zeros follow the data): a view, nothing is spread out."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of each span's bytes. The state is mixed after each 8 bytes, so no arithmetic relation of the bytes makes two spans
    collide; spans of over ``BLOCKED`` bytes are known by a digest."""
    size = (stop - start).astype(np.int64)
    out = mixed(size.astype(np.uint64) * _MIX1 + _MIX2)
    wide = eights(data)
    active = np.flatnonzero(size <= BLOCKED)
    at, rest = start[active], size[active]
    while len(active):
        block = wide[at] & _MASKS[np.minimum(rest, 8)]
        out[active] = mixed((out[active] * _MIX2 + _MIX1) ^ block)
        more = rest > 8
        active, at, rest = active[more], at[more] + 8, rest[more] - 8
    long = np.flatnonzero(size > BLOCKED)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        spans = zip(start[long].tolist(), stop[long].tolist(), strict=True)
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in spans]
    return out


def equal_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes in ``data`` and ``other`` are the same, byte for byte."""
    same = np.ones(len(size), dtype=bool)
    one, two = eights(data), eights(other)
    active, a, b, rest = np.arange(len(size)), start, other_start, size
    while len(active):
        differ = ((one[a] ^ two[b]) & _MASKS[np.minimum(rest, 8)]) != 0
        same[active[differ]] = False
        more = ~differ & (rest > 8)
        active, a, b, rest = active[more], a[more] + 8, b[more] + 8, rest[more] - 8
    return same


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows [first, end) of a string or binary column with their joint bytes and offsets.

    ``limit``: bytes of a group; a longer text is a group of its own. Nulls are empty.
    """
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    # views of the batch's own buffers: nothing is copied
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], (offsets[first : end + 1] - offsets[first]).astype(np.int64)
        first = end


class Words:
    """Words of a group of texts: ``start``, ``stop`` (bytes), ``row`` (index in the group), ``per_row``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[cuts] = inside[cuts]  # a text's first byte
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        lasts = offsets[1:-1] - 1
        lasts = lasts[lasts >= 0]
        ends[lasts] = inside[lasts]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.per_row)))

    def hashes(self, lower: bool) -> np.ndarray:
        """64 bits a word (``span_hashes``), A-Z lower-cased first if asked."""
        return span_hashes(_LOWER[self.data] if lower else self.data, self.start, self.stop)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words within a text, and the word that each begins at."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            out = mixed(out + hashes[at + k] + np.uint64((k + 1) * int(_MIX2) % (1 << 64)))
        return out, at
