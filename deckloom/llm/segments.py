"""Token ids of many texts at once from their distinct segments.

A tokenizer that never joins what two segments hold gives a text's ids as those of its segments, so each distinct segment is encoded once: prose
repeats its words. Segments are found by numpy over the bytes, told apart by hashes, and compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np

from deckloom.llm.text import equal_spans, span_hashes

#: Distinct segments that a task keeps, and their bytes; beyond, it starts anew.
KEPT, KEPT_BYTES = 1 << 18, 16 << 20


def byte_symbols() -> dict[str, int]:
    """The byte of each character in which a byte-level vocabulary is written: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def distinct_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans and, for each span, its place among them."""
    if not len(start):
        return [], np.zeros(0, dtype=np.int64)
    raw = data.tobytes()
    size = stop - start
    _, first, inverse = np.unique(span_hashes(data, start, stop), return_index=True, return_inverse=True)
    same = size == size[first][inverse]
    if same.all() and equal_spans(data, start, data, start[first][inverse], size).all():
        return [raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)], inverse
    found: dict[bytes, int] = {}  # two spans share 64 bits of hash
    inverse = np.array([found.setdefault(raw[a:b], len(found)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], dtype=np.int64)
    return list(found), inverse


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of ``size[i]`` items each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)


class Remembered:
    """Numbers of segments, with what ``learn`` (new segments) appends for them; ``forget`` is called when there are too many."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None]):
        self.learn, self.forget, self.known, self.held = learn, forget, {}, 0

    def numbers(self, segments: list[bytes]) -> np.ndarray:
        """A number for each of the distinct ``segments``, valid until the next call."""
        get = self.known.get
        found = np.array([get(s, -1) for s in segments], dtype=np.int64)
        missing = found < 0
        if len(self.known) + missing.sum() > KEPT or self.held > KEPT_BYTES:
            self.known, self.held = {}, 0
            self.forget()
            missing[:] = True
        new = list(compress(segments, missing))
        if new:
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.held += sum(map(len, new))
            self.learn(new)
            found[missing] = np.arange(first, first + len(new))
        return found


class Flat:
    """Arrays of several items for each number, one after the other."""

    def __init__(self, kind: type):
        self.items, self.first, self.size = np.zeros(1 << 12, dtype=kind), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.used = 0

    def add(self, items: np.ndarray, size: np.ndarray) -> None:
        """Append ``size[i]`` items for each new number."""
        if self.used + len(items) > len(self.items):
            self.items = np.concatenate((self.items[: self.used], np.zeros(max(len(items), self.used), dtype=self.items.dtype)))
        self.items[self.used : self.used + len(items)] = items
        self.first = np.concatenate((self.first, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used += len(items)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.items[spread(self.first[numbers], self.size[numbers])]
