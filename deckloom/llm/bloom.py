"""Bloom filters over 128-bit key hashes, built by a distributed bit_or, and cascades of them (exact on a universe)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import hash_bits, mapped, staged

#: A filter beyond so many bits isn't built: the caller takes its other way (64 MB).
MAX_BITS = 1 << 29
#: Levels of a cascade; each shrinks the rest by a constant factor. What still remains is kept as plain hashes.
MAX_LEVELS = 48

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def key_hashes(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key."""
    return hash_bits(*cols, seed=1), hash_bits(*cols, seed=2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass
class Bloom:
    """``n_hashes`` bits a key in a table of ``n_bits`` (a multiple of 64); ``salt`` makes levels independent."""

    n_bits: int
    n_hashes: int
    salt: int
    words: np.ndarray = field(repr=False)

    @staticmethod
    def shape(n_keys: int, rate: float) -> tuple[int, int]:
        bits_a_key = -math.log(rate) / math.log(2) ** 2
        return max(64, 64 * math.ceil(n_keys * bits_a_key / 64)), max(1, round(bits_a_key * math.log(2)))

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """(keys, n_hashes) bit positions."""
        salt = _mixed(np.array([self.salt], dtype=np.uint64) * _MIX2)[0]
        a, b = _mixed(h1 ^ salt), _mixed(h2 + salt) | np.uint64(1)
        steps = np.arange(self.n_hashes, dtype=np.uint64)
        return _mixed(a[:, None] + steps[None, :] * b[:, None]) % np.uint64(self.n_bits)

    def might_contain(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(h1):
            return np.zeros(0, dtype=bool)
        at = self.positions(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def build(keys: DataFrame, n_keys: int, rate: float, salt: int, hashes: Callable[[pa.RecordBatch], tuple] | None = None) -> Bloom | None:
    """Encode ``keys`` (h1, h2). None if the filter would pass ``MAX_BITS``.

    ``hashes`` gives h1 and h2 (numpy) of a batch of other columns, in the same worker. Executors turn keys into (word, bits) and bit_or them; what reaches the driver is the filter itself.
    """
    n_bits, n_hashes = Bloom.shape(max(1, n_keys), rate)
    if n_bits > MAX_BITS:
        return None
    filled = Bloom(n_bits, n_hashes, salt, np.zeros(n_bits // 64, dtype=np.uint64))
    shape = Bloom(n_bits, n_hashes, salt, np.zeros(0, dtype=np.uint64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shape.positions(*(hashes(batch) if hashes else map(_unsigned, batch.columns))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    merged = mapped(keys if hashes else keys.select("h1", "h2"), bits, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    filled.words[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return filled


@dataclass
class Cascade:
    """Alternating filters: an odd level holds listed keys, an even one the universe's false positives so far.

    A key of the universe is listed exactly if the first level that rejects it is an even one, or none does and the
    last level holds listed keys. ``sure`` has the hashes of listed keys that the last level could not tell apart.
    """

    levels: list[Bloom]
    sure: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), dtype=np.uint64), repr=False)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h1), dtype=bool)
        alive = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            inside = level.might_contain(h1[alive], h2[alive])
            listed[alive[~inside]] = k % 2 == 1
            alive = alive[inside]
        if len(alive):
            if len(self.levels) < MAX_LEVELS:
                listed[alive] = len(self.levels) % 2 == 1
            else:
                known = set(map(tuple, self.sure.tolist()))
                listed[alive] = [(int(a), int(b)) in known for a, b in zip(h1[alive], h2[alive], strict=True)]
        return listed

    @property
    def n_bytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels) + self.sure.nbytes


def cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade | None:
    """A cascade that tells ``listed`` from the rest of ``universe`` (both: h1, h2). None if it would be too large.

    The first level's rate is set so that about as many false positives as listed keys are left; so only that level
    reads the whole universe, and the size follows the list and the logarithm of the universe's share to it.
    """
    listed = listed.select("h1", "h2").distinct()
    n_listed = listed.count()
    if not n_listed:
        return Cascade([])
    rate = min(0.5, max(1e-9, n_listed / (2.0 * max(1, n_universe))))
    first = build(listed, n_listed, rate, salt=1)
    if first is None:
        return None

    def passing(level: Bloom):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(level.might_contain(_unsigned(batch.column(0)), _unsigned(batch.column(1)))))

        return keep

    false = mapped(universe.select("h1", "h2"), passing(first), "h1 long, h2 long").distinct().join(listed, ["h1", "h2"], "left_anti")
    rest = [staged(listed), staged(false)]  # of the side that the next level encodes after the other
    levels = [first]
    while len(levels) < MAX_LEVELS:
        n = rest[1].count()
        if not n:
            return Cascade(levels)
        level = build(rest[1], n, 0.5, salt=len(levels) + 1)
        if level is None:
            return None
        levels.append(level)
        rest = [rest[1], staged(mapped(rest[0], passing(level), "h1 long, h2 long"))]
    sides = rest[1] if len(levels) % 2 == 0 else rest[0]
    left = sides.toArrow()  # keys with equal bits at every level: hash collisions, a handful at most
    return Cascade(levels, np.stack([left[c].to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1))
