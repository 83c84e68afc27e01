"""Operator 8: SentencePiece encoding and decoding by suffix-array matching.

For a batch, the distinct segments (a run of spaces and what follows it) are concatenated and indexed by a suffix array;
every piece of the vocabulary is looked up by binary search, which gives all its occurrences at once; the occurrences
are the edges, sorted by position; relaxing them gives the encoding. For a BPE model the relaxation is the merging
order (best score first, leftmost among equals), so ids equal those of the sentencepiece library; for a unigram
model it is the best path.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.common import col, free_names, mapped, typed
from deckloom.llm.text import equal_spans, give_back, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts are taken in groups of about so many bytes.
GROUP_BYTES = 1 << 18
#: Bytes of segments, ids and tables that a worker remembers between groups; then it starts anew.
CACHE_BYTES = 12 << 20
#: Segments of more symbols merge by a heap of their own.
LONG = 64
SPACE = "▁".encode()
_BREAK = 0xFF  # never in UTF-8: no piece crosses it


@dataclass
class Vocabulary:
    """Pieces as bytes with the space mark as one byte 0x20, sorted; ids, scores, and the ids of single bytes."""

    pieces: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]
    bpe: bool
    unk: int

    def __post_init__(self) -> None:
        self.probes = Probes(self.pieces)

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        plain, byte_ids, surface, unk = [], np.zeros(256, dtype=np.int32), [], 0
        for k, p in enumerate(model.pieces):
            raw = p.piece.encode().replace(SPACE, b" ")
            if p.type == p.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = k
                raw = bytes([int(p.piece[3:5], 16)])
            elif p.type in (p.NORMAL, p.USER_DEFINED):
                inner = raw.lstrip(b" ")
                if b" " in inner:
                    raise ValueError("pieces that go over a space are not supported")
                plain.append((raw, k, p.score))
            elif p.type == p.UNKNOWN:
                unk, raw = k, b" \xe2\x81\x87 "
            else:
                raw = b""
            surface.append(raw)
        plain.sort()
        return Vocabulary([p[0] for p in plain], np.array([p[1] for p in plain], dtype=np.int32), np.array([p[2] for p in plain]), byte_ids, surface, model.trainer_spec.model_type == model.trainer_spec.BPE, unk)


def _first_bytes(text: np.ndarray, depth: int) -> np.ndarray:
    """At each position the next 8 bytes as a big-endian number, so they compare as the bytes do; zeros follow the text."""
    n = len(text) + depth + 8
    wide = np.zeros(n + 8, dtype=np.uint8)
    wide[: len(text)] = text
    one = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        one <<= np.uint64(8)
        one |= wide[k : k + n]
    return one


class Probes:
    """What the pieces' binary searches need, made once a vocabulary: their bytes as numbers, padded to the least and the greatest
    suffix that begins with them; pieces of more than 8 bytes in several numbers."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.sizes, self.depth = sizes, int(sizes.max(initial=1))
        self.levels = -(-self.depth // 8)
        self.short, self.deep = np.flatnonzero(sizes <= 8), np.flatnonzero(sizes > 8)
        self.low, self.high = (self._numbers([pieces[k] for k in self.short], 1, pad)[:, 0] for pad in (b"\0", b"\xff"))
        self.deep_low, self.deep_high = (self._numbers([pieces[k] for k in self.deep], self.levels, pad) for pad in (b"\0", b"\xff"))
        self.heads = np.unique(self.deep_low[:, 0])

    @staticmethod
    def _numbers(pieces: list[bytes], levels: int, pad: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(p.ljust(8 * levels, pad) for p in pieces), dtype=">u8").astype(np.uint64).reshape(len(pieces), levels)


def suffix_array(text: np.ndarray, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next bytes, and the bytes at each position (``_first_bytes``).

    Sorted by 8 bytes, and by as many as the longest piece has where a piece of more than 8 bytes begins as the suffix does:
    only there could a deeper order be asked for.
    """
    at = _first_bytes(text, probes.depth)
    order = np.argsort(at[: len(text)])
    if len(probes.heads) and len(order):
        first = at[order]
        a, b = np.searchsorted(first, probes.heads), np.searchsorted(first, probes.heads, side="right")
        sizes = b - a
        where = np.repeat(a, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = order[where]
        order[where] = part[np.lexsort(tuple(at[part + 8 * k] for k in range(probes.levels - 1, -1, -1)))]
    return order, at


def occurrences(order: np.ndarray, at: np.ndarray, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range of the suffix array whose suffixes begin with it, by binary search."""
    out = np.zeros(len(probes.sizes), dtype=np.int64), np.zeros(len(probes.sizes), dtype=np.int64)
    first = at[order]
    out[0][probes.short], out[1][probes.short] = np.searchsorted(first, probes.low), np.searchsorted(first, probes.high, side="right")
    for found, target, right in ((out[0], probes.deep_low, False), (out[1], probes.deep_high, True)):
        found[probes.deep] = _search_deep(order, at, target, right)
    return out


def _search_deep(order: np.ndarray, at: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all targets (several numbers each) at once."""
    pieces, levels = target.shape
    n = len(order)
    a, b = np.zeros(pieces, dtype=np.int64), np.full(pieces, n, dtype=np.int64)
    while (a < b).any():
        mid = (a + b) >> 1
        suffix = order[np.minimum(mid, max(n - 1, 0))]
        before, equal = np.zeros(pieces, dtype=bool), np.ones(pieces, dtype=bool)
        for k in range(levels):
            here = at[suffix + 8 * k]
            before |= equal & (here < target[:, k])
            equal &= here == target[:, k]
        if right:
            before |= equal
        go = a < b
        a = np.where(go & before, mid + 1, a)
        b = np.where(go & ~before, mid, b)
    return a


class Lattice:
    """All occurrences of pieces in a text: edges sorted by position and length."""

    def __init__(self, text: np.ndarray, vocab: Vocabulary):
        order, at = suffix_array(text, vocab.probes)
        low, high = occurrences(order, at, vocab.probes)
        counts = high - low
        self.shift = vocab.probes.depth.bit_length()
        bits = int(len(counts)).bit_length()
        # position, length and piece in one number: a plain sort puts the edges in order
        edge = np.repeat((vocab.probes.sizes << bits) | np.arange(len(counts)), counts)
        inside = np.arange(len(edge)) - np.repeat(np.cumsum(counts) - counts - low, counts)
        edge |= order[inside] << (self.shift + bits)
        edge.sort()
        self.edge, self.piece = edge >> bits, (edge & ((1 << bits) - 1)).astype(np.int32)

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece on each span, -1 where there is none."""
        wanted = np.where(length < 1 << self.shift, (start << self.shift) | length, -1)
        at = np.minimum(np.searchsorted(self.edge, wanted), max(len(self.edge) - 1, 0))
        if not len(self.edge):
            return np.full(len(start), -1, dtype=np.int64)
        return np.where(self.edge[at] == wanted, self.piece[at], -1)


def _merge_long(starts: list[int], end: int, lattice: Lattice, scores: np.ndarray) -> list[int]:
    """Starts of the symbols of one long segment after all merges."""
    n = len(starts)
    stop = [*starts[1:], end]
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    alive = [True] * n
    first = np.array(starts[:-1], dtype=np.int64)
    found = lattice.find(first, np.array(stop[1:], dtype=np.int64) - first)
    queue = [(-scores[p], starts[i], i, stop[i + 1]) for i, p in enumerate(found.tolist()) if p >= 0]
    heapq.heapify(queue)

    def look(i: int) -> None:
        j = after[i]
        if j >= 0:
            p = int(lattice.find(np.array([starts[i]]), np.array([stop[j] - starts[i]]))[0])
            if p >= 0:
                heapq.heappush(queue, (-scores[p], starts[i], i, stop[j]))

    while queue:
        _, _, i, to = heapq.heappop(queue)
        j = after[i] if alive[i] else -1
        if j < 0 or stop[j] != to:
            continue
        stop[i], alive[j], after[i] = to, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return [s for s, ok in zip(starts, alive, strict=True) if ok]


def _relax_bpe(start: np.ndarray, stop: np.ndarray, seg: np.ndarray, lattice: Lattice, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge neighbouring symbols of each segment, best score first, the leftmost of equals; all segments at once."""
    counts = np.bincount(seg, minlength=0)
    long = np.flatnonzero(counts > LONG)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(long):
        chosen = np.isin(seg, long)
        edges = np.searchsorted(seg, long), np.searchsorted(seg, long, side="right")
        for s, a, b in zip(long.tolist(), *map(np.ndarray.tolist, edges), strict=True):
            starts = np.array(_merge_long(start[a:b].tolist(), int(stop[b - 1]), lattice, scores), dtype=np.int64)
            done.append((starts, np.concatenate((starts[1:], stop[b - 1 : b])), np.full(len(starts), s)))
        start, stop, seg = start[~chosen], stop[~chosen], seg[~chosen]

    def pair_scores(at: np.ndarray) -> np.ndarray:
        found = lattice.find(start[at], stop[at + 1] - start[at])
        return np.where(found >= 0, scores[found], -np.inf)

    score = np.full(len(start), -np.inf)
    pairs = np.flatnonzero(seg[:-1] == seg[1:])
    score[pairs] = pair_scores(pairs)
    while len(start):
        heads = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        best = np.maximum.reduceat(score, heads)
        sizes = np.diff(np.concatenate((heads, [len(start)])))
        settled = np.repeat(best == -np.inf, sizes)
        if settled.any():
            done.append((start[settled], stop[settled], seg[settled]))
            go = ~settled
            start, stop, seg, score = start[go], stop[go], seg[go], score[go]
            if not len(start):
                break
            sizes, best = sizes[best != -np.inf], best[best != -np.inf]
        hit = np.flatnonzero(score == np.repeat(best, sizes))
        at = hit[np.concatenate(([True], seg[hit][1:] != seg[hit][:-1]))]  # the leftmost of each segment
        stop[at] = stop[at + 1]
        gone = np.zeros(len(start), dtype=bool)
        gone[at + 1] = True
        moved = np.cumsum(~gone) - 1
        start, stop, seg, score = start[~gone], stop[~gone], seg[~gone], score[~gone]
        at = moved[at]
        near = np.zeros(len(start) + 1, dtype=bool)
        near[at + 1] = near[at] = True  # the merged symbol and the one before it, shifted by one
        changed = np.flatnonzero(near[1:])
        score[changed] = -np.inf
        changed = changed[changed + 1 < len(start)]
        changed = changed[seg[changed] == seg[changed + 1]]
        score[changed] = pair_scores(changed)
    if not done:
        return start, stop, seg
    start, stop, seg = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], stop[order], seg[order]


def _relax_unigram(bounds: np.ndarray, seg_start: np.ndarray, seg_stop: np.ndarray, lattice: Lattice, scores: np.ndarray, unk_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best path over the edges, which come sorted by their start. ``bounds``: starts of all characters."""
    n = int(seg_stop.max(initial=0))
    best, back = np.full(n + 1, -np.inf), np.full(n + 1, -1, dtype=np.int64)
    best[seg_start] = 0.0
    size_mask = (1 << lattice.shift) - 1
    first = np.searchsorted(lattice.edge >> lattice.shift, bounds)
    last = np.searchsorted(lattice.edge >> lattice.shift, bounds, side="right")
    next_char = np.concatenate((bounds[1:], seg_stop[-1:]))
    inside = np.searchsorted(seg_start, bounds, side="right") - 1
    for at, a, b, nxt, s in zip(bounds.tolist(), first.tolist(), last.tolist(), next_char.tolist(), inside.tolist(), strict=True):
        nxt = min(nxt, int(seg_stop[s]))
        single = False
        for e in range(a, b):
            end = at + int(lattice.edge[e] & size_mask)
            single |= end == nxt
            value = best[at] + scores[lattice.piece[e]]
            if value > best[end]:
                best[end], back[end] = value, at
        if not single and best[at] + unk_score > best[nxt]:
            best[nxt], back[nxt] = best[at] + unk_score, at
    starts, stops, segs = [], [], []
    for s, (a, b) in enumerate(zip(seg_start.tolist(), seg_stop.tolist(), strict=True)):
        path = []
        while b > a:
            path.append((int(back[b]), b))
            b = int(back[b])
        for x, y in reversed(path):
            starts.append(x)
            stops.append(y)
            segs.append(s)
    return np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64), np.array(segs, dtype=np.int64)


class Encoder:
    """Encodes texts in groups; remembers segments with their bytes and ids, up to ``CACHE_BYTES``."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()
        lengths = np.array([len(s) for s in vocab.surface], dtype=np.int64)
        self.surface_at = np.concatenate(([0], np.cumsum(lengths)))
        self.surface = np.frombuffer(b"".join(vocab.surface), dtype=np.uint8)

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # hashes of segments, sorted, with their slots
        self.slots = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)  # ids of the slots
        self.at = np.zeros(1, dtype=np.int64)
        self.raw = np.zeros(0, dtype=np.uint8)  # bytes of the slots
        self.raw_at = np.zeros(1, dtype=np.int64)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.known, self.slots, self.flat, self.at, self.raw, self.raw_at))

    def segments(self, segs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments in one array, and their counts."""
        vocab = self.vocab
        joined = np.frombuffer(bytes([_BREAK]).join(segs) + bytes([_BREAK]), dtype=np.uint8)
        lattice = Lattice(joined, vocab)
        sizes = np.array([len(s) for s in segs], dtype=np.int64)
        seg_start = np.cumsum(sizes + 1) - sizes - 1
        chars = np.flatnonzero(((joined & 0xC0) != 0x80) & (joined != _BREAK))
        seg = np.searchsorted(seg_start, chars, side="right") - 1
        stop = np.concatenate((chars[1:], [len(joined)]))
        stop = np.minimum(stop, (seg_start + sizes)[seg])
        if vocab.bpe:
            start, stop, seg = _relax_bpe(chars.astype(np.int64), stop.astype(np.int64), seg, lattice, vocab.scores)
        else:
            start, stop, seg = _relax_unigram(chars, seg_start, seg_start + sizes, lattice, vocab.scores, float(vocab.scores.min(initial=0.0)) - 10.0)
        found = lattice.find(start, stop - start)
        # a symbol without a piece is a single character: it falls back to its bytes
        spread = np.where(found >= 0, 1, stop - start)
        which = np.repeat(np.arange(len(start)), spread)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(spread) - spread, spread)
        ids = np.where(found[which] >= 0, vocab.ids[found[which]], vocab.byte_ids[joined[start[which] + inside]]).astype(np.int32)
        return ids, np.bincount(seg[which], minlength=len(segs))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin."""
        rows = [b" " + t.replace(SPACE, b" ") if t else b"" for t in texts]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        row_start = np.cumsum(sizes) - sizes
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[row_start[sizes > 0]] = True
        start = np.flatnonzero(begins)
        stop = np.concatenate((start[1:], [len(data)]))
        slots = self._slots(data, start, stop)
        counts = self.at[slots + 1] - self.at[slots]
        where = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - self.at[slots], counts)
        row = np.searchsorted(row_start, start, side="right") - 1
        per_row = np.bincount(row, weights=counts, minlength=len(rows)).astype(np.int64)
        return self.flat[where], np.concatenate(([0], np.cumsum(per_row)))

    def _slots(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Where the ids of each segment are kept; new segments are encoded first.

        Hashes only find candidates: a segment takes another's ids after their bytes were compared, and those that share a hash
        with other bytes are encoded on their own.
        """
        if self.held() > CACHE_BYTES:
            self.forget()
        size = stop - start
        unique, first, inverse = np.unique(span_hashes(data, start, stop), return_index=True, return_inverse=True)
        twin = first[inverse]
        alone = np.flatnonzero((size != size[twin]) | ~equal_spans(data, start, data, start[twin], np.minimum(size, size[twin])))
        place = np.searchsorted(self.known, unique)
        found = np.zeros(len(unique), dtype=np.int64)
        known = np.zeros(len(unique), dtype=bool)
        inside = np.flatnonzero(place < len(self.known))
        known[inside] = self.known[place[inside]] == unique[inside]
        hit = np.flatnonzero(known)
        found[hit] = self.slots[place[hit]]
        fits = self.raw_at[found[hit] + 1] - self.raw_at[found[hit]] == size[first[hit]]
        fits[fits] = equal_spans(data, start[first[hit[fits]]], self.raw, self.raw_at[found[hit[fits]]], size[first[hit[fits]]])
        new, other = np.flatnonzero(~known), hit[~fits]
        view = memoryview(data)
        spans = np.concatenate((first[new], first[other], alone)).tolist()
        if spans:
            raw = [bytes(view[a:b]) for a, b in zip(start[spans].tolist(), stop[spans].tolist(), strict=True)]
            ids, counts = self.segments(raw)
            base = len(self.at) - 1
            self.flat = np.concatenate((self.flat, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(counts)))
            self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(raw), dtype=np.uint8)))
            self.raw_at = np.concatenate((self.raw_at, self.raw_at[-1] + np.cumsum([len(r) for r in raw])))
            self.known = np.insert(self.known, place[new], unique[new])
            self.slots = np.insert(self.slots, place[new], np.arange(base, base + len(new)))
            found[new], found[other] = np.arange(base, base + len(new)), np.arange(base + len(new), base + len(new) + len(other))
        out = found[inverse]
        out[alone] = len(self.at) - 1 - len(alone) + np.arange(len(alone))
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of id lists; the dummy prefix's space goes."""
        counts = self.surface_at[ids + 1] - self.surface_at[ids]
        where = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - self.surface_at[ids], counts)
        raw = self.surface[where].tobytes()
        ends = np.concatenate(([0], np.cumsum(counts)))[offsets].tolist()
        return [raw[a + 1 if raw[a : a + 1] == b" " else a : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str = MODEL) -> Encoder:
    """This process's encoder for the model file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(Vocabulary.load(path))
    return _encoders[path]


def shipped(spark: SparkSession, path: str) -> str:
    """Send the model file to all executors; returns the name under which workers find it."""
    if path not in _shipped.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _shipped[spark.sparkContext.applicationId].add(path)
    return os.path.basename(path)


_shipped: dict[str, set[str]] = {}


def _groups(texts: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in texts:
        held.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, token_ids array<int>, n_tokens, n_bytes, round_trip) of every whole text.

    ``round_trip``: decoding the ids gives the text (with U+2581 as a space, which the model does not tell apart). Null texts and
    empty ones have no tokens; null text is not told from empty here. Characters without a piece become byte pieces. Repeated rows come back as often as
    given, null ids too; an empty table gives no rows; other columns are ignored. Very long texts are groups of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    name = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            done = 0
            for texts in _groups(batch.column(1)):
                ids, offsets = own.encode(texts)
                back = own.decode(ids, offsets)
                same = [b == t.replace(SPACE, b" ") for b, t in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(offsets)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(same),
                    ],
                    names=["id", "token_ids", "n_tokens", "n_bytes", "round_trip"],
                )
                done += len(texts)
                del texts, ids, back
            give_back()
        _encoders.clear()  # a worker lives on: the vocabulary and what it remembers don't
        del own
        give_back()

    shaped = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    return mapped(shaped, run, f"id {kind}, token_ids array<int>, n_tokens long, n_bytes long, round_trip boolean").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, keep: tuple[str, ...], ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``keep`` and ``text``: the texts of id lists (null for null)."""
    name = shipped(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            lists = [x.values.to_numpy(zero_copy_only=False).astype(np.int32) if x.is_valid else np.zeros(0, np.int32) for x in batch.column(batch.num_columns - 1)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            ids = np.concatenate([np.zeros(0, np.int32), *lists])
            texts = [t.decode("utf-8", "replace") for t in own.decode(ids, offsets)]
            valid = batch.column(batch.num_columns - 1).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())], names=[*keep, "text"])

    (ids,) = free_names(list(keep), "ids")
    return mapped(encoded.select(*map(col, keep), col(ids_col).alias(ids)), run, ", ".join([*typed(encoded, list(keep)), "text string"]))
