"""Operator 12: best-fit packing of token sequences under several capacities.

A document is cut into pieces of at most a sequence's tokens. Pieces of one length are alike, so what is packed is the histogram of lengths: it
has no more rows than a sequence has tokens, however many documents there are. Vector best-fit runs over it, longest pieces first, on classes of
bins with equal content, and yields patterns with how often each is used. The pieces, numbered within their length by counts of each task, then take
their places in the patterns. Only counts pass through the driver.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress
from math import isqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.common import col, free_names, mapped, staged
from deckloom.llm.segments import Flat, Remembered, byte_symbols, distinct_spans
from deckloom.llm.text import Words, give_back, groups

#: Tokens of a sequence.
TOKENS = 4096
#: The id that ends a document.
END = 1
RESULTS = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents (pieces), and attention cost: the sum of squared lengths, as each piece attends to itself."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)

    def longest(self) -> int:
        """The longest piece that a sequence can hold."""
        return min(self.tokens, isqrt(int(self.limits()[2])))


@dataclass
class Bins:
    """``count`` bins of equal content: the residual capacities and the content as (content before, length, copies)."""

    count: int
    left: np.ndarray
    content: tuple | None


def best_fit(histogram: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of bins, [(length, copies), ...]), by decreasing length.

    Each piece goes to the bin, of those that have room for it in every capacity, with the least weighted norm of what would be left ('norm') or the
    largest weighted dot product of its demands and what is left ('dot'); a new bin opens only if none has room. Under 'norm' a bin that took
    a piece is the best for the next of that length too, so whole classes of bins are filled at once: the work grows with the number of lengths
    (each opens or splits two classes at most), not with that of the pieces.
    """
    limits = capacity.limits()
    scale = np.asarray(weights, dtype=float)
    bins: list[Bins] = []
    left = np.zeros((0, 3), dtype=np.int64)
    open_bins: list[int] = []  # places in ``bins`` of the rows of ``left``

    def add(count: int, rest: np.ndarray, content: tuple) -> None:
        nonlocal left
        bins.append(Bins(count, rest, content))
        if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
            left = np.vstack((left, rest))
            open_bins.append(len(bins) - 1)

    def take(row: int) -> Bins:
        nonlocal left
        left = np.delete(left, row, axis=0)
        own = bins[at := open_bins.pop(row)]
        bins[at] = Bins(0, own.left, None)
        return own

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        todo, item = histogram[length], np.array([length, 1, length * length], dtype=np.int64)
        if (item > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            room = (left >= item).all(axis=1).nonzero()[0]
            if len(room):
                after = (left[room] - item) / limits if rule == "norm" else left[room] / limits
                score = (scale * after**2).sum(axis=1) if rule == "norm" else -(scale * after * (item / limits)).sum(axis=1)
                own = take(int(room[score.argmin()]))
            else:
                own = None
            base = limits if own is None else own.left
            copies = int((base // item).min()) if own is None or rule == "norm" else 1
            count = -(-todo // copies) if own is None else min(own.count, -(-todo // copies))
            full, rest = (count, 0) if count * copies <= todo else (count - 1, todo - (count - 1) * copies)
            before = own.content if own else None
            if full:
                add(full, base - copies * item, (before, length, copies))
            if rest:
                add(1, base - rest * item, (before, length, rest))
            if own and own.count > count:
                add(own.count - count, own.left, own.content)
            todo -= full * copies + rest
    found = []
    for b in bins:
        if b.count and b.content is not None:
            pattern, at = [], b.content
            while at is not None:
                at, length, copies = at
                pattern.append((length, copies))
            found.append((b.count, pattern[::-1]))
    return found


def fewest(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, list[tuple[int, int]]]]:
    """The best of a few rules and weights: the fewest bins, the first of them on ties. Capacities that can't bind have no weight."""
    limits, most = capacity.limits(), max(histogram, default=1)
    binds = (1.0, float(limits[1] < capacity.tokens), float(limits[2] < capacity.tokens * most))
    tries = [("norm", binds), ("norm", (1.0, 0.0, 0.0))] if any(binds[1:]) else [("norm", binds)]
    tries.append(("dot", binds))
    return min((best_fit(histogram, capacity, rule, weights) for rule, weights in tries), key=lambda p: sum(n for n, _ in p))


@dataclass
class Places:
    """Where the pieces of each length go: for (length, first rank), the copies a bin, the first sequence and the offset there."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> Places:
        rows, taken, sequence = [], {}, 0
        for count, pattern in patterns:
            offset = 0
            for length, copies in pattern:
                rank = taken.get(length, 0)
                rows.append((length, rank, copies, sequence, offset))
                taken[length] = rank + count * copies
                offset += length * copies
            sequence += count
        rows.sort()
        return Places(*(np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 5)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the ``rank``-th piece of a length."""
        first, last = np.searchsorted(self.length, length), np.searchsorted(self.length, length, side="right")
        low, high = first.copy(), last - 1
        while (low < high).any():  # the last row of the length whose first rank is not past it
            mid = (low + high + 1) >> 1
            ok = self.rank[mid] <= rank
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        into = rank - self.rank[low]
        return self.sequence[low] + into // self.copies[low], self.offset[low] + into % self.copies[low] * length


#: A longer word goes to the library.
LONG_WORD = 1000
_ODD = np.zeros(256, dtype=bool)  # bytes that no word of common characters has
_ODD[:0x21] = _ODD[0x7F] = _ODD[0xC0:0xC2] = _ODD[0xC9:] = True


def common_words(words: list[bytes]) -> np.ndarray:
    """Whether each word has only characters below U+0240 that are printable, no white space, not the dotted capital I: these are normal under NFC and
    lower-cased one by one."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    size = np.array([len(w) for w in words], dtype=np.int64)
    after = np.append(data[1:], np.uint8(0))
    odd = _ODD[data] | ((data == 0xC2) & (after < 0xA1)) | ((data == 0xC4) & (after == 0xB0))
    sums = np.concatenate(([0], np.cumsum(odd)))[np.concatenate(([0], np.cumsum(size)))]
    return (np.diff(sums) == 0) & (size <= LONG_WORD)


class WordIds:
    """Token ids by a ``tokenizers`` file whose words end with a suffix; words between white space are encoded once each.

    Words of common characters take a short way: they are lower-cased and split by the file's pattern, and ``tiktoken`` merges their bytes
    with a line feed for the suffix, by ranks from the file's merges. All others go to the library, and so do all words of a file of another form.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Remembered(self._learn, self._forget)
        self._forget()
        with open(path, encoding="utf-8") as f:
            self._read(json.load(f))

    def _read(self, file: dict) -> None:
        import tiktoken

        self.encoding, model, suffix = None, file["model"], file["model"].get("end_of_word_suffix")
        splits = [p for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        steps = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        if not suffix or len(splits) != 1 or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or steps != ["NFC", "Replace", "Lowercase"]:
            return
        of = byte_symbols()
        spelled = lambda entry: bytes(of[c] for c in entry.removesuffix(suffix)) + (b"\n" if entry.endswith(suffix) else b"")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 10]): 256 + b for b in range(256)}
        for merge in model["merges"]:
            ranks.setdefault(spelled("".join(merge if isinstance(merge, list) else merge.split(" "))), len(ranks))
        vocab = {spelled(entry): i for entry, i in model["vocab"].items()}
        self.id_of = np.array([vocab.get(b, 0) for b in sorted(ranks, key=ranks.get)], dtype=np.uint32)
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\n]+\n|\n", mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.ids = Flat(np.uint32)

    def _by_library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        easy = common_words(words) if self.encoding is not None else np.zeros(len(words), dtype=bool)
        ready = b"\n".join(compress(words, easy)).decode()
        if any(x in ready for x in self.special):
            easy &= [not any(x.encode() in w for x in self.special) for w in words]
            ready = b"\n".join(compress(words, easy)).decode()
        hard = self._by_library([w.decode("utf-8", "replace") for w in compress(words, ~easy)])
        found, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if ready:
            ranks = np.array(self.encoding.encode_ordinary(self.pattern.sub("\\g<0>\n", ready.lower()) + "\n"), dtype=np.int64)
            lone = np.flatnonzero(ranks == 10)  # a line feed of its own ends a word
            ends = lone - np.arange(len(lone))
            found = self.id_of[np.delete(ranks, lone)]
        size = np.zeros(len(words), dtype=np.int64)
        size[easy] = np.diff(ends, prepend=0)
        size[~easy] = [len(x) for x in hard]
        ids = np.zeros(int(size.sum()), dtype=np.uint32)
        is_easy = np.repeat(easy, size)
        ids[is_easy] = found
        ids[~is_easy] = np.fromiter(chain.from_iterable(hard), dtype=np.uint32)
        self.ids.add(ids, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text of a group."""
        words = Words(data, offsets)
        segments, inverse = distinct_spans(data, words.start, words.stop)
        numbers = self.words.numbers(segments)[inverse]
        ids = self.ids.of(numbers)
        before = np.concatenate(([0], np.cumsum(self.ids.size[numbers])))[words.first]
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield ids[a:b]


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, cut: int, path: str, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank[, ids]): ``rank`` counts the pieces of a length in the task ``part``. Staged."""
    own, part, rank, ids_name = free_names([id_col, *RESULTS], "id", "part", "rank", "ids")
    names = [own, "piece", "start", "length", "ids_crc32", part, rank, *([ids_name] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(path), np.zeros(cut + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for begin, _, data, offsets in groups(batch.column(1)):
                row, piece, start, length, crc, rank_of, kept = [], [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(data, offsets)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), cut)):
                        one = ids[at : at + cut]
                        row.append(begin + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(one))
                        crc.append(zlib.crc32(one.tobytes()))
                        rank_of.append(seen[len(one)])
                        seen[len(one)] += 1
                        if keep_ids:
                            kept.append(one.astype(np.int64))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(rank_of, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int64()))] if keep_ids else [])], names=names)
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{own} {kind}, piece int, start long, length long, ids_crc32 long, {part} int, {rank} long" + (f", {ids_name} array<long>" if keep_ids else "")
    shaped = docs.select(col(id_col).alias(own), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("_text"))
    return staged(mapped(shaped, run, schema))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity | None = None, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    A document is its token ids and ``END``. One that is longer than a sequence can hold is cut into pieces of that length, the last may be shorter; no other is cut.
    Sequences hold whole pieces, gapless from 0, within every limit of ``capacity``. Null and empty texts are the end id alone. Repeated rows are
    packed as often as given; copies are pieces of one length like any others, and take distinct places. Null ids stay null. An empty table gives no rows. Other columns are ignored.
    """
    if id_col in RESULTS:
        raise ValueError(f"{id_col} is the name of a result")
    capacity = capacity or Capacity()
    cut = capacity.longest()
    found = pieces_of(docs, id_col, text_col, cut, path or vocabulary("word_bpe_49k.json"), keep_ids)
    own, part, rank, ids_name = free_names([id_col, *RESULTS], "id", "part", "rank", "ids")
    of_part, of_length, before = free_names(found.columns, "of_part", "of_length", "before")
    counts = staged(found.groupBy(F.col(part).alias(of_part), F.col("length").alias(of_length)).agg(F.count(F.lit(1)).alias("n")))
    # a row for each length: no more than a sequence has tokens
    histogram = {r["length"]: r["n"] for r in counts.groupBy(F.col(of_length).alias("length")).agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy(of_length).orderBy(of_part).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    joined = found.join(placed, (F.col(part) == F.col(of_part)) & (F.col("length") == F.col(of_length)))
    ranked = joined.select(own, "piece", "start", "length", "ids_crc32", (F.col(rank) + F.col(before)).alias(rank), *([ids_name] if keep_ids else []))
    # some bytes for each class of bins, of which there are at most three a length
    places = docs.sparkSession.sparkContext.broadcast(Places.of(fewest(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(*(batch.column(i).to_numpy() for i in (3, 5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], names=names)

    names = [own, *RESULTS, *([ids_name] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{own} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (f", {ids_name} array<long>" if keep_ids else "")
    done = mapped(ranked, run, schema).withColumnRenamed(own, id_col)
    return done.withColumnRenamed(ids_name, "ids") if keep_ids else done


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, documents): what a training step reads, from ``pack_documents`` with ``keep_ids``. ``documents`` are (offset, id, piece, start, length).
    A sequence's rows are at most its tokens, so no group grows with the corpus."""
    part = F.struct("offset", col(id_col).alias("id"), "piece", "start", "length", "ids")
    found = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return found.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("documents"))
