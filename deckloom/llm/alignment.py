"""Operator 13: alignment of two tokenizers over the bytes of each text.

A bitset for each tokenizer marks the bytes at which its tokens end. Their AND has the shared cuts, which part both token sequences into groups; each
bit of their OR ends a stretch of bytes that lies in one token of either, that is one link. Popcounts turn positions into token numbers (rank), and bits
into positions (select). Where one space stands between other characters both tokenizers always cut, so texts are taken by such segments, each distinct one once.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import BROADCAST_BYTES, col, free_names, mapped, split_hot, staged
from deckloom.llm.packing import vocabulary
from deckloom.llm.segments import Flat, Remembered, byte_symbols, distinct_spans
from deckloom.llm.text import give_back, groups

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: A link's pair of ids as one number: a * 2^32 + b.
SHIFT = 32
#: Bytes of a pair in the table of counts.
PAIR_BYTES = 17
SPACE = "▁"

_MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)
_PLAIN = np.zeros(256, dtype=bool)  # bytes beside which a single space is a sure cut
_PLAIN[0x21:0x7F] = True
_ALONE = _PLAIN.tolist()
#: The bytes with which white space beyond ASCII begins.
_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


class Bits:
    """A bitset over byte positions, with the bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def of_ends(ends: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, dtype=bool)
        flags[ends - 1] = True
        return Bits(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits at positions before ``at``."""
        word = at >> 6
        inside = self.words[np.minimum(word, len(self.words) - 1)] & _MASKS[at & 63] if len(self.words) else np.zeros(len(at), np.uint64)
        return self.before[word] + np.where(word < len(self.words), np.bitwise_count(inside), 0)

    def select(self) -> np.ndarray:
        """The positions of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tokenizations of the same ``size`` bytes (each token's end): the shared cuts (positions of last bytes), how many a and b tokens end
    up to each, and the a and b token of each link."""
    a, b = Bits.of_ends(ends_a, size), Bits.of_ends(ends_b, size)
    cuts = Bits(a.words & b.words).select()
    stretches = Bits(a.words | b.words).select()
    return cuts, a.rank(cuts + 1), b.rank(cuts + 1), a.rank(stretches), b.rank(stretches)


class ByteTokens:
    """Byte-level BPE of a ``tokenizers`` file; its entries' ids are their merge ranks, so ``tiktoken`` gives the same ids, faster. Special tokens'
    strings are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = byte_symbols()
        ranks = {bytes(of[c] for c in entry): i for entry, i in vocab.items()}
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.bytes = {i: b for b, i in ranks.items()}
        for b, i in ranks.items():
            self.size[i] = len(b)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


class PieceTokens:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece has a space after another character: segments don't stand alone")
        self.bytes = {i: bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)}
        self.size = np.array([len(self.bytes[i]) for i in range(n)], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


def cut_places(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text's first byte (``firsts``, a space), and at each single space between characters that surely are no white space."""
    lead = np.isin(data, np.array(_LEADS, dtype=np.uint8))
    high = data >= 0x80
    before = np.zeros(len(data), dtype=bool)
    two, three = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    two[2:], three[3:] = lead[:-2], lead[:-3]
    before[1:] = _PLAIN[data[:-1]] | high[:-1]
    before &= ~(two | three) | np.concatenate(([False], _PLAIN[data[:-1]]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = _PLAIN[data[1:]] | (high[1:] & ~lead[1:])
    begins = (data == 0x20) & before & after
    begins[firsts] = True
    return np.flatnonzero(begins)


#: Segments are encoded in runs of about so many bytes: those that begin and end with a plain character beside their space stand alone in a run too.
RUN_BYTES = 1 << 15


class Aligner:
    """Segments of texts (each with a space before it) with their tokens' groups and links."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.segments = Remembered(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.figures = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, good
        self.strings: list[bytes] = []
        self.links = Flat(np.int64)

    def _encoded(self, raw: list[bytes]) -> tuple[list[int], list[int], bool]:
        """The ids of segments that follow each other, and whether the tokens of both spell them."""
        whole = b"".join(raw)
        text = whole.decode("utf-8", "replace")
        found = self.a.encode(text), self.b.encode(text)
        return *found, all(b"".join([t.bytes.get(i, b"") for i in ids]) == whole for t, ids in zip((self.a, self.b), found, strict=True))

    def _tokens(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of A, of B, and whether each segment is spelled by both; the ids of those that aren't are left out."""
        of_a: list[int] = []
        of_b: list[int] = []
        good = np.ones(len(raw), dtype=bool)

        def close(run: list[int]) -> None:
            a, b, fine = self._encoded([raw[i] for i in run])
            if fine:
                of_a.extend(a)
                of_b.extend(b)
            elif len(run) > 1:
                for i in run:
                    close([i])
            else:
                good[run[0]] = False

        run, size = [], 0
        for i, s in enumerate(raw):
            plain = len(s) > 1 and (_ALONE[s[1]] or s[1] > 0x7F and s[1] not in _LEADS) and (_ALONE[s[-1]] or s[-1] > 0x7F and s[-2] != 0xC2 and s[-3] not in _LEADS)
            if run and (not plain or size > RUN_BYTES):
                close(run)
                run, size = [], 0
            run.append(i)
            size += len(s)
            if not plain:
                close(run)
                run, size = [], 0
        if run:
            close(run)
        return np.array(of_a, dtype=np.int64), np.array(of_b, dtype=np.int64), good

    def _learn(self, raw: list[bytes]) -> None:
        ids_a, ids_b, good = self._tokens(raw)
        size = np.array([len(s) for s in raw], dtype=np.int64) * good
        ends, ends_a, ends_b = np.cumsum(size), np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        cuts, upto_a, upto_b, link_a, link_b = align(ends_a, ends_b, int(size.sum()))
        n_a, n_b, n_groups = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (ends_a, ends_b, cuts + 1))
        self.figures = np.concatenate((self.figures, np.stack((n_a, n_b, n_groups, good), axis=1)))
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        whole, a0, b0 = [], 0, 0
        for x, y in zip(upto_a.tolist(), upto_b.tolist(), strict=True):
            whole.append(f"{names_a[a0] if x == a0 + 1 else ','.join(names_a[a0:x])}|{names_b[b0] if y == b0 + 1 else ','.join(names_b[b0:y])}")
            a0, b0 = x, y
        g0 = 0
        for g1 in np.cumsum(n_groups).tolist():
            self.strings.append(";".join(whole[g0:g1]).encode())
            g0 = g1
        n_links = np.diff(np.searchsorted(ends_a[link_a], ends, side="right"), prepend=0)
        self.links.add(ids_a[link_a] << SHIFT | ids_b[link_b], n_links)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text of a group: n_a, n_b, n_groups, n_links, groups_sha256, its distinct links and how often it has each."""
        size = np.diff(offsets)
        data = np.insert(data, offsets[:-1][size > 0], 0x20)
        offsets = np.concatenate(([0], np.cumsum(size + (size > 0))))
        begin = cut_places(data, offsets[:-1][size > 0]) if len(data) else np.zeros(0, dtype=np.int64)
        raw, inverse = distinct_spans(data, begin, np.append(begin[1:], len(data)))
        known = self.segments.numbers(raw)
        numbers = known[inverse]
        strings = [self.strings[n] for n in known.tolist()]
        flat, upto = self.links.of(numbers), np.concatenate(([0], np.cumsum(self.links.size[numbers])))
        bounds = np.searchsorted(begin, offsets)
        sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.figures[numbers], axis=0)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n_a, n_b, n_groups, good = (sums[b] - sums[a]).tolist()
            if a == b or good < b - a:
                yield 0, 0, 0, 0, "", flat[:0], flat[:0]
                continue
            keys, times = np.unique(flat[upto[a] : upto[b]], return_counts=True)
            digest = hashlib.sha256(b";".join([strings[i] for i in inverse[a:b].tolist()])).hexdigest()
            yield n_a, n_b, n_groups, int(upto[b] - upto[a]), digest, keys, times


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(ByteTokens(path_a), PieceTokens(path_b))


def _linked(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, own: str) -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of every document. Staged; ``row`` tells rows apart."""
    names = [own, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(path_a, path_b)
        for batch in batches:
            for begin, end, data, offsets in groups(batch.column(2)):
                a, b, n_groups, links, digest, keys, times = zip(*found.documents(data, offsets), strict=True)
                ids = [batch.column(i).slice(begin, end - begin) for i in (0, 1)]
                counts = [pa.array(c, pa.int64()) for c in (a, b, n_groups, links)]
                first = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(np.concatenate(x))) for x in (keys, [t.astype(np.int32) for t in times])]
                yield pa.RecordBatch.from_arrays([*ids, *counts, pa.array(digest, pa.string()), *lists], names=names)
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    shaped = docs.select(col(id_col).alias(own), F.monotonically_increasing_id().alias("row"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = f"{own} {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>"
    return staged(mapped(shaped, run, schema))


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A: byte-level BPE of a space and the text. B: sentencepiece of the text, which adds the space. Offsets at which tokens of both end part the tokens into groups. Two
    tokens link where their bytes overlap. A pair of ids counts the documents that hold it linked; ``n_best``: links whose count is the highest of their a id,
    ``count_sum``: the counts of all links. ``groups_sha256`` is over ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that the tokens of either don't spell, have zeros and ''. Repeated rows are documents like others. Null ids
    stay null. An empty table gives no rows. Other columns are ignored.
    """
    if id_col in RESULTS:
        raise ValueError(f"{id_col} is the name of a result")
    (own,) = free_names([*RESULTS, "row", "keys", "times"], "id")
    linked = _linked(docs, id_col, text_col, path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model"), own)
    counts = linked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts)
    best = counts.groupBy(F.shiftright("key", SHIFT).alias("_a")).agg(F.max("n").alias("most"))
    judged = staged(counts.join(best, F.shiftright("key", SHIFT) == F.col("_a")).select("key", "n", (F.col("n") == F.col("most")).alias("best")))
    hot, rest = split_hot(judged, "n", BROADCAST_BYTES // PAIR_BYTES)
    # the most frequent pairs, as many as fit: at 17 bytes each within ``BROADCAST_BYTES``
    table = hot.toPandas()
    order = np.argsort(table["key"].to_numpy())
    known = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("key", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, is_best = known.value
        for batch in batches:
            lists, times = batch.column(7), batch.column(8)
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            key, time = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            have = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
            of = lambda values: np.where(have, values[at] if len(keys) else 0, 0)
            sums = [np.concatenate(([0], np.cumsum(time * of(v)))) for v in (is_best.astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *(pa.array(s[first[1:]] - s[first[:-1]]) for s in sums)], names=names)
            give_back()

    names = [*linked.columns[:7], "n_best", "count_sum"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{own} {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    done = mapped(linked, run, schema)
    if rest is not None:  # the other pairs meet their links in a join: few a pair, since the frequent ones are known
        links = linked.select(F.col("row").alias("_row"), F.explode(F.arrays_zip("keys", "times")).alias("link")).select("_row", F.col("link.keys").alias("_key"), F.col("link.times").cast("long").alias("_times"))
        met = links.join(rest, F.col("_key") == F.col("key"))
        more = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("_times") * F.col("n")).alias("_sum"))
        done = done.join(more, F.col("row") == F.col("_row"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return done.select(col(own).alias(id_col), *RESULTS)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id, start, stop, a_ids, b_ids): one row a group, with its bytes' offsets in space + text; what a transfer between the tokenizers reads."""
    own, start, stop = free_names([id_col], "id", "start", "stop")
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(path_a, path_b)
        for batch in batches:
            for i, raw in enumerate(batch.column(1)):
                if not (text := raw.as_buffer().to_pybytes().decode("utf-8", "replace")):
                    continue
                whole = (" " + text).encode()
                a, b = found.a.encode(" " + text), found.b.encode(" " + text)
                if any(b"".join(t.bytes.get(x, b"") for x in ids) != whole for t, ids in ((found.a, a), (found.b, b))):
                    continue
                a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                cuts, upto_a, upto_b, _, _ = align(np.cumsum(found.a.size[a]), np.cumsum(found.b.size[b]), len(whole))
                begins = np.concatenate(([0], cuts[:-1] + 1))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)), pa.int32()), pa.array(ids)) for upto, ids in ((upto_a, a), (upto_b, b))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(cuts), pa.int64())), pa.array(begins), pa.array(cuts + 1), *lists], names=[own, "start", "stop", "a_ids", "b_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    shaped = docs.select(col(id_col).alias(own), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("_text"))
    return mapped(shaped, run, f"{own} {kind}, start long, stop long, a_ids array<long>, b_ids array<long>").withColumnRenamed(own, id_col)
