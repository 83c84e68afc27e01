"""Operator 2: line deduplication by a segment-partition edit join.

A line is dropped if the same line, or one within the edit distance below, comes earlier in the corpus (by document id, then
place). Lines are sequences of symbols: words, or characters. A line of n symbols is split into ``THRESHOLD`` + 1 segments and listed under
each; every line probes, for each length it could match, the substrings that a segment of that length could have moved to.
Lines within the distance share such a key, since the edits can't touch all segments. What shares a key is verified by banded
bit-parallel edit distance.

Lists aren't paired. First their lines are verified against two of each list, its earliest line and the one with the longest lists, which
settles groups of near copies. Lines that are still open meet what is before them in their lists, if lengths and parities of their
symbols let them be near; where such a list is long, its lines are listed anew under two segments of a partition into one more, and so on: lines within the distance share m segments of ``THRESHOLD`` + m
at any m, and lists get shorter with each. Lines that are settled probe no more. What is still in long lists at the last level is paired there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm import bloom
from deckloom.llm.common import BROADCAST_BYTES, broadcast_if_small, col, free_names, hash_bits, mapped, staged, text_or_empty, twins, typed
from deckloom.llm.text import Words, give_back, groups, mixed, span_hashes

#: Edits that make a near copy at most, and the share of the longer line's symbols that they may be: two words of twenty.
THRESHOLD, SHARE = 2, 0.1
#: What an edit is about: a word or a character.
UNIT = "word"
#: Longer lists of open lines are split by levels of ever more segments. A pair costs some 20 ns there (two comparisons of its facts), a line's keys at
#: the next level some 100 us: lists of some thousands are where they cost the same.
HOT, LEVELS = 4096, 3
#: Lines that a task remembers so as not to list a copy again.
SEEN = 1 << 18
#: An odd number and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
HAS_WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"


def within(a, b, k: int) -> bool:
    """Whether the edit distance of two sequences (texts or lists of symbols) is at most ``k``: bit-parallel over a band of 2 k + 1
    diagonals, after the common ends are cut off; it ends as soon as the band's outer diagonal is too far."""
    if abs(len(a) - len(b)) > k:
        return False
    size = min(len(a), len(b))
    low, high = 0, size
    while low < high:  # the common prefix by bisection: slices compare fast
        mid = (low + high + 1) >> 1
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) >> 1
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m <= k:  # every cell is in the band: n is at most 2 k here
        return n <= k or _distance(a, b) <= k
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus = full & ~((1 << k) - 1), 0  # column 0 as the band of column 1 sees it: rows 1.. rise by one
    value, horizontal = k, top >> 1
    for j in range(1, n + 1):
        first = j - k - 1  # the row below the band's lowest
        x = places.get(b[j - 1], 0)
        x = (x >> first if first >= 0 else x << -first) & full
        d0 = ((((x & plus) + plus) ^ plus) | x | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        if j <= m - k:  # down the outer diagonal
            value += not d0 & top
            if value - (n - m + k) > k:
                return False
        else:  # along the last row
            value += bool(hp & horizontal)
            value -= bool(hn & horizontal)
            horizontal >>= 1
        d0 >>= 1
        plus, minus = hn | (full & ~(d0 | hp)), d0 & hp
    return value <= k


def _distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(n: int, k: int, share: float) -> int:
    """Edits between two lines of which the longer has ``n`` symbols."""
    return min(k, int(share * n + 1e-9))


@cache
def moves(k: int, m: int) -> tuple:
    """(lack, segments, shifts): where ``m`` segments of a line that is ``lack`` symbols shorter can stand in a line within ``k`` edits.

    A line is split into k + m segments, of which at least m are untouched. A segment's shift is what the edits before it
    add, so shifts start from 0, end at ``lack``, and their changes sum up to k at most. With one segment the first untouched one will do
    from either side: i segments before it were edited, so its shift is at most i, and alike from behind.
    """
    found = []
    for lack in range(k + 1):
        for chosen in combinations(range(k + m), m):
            for shifts in _shifts(k, m, lack):
                if m > 1 or (abs(shifts[0]) <= chosen[0] and abs(lack - shifts[0]) <= k - chosen[0]):
                    found.append((lack, chosen, shifts))
    return tuple(found)


def _shifts(k: int, m: int, lack: int) -> list[tuple]:
    found = [((), 0, k)]
    for _ in range(m):
        found = [((*s, t), t, left - abs(t - last)) for s, last, left in found for t in range(-k, k + 1) if abs(t - last) <= left]
    return [s for s, last, left in found if abs(lack - last) <= left]


def _lines(docs: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """One row for each line with a word: doc, mark (of the whole text), no, line (with single spaces if words count), id (64 bits of the
    line) and check (64 others)."""
    text = col(text_col)
    rows = docs.select(col(id_col).alias("doc"), hash_bits(text, seed=2).alias("mark"), F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("no", "line"))
    rows = rows.where(F.col("line").rlike(HAS_WORD))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", SPACES, " "))) if unit == "word" else rows
    return rows.select("*", hash_bits(F.col("line"), seed=11).alias("id"), hash_bits(F.col("line"), seed=12).alias("check"))


def _split(line: str, unit: str):
    return line.split(" ") if unit == "word" else line


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, unit: str = UNIT) -> tuple[DataFrame, DataFrame]:
    """(id, place: its first doc, mark, no) of each line, and (id, line) of all occurrences. Lines are known by 128 bits; ids are half of
    them, and of lines that share that half all but one get an id of their own (``twins``), so texts need not travel. Occurrences are reduced in each
    task first: a line that all documents share is one row a task."""
    rows = _lines(docs, id_col, text_col, unit)
    lines = staged(_once(rows))
    shared = staged(lines.where("lo <> hi").select(F.col("id").alias("_shared")))
    if not shared.isEmpty():
        pairs = staged(rows.select("id", "check").join(shared, F.col("id") == F.col("_shared"), "left_semi").distinct())
        renamed = rows.sparkSession.createDataFrame(twins(pairs, lines.select("id")), "_id long, _check long, _new long")
        # a row for each line but one that shares half of its hash: at most ``TWINS_MAX``
        met = rows.join(F.broadcast(renamed), (F.col("id") == F.col("_id")) & (F.col("check") == F.col("_check")), "left")
        rows = met.withColumn("id", F.coalesce("_new", "id")).drop("_id", "_check", "_new")
        lines = staged(_once(rows))
    return lines.select("id", "place"), rows.select("id", "line")


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.min(F.struct("doc", "mark", "no")).alias("place"), F.min("check").alias("lo"), F.max("check").alias("hi"))


def _symbols(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each symbol of a group of lines, and the symbols before each line."""
    if unit == "word":
        words = Words(data, offsets)
        return words.hashes(lower=False), words.first
    start = np.flatnonzero((data & 0xC0) != 0x80)
    return span_hashes(data, start, np.append(start[1:], len(data))), np.searchsorted(start, offsets)


def segment_keys(hashes: np.ndarray, first: np.ndarray, k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, lines, own) of a group of lines for each way that a segment can stand in a line. A key is a hash of the length that it is for, the
    segment's number and its symbols; hashes of segments come from sums of powers, which may collide: what meets is verified."""
    n, parts = np.diff(first), k + 1
    powers = np.cumprod(np.full(len(hashes) + 1, _BASE, dtype=np.uint64))
    back = np.cumprod(np.full(len(hashes) + 1, _BACK, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])))
    listed = np.floor(share * (n + k) + 1e-9) >= 1
    most = np.minimum(k, np.floor(share * n + 1e-9))
    for lack, (segment,), (shift,) in moves(k, 1):
        size, own = n - lack, lack == 0 and shift == 0
        start, stop = segment * size // parts + shift, (segment + 1) * size // parts + shift
        enough = listed if own else most >= max(1, abs(shift) + abs(lack - shift))
        at = np.flatnonzero(enough & (size >= 1) & (start >= 0) & (stop <= n))
        a, b = first[at] + start[at], first[at] + stop[at]
        yield mixed((sums[b] - sums[a]) * back[a] + mixed(size[at].astype(np.uint64) * np.uint64(parts) + np.uint64(segment))), at, own


def _first_keys(texts: DataFrame, unit: str, k: int, share: float) -> DataFrame:
    """(key, id, own): level 1. ``own``: the line's own segment. A task skips lines that it has seen, as far as it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, _, data, offsets in groups(batch.column(1)):
                fresh = np.zeros(len(offsets) - 1, dtype=bool)
                for i, line in enumerate(ids[begin : begin + len(fresh)].tolist()):
                    if line not in seen:
                        fresh[i] = True
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(line)
                hashes, first = _symbols(data, offsets, unit)
                for keys, at, own in segment_keys(hashes, first, k, share):
                    new = fresh[at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(ids[begin + at[new]]), pa.array(np.full(int(new.sum()), own))], names=["key", "id", "own"])
            give_back()

    return mapped(texts.select("id", F.col("line").cast("binary").alias("line")), run, "key long, id long, own boolean")


def _deeper_keys(lines: DataFrame, unit: str, k: int, share: float, m: int) -> DataFrame:
    """(key, id, own) of the lines (id, line, probes) under ``m`` of k + m segments; those that don't probe look for shorter lines only."""
    parts = k + m

    def keys(symbols, probes: bool) -> Iterator[tuple[int, bool]]:
        n, seen = len(symbols), set()
        for lack, chosen, shifts in moves(k, m):
            size, own = n - lack, lack == 0 and not any(shifts)
            if size < 1 or not own and (allowed(n, k, share) < 1 or not probes and not lack):
                continue  # a settled line is found by the open ones of its length, but has to look for the shorter ones
            spans = [(i * size // parts + t, (i + 1) * size // parts + t) for i, t in zip(chosen, shifts, strict=True)]
            if spans[0][0] < 0 or any(b > n for _, b in spans):
                continue
            found = (m, size, chosen, *(tuple(symbols[max(0, a) : b]) for a, b in spans))
            key = int.from_bytes(hashlib.blake2b(repr(found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            if (key, own) not in seen:
                seen.add((key, own))
                yield key, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, line, probes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(key, i, own) for key, own in keys(_split(line, unit), probes)]
                if len(out) > 1 << 16:
                    yield pack(out)
                    out = []
            yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        keys_, ids, own = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array(ids, pa.int64()), pa.array(own, pa.bool_())], names=["key", "id", "own"])

    return mapped(lines.select("id", "line", "probes"), run, "key long, id long, own boolean")


def _met(keys: DataFrame) -> DataFrame:
    """(key, id, own, size): the rows of lists that hold an own segment and another line, with the list's size. All keys are dealt once, and most
    go there."""
    mine = Window.partitionBy("key")
    met = keys.select("*", F.max("own").over(mine).alias("owned"), F.min("id").over(mine).alias("lo"), F.max("id").over(mine).alias("hi")).where("owned AND lo <> hi")
    return staged(met.groupBy("key", "id").agg(F.max("own").alias("own")).withColumn("size", F.count(F.lit(1)).over(mine)))


def _facts(near_texts: DataFrame, lines: DataFrame, unit: str) -> DataFrame:
    """(id, place, n, parity) of the lines that met another: symbols, and 64 bits of which each says whether an odd number of the symbols has that
    hash. An edit changes two of them at most, so lines with more changed bits can't be near."""
    symbols = "split(line, ' ')" if unit == "word" else "split(line, '')"
    parity = F.expr(f"aggregate(transform({symbols}, x -> shiftleft(1L, CAST(xxhash64(x) & 63L AS INT))), 0L, (a, x) -> a ^ x)")
    return staged(near_texts.select("id", F.expr(f"size({symbols})").alias("n"), parity.alias("parity")).join(lines, "id"))


def _listed(met: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their line's facts, and ``first``: the facts of the list's earliest line that owns the segment."""
    mine = Window.partitionBy("key")
    first = F.min(F.when(F.col("own"), F.struct("place", "id", "n", "parity"))).over(mine)
    return staged(met.join(facts, "id").select("key", "id", "place", "n", "parity", "own", "size", first.alias("first")))


def _close(l: str, r: str, k: int, share: float) -> Column:
    """Whether two lines can be near, by their lengths and parities."""
    most = F.least(F.lit(k), F.floor(share * F.greatest(f"{l}n", f"{r}n") + 1e-9))
    return (F.abs(F.col(f"{l}n") - F.col(f"{r}n")) <= most) & (F.bit_count(F.col(f"{l}parity").bitwiseXOR(F.col(f"{r}parity"))) <= 2 * most)


def _stars(listed: DataFrame, k: int, share: float) -> DataFrame:
    """(a, b), a before b: every line of a list with two of its lines, the earliest and the one whose own lists are the longest (the original
    among its near copies). The number of pairs is that of the rows at most."""
    rich = listed.where("size > 2")
    weight = rich.where("own").groupBy(F.col("id").alias("i")).agg(F.sum("size").alias("weight"))
    heavy = rich.where("own").join(weight, F.col("id") == F.col("i")).groupBy(F.col("key").alias("k")).agg(F.max(F.struct("weight", "place", "id", "n", "parity")).alias("centre"))
    own = ("id", "place", "n", "parity")
    second = rich.join(heavy, F.col("key") == F.col("k")).select(*own, F.struct(*[F.col(f"centre.{c}").alias(c) for c in ("place", "id", "n", "parity")]).alias("centre"))
    both = listed.select(*own, F.col("first").alias("centre")).union(second).where(F.col("id") != F.col("centre.id")).where(_close("", "centre.", k, share))
    before = F.col("place") < F.col("centre.place")
    return both.select(F.when(before, F.col("id")).otherwise(F.col("centre.id")).alias("a"), F.when(before, F.col("centre.id")).otherwise(F.col("id")).alias("b"))


def _of_ids(texts: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """(id, line), once, of the given ids (a column i, ``count`` rows at most): from another pass over the texts, of which little travels."""
    if count * 16 <= BROADCAST_BYTES:
        return staged(texts.join(F.broadcast(ids), F.col("id") == F.col("i"), "left_semi").dropDuplicates(["id"]))
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bloom.build(ids.select("i"), count, 0.01, salt=79, hashes=_id_hashes))  # None beyond its bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch if shared.value is None else batch.filter(pa.array(shared.value.might_contain(mixed(own), own)))

    found = mapped(texts, run, "id long, line string")
    kept = staged(found.join(ids, F.col("id") == F.col("i"), "left_semi").dropDuplicates(["id"]))
    shared.unpersist()
    return kept


def _id_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return mixed(own), own


def _verified(pairs: DataFrame, near_texts: DataFrame, unit: str, k: int, share: float) -> DataFrame:
    """Ids of the later lines b of those pairs (a, b) that are near."""
    one = near_texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    two = near_texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    joined = staged(pairs.select("a", "b").distinct()).join(one, "a").join(two, "b").select("b", "line_a", "line_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = _split(x, unit), _split(y, unit)
                good.append(within(x, y, allowed(max(len(x), len(y)), k, share)))
            yield pa.RecordBatch.from_arrays(batch.columns[:1], names=["id"]).filter(pa.array(good, pa.bool_()))

    return staged(mapped(joined, verify, "id long").distinct())


def near_lines(lines: DataFrame, texts: DataFrame, unit: str = UNIT, k: int = THRESHOLD, share: float = SHARE, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """(id) of the distinct lines (id, place; texts: id, line) that have an earlier line within the distance.

    ``hot`` and ``levels`` move cost only."""
    if k < 1:
        return lines.sparkSession.createDataFrame([], "id long")
    met = _met(_first_keys(texts, unit, k, share))
    ids = staged(met.select(F.col("id").alias("i")).distinct())
    near_texts = _of_ids(texts, ids, ids.count())
    facts = _facts(near_texts, lines, unit)
    near: DataFrame | None = None
    for level in range(1, levels + 1):
        listed = _listed(met, facts)
        found = _verified(_stars(listed, k, share), near_texts, unit, k, share)
        near = found if near is None else staged(near.union(found).distinct())
        rest = _open_lists(listed, near)
        if rest.isEmpty():
            return near
        last = level == levels  # what the levels leave is paired
        short, long = rest.where(F.lit(last) | (F.col("size") <= hot)), rest.where(~F.lit(last) & (F.col("size") > hot))
        near = staged(near.union(_verified(_pairs(short, k, share), near_texts, unit, k, share)).distinct())
        if last or long.isEmpty():
            return near
        inside = long.groupBy("id").agg(F.max("open").alias("open"))
        asked = near_texts.join(inside, "id").join(near.withColumn("known", F.lit(True)), "id", "left")
        met = _met(_deeper_keys(asked.select("id", "line", F.col("known").isNull().alias("probes")), unit, k, share, level + 1))
    return near


def _open_lists(listed: DataFrame, near: DataFrame) -> DataFrame:
    """The rows, with ``open``, of lists where a line that is not settled has another one than the earliest before it; what comes after the last
    such line is left out, and ``size`` is what remains."""
    rows = listed.where("size > 2").join(near.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left").withColumn("open", F.col("i").isNull()).drop("i", "size")
    last = rows.groupBy(F.col("key").alias("k")).agg(F.max(F.when(F.col("open"), F.col("place"))).alias("last"), F.min(F.when(F.col("id") != F.col("first.id"), F.col("place"))).alias("second"))
    kept = rows.join(last.where("last > second"), F.col("key") == F.col("k")).where("place <= last").drop("k", "last", "second")
    return staged(kept.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))))


def _pairs(rows: DataFrame, k: int, share: float) -> DataFrame:
    """(a, b) of lines that meet in a list, one by its own segment, b not settled and after a, that can be near; the earliest line's are known."""
    left, right = rows.where(F.col("id") != F.col("first.id")).alias("l"), rows.where("open").alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.place") < F.col("r.place")) & (F.col("l.own") | F.col("r.own")) & _close("l.", "r.", k, share))
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = THRESHOLD, share: float = SHARE, unit: str = UNIT) -> DataFrame:
    """``docs`` with ``text_col`` less its dropped lines, and n_lines, n_kept, n_exact, n_near (long).

    Lines are cut at line feeds; only lines with a word count, the others stay where they are. With ``unit`` 'word' a line is
    its words (white space between them doesn't count), with 'char' its characters. A line stays if no equal line and no line within ``k`` edits of a
    symbol, nor more than ``share`` of the longer one's symbols, comes before it, by id (null first), then a hash of
    the text, then place; dropped lines count as coming before too. So short lines (under 10 words at the default share) are dropped as
    equal only: one word of five makes another line.

    Null texts stay null with zeros. Rows that repeat id and text are one document: all keep the same lines. Very long lines
    cost their length. An empty table gives no rows. Input columns named like the results are replaced; other columns may have any name.
    """
    lines, texts = distinct_lines(docs, id_col, text_col, unit)
    near = near_lines(lines, texts, unit, k, share).select(F.col("id").alias("near_id"))
    marked = lines.select("id", "place").join(broadcast_if_small(near, 16), F.col("id") == F.col("near_id"), "left")
    added = ("n_lines", "n_kept", "n_exact", "n_near")
    columns = [c for c in docs.columns if c not in added]
    mark, doc, of_mark, places, n_near = free_names(columns, "mark", "doc", "of_mark", "places", "near")
    kept = marked.groupBy(F.col("place.doc").alias(doc), F.col("place.mark").alias(of_mark)).agg(F.sort_array(F.collect_list(F.when(F.col("near_id").isNull(), F.col("place.no")))).alias(places), F.count("near_id").alias(n_near))
    rows = docs.select(*map(col, columns), hash_bits(col(text_col), seed=2).alias(mark))
    joined = rows.join(kept, col(id_col).eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(of_mark)), "left")
    where = columns.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], [[], [], [], []]
            for text, places, n_near in zip(batch.column(where), batch.column(len(columns)), batch.column(len(columns) + 1), strict=True):
                keep = set(places.as_py() or ())
                lines = (text.as_py() or "").split("\n")
                words = [bool(line.strip(" \t\n\r\v\f")) for line in lines]
                out.append("\n".join(line for i, line in enumerate(lines) if i in keep or not words[i]) if text.is_valid else None)
                total, near = sum(words), n_near.as_py() or 0
                for c, v in zip(counts, (total, len(keep), total - len(keep) - near, near), strict=True):
                    c.append(v)
            arrays = list(batch.columns[: len(columns)])
            arrays[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in counts)], names=[*columns, *added])
            del out, counts, arrays
            give_back()

    return mapped(joined.select(*map(col, columns), places, n_near), rebuild, ", ".join([*typed(docs, columns), *(f"{c} long" for c in added)]))
