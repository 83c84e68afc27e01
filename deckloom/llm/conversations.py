"""Operator 11: repair of conversations' structure at least cost.

What is done to a row is a macro edit: a run of insertions, then one edit of the row (keep, rerole, delete). Macro edits are written as ordered prefix-free
codes, so audits of equally many rows never are prefixes of one another, and the least audit of each state follows from the rank of its parent in the layer
before and its code's place: no audit strings are kept, only ranks and parent pointers, from which the edits are read afterwards.

Conversations lie sorted in ranges of the whole table, so one that holds a third of all rows spans many tasks. It goes by blocks of rows: each block is summed up
by the costs and ranks from each state to each state, the few summaries are chained, and each block is then repaired between the states that the chain gives it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import col, mapped, shuffle_partitions, staged

#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of a block at most; a longer row is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULTS = (*FIGURES, "audit", "repaired_sha256")

_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. The role that may be inserted next in each, and what a kept initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Runs of insertions before an edit: two lead back to a state that behaves like the first, so longer ones only cost more.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: Insertions after the last row that lead to an end, with their number.
FINISH = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
FAR = 1 << 40


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The rows (conv_id, turn, role, text) after a repeatable damage by crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it,
    4 sets the role user. Nulls count as one space."""
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(col(conv).alias("conv_id"), col(turn).alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


@cache
def transitions(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each state after a row of that kind: the (state before, code's place, cost) that lead there."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for before in range(4):
        for place, code in enumerate(CODES):
            at, cost = before, INSERT * (len(code) - 1)
            for _ in code[:-1]:
                at = NEXT[at]
            if code[-1] == "D":
                cost += DELETE
            elif must_go:
                continue
            elif code[-1] == "R":
                at, cost = NEXT[at], cost + REROLE + TRUNCATED * truncated
            elif (at, initial) in KEEPS:
                at, cost = KEEPS[at, initial], cost + TRUNCATED * truncated
            else:
                continue
            found[at].append((before, place, cost))
    return tuple(map(tuple, found))


@cache
def step(costs: tuple[int, ...], ranks: tuple[int, ...], kind: tuple[str, bool, bool]) -> tuple[tuple[int, ...], tuple[int, ...], int, tuple[tuple[int, int], ...]]:
    """The next layer: costs less their least, ranks, that least, and each state's parent (state, code's place). There are few layers up to the least cost, so each is worked out once."""
    best = []
    for ways in transitions(*kind):
        best.append(min(((costs[p] + cost, ranks[p], place, p) for p, place, cost in ways if costs[p] < FAR), default=(FAR, 4, 0, -1)))
    # a state that any end leaves dearer than one beside it leads nowhere: what follows START costs at most a deletion less than what follows
    # ASSISTANT, and what follows SYSTEM nothing less
    for q, most in ((START, best[ASSISTANT][0] + DELETE), (SYSTEM, best[ASSISTANT][0])):
        if best[q][0] > most:
            best[q] = (FAR, 4, 0, -1)
    order = sorted(range(4), key=lambda q: (best[q][1], best[q][2]))
    least = min(b[0] for b in best)
    return tuple(b[0] - least if b[0] < FAR else FAR for b in best), tuple(order.index(q) for q in range(4)), least, tuple((b[3], b[2]) for b in best)


def sweep(kinds: list[tuple[str, bool, bool]], start: int) -> tuple[tuple[int, ...], tuple[int, ...], list[tuple[tuple[int, int], ...]]]:
    """Costs and ranks of each state after all rows, from one state before them, and the parents of every layer."""
    costs, ranks, total, parents = tuple(0 if q == start else FAR for q in range(4)), (0, 1, 2, 3), 0, []
    for kind in kinds:
        costs, ranks, least, parent = step(costs, ranks, kind)
        total += least
        parents.append(parent)
    return tuple(c + total if c < FAR else FAR for c in costs), ranks, parents


def ending(costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, int]:
    """The cheapest state at the end, the least audit first, and the whole cost."""
    cost, _, state = min((costs[q] + INSERT * n, ranks[q], q) for q, n in FINISH.items())
    return state, cost


def edits(parents: list[tuple[tuple[int, int], ...]], end: int) -> list[str]:
    """The code of each row on the way to the state ``end``."""
    found, state = [], end
    for layer in reversed(parents):
        state, place = layer[state]
        found.append(CODES[place])
    return found[::-1]


def repaired(codes: list[str], roles: list[str], texts: list[str], start: int, finish: int) -> Iterator[str]:
    """The ``role:text`` lines after the edits and ``finish`` insertions."""
    state = start
    for code, role, text in zip(codes, roles, texts, strict=True):
        for _ in code[:-1]:
            state = NEXT[state]
            yield f"{ROLE[state]}:"
        if code[-1] == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"
        elif code[-1] == "K":
            state = KEEPS[state, role[:1]]
            yield f"{role}:{text}"
    for _ in range(finish):
        state = NEXT[state]
        yield f"{ROLE[state]}:"


class Rows:
    """Rows of one conversation that follow each other, with their first faults. ``fresh``: whether each row is the first with its role and text."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str], fresh: list[bool]):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.initials = [r[:1] for r in roles]
        self.kinds, self.blank, self.duplicate, self.truncated = [], 0, 0, 0
        for initial, text, first in zip(self.initials, texts, fresh, strict=True):
            core = text.strip(_SPACES)
            blank, duplicate = not core, bool(core) and not first
            cut = bool(core) and first and core[-1] not in ".!?"
            self.blank += blank
            self.duplicate += duplicate
            self.truncated += cut
            self.kinds.append((initial if initial in "sua" else "", blank or duplicate, cut))
        self.illegal = sum(a + b not in _LEGAL for a, b in zip(self.initials, self.initials[1:], strict=False))
        known = [t for t in turns if t is not None]
        self.first, self.last = (known[0], known[-1]) if known else (None, None)
        self.distinct = len(set(known))


def mark(role: str, text: str) -> bytes:
    """128 bits of a role and a text."""
    raw = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(struct.pack("<q", len(raw)) + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def firsts(marks: list[bytes]) -> list[bool]:
    seen: set[bytes] = set()
    return [not (m in seen or seen.add(m)) for m in marks]


def whole(rows: Rows) -> tuple:
    """The results of a conversation that is in one place."""
    costs, ranks, parents = sweep(rows.kinds, START)
    end, cost = ending(costs, ranks)
    codes = edits(parents, end)
    lines = "\n".join(repaired(codes, rows.roles, rows.texts, START, FINISH[end]))
    gaps = 0 if rows.first is None else rows.last - rows.first + 1 - rows.distinct
    return gaps, rows.blank, rows.duplicate, rows.truncated, rows.illegal, cost, "".join(codes) + "I" * FINISH[end], hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _kind(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    """The SQL and the Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return df.schema[name].dataType.simpleString(), to_arrow_type(df.schema[name].dataType)


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    """Results of conversations that lie in one task's range whole, and blocks of the others: staged rows (done, conv, results, part, block, turns, roles, texts, marks)."""
    sql, arrow = _kind(rows, "conv")
    names = [("done", pa.bool_()), ("conv", arrow), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("block", pa.int32())]
    schema = pa.schema([*names, ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("marks", pa.list_(pa.binary()))])
    nothing = (None,) * len(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held: tuple[list, list, list] = ([], [], [])
        own, block, size, seen, weight = None, 0, 0, 0, 0  # block: those that the conversation has filled; seen: conversations that ended

        def flush(closed: bool) -> None:
            nonlocal block, size, weight
            turns, roles, texts = (list(x) for x in held)
            marks = [mark(r, t) for r, t in zip(roles, texts, strict=True)]
            if closed and not block and seen:
                out.append((True, own, *whole(Rows(turns, roles, texts, firsts(marks))), part, 0, None, None, None, None))
            else:
                out.append((False, own, *nothing, part, block, turns, roles, texts, marks))
                block += 1
            weight += size
            size = 0
            for x in held:
                x.clear()

        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] or block:
                    if conv != own:
                        if held[0]:
                            flush(True)
                        seen, block = seen + 1, 0
                    elif len(held[0]) >= BLOCK_ROWS or size + len(text) > BLOCK_CHARS:
                        flush(False)
                own = conv
                size += len(text)
                for x, v in zip(held, (turn, role, text), strict=True):
                    x.append(v)
                if len(out) >= 4096 or weight > BLOCK_CHARS:
                    yield _batch(out, schema)
                    out, weight = [], 0
        if held[0]:  # the range's last conversation may go on in the next
            flush(False)
        yield _batch(out, schema)

    longs = ", ".join(f"{c} long" for c in FIGURES)
    spelled = f"done boolean, conv {sql}, {longs}, audit string, repaired_sha256 string, part int, block int, turns array<long>, roles array<string>, texts array<string>, marks array<binary>"
    # rows that tie in all of these are equal; the last key only spreads them
    dealt = rows.select("conv", "turn", "role", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_h", "_n"]
    ranged = dealt.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return staged(mapped(ranged.select("conv", "turn", "role", "text"), run, spelled))


def _with_firsts(blocks: DataFrame) -> DataFrame:
    """The open blocks with ``fresh``: the numbers of their rows that are the first of their conversation with that role and text. Found from partial minima, so what a conversation
    repeats is a row a task, and brought back by block: no text meets all its copies."""
    rows = blocks.select("conv", "part", "block", F.posexplode("marks").alias("i", "mark"))
    least = rows.groupBy("conv", "mark").agg(F.min(F.struct("part", "block", "i")).alias("at"))
    fresh = least.groupBy(F.col("at.part").alias("_part"), F.col("at.block").alias("_block"), F.col("conv").alias("_conv")).agg(F.collect_list("at.i").alias("fresh"))
    same = (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")) & F.col("conv").eqNullSafe(F.col("_conv"))
    return staged(blocks.join(fresh, same, "left").select("conv", "part", "block", "turns", "roles", "texts", "fresh"))


def _rows_of(turns: list, roles: list, texts: list, fresh: list | None) -> Rows:
    first = set(fresh or ())
    return Rows(turns, roles, texts, [i in first for i in range(len(roles))])


_SUMMARY = ("blank", "duplicate", "truncated", "illegal", "first", "last", "distinct_turns")


def _summaries(blocks: DataFrame) -> DataFrame:
    """A short row for each block: counts, its ends, and from each state to each state the costs and ranks."""
    sql, arrow = _kind(blocks, "conv")
    schema = pa.schema([("conv", arrow), ("part", pa.int32()), ("block", pa.int32()), *((c, pa.int64()) for c in _SUMMARY), ("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, block, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _rows_of(*data)
                ways = [sweep(rows.kinds, p) for p in range(4)]
                out.append((conv, part, block, rows.blank, rows.duplicate, rows.truncated, rows.illegal, rows.first, rows.last, rows.distinct, rows.initials[0], rows.initials[-1], [c for w in ways for c in w[0]], [r for w in ways for r in w[1]]))
            yield _batch(out, schema)

    longs = ", ".join(f"{c} long" for c in _SUMMARY)
    return mapped(blocks, run, f"conv {sql}, part int, block int, {longs}, head string, tail string, costs array<long>, ranks array<int>")


class Chain:
    """The layers of one conversation's blocks."""

    def __init__(self) -> None:
        self.costs, self.ranks = (0, FAR, FAR, FAR), (0, 1, 2, 3)
        self.at: list[tuple[int, int, bytes]] = []  # part, block, the state before it for each state after it
        self.sums = [0, 0, 0, 0]
        self.first = self.last = self.tail = None
        self.distinct = 0

    def add(self, part: int, block: int, sums: list[int], first: int | None, last: int | None, distinct: int, head: str, tail: str, costs: list[int], ranks: list[int]) -> None:
        best = [min(((self.costs[p] + costs[4 * p + q], self.ranks[p], ranks[4 * p + q], p) for p in range(4) if self.costs[p] < FAR and costs[4 * p + q] < FAR), default=(FAR, 4, 4, 0)) for q in range(4)]
        order = sorted(range(4), key=lambda q: (best[q][1], best[q][2]))
        self.costs, self.ranks = tuple(b[0] for b in best), tuple(order.index(q) for q in range(4))
        self.at.append((part, block, bytes(b[3] for b in best)))
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
        self.sums[3] += self.tail is not None and self.tail + head not in _LEGAL
        self.tail = tail
        if first is not None:
            self.distinct += distinct - (self.last == first)
            self.first, self.last = first if self.first is None else self.first, last

    def plan(self) -> Iterator[tuple]:
        """(part, block, state before, state after, is the last, gaps, blank, duplicate, truncated, illegal, cost) from the last block on."""
        state, cost = ending(self.costs, self.ranks)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        for k, (part, block, before) in enumerate(reversed(self.at)):
            yield part, block, before[state], state, k == 0, gaps, *self.sums, cost
            state = before[state]


def _chained(summaries: DataFrame) -> DataFrame:
    """For each block the states that the cheapest edits of the whole conversation give it. A task streams a conversation's summaries, a row for up to ``BLOCK_ROWS`` rows, and
    keeps some bytes of each."""
    sql, arrow = _kind(summaries, "conv")
    plan = ("p_part", "p_block", "before", "after", "is_last", *FIGURES)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * len(FIGURES)]
    schema = pa.schema([("p_conv", arrow), *zip(plan, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, own = None, None

        def close() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in chain.plan():
                rows.append((own, *row))
                if len(rows) == 4096:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

        for batch in batches:
            for conv, part, block, blank, duplicate, truncated, illegal, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain is None or conv != own:
                    if chain is not None:
                        yield from close()
                    chain, own = Chain(), conv
                chain.add(part, block, [blank, duplicate, truncated, illegal], *rest)
        if chain is not None:
            yield from close()

    ordered = summaries.repartition(shuffle_partitions(summaries.sparkSession), "conv").sortWithinPartitions("conv", "part", "block")
    longs = ", ".join(f"{c} long" for c in FIGURES)
    return mapped(ordered, run, f"p_conv {sql}, p_part int, p_block int, before int, after int, is_last boolean, {longs}")


def _finished(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Repairs each block between its states and joins what they give, in order, as a stream: a digest can't be put together from digests of parts, so the repaired lines of a
    conversation of several blocks pass through one task, a batch at a time."""
    sql, arrow = _kind(blocks, "conv")
    same = (F.col("part") == F.col("p_part")) & (F.col("block") == F.col("p_block")) & F.col("conv").eqNullSafe(F.col("p_conv"))
    joined = blocks.join(plan, same).select("conv", "part", "block", "turns", "roles", "texts", "fresh", "before", "after", "is_last", *FIGURES)
    piece = pa.schema([("conv", arrow), ("part", pa.int32()), ("block", pa.int32()), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string()), ("lines", pa.binary())])
    result = pa.schema([("conv", arrow), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, block, turns, roles, texts, fresh, before, after, is_last, *figures in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _rows_of(turns, roles, texts, fresh)
                codes = edits(sweep(rows.kinds, before)[2], after)
                finish = FINISH[after] if is_last else 0
                lines = "".join(f"\n{line}" for line in repaired(codes, roles, texts, before, finish))
                out.append((conv, part, block, *figures, "".join(codes) + "I" * finish, lines.encode("utf-8", "surrogatepass")))
            yield _batch(out, piece)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, audit, figures, begun = None, None, [], None, False

        def close() -> pa.RecordBatch:
            return _batch([(own, *figures, "".join(audit), digest.hexdigest())], result)

        for batch in batches:
            for conv, _, _, *numbers, codes, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv != own:
                    if digest is not None:
                        yield close()
                    own, digest, audit, begun = conv, hashlib.sha256(), [], False
                figures = numbers
                audit.append(codes)
                digest.update(lines if begun else lines[1:])  # each line follows a line feed, but for the first
                begun = begun or bool(lines)
        if digest is not None:
            yield close()

    longs = ", ".join(f"{c} long" for c in FIGURES)
    pieces = mapped(joined, repair, f"conv {sql}, part int, block int, {longs}, audit string, lines binary")
    ordered = pieces.repartition(shuffle_partitions(blocks.sparkSession), "conv").sortWithinPartitions("conv", "part", "block")
    return mapped(ordered, join, f"conv {sql}, {longs}, audit string, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows``, and of those that only ``keep`` has.

    A conversation's rows go by turn (nulls first), then role and text. Each row's first fault counts: blank (no character but white space), duplicate (its role and text came
    earlier), truncated (its last such character is none of ``.!?``). ``illegal`` counts neighbours whose roles' initials aren't su, ua or au, ``gaps`` the turns
    missing between the least and the largest. The cheapest edits (keep 0, rerole to user or assistant 3, delete 4, which blank and duplicate rows must, insert an empty user or
    assistant 3; truncated rows that stay 3) give initials ``(s?(ua)+)?``; ``audit`` is theirs in order (K, R, D, I), the least in ASCII of equally cheap ones. ``repaired_sha256`` is
    over the repaired ``role:text`` lines, joined by line feeds.

    Null roles and texts are one space; null turns take no part in gaps; null ids are one conversation. Very long texts and conversations go by blocks. A conversation without rows has zeros,
    an empty audit and the digest of nothing. An empty table gives no rows. Other columns are ignored.
    """
    if conv in RESULTS:
        raise ValueError(f"{conv} is the name of a result")
    shaped = rows.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), *(F.coalesce(col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    found = _sorted_blocks(shaped)
    blocks = _with_firsts(found.where("NOT done").drop("done", *RESULTS))
    finished = _finished(blocks, _chained(_summaries(blocks)))
    done = found.where("done").select("conv", *RESULTS).unionByName(finished)
    if keep is not None:
        done = staged(done)
        given = keep.select(col(conv).alias("conv")).distinct().join(done.select(F.col("conv").alias("_conv")), F.col("conv").eqNullSafe(F.col("_conv")), "left_anti")
        nothing = [F.lit(0).cast("long").alias(c) for c in FIGURES]
        done = done.unionByName(given.select("conv", *nothing, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")))
    return done.select(F.col("conv").alias(conv), *RESULTS)


def repaired_turns(rows: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, no, edit, role, text): the repaired turns themselves, by the audits of ``repair_conversations``. A conversation's audit and then its turns pass through a task in order, sorted on disk where they are many; what is
    held is the audit and the place in it, never the turns."""
    turns = rows.select(col(conv).alias("conv"), F.lit(1).alias("kind"), col(turn).cast("long").alias("turn"), *(F.coalesce(col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    audits = repairs.select(col(conv).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("kind").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.xxhash64("text").asc()]
    ordered = turns.unionByName(audits).repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")
    sql, arrow = _kind(turns, "conv")
    schema = pa.schema([("conv", arrow), ("no", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, audit, at, state, no = None, "", 0, START, 0
        out: list[tuple] = []

        def insertions() -> None:
            nonlocal at, state, no
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                out.append((own, no, "I", ROLE[state], ""))
                at, no = at + 1, no + 1

        for batch in batches:
            for conv_id, kind, said, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    insertions()  # after the last turn of the conversation before
                    own, audit, at, state, no = conv_id, body, 0, START, 0
                    continue
                insertions()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = NEXT[state] if edit == "R" else KEEPS[state, said[:1]]
                    out.append((own, no, edit, ROLE[state] if edit == "R" else said, body))
                    no += 1
            yield _batch(out, schema)
            out.clear()
        insertions()
        yield _batch(out, schema)

    return mapped(ordered, run, f"conv {sql}, no long, edit string, role string, text string").withColumnRenamed("conv", conv)
