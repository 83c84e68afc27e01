"""Operator 3: near-duplicate documents by a size-aware heavy-light set join on word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm import bloom
from deckloom.llm.common import col, free_names, mapped, restaged, staged, twins
from deckloom.llm.components import components
from deckloom.llm.text import Words, give_back, groups, mixed

WORDS = 5
#: Two sets link if 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Sets of at most so many shingles are small while that costs no more (see ``boundary``); the rest are large.
SMALL_MAX = 24
#: Tokens in the table of frequent ones: the frequency from which a token counts as frequent is chosen so that they fit.
FREQUENT_MAX = 1 << 20
#: Inverted lists of up to so many sets are compared pair by pair; longer ones by a centre first.
LIGHT_LIST = 32
#: Shingles that are counted together; a token that is seen once in each lot isn't counted, which moves cost only.
COUNTED = 1 << 21
#: Sets that a task remembers so as not to send a copy's tokens again.
SEEN = 1 << 18


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    for _, _, data, offsets in groups(column):
        found = Words(data, offsets)
        hashes = found.hashes(lower=True)
        shingles, at = found.windows(hashes, words)
        row = found.row[at]
        for k in range(1, words):
            few, begin = found.windows(hashes, k)
            whole = found.per_row[found.row[begin]] == k
            shingles, row = np.concatenate((shingles, few[whole] + np.uint64(k))), np.concatenate((row, found.row[begin][whole]))
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(offsets)))
        shingles = shingles[order]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(shingles[a:b])


@dataclass
class Names:
    """A set's id: ``bits`` of its signature's first half, but for those of ``renamed``, which share them with another set."""

    bits: int = 64
    renamed: dict[tuple[int, int], int] = field(default_factory=dict)

    def signature(self, tokens: np.ndarray) -> tuple[int, int]:
        raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
        first = int.from_bytes(raw[:8], "little", signed=True)
        return first if self.bits == 64 else first & ((1 << self.bits) - 1), int.from_bytes(raw[8:], "little", signed=True)

    def node(self, tokens: np.ndarray) -> int:
        pair = self.signature(tokens)
        return self.renamed.get(pair, pair[0]) if self.renamed else pair[0]


def prefix_length(n: int, subset: int = 1) -> int:
    """Tokens of which a set of ``n`` shares at least ``subset`` with any set it links to, whatever the order of tokens."""
    need = -(-PERCENT * n // 100)
    return min(n, n - need + subset) if need >= subset else n


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, level: np.ndarray, small: int) -> np.ndarray:
    """The keys under which a set is listed.

    Tokens are ordered by frequency (rare ones first, then by hash). A small set of at least three shingles is listed under
    the pairs of its prefix: linked sets share two tokens of it. A large set is listed under each token of its prefix. Since sets on both sides of the
    boundary may link, sets up to a quarter larger than the boundary are listed both ways.
    """
    n = len(tokens)
    if not n:
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), max(len(frequent) - 1, 0))
    if len(frequent):
        rank = np.where(frequent[at] == tokens, level[at], np.int8(-1))
        ordered = tokens[np.argsort(rank, kind="stable")]
    else:
        ordered = tokens
    keys = []
    if n <= small + small // 4 and n >= 3:  # as the small side, or as its partner
        head = ordered[: prefix_length(n, 2)]
        a, b = np.triu_indices(len(head), 1)
        low, high = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
        keys.append(mixed(mixed(low) + high))
    if n > small or n < 3:
        keys.append(ordered[: prefix_length(n)])
    return np.concatenate(keys) if keys else tokens[:0]


def boundary(histogram: dict[int, int], frequent_share: float) -> int:
    """The largest size at which enumerating pairs of a prefix costs less than scanning single tokens' lists.

    A set of n shingles has about C(0.2 n + 2, 2) pairs and 0.2 n + 1 single tokens. A pair's row costs 1; a token's row costs 1
    and, where the token is frequent, the rows of its list that it meets, at least ``LIGHT_LIST``.
    """
    best = 0
    for n in range(3, SMALL_MAX + 1):
        head = prefix_length(n, 2)
        if head * (head - 1) / 2 <= prefix_length(n) * (1 + frequent_share * LIGHT_LIST):
            best = n
    return best if any(n <= best for n in histogram) else 0


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _profile(docs: DataFrame, id_col: str, text_col: str, named: Names) -> DataFrame:
    """One row a document (kind 0: doc_id, n, a and b: its set's signature) and one for each token that several sets of a
    batch have (kind 1: a: the token, b: how many)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "a", "b"]
        for batch in batches:
            sizes, one, two, held, seen, total = [], [], [], [], set(), 0
            for tokens in shingle_sets(batch.column(1)):
                s = named.signature(tokens) if len(tokens) else (None, None)
                sizes.append(len(tokens))
                one.append(s[0])
                two.append(s[1])
                if len(tokens) and s not in seen:
                    seen.add(s)
                    held.append(tokens)
                    total += len(tokens)
                    if total > COUNTED:
                        yield counts(held, batch.column(0).type)
                        held, total = [], 0
            if held:
                yield counts(held, batch.column(0).type)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=names)

    def counts(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        found = np.diff(np.concatenate((starts, [len(every)])))
        some = found > 1
        n = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), _int64(every[starts[some]]), pa.array(found[some])], names=["kind", "doc_id", "n", "a", "b"])

    shaped = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    return staged(mapped(shaped, run, f"kind int, doc_id {kind}, n long, a long, b long"))


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and the power of two of their counts. At most ``FREQUENT_MAX``; any order of tokens gives the
    same links, so the bound moves cost only."""
    counted = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).select("a", F.floor(F.log2("n")).cast("int").alias("level"))
    counted = staged(counted)
    levels = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}  # a row a power of two
    least, total = max(levels, default=0) + 1, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > FREQUENT_MAX or level < 2:
            break
        least = level
    found = counted.where(F.col("level") >= least).toPandas()
    tokens = found["a"].to_numpy(dtype=np.int64, copy=True).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["level"].to_numpy(dtype=np.int8)[order]


def _listed(docs: DataFrame, text_col: str, named: Names, tables: object, only: object = None) -> DataFrame:
    """(token, node, n): the keys of every distinct set. ``only``: a Bloom filter of tokens; the others aren't sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, level, small = tables.value
        wanted = only.value if only is not None else None
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes, held = [], [], [], 0
            for tokens in shingle_sets(batch.column(0)):
                if not len(tokens):
                    continue
                node = named.node(tokens)
                if node in seen:
                    continue
                if len(seen) >= SEEN:  # what is forgotten is sent once more; rows are made distinct later
                    seen.clear()
                seen.add(node)
                own = prefix_keys(tokens, frequent, level, small)
                if wanted is not None:
                    own = own[wanted.might_contain(mixed(own), own)]
                keys.append(own)
                nodes.append(node)
                sizes.append(len(tokens))
                held += len(own)
                if held > 1 << 18:
                    yield pack(keys, nodes, sizes)
                    keys, nodes, sizes, held = [], [], [], 0
            if held:
                yield pack(keys, nodes, sizes)
            give_back()

    def pack(keys: list, nodes: list, sizes: list) -> pa.RecordBatch:
        counts = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays([_int64(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), counts)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts))], names=["token", "node", "n"])

    return mapped(docs.select(col(text_col).cast("binary").alias("text")), run, "token long, node long, n int")


def _token_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The (h1, h2) under which ``_listed`` looks up a token in the Bloom filter."""
    raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return mixed(raw), raw


def _can_link(l: str, r: str) -> Column:
    """Whether two sets with ``n`` shingles, ``c`` listed ones in the prefix and ``after`` behind it can link: 100 i >= PERCENT (n_l + n_r - i).

    The set whose prefix ends first in the order of tokens has its prefix's tokens in common with the other's prefix only, so two
    sets share at most what both prefixes list and the longer remainder. A set's own ``c`` and ``after`` don't bound it: the larger
    set may hold the smaller one's prefix behind its own.
    """
    n_l, n_r = F.col(f"{l}n"), F.col(f"{r}n")
    most = F.least(n_l, n_r, F.least(f"{l}c", f"{r}c") + F.greatest(f"{l}after", f"{r}after"))
    return most * (100 + PERCENT) >= PERCENT * (n_l + n_r)


def _sets_of(docs: DataFrame, text_col: str, named: Names, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of the given nodes, from another pass over the texts; tokens as packed 64-bit numbers."""
    count = nodes.count()
    filt = bloom.build(nodes.select("node"), count, 0.01, salt=77, hashes=_token_hashes)
    shared = docs.sparkSession.sparkContext.broadcast(filt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for batch in batches:
            ids, sets, size = [], [], 0
            for tokens in shingle_sets(batch.column(0)):
                node = named.node(tokens) if len(tokens) else None
                if node is None or node in seen:
                    continue
                key = np.array([node], dtype=np.int64).view(np.uint64)
                if wanted is not None and not wanted.might_contain(mixed(key), key)[0]:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                ids.append(node)
                sets.append(tokens.tobytes())
                size += len(sets[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])
                    ids, sets, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])
            give_back()

    found = mapped(docs.select(col(text_col).cast("binary").alias("text")), run, "node long, tokens binary")
    sets = staged(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    shared.unpersist()  # workers would keep it for as long as they live
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                shared = int((v[at] == u).sum())
                keep.append(100 * shared >= PERCENT * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    return mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b"), run, "a long, b long")


def links(docs: DataFrame, text_col: str, named: Names, histogram: dict[int, int], profile: DataFrame) -> DataFrame:
    """Links (a, b) between distinct sets that give the right components: of two linked sets, either the link is there or both are
    linked through others."""
    sc = docs.sparkSession.sparkContext
    frequent, level = _frequent(profile)
    total = sum(n * c for n, c in histogram.items())
    tables = sc.broadcast((frequent, level, boundary(histogram, min(1.0, len(frequent) / max(1, total)))))
    # Tokens that one set alone has can't lead to another: found from partial minima, so a hot token is one row a task.
    counted = _listed(docs, text_col, named, tables).groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = staged(counted.where("lo <> hi").select("token"))
    n_shared = shared.count()
    if not n_shared:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    filt = bloom.build(shared, n_shared, 0.02, salt=78, hashes=_token_hashes)  # None beyond its bound: then all rows are sent again
    rows = _listed(docs, text_col, named, tables, sc.broadcast(filt) if filt is not None else None)
    rows = staged(rows.join(shared, "token", "left_semi").groupBy("token", "node").agg(F.first("n").alias("n")))
    small = tables.value[2]
    # c: the prefix's tokens that other sets list too; after: the tokens behind the prefix. Sets listed by pairs count whole.
    need = F.expr(f"CAST(n - ({PERCENT} * n + 99) DIV 100 + 1 AS INT)")
    single = (F.col("n") > small + small // 4) | (F.col("n") < 3)
    bound = rows.groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).cast("int").alias("c"), F.first("n").alias("n"))
    bound = bound.select("_node", "c", F.when(single, F.col("n") - need).otherwise(F.col("n")).cast("int").alias("after"))
    rows = restaged(rows.join(bound, F.col("node") == F.col("_node")).drop("_node"), rows)
    lists = rows.groupBy(F.col("token").alias("_token")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = restaged(rows.join(lists, F.col("token") == F.col("_token")).drop("_token"), rows)
    # A list's centre is the set whose own lists are the longest on average: the original among its near copies.
    alone = F.greatest(F.first("n") - F.first("after") - F.first("c"), F.lit(0))
    weight = rows.groupBy(F.col("node").alias("_node")).agg(((F.sum("size") + alone) / (F.count(F.lit(1)) + alone)).alias("common"))
    long = rows.where(F.col("size") > LIGHT_LIST).join(weight, F.col("node") == F.col("_node")).drop("_node")
    centres = long.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("common", "node", "n", "c", "after")).alias("centre"))
    long = staged(long.join(centres, F.col("token") == F.col("_token")).drop("_token"))
    star = long.where(F.col("node") != F.col("centre.node")).where(_can_link("", "centre."))
    star = star.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
    light = rows.where(F.col("size") <= LIGHT_LIST).select("token", "node", "n", "c", "after")
    pairs = staged(star.union(_pairs(light, F.lit(True))).distinct())
    sets = _sets_of(docs, text_col, named, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    found = staged(_verified(pairs, sets))
    # Long lists whose sets are all in one component by now are settled. In the others, sets of different components still
    # have to be compared: the exact way for the rest.
    whole_long, long = long, long.select("token", "node", "n", "c", "after")
    parts = components(found).select(F.col("node").alias("_node"), "component")
    long = long.join(parts, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("component", "node")).drop("_node", "component")
    long = restaged(long, whole_long)
    open_lists = long.groupBy(F.col("token").alias("_token")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("_token")
    rest = staged(long.join(open_lists, F.col("token") == F.col("_token")).drop("_token"))
    # Sets that share many lists are paired in the first of them only: each brings its open lists along. It brings its whole listed
    # prefix too, for the bound of ``_can_link`` from what two prefixes do share.
    open_nodes = rest.select(F.col("node").alias("_node")).distinct()
    whole = rows.join(open_nodes, F.col("node") == F.col("_node"), "left_semi").groupBy(F.col("node").alias("_w")).agg(F.collect_list("token").alias("prefix"))
    shared = rest.groupBy(F.col("node").alias("_node")).agg(F.sort_array(F.collect_list("token")).alias("own"))
    rest = rest.join(shared, F.col("node") == F.col("_node")).join(whole, F.col("node") == F.col("_w")).drop("_node", "_w")
    rest = rest.withColumn("single", single)
    once = F.get(F.array_intersect(F.col("l.own"), F.col("r.own")), F.lit(0)) == F.col("l.token")
    most = F.size(F.array_intersect(F.col("l.prefix"), F.col("r.prefix"))) + F.greatest("l.after", "r.after")
    enough = ~(F.col("l.single") & F.col("r.single")) | (most * (100 + PERCENT) >= PERCENT * (F.col("l.n") + F.col("r.n")))
    more = _pairs(rest, (F.col("l.part") != F.col("r.part")) & once & enough).distinct().join(pairs, ["a", "b"], "left_anti")
    more = staged(more)
    if not more.isEmpty():
        nodes = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct()
        found = staged(found.union(_verified(more, _sets_of(docs, text_col, named, nodes))))
    return found


def _pairs(rows: DataFrame, extra: Column) -> DataFrame:
    left, right = rows.alias("l"), rows.alias("r")
    fits = (F.col("l.token") == F.col("r.token")) & (F.col("l.node") < F.col("r.node")) & extra & _can_link("l.", "r.")
    return left.join(right, fits).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def spark_rows(df: DataFrame, new: list[tuple[int, int, int]]) -> DataFrame:
    return df.sparkSession.createDataFrame(new, "_id long, _check long, _new long")


def with_ids(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with the new ids (``TWINS_MAX`` rows at most) of those that share half of their signature."""
    met = rows.join(F.broadcast(new), (F.col("node") == F.col("_id")) & (F.col("check") == F.col("_check")), "left")
    return met.withColumn("node", F.coalesce("_new", "node")).drop("_id", "_check", "_new")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that links reach, the document's own included.

    Words are runs of bytes outside white space, A-Z lower-cased; a document's set has its distinct 5-word shingles, or its
    whole sequence of fewer words. Two documents link if 100 * |intersection| >= 80 * |union|. Copies are one set
    from the start, so they are never paired. Shingles are known by 64 hash bits and sets by 128, of
    which ``id_bits`` are a set's id; sets that share those get ids of their own.

    Null and empty texts have no shingles and link with nothing. A null id never is a component's id unless it has no other.
    Repeated rows are copies. An empty table gives no rows. Other columns are ignored.
    """
    named = Names(id_bits)
    profile = _profile(docs, id_col, text_col, named)
    own = profile.where("kind = 0").select("doc_id", "n", F.col("a").alias("node"), F.col("b").alias("check"))
    nodes = staged(own.where("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")))
    shared = staged(nodes.groupBy(F.col("node").alias("_shared")).agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1"))
    if not shared.isEmpty():
        pairs = nodes.select(F.col("node").alias("id"), "check").join(shared, F.col("id") == F.col("_shared"), "left_semi")
        new = twins(pairs, nodes.select(F.col("node").alias("id")))
        named = Names(id_bits, {(i, c): n for i, c, n in new})
        ids = spark_rows(docs, new)
        own, nodes = with_ids(own, ids), staged(with_ids(nodes, ids))
    histogram = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= SMALL_MAX).groupBy("n").count().collect()}
    found = links(docs, text_col, named, histogram, profile)
    parts = components(found)
    members = parts.join(nodes.select("node", "least"), "node")
    least = members.groupBy("component").agg(F.min("least").alias("id"))
    linked = members.join(least, "component").select(F.col("node").alias("_node"), F.col("id").alias("linked_id"))
    ids = nodes.join(linked, F.col("node") == F.col("_node"), "left").select(F.col("node").alias("_own"), F.coalesce("linked_id", "least").alias("id"))
    placed = own.join(staged(ids), F.col("node") == F.col("_own"), "left")
    return placed.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not their component's: one id of each group stays, and all that link with nothing.

    The ids to drop are fewer than those to keep, so they are what meets the documents; rows that repeat a kept id stay, and null and
    empty texts, which link with nothing. Columns may have any name; an empty table gives no rows.
    """
    found = similar_documents(docs, id_col, text_col)
    (own,) = free_names(docs.columns, "id")
    mine = col(id_col).eqNullSafe(F.col("component_id"))
    dropped = staged(found.groupBy(col(id_col).alias(own)).agg(F.max(mine).alias("stays")).where("NOT stays").select(own))
    return docs.join(dropped, col(id_col).eqNullSafe(F.col(own)), "left_anti")
