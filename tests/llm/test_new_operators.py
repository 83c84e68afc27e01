"""Operators 11 to 13 against brute force, on small tables, odd tables, and the registered queries on whole tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from deckloom.llm import alignment, conversations, packing, queries, segments, urls

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def table(name: str, columns: str) -> list[tuple]:
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


# ---- 11: conversations


def brute_faults(rows: list[tuple[str, str]]) -> list[str]:
    seen, found = set(), []
    for role, text in rows:
        core = text.strip(SPACES)
        found.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def brute_repair(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """All audits with whole strings, by cost and then ASCII: a layer keeps the least of each automaton state."""
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    add = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(layer):
        best = dict(layer)
        todo = list(layer.items())
        while todo:
            state, (cost, audit, lines) = todo.pop()
            new = (cost + 3, audit + "I", (*lines, f"{names[add[state]]}:"))
            if new[0] <= 12 + min(v[0] for v in best.values()):
                key = (add[state], new[1])
                todo.append((add[state], new))
                best.setdefault(key, new)
        return [(k[0] if isinstance(k, tuple) else k, v) for k, v in best.items()]

    layer = {"": (0, "", ())}
    for (role, text), fault in zip(rows, brute_faults(rows), strict=True):
        new: dict[str, tuple] = {}
        for state, (cost, audit, lines) in inserted(layer):
            ways = [(state, cost + 4, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((add[state], cost + 3 + more, audit + "R", (*lines, f"{names[add[state]]}:{text}")))
                if (state, role[:1]) in go:
                    ways.append((go[state, role[:1]], cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for to, *value in ways:
                if to not in new or tuple(value) < new[to]:
                    new[to] = tuple(value)
        layer = new
    cost, audit, lines = min(v for state, v in inserted(layer) if state in ("", "a"))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_conversation(rows: list[tuple]) -> tuple:
    """Of rows (turn, role, text) in order: the results."""
    pairs = [(r[1], r[2]) for r in rows]
    faults, turns = Counter(brute_faults(pairs)), {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *brute_repair(pairs)


def brute_damage(rows: list[tuple]) -> dict:
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found[conv]
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            found[conv] += [row] * (1 + (kind == 3))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0])) for c, r in found.items()}


def results(df) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_every_audit_is_considered():
    """The macro edits give the least of all edit strings, by full enumeration of short conversations."""

    def every(rows):
        best = None
        for runs in itertools.product(range(3), repeat=len(rows) + 1):
            for ops in itertools.product("DKR", repeat=len(rows)):
                audit = "".join("I" * n + op for n, op in zip(runs, (*ops, ""), strict=True))
                state, cost, good = "", 0, True
                for n, op, row in zip(runs, (*ops, ""), (*rows, None), strict=True):
                    for _ in range(n):
                        state += "a" if state[-1:] == "u" else "u"
                    cost += 3 * n
                    if op == "D":
                        cost += 4
                    elif op == "R":
                        state, cost = state + ("a" if state[-1:] == "u" else "u"), cost + 3
                    elif op == "K":
                        state += row[0][0]
                if good and re.fullmatch("(s?(ua)+)?", state):
                    best = min(best, (cost, audit)) if best else (cost, audit)
        return best

    for n in range(1, 4):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            rows = [(r, f"text {i}.") for i, r in enumerate(roles)]
            assert brute_repair(rows)[:2] == every(rows), roles
            whole = conversations.whole(conversations.Rows(list(range(n)), list(roles), [t for _, t in rows], [True] * n))
            assert whole[5:7] == every(rows)


def odd_conversations(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", "a b. \t", "é.", None, "long " * 3000 + "."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rnd.randrange(1, 12)):
            rows.append((conv, None if rnd.random() < 0.05 else turn * rnd.choice((1, 1, 2)), rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rnd.choice(texts[: rnd.choice((4, 10))])))
    return rows


def ordered(spark, rows: list[tuple]) -> dict:
    """Conversations by turn, then role and the hash of the text, as the operator orders ties."""
    made = spark.createDataFrame([(i, r[3] if r[3] is not None else " ") for i, r in enumerate(rows)], "i long, text string").select("i", F.xxhash64("text")).collect()
    mark = {r[0]: r[1] for r in made}
    found = defaultdict(list)
    for i, (conv, turn, role, text) in enumerate(rows):
        found[conv].append((turn, role if role is not None else " ", text if text is not None else " ", mark[i]))
    return {c: [x[:3] for x in sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[3]))] for c, r in found.items()}


@pytest.mark.parametrize(("block_rows", "parts"), [(1024, 1), (1024, 5), (2, 3), (1, 4)])
def test_repair_equals_brute_force(spark, monkeypatch, block_rows, parts):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(conversations, "shuffle_partitions", lambda s: parts)
    rows = odd_conversations()
    rows += [(7, t, ("user", "assistant")[t % 3 % 2], f"turn {t % 40}" + "." * (t % 5 > 0)) for t in range(400)]  # one that holds most rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("blank", F.lit("x")).repartition(3)
    got = results(conversations.repair_conversations(df))
    assert got == {c: brute_conversation(r) for c, r in ordered(spark, rows).items()}


def test_repaired_turns(spark):
    rows = odd_conversations(5, 20)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repairs = conversations.repair_conversations(df)
    lines = defaultdict(list)
    for r in sorted(conversations.repaired_turns(df, repairs).collect(), key=lambda r: r["no"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, got in results(repairs).items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == got[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[conv]))


def test_op11_query(spark):
    want = {c: brute_conversation(r) for c, r in brute_damage(table("conversations", "conv_id, turn, role, text")).items()}
    assert results(queries.op11_repair(spark, SF)) == want


def test_op11_odd_tables(spark):
    rows = [(None if c is None else str(c), t, r, x) for c, t, r, x in odd_conversations(3, 10)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "part", "block", "audit", "fresh", "_h")})
    damaged = conversations.damaged(df)
    dropped = df.limit(0).unionByName(spark.createDataFrame([("only here", 1, "user", "x")], "conv_id string, turn int, role string, text string"), allowMissingColumns=True)
    got = results(conversations.repair_conversations(damaged, keep=df.unionByName(dropped)))
    assert set(got) == {r[0] for r in rows} | {"only here"}
    assert got["only here"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_conversations(conversations.damaged(df.limit(0)), keep=df.limit(0)).count() == 0


# ---- 12: packing


def brute_best_fit(lengths: list[int], limits: tuple[int, int, int], weights=(1.0, 0.0, 0.0), rule="norm") -> int:
    """Bins of best-fit decreasing, one piece at a time."""
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        item = (n, 1, n * n)
        fits = [b for b in bins if all(x >= y for x, y in zip(b, item, strict=True))]
        if fits:
            if rule == "norm":
                best = min(fits, key=lambda b: sum(w * ((x - y) / m) ** 2 for w, x, y, m in zip(weights, b, item, limits, strict=True)))
            else:
                best = max(fits, key=lambda b: sum(w * x / m * y / m for w, x, y, m in zip(weights, b, item, limits, strict=True)))
        else:
            best = list(limits)
            bins.append(best)
        for k in range(3):
            best[k] -= item[k]
    return len(bins)


@pytest.mark.parametrize("capacity", [packing.Capacity(64), packing.Capacity(64, 4), packing.Capacity(64, 5, 1500), packing.Capacity(64, None, 900)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_classes_of_bins_equal_single_pieces(capacity, rule):
    rnd = random.Random(4)
    for weights in ((1.0, 0.0, 0.0), (1.0, 0.7, 0.3)):
        for _ in range(20):
            lengths = [min(capacity.longest(), max(1, int(rnd.expovariate(1 / rnd.choice((3, 15, 40)))))) for _ in range(rnd.randrange(1, 400))]
            patterns = packing.best_fit(dict(Counter(lengths)), capacity, rule, weights)
            used = Counter()
            for count, pattern in patterns:
                assert sum(n * c for n, c in pattern) <= capacity.limits()[0] and sum(c for _, c in pattern) <= capacity.limits()[1] and sum(n * n * c for n, c in pattern) <= capacity.limits()[2]
                for n, c in pattern:
                    used[n] += c * count
            assert used == Counter(lengths)
            bins = sum(n for n, _ in patterns)
            if rule == "norm" and weights == (1.0, 0.0, 0.0) and capacity.documents is None and capacity.attention is None:
                assert bins == brute_best_fit(lengths, tuple(capacity.limits()))
            assert bins <= 1.25 * brute_best_fit(lengths, tuple(capacity.limits()), weights, rule) + 1


def check_packing(rows: list, capacity: packing.Capacity) -> int:
    """Every sequence gapless and within its limits; the number of sequences."""
    of = defaultdict(list)
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= capacity.limits()[1] and sum(n * n for _, n in parts) <= capacity.limits()[2]
    return len(of)


def brute_pieces(rows: list[tuple], cut: int) -> Counter:
    from tokenizers import Tokenizer

    whole, found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), cut)):
            found[doc, k, at, len(ids[at : at + cut]), zlib.crc32(np.array(ids[at : at + cut], dtype="<u4").tobytes())] += 1
    return found


WORDS = [None, "", " ", "Don't we'll 'S x'LL 12a3 ½ ² a_b--c ß ÿ", "ΑΣ ΟΔΟΣ İstanbul é ́x", "a<|endoftext|>b", "<|startoftext|>", "日本語 naïve 🙂", "\x1c a\x85b a\xa0b \x7f", "x" * 3000, "the cat sat " * 4000]


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(64, 3, 2000)])
def test_pack_documents(spark, capacity):
    rows = [(None if k % 7 == 0 else k, t) for k, t in enumerate([*WORDS, *WORDS, *(f"copy {'of a text ' * (k % 5)}" for k in range(300))])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "part", "n", "ids")}).repartition(4)
    packed = packing.pack_documents(df, capacity=capacity, keep_ids=True)
    found = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == brute_pieces(rows, capacity.longest())
    n = check_packing(found, capacity)
    assert n <= 1.1 * brute_best_fit([r["length"] for r in found], tuple(capacity.limits())) + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert len(whole) == n
    for r in found:
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_op12_query(spark):
    rows = queries.op12_packing(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute_pieces(table("documents", "doc_id, text"), 4096)
    n = check_packing(rows, packing.Capacity())
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert n == brute_best_fit([r["length"] for r in rows], tuple(packing.Capacity().limits())) and n <= least + 2


# ---- 13: alignment


def brute_alignment(rows: list[tuple]) -> Counter:
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    of = segments.byte_symbols()
    docs, counts = [], Counter()
    for doc, text in rows:
        docs.append((doc, 0, 0, 0, [], ""))
        if not text:
            continue
        a = [(i, bytes(of[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
        if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (a, b)):
            continue
        spans = [[], []]
        for tokens, out in zip((a, b), spans, strict=True):
            at = 0
            for i, raw in tokens:
                out.append((at, at + len(raw), i))
                at += len(raw)
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for x, y, i in s if before < y <= c) for s in spans) if len(a) < 400 else None)
            before = c
        links, j = [], 0
        for x, y, i in spans[0]:
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(set(links))
        docs[-1] = (doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None)
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(d, a, b, g, len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), s) for d, a, b, g, x, s in docs]


STRINGS = [None, "", " ", "a  b", "  x y", "naïve 日本語 🙂 text", "a　 b c", "x 　b", "▁ a", "a ▁b", "<|endoftext|> <s> <0x41> b", "é é à b", "tab\t x\n y", "I'm  'll ' s 's", "don't stop. don't", "x" * 900, "ab " * 3000]


@pytest.mark.parametrize("bound", [1 << 25, 17 * 20, 0])
def test_alignment(spark, monkeypatch, bound):
    """All pairs' counts known to all tasks, only the frequent ones, or none: then the others meet their links in a join."""
    monkeypatch.setattr(alignment, "BROADCAST_BYTES", bound)
    rows = [(None if k % 6 == 0 else k, t) for k, t in enumerate([*STRINGS, *STRINGS[3:12], *(f"row {k % 4} of {k}" for k in range(40))])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("1") for c in ("id", "row", "keys", "n_a", "links")}).repartition(3)
    got = Counter(tuple(r) for r in alignment.align_tokenizers(df).collect())
    want = brute_alignment(rows)
    assert Counter(r[:7] for r in got.elements()) == Counter(r[:7] for r in want)
    assert {r[7] for r in want} - {None} <= {r[7] for r in got}
    assert alignment.align_tokenizers(df.limit(0)).count() == 0


def test_spans_spell_the_texts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(STRINGS)], "doc_id long, text string")
    a, b = alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")), alignment.PieceTokens(public_tokenizers.path("piece_bpe_32k.model"))
    at = defaultdict(int)
    for r in sorted(alignment.spans(df).collect(), key=lambda r: (r["doc_id"], r["start"])):
        raw = (" " + STRINGS[r["doc_id"]]).encode()[r["start"] : r["stop"]]
        assert r["start"] == at[r["doc_id"]] and raw == b"".join(a.bytes[i] for i in r["a_ids"]) == b"".join(b.bytes[i] for i in r["b_ids"])
        at[r["doc_id"]] = r["stop"]
    assert {k: len((" " + t).encode()) for k, t in enumerate(STRINGS) if t and "▁" not in t} == dict(at)


def test_op13_query(spark):
    rows = table("documents", "doc_id, text")
    got = {r[0]: tuple(r)[1:] for r in queries.op13_alignment(spark, SF).collect()}
    want = {r[0]: r[1:] for r in brute_alignment(rows)}
    assert {d: v[:6] for d, v in got.items()} == {d: v[:6] for d, v in want.items()}
    assert all(v[6] in (None, got[d][6]) for d, v in want.items()) and sum(v[6] is not None for v in want.values()) > 50


def test_segments_forgotten_and_colliding(monkeypatch):
    """Ids don't depend on what a task remembers, nor on hashes."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"word{i} again é{i % 3} <|endoftext|>" for i in range(50)]
    want = [e.ids for e in packing.WordIds(path).tokenizer.encode_batch(texts, add_special_tokens=False)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    monkeypatch.setattr(segments, "KEPT", 5)
    whole = segments.span_hashes
    for hashes in (whole, lambda *a: whole(*a) % np.uint64(3)):
        monkeypatch.setattr(segments, "span_hashes", hashes)
        own = packing.WordIds(path)
        for _ in range(2):
            assert [x.tolist() for x in own.encode(data, offsets)] == want


@pytest.mark.parametrize("text", ["a\n\n", "\x00", "\x1cé'\t", "<0x0A>🙂", "  x y", "é first"])
def test_last_text_of_a_group_begins_a_segment(spark, text):
    """The last text of a group keeps its own first segment, whatever it begins with and whatever stands before it, also alone."""
    for rows in ([(1, text)], [(1, "ends in a tab\t"), (2, text)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert Counter(map(tuple, alignment.align_tokenizers(df).collect())) == Counter(brute_alignment(rows))

def test_op4_rules_are_those_of_the_contract():
    """Each rule's word, host and path as the contract lists them."""
    assert [f"{v} {h}{p}" for v, h, p in urls.RULES] == ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]
