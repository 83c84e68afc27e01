"""Small cases at which results once differed from the SQL, overflowed or depended on the input's size."""

from __future__ import annotations

import time

from pyspark.sql import functions as F


def test_picture_actions_of_a_large_picture(spark):
    """90,042 x 60,028 pixels are more than an int holds."""
    from deckloom.operators.layouts import picture_actions

    rows = spark.createDataFrame([(1, 90042, 60028, "", "", False), (2, 10, 10, "", "", False)], "id long, width int, height int, ocr string, slide_text string, referenced boolean")
    assert {r["id"]: r["action"] for r in picture_actions(rows).collect()} == {1: "KEEP_AS_IS", 2: "DROP"}


def test_context_words_have_ascii_bounds(spark):
    """A keyword is found after a letter beyond ASCII, as in the SQL."""
    from deckloom.operators.keyterms import context_sentences

    rows = [(1, 1, "Übertree", []), (1, 2, "Others", ["The übertree of a small house is what we use there."])]
    got = context_sentences(spark.createDataFrame(rows, "deck long, slide_no int, title string, bullets array<string>")).collect()
    assert [(r["slide_no"], r["source"]) for r in got] == [(1, 2)]


def test_facts_at_ends_of_lines(spark):
    """A figure keeps what stands before its line's end, and a word before a letter beyond ASCII ends a formula."""
    from deckloom.operators.extract import facts

    docs = spark.createDataFrame([(1, "in 1999,\nnext"), (2, "y = 100, soé more"), (3, "### a\r\nYear 2001\n")], "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["value"]) for r in facts(docs).collect()}
    assert {(1, "figure", "1999,\n"), (2, "formula", "y = 100")} <= got


def test_rounding_of_ties(spark):
    """Ties are those of the scaled double: 7.05 is 70.5 tenths, which is even at 70."""
    from deckloom.functions.text import round_even

    rows = spark.createDataFrame([(7.05, 1, 7.0), (-7.05, 1, -7.0), (2.675, 2, 2.68), (0.15, 1, 0.2), (0.25, 1, 0.2), (3.5, 0, 4.0)], "x double, n int, want double")
    for r in rows.collect():
        assert rows.where(F.col("n") == r["n"]).where(F.col("x") == r["x"]).select(round_even(F.col("x"), r["n"])).first()[0] == r["want"]


def test_upper_case_stays_one_letter(spark):
    """A sharp s heads a label as its own capital; letters without a capital of one letter stay."""
    from deckloom.functions.phrases import cap

    rows = spark.createDataFrame([("ßötz",), ("ŉa",), ("ᾳx",), ("été",), ("",)], "t string")
    assert [r[0] for r in rows.select(cap(F.col("t"))).collect()] == ["ẞötz", "ŉa", "ᾼx", "Été", ""]


def test_packing_tries_every_rule_at_any_size(monkeypatch):
    """The rules that are tried don't depend on how many lengths there are."""
    from deckloom.llm import packing

    tried = []
    whole = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda h, c, rule, weights: tried.append(rule) or whole(h, c, rule, weights))
    used = [sum(n for n, _ in packing.fewest({k: 2 for k in range(1, most + 1)}, packing.Capacity())) for most in (3, 700)]
    assert tried == ["norm", "dot"] * 2
    assert used == [1, -(-sum(2 * k for k in range(1, 701)) // 4096)]


def test_near_sets_equal_all_pairs(spark):
    """Sets that meet by hashes and marks are those that a comparison of all pairs finds; short and long sets, null ids; pairs carry no words."""
    import random

    from deckloom.operators.sentences import NEAR_SHARE, near_before

    r = random.Random(2)
    sets = {(d, (1, k)): frozenset(r.choices([f"w{i}" for i in range(40)], k=r.choice([4, 5, 8, 30, 90]))) for d in (1, 2, None) for k in range(1, 60)}
    df = spark.createDataFrame([(d, at, sorted(ws)) for (d, at), ws in sets.items() if len(ws) > 3], "doc_id long, first struct<slide_no:int,sent_no:int>, ws array<string>")
    want = {}
    for (d, a), x in sets.items():
        others = [b for (e, b), y in sets.items() if e == d and a != b and min(len(x), len(y)) > 3 and (x <= y or y <= x or len(x & y) / len(x | y) >= NEAR_SHARE)]
        if others:
            want[d, a] = min(others)
    found = near_before(df)
    assert {(q["doc_id"], tuple(q["first"])): tuple(q["near"]) for q in found.collect()} == want
    words = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "word" in x]
    assert len(words) == 1 and "ws" not in words[0]


def _shuffled(spark, run) -> int:
    """Bytes that the executors of a local session shuffle while ``run`` runs."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    run()
    time.sleep(1)
    return written() - before


def test_bm25_shuffles_no_words(spark):
    """What is shuffled grows with the queries, not with the passages; ties go by the key, a query that is there twice counts twice."""
    from deckloom.operators.retrieval import bm25_topk

    queries = spark.createDataFrame([(1, "red fox"), (1, "fox"), (None, "red"), (3, "absent"), (4, None)], "item_id long, text string")
    rows = [(-i, 1, 1, "fox" if i % 7 == 0 else "other", f"red fox number{i} runs over word{i * 31} and word{i * 17}") for i in range(4000)]
    passages = spark.createDataFrame(rows, "doc_id long, slide_no int, sent_no int, title string, sent string")
    found = []
    assert _shuffled(spark, lambda: found.extend(bm25_topk(queries, passages, 3).collect())) < 150_000
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found}
    assert sorted(got, key=str) == [(1, 1), (1, 2), (1, 3), (None, 1), (None, 2), (None, 3)]
    assert [got[1, n][0] for n in (1, 2, 3)] == [-3997, -3990, -3983] and [got[None, n][0] for n in (1, 2, 3)] == [-3999, -3998, -3997]
    assert bm25_topk(queries, passages.limit(0)).count() == 0 == bm25_topk(queries.limit(0), passages).count()


def test_definitions_of_a_long_text_without_one(spark):
    """The words of a definition are looked for before the pattern tries every length at every letter."""
    from deckloom.operators.extract import definitions

    body = "lorem ipsum dolor sit amet consectetur " * 40_000
    rows = spark.createDataFrame([(1, 1, body), (1, 2, "An Atom IS a tiny part. Cell: small room")], "doc_id long, slide_no int, body string")
    began = time.time()
    got = {(r["slide_no"], r["term"], r["definition"]) for r in definitions(rows).collect()}
    assert got == {(2, "An Atom", "tiny part"), (2, "Cell", "small room")} and time.time() - began < 6


def test_listed_blocks_reads_its_rows_once(spark):
    """Files are made and parsed for one reading of their blocks; null texts and cells, and items around other blocks, are told apart."""
    from deckloom.operators.shaping import listed_blocks

    rows = [("item", 0, " a ", None), ("item", 0, "b", None), ("item", 0, None, None), ("item", 0, "c", None), ("item", 0, "d", None), ("row", 0, None, ["H", " ", "K"]), ("row", 0, None, [" 1 ", "", None]), ("row", 0, None, ["2", "x", "3"]), ("item", 0, "e", None), ("row", 1, None, ["only"])]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "doc long, unit int, place int, block string, level int, text string, cells array<string>"
    blocks = spark.createDataFrame([(7, 0, n, *r) for n, r in enumerate(rows)], schema).mapInArrow(count, schema)
    got = [(r["list_no"], r["items"]) for r in listed_blocks(blocks).orderBy("list_no").collect()]
    assert got == [(1, ["a", "b"]), (2, ["c", "d"]), (3, ["H", " ", "K"]), (4, ["1", "2"]), (5, ["x"]), (6, ["3"]), (7, ["only"])]
    assert seen.value == len(rows)


def test_enumerations_of_odd_lines_equal_their_sql(spark):
    """A lead that ends with a line feed, other ends of lines, vertical tabs, letters beyond ASCII beside a cue or mark."""
    import duckdb

    from deckloom.operators import enumerations as N
    from deckloom.plans.enumerated import ENUMERATIONS_SQL

    texts = ["Heed are \nRed Ones, white and blue or green", "The parts are:\u2028Wheels, doors and seats", "1. one\x0b\n2. two\rhalf\n3. three.\u2028\n4. four\x85", "Types of cells:\u2028\nred\nwhite\nplates", "Red etc.\u2028\nWhite\x0b\nBlue!\x85\nGreen\nOne"]
    texts += ["éThe parts include Wheels, doors and seats", "It haſ three types: one, two and three", "There are two ſtepsé: one, two and three", "the three \u212aindſ are a, b, c", "- one \u2028and more\n- two\x0b\x0b\n- \x0bthree", "The kinds of it :\x0b\nOne\x0bTwo\nThree\n\x0b\nFour and so on.\u2029"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"WITH {ENUMERATIONS_SQL} SELECT doc, place, style, kind, lead, claimed, items FROM enums WHERE doc < -1 ORDER BY doc, place").fetchall()
    rows = N.enumerations(spark.createDataFrame([(-2 - i * 2, t) for i, t in enumerate(texts)], "doc long, text string"))
    got = [tuple(r) for r in rows.select("doc", "place", "style", "kind", "lead", "claimed", "items").orderBy("doc", "place").collect()]
    assert got == want and len(got) >= 8


def test_long_bullets_are_split_to_their_end(spark):
    """Every part meets the limits, also after the ninth; the parts are those of a plain loop."""
    from deckloom.operators.shaping import split_bullet

    def plain(text: str, words: int, chars: int) -> list[str]:
        fits = lambda s: len(s.split()) <= words and len(s) <= chars
        out, rest = [], text
        while rest and not fits(rest):
            head = " ".join(rest.split()[:words])
            if len(head) > chars:
                head = head[:chars].rsplit(" ", 1)[0] or head[:chars]
            out.append(head)
            rest = rest[len(head) :].strip(" ,;:—–")
        return out + [rest] * (rest != "")

    texts = ["word " * 300 + "end", "x" * 1000, "x" * 95 + " y " + "z" * 200, ("a " * 11 + "y" * 100 + " ") * 20 + "b", "é" * 89 + " " + "w" * 90 + " " + "v" * 91, "a" * 88 + " b c" + " de" * 200, "one two three " * 4000 + "four"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", split_bullet(F.col("t"), 12, 90).alias("p")).collect()
    for r in rows:
        parts = [p.removeprefix("↳ ") for p in r["p"]]
        assert all(len(p.split()) <= 12 and len(p) <= 90 for p in parts) and parts == plain(texts[r["i"]], 12, 90)


def test_labels_cut_a_sentence_once(spark):
    """Label, step and heading share a sentence's words, and capitals don't make a label anew for its letter and its rest."""
    from deckloom.functions.phrases import sentence_labels, short_label

    sents = spark.createDataFrame([(1, 1, "first, the rate of growth is shown (in part) which falls"), (2, 1, "it is (open words"), (3, 1, "")], "id long, pos int, sent string")
    found = sentence_labels(sents)
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, 1, "The rate of growth is shown", "Rate of growth shown (in", "Rate of growth"), (2, 1, "It is (open words", "It is (open words", "It is (open"), (3, 1, "", "", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("whereas") == 1
    assert sents.select(short_label(F.col("sent")).alias("l"))._jdf.queryExecution().optimizedPlan().toString().count("whereas") == 1


def test_reasons_are_those_of_the_plain_patterns(spark):
    """Asking for a word first loses no match, in whatever case; a sentence's words are made once, as an item that is spread, and sorted without a comparing function."""
    from deckloom.operators.sentences import REASONING, REASONING_WORDS, VERBATIM, treatments, verbatim_reason

    texts = ["He Said: “yes", '"a quote of some length"', "It IS  Defined\tas x", "is the RATE of", "Is the degree of", "refers to", "MEANS  that", "is a term\nused", "Denoted by", "is KNOWN as", "Law of", "theorem:", "a rule states", "It states that", "If  and only if", "FOR\tall"]
    texts += ["There EXISTS", "we shall", "must not", "Must Not", "is prohibited", "pursuant to", "in accordance with", "Section 3", "Clause\t4", "a => b", "x::y", "def f", "return x", "import y", "`code`", "SELECT a FROM b", "(so", "x = 3", "α ≤ β", "3 + 4", "12/5", "2 ^ 3", "proportional to", "equals two"]
    texts += ["it equals the number", "a plain one", "", "4 - 3", "π", "Principle of", "lemma of"] + [w.upper() + "3 on" for w in REASONING_WORDS] + list(REASONING_WORDS)
    df = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id long, slide_no int, sent_no int, sent string")
    plain = F.coalesce(*[F.when(F.col("sent").rlike(p), n) for n, p in VERBATIM])
    rows = df.select("sent", verbatim_reason(F.col("sent")).alias("got"), plain.alias("want"))
    assert rows.where("NOT got <=> want").collect() == [] and rows.where("got IS NULL").count() < len(texts)
    made = treatments(df)
    told = made.join(df, "sent_no").where("treatment IN ('KEEP_REASONING', 'TIGHTEN')").select("treatment", F.col("sent").rlike(REASONING).alias("r")).collect()
    assert all((x["treatment"] == "KEEP_REASONING") == x["r"] for x in told) and sum(x["r"] for x in told) > 25
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "Generate explode(array(" in plan
