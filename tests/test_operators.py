"""Worked cases of the operators that fold over an order."""

from __future__ import annotations

import itertools
import math
from collections import deque

from pyspark.sql import functions as F

from deckloom.functions import score as S
from deckloom.functions.text import content_words, idf_guess
from deckloom.operators import statistics as T
from deckloom.streaming import events as E


def test_limiter_does_not_log_refused_hits():
    assert E.limited([0, 1, 2, 3, 11, 12, 13], deque(), cap=2, window=10) == [True, True, False, False, True, True, False]


def test_breaker_opens_and_retries(spark):
    rows = [(i, t, 1, k, 0.0) for i, (t, k) in enumerate([(0, "error"), (1, "error"), (2, "error"), (3, "error"), (4, "view"), (1000, "error"), (1001, "error"), (1002, "view"), (1003, "error")])]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = [r["is_open"] for r in E.breaker(events).orderBy("event_id").collect()]
    assert got == [False, False, False, False, True, False, False, False, False]


def brute_viterbi(seq, states, start, move, emit):
    best = None
    for path in itertools.product(range(len(states)), repeat=len(seq)):
        p = start[states[path[0]]] * emit.get((states[path[0]], seq[0]), 0.0)
        for a, b, o in zip(path, path[1:], seq[1:], strict=False):
            p = p * move.get((states[a], states[b]), 0.0) * emit.get((states[b], o), 0.0)
        if best is None or p > best[0] + 1e-15:
            best = (p, path)
    return best[0]


def test_viterbi_is_the_best_path(spark):
    from deckloom.plans.service import EMIT, MOVE, START, STATES

    seqs = [["view", "click", "error"], ["purchase"], ["error", "error", "view", "signup"], ["click"] * 5]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, observations array<string>")
    for r in T.viterbi(rows, STATES, START, MOVE, EMIT).collect():
        assert abs(r["p"] - brute_viterbi(seqs[r["id"]], STATES, START, MOVE, EMIT)) < 1e-12


def test_viterbi_decodes_whole_sequences(spark, tmp_path):
    from deckloom.plans.service import EMIT, MOVE, START, STATES, viterbi_paths

    kinds = ["view", "click", "error", "signup", "purchase"]
    seqs = {1: [kinds[i * i % 5] for i in range(10)], 2: ["error", "view"] * 4, 3: [kinds[(i * 7 + i // 3) % 5] for i in range(1200)]}
    rows = [(1000 * u + i, i, u, k) for u, seq in seqs.items() for i, k in enumerate(seq)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("t"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["id"]: r for r in viterbi_paths(spark, str(tmp_path)).collect()}
    for u, seq in seqs.items():
        path = got[u]["path"].split(">")
        assert len(path) == len(seq)
        value = math.log(START[path[0]] * EMIT[path[0], seq[0]]) + sum(math.log(MOVE[a, b] * EMIT[b, o]) for a, b, o in zip(path, path[1:], seq[1:], strict=False))
        top = {s: math.log(START[s] * EMIT[s, seq[0]]) for s in STATES}
        for o in seq[1:]:
            top = {s: max(top[r] + math.log(MOVE[r, s] * EMIT[s, o]) for r in STATES) for s in STATES}
        assert abs(got[u]["log_p"] - value) < 1e-6 and abs(value - max(top.values())) < 1e-6
        if len(seq) <= 10:
            assert math.isclose(got[u]["p"], brute_viterbi(seq, STATES, START, MOVE, EMIT), rel_tol=1e-9)


def test_long_slides_are_segmented_too(spark, tmp_path):
    from deckloom.plans.service import load_segments

    verbs = ["divide because", "convert light into", "need", "store then release"]
    text = "A title. " + " ".join(f"Cells number {i} {verbs[i % 4]} energy {i % 9}." for i in range(60))
    spark.createDataFrame([(1, text), (2, "A title. One bullet.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in load_segments(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2} and rows[1]["n_bullets"] == 60
    ends = [0, *map(int, rows[1]["page_ends"].split(","))]
    assert ends[-1] == 60 and all(0 < b - a <= 5 for a, b in zip(ends, ends[1:], strict=False)) and rows[1]["n_pages"] == len(ends) - 1


def test_segments_are_the_cheapest_and_lose_nothing(spark):
    text = "Cells divide because energy flows. Plants convert light. Light drives chemistry. Water splits then oxygen leaves. Sugar stores energy. Roots take water. Leaves hold pigment."
    bullets = text.replace(". ", ".|").split("|")
    slides = spark.createDataFrame([(1, 1, "", bullets)], "doc_id long, slide_no int, title string, bullets array<string>")
    cap, target = 5, max(1, min(5, round(5 * 0.75)))
    costs = {(r["i"], r["j"]): r["cost"] for r in T.group_costs(slides, cap, target).collect()}
    m, best = len(bullets), None
    for k in range(m):
        for cuts in itertools.combinations(range(1, m), k):
            ends = [0, *cuts, m]
            if all(b - a <= cap for a, b in zip(ends, ends[1:], strict=False)):
                c = sum(costs[a, b] + S.SLIDE_COST for a, b in zip(ends, ends[1:], strict=False))
                best = c if best is None else min(best, c)
    got = T.segments(slides, cap).first()
    ends = [0, *map(int, got["page_ends"].split(","))]
    assert ends[-1] == m and abs(sum(costs[a, b] + S.SLIDE_COST for a, b in zip(ends, ends[1:], strict=False)) - best) < 1e-9


def test_costs_of_spans_are_those_of_their_text(spark):
    bullets = ["It rains so.", "That is due", "to clouds.", "If cells divide, they grow", "then rest therefore.", "Cells depend on energy.", "Energy flows next.", "Then clouds result", "In rain because cells divide."]
    slides = spark.createDataFrame([(1, 1, "", bullets), (2, 1, "", bullets[5:7]), (3, 1, "", ["Cells depend on energy.", "As a result cells divide.", "Cells cause rain then."])], "doc_id long, slide_no int, title string, bullets array<string>")
    got = {(r["doc_id"], r["i"], r["j"]): r["cost"] for r in T.group_costs(slides, 5, 4).collect()}
    texts = [(r["doc_id"], i, j, "", r["bullets"][i:j]) for r in slides.collect() for j in range(1, len(r["bullets"]) + 1) for i in range(max(0, j - 5), j)]
    rows = S.with_redundancy(spark.createDataFrame(texts, "doc_id long, i int, j int, title string, bullets array<string>")).withColumn("body", F.array_join("bullets", " "))
    rows = rows.withColumn("concepts", F.array_distinct(content_words(F.col("body"))))
    information = F.bround(F.aggregate(F.transform("concepts", idf_guess), F.lit(0.0), lambda a, x: a + x), 6)
    load = S.load(F.size("concepts").cast("double"), F.col("body"), F.size("bullets"), F.lit(0), F.lit(0.0))
    over = F.greatest(F.lit(0), F.size("bullets") - 4).cast("double")
    cost = F.bround(load + S.EMPTY_COST * (1.0 - S.efficiency(information, F.col("redundancy"), F.lit(False))) + S.OVER_COST * over * over, 9)
    assert got == {(r["doc_id"], r["i"], r["j"]): r["c"] for r in rows.select("doc_id", "i", "j", cost.alias("c")).collect()}


def test_slides_of_one_page_have_no_costs(spark):
    slides = spark.createDataFrame([(1, 1, "", ["One.", "Two."]), (1, 2, "", [f"Cell {k}." for k in range(6)])], "doc_id long, slide_no int, title string, bullets array<string>")
    costs = T.group_costs(slides, 5, 4, 6).collect()
    assert [r["i"] for r in costs if r["slide_no"] == 1] == [None] and len(costs) == 21
    assert {(r["slide_no"], r["n_pages"]) for r in T.segments(slides).collect() if r["slide_no"] == 1} == {(1, 1)}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bullets_and_titles_are_made_plain_once(spark):
    from deckloom.operators import paging as P

    rows = [(1, 1, "Cells divide", ["Cells divide.", "cells", "Cells divide and grow", "divide and grow", "", "of cells", "Plants grow"])]
    slides = spark.createDataFrame(rows, "deck long, slide_no long, title string, bullets array<string>")
    assert P.paged(slides).first()["bullets"] == ["divide and grow", "of cells", "Plants grow"]
    assert _plan(P.paged(slides)).count("[^a-z0-9 ]") <= 3


def test_words_are_not_made_to_test_sizes(spark):
    from deckloom.functions.text import words
    from deckloom.operators.sentences import salience

    texts = spark.createDataFrame([(1, "a", "good cat"), (2, "b", "bad dog"), (3, "a", ""), (4, "b", None)], "id long, label string, text string").select("id", "label", words(F.col("text")).alias("words"))
    found = T.naive_bayes(texts.select("label", "words"), texts.select("id", "words"))
    assert "size(regexp_extract_all" not in _plan(found) and {r["id"]: r["label"] for r in found.collect()} == {1: "a", 2: "b"}
    passages = spark.createDataFrame([(1, 1, 1, "Cells divide.")], "doc_id long, slide_no int, sent_no int, sent string")
    assert "size(filter(regexp_extract_all" not in _plan(salience(passages))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i * 700, i % 3, "view" if i % 4 else "click", 1.0) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    for name, got, want in (
        ("tumbled", E.tumbling(stream, "1 hour", late="1 hour"), E.tumbling(events, "1 hour")),
        ("limits", E.rate_limited_stream(stream), E.rate_limited(events)),
    ):
        mode = "append" if name == "limits" else "complete"
        query = got.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, want.collect()))


def test_sources_round_trip(spark, tmp_path):
    from deckloom.sources.tables import read_markdown, read_ratings_csv

    (tmp_path / "a.md").write_bytes("﻿# T\r\ntext é".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes("wide".encode("utf-16"))
    got = sorted(r["markdown"] for r in read_markdown(spark, str(tmp_path)).collect())
    assert got == ["# T\ntext é", "café", "wide"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.csv").write_text("title,bullets,takeaway,layout_type,score\nA,one||two,t,TABLE,2\nB,,,,4\n")
    rows = {r["title"]: r for r in read_ratings_csv(spark, str(tmp_path / "r")).collect()}
    assert rows["A"]["bullets"] == ["one", "two"] and rows["A"]["score"] == 0.0 and rows["B"]["score"] == 1.0
