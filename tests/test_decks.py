"""What SQL doesn't state: items of decisions, takeaways, steps of problems, plans to a budget, generated questions."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from deckloom.functions import phrases as P
from deckloom.operators import desk, engine, paging, problems, shaping
from deckloom.plans import desked, pictured, solved

SF = "/root/testdata/sf0.001"


def decisions(spark):
    return engine.decided(spark.createDataFrame(list(pictured.SLIDES), "id long, title string, text string"))


def test_decisions_and_their_items(spark):
    rows = {r["id"]: r for r in decisions(spark).collect()}
    want = {
        1: "COMPARE_TABLE", 3: "CHART_PART_TO_WHOLE", 4: "TIMELINE", 5: "LIST_STRUCTURED", 6: "SET_DIAGRAM", 7: "PROCESS_CYCLIC", 11: "REFERENCES", 12: "CHART_TREND", 13: "LIST_STRUCTURED", 14: "ALGORITHM",
        16: "FUNCTION_PLOT", 17: "WORKED_EXAMPLE", 18: "FORMULA_CALLOUT", 19: "LIST_STRUCTURED", 20: "PROCESS_LINEAR", 21: "COMPARE_TABLE", 22: "COMPARE_TABLE", 24: "MATRIX_GRID", 26: "DEFINITION", 27: "FORMULA_CALLOUT",
        28: "LAYERS", 29: "FLOWCHART", 30: "PROCESS_LINEAR", 32: "CHECKLIST", 33: "CHART_CATEGORICAL", 35: "SECTIONS",
    }
    assert {i: rows[i]["family"] for i in want} == want
    assert all(r["items"] and 0.5 <= r["confidence"] <= engine.MOST for r in rows.values())
    assert [(i["head"], i["body"]) for i in rows[1]["items"]] == [("Basic", "5 | "), ("Team", "20 | extra")]
    assert [i["head"] for i in rows[4]["items"]] == ["1969", "1991", "2007"]
    assert [i["body"] for i in rows[18]["items"]] == ["N₂ + 3H₂ ⇌ 2NH₃"]
    assert [i["head"] for i in rows[29]["items"]] == ["process", "decision", "process"]
    assert "PROCESS_LINEAR" not in rows[29]["others"]  # a branching procedure is drawn once


def test_takeaways(spark):
    said = {r["id"]: r["takeaway"] for r in engine.takeaways(decisions(spark)).collect()}
    assert said[4] == "3 milestones between 1969 and 2007." and said[20] == "" and said[18] == ""
    assert said[30].startswith("4 steps — from “Heat the water”") and said[6].startswith("What the two sets share")


def test_steps_of_problems(spark):
    rows = problems.explained(spark.createDataFrame(list(solved.PROBLEMS), "id long, text string")).orderBy("id", "step_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert all([s["step_no"] for s in steps] == list(range(1, len(steps) + 1)) and len(steps) >= 3 for steps in by.values())
    assert by[9][0]["kind"] == "quadratic equation" and by[9][-1]["line"] == "x = 2 or x = 3"
    assert by[29][0]["answer"] == "x = 2.500000" or by[29][0]["answer"] == "x = 2.5"
    assert 7 not in by


def test_plan_to_a_budget(spark):
    sents = [f"Point {k} says a few more words about topic {k % 3} of this long slide" for k in range(60)]
    entries = spark.createDataFrame([("d", 1, "Long one", sents)], "deck string, slide_no long, title string, bullets array<string>")
    first = paging.planned(entries).count()
    plan, words = paging.planned_to_budget(entries, 5)
    assert plan.count() < first and words > paging.MAX_WORDS
    kept = [b for r in plan.orderBy("part").collect() for b in r["bullets"]]
    assert kept == sents  # nothing is lost, nothing moves


def test_generated_questions(spark):
    rows = {r["question"]: (r["intent"], r["origin"]) for r in desked.QUERIES["generated_questions"](spark, SF).collect()}
    topics = {("topic", r[0].lower()) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()}
    want = {q: (i, "gold") for i, q in desked.GOLD}
    for intent, template, slot in desked.TEMPLATES:
        for name, value in {*desked.SLOTS, *topics}:
            if name == slot and zlib.crc32(f"{template}|{value}".encode()) % 3 == 0:
                want.setdefault(template.replace("{" + slot + "}", value), (intent, "generated"))
    assert rows == want


def test_each_distinct_image_is_read_once(spark):
    images = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"a"), (4, None)], "image_id long, content binary")
    got = {r["image_id"]: r["made"] for r in desk.once_each(images.where("content IS NOT NULL"), lambda c: F.length(c)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_patterns_of_detectors_are_compiled_once(spark):
    # split compiles its pattern for every text it reads: the long ones are cut by a replacement, which keeps it
    rows = engine.detections(spark.createDataFrame(list(pictured.SLIDES), "id long, title string, text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert f"{P.VERBISH}, 2)" not in plan and f"{P.CLAUSE}, 2)" not in plan
    texts = ["", "is", "a is b is c", "no verb", "IS it?", "one\nwas two\nthree"]
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.before(F.col("t"), P.VERBISH).alias("cut"), F.split("t", P.VERBISH, 2)[0].alias("want"))
    assert all(r["cut"] == r["want"] for r in cut.collect())


def test_ends_are_those_of_the_whole_text(spark):
    # Java's $ also stands before a last line separator, SQL's doesn't
    rows = spark.createDataFrame([(" a \u2028",), ("\t b. ;\n",), ("\u00a0c",), (" . ",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(P.ends(F.col("t")), P.strip_end(F.col("t")), P.blanks(F.col("t"))).collect()]
    assert got == [("a \u2028", "a \u2028", ["a", "\u2028"]), ("b. ;", "b", ["b.", ";"]), ("\u00a0c", "\u00a0c", ["\u00a0c"]), (".", "", ["."]), (None, None, None)]


def test_sentences_said_again_once(spark):
    rows = P.with_sentences(spark.createDataFrame([("One is here. Two is there. ONE is here! ...",), ("A. B. C.",), ("--",), ("",)], "text string"))
    assert [r["sents"] for r in rows.collect()] == [["One is here.", "Two is there."], ["A.", "B.", "C."], [], []]


def test_scenes_are_scored_once_and_counted_as_their_patterns_do(spark):
    texts = ["", "Trees and a tree\u0436, wordy words, \u0436word _word word_x word\u00e9", "data-set Data, functions: FUNCTION probability", "state of the art laboratory; Kingdom, civilisations. learning"]
    slides = spark.createDataFrame([(d, i, t[:20], t) for d in (1, 2) for i, t in enumerate(texts)], "deck long, slide_no int, title string, text string")
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), shaping.BEYOND_ASCII, "z")
    n = lambda c, s: F.regexp_count(plain(c), F.lit(shaping.SCENES[s])).cast("double")
    title = lambda s: F.when(plain("title").rlike(shaping.SCENES[s]), float(shaping.IN_TITLE)).otherwise(0.0)
    want = slides.select("deck", "slide_no", F.array(*[2 * n("title", s) + n("text", s) + title(s) for s in shaping.SCENE_ORDER]).alias("scores"), F.array(*[n("text", s) for s in shaping.SCENE_ORDER]).alias("body"))
    got = shaping.scene_scores(slides).select("deck", "slide_no", "scores", "body")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in shaping.scenes(slides)._jdf.queryExecution().optimizedPlan().toString()
