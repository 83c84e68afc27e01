"""Each stage of the pipeline on a fixture against what a plain version of it gives for the same input."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_small_fixtures import WORD, brute_components, brute_lines, fill, n_words, tongue_rows, unequal_pairs

import corpus_pipeline
from deckloom.llm import langid, pieces
from deckloom.llm.common import staged

ROWS: list[tuple] = []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    tongues = {"xx": "zork blat fumo gripe neral dovi".split(), "yy": "chlo dwen ystr afon llyn gwy".split()}
    rows = []
    for i in range(160):
        words = tongues[("xx", "yy")[i % 2]]
        text = "\n".join(" ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(12)) for _ in range(4))
        rows.append((i, text, ("xx", "yy")[i % 2], f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(1000 + k, rows[k][1], "xx", "s0", 0) for k in range(6)]  # copies
    rows += [(2000 + k, rows[k][1].replace("zork", "zirk", 1), "xx", "s1", 0) for k in range(0, 6, 2)]  # near copies
    rows += [(3000, None, "xx", "s0", None), (3001, "", "yy", "s0", 0), (3002, "123 456 !!!", "yy", "s0", 0)]
    ROWS[:] = rows
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder))
        out.append(docs.collect())
    return out


def test_columns_stay(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == list(corpus_pipeline.COLUMNS)


def test_language_stage(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = langid.packers(langid.learn(docs.where(~langid.held_out(F.col("doc_id")))))
    want = set()
    for r in stages[0]:
        if r["text"] and any(c.isalpha() for c in r["text"]):
            lang, score = langid.classify(r["text"].encode(), made)
            if score >= langid.MIN_MARGIN:
                want.add(tuple(r))
    assert {tuple(r) for r in stages[1]} == want and len(want) >= 160


def test_language_stage_keeps_very_long_texts(spark, folder):
    """Clean documents of 20,000 words and more stay, in every language."""
    short, long = tongue_rows(5)
    docs = spark.createDataFrame([(i, t, k, "s0", len(t)) for i, t, k in short + long], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, folder).select("doc_id").collect()}
    assert kept >= {i for i, _, _ in long}


def test_line_stage(stages):
    kept = brute_lines([(r["doc_id"], r["text"]) for r in stages[1]])
    want = {r["doc_id"]: kept[r["doc_id"], r["text"]] for r in stages[1]}
    want = {i: t for i, t in want.items() if WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])
    assert not any(1000 <= r["doc_id"] < 2000 for r in stages[2])


def test_near_duplicate_stage(stages):
    found = brute_components([(r["doc_id"], r["text"]) for r in stages[2]])
    assert {r["doc_id"] for r in stages[3]} == {i for i, _, c in found if i == c}


def test_near_duplicate_stage_of_unequal_lengths(spark, folder):
    """Of a text and its appended or shortened copy near Jaccard 0.8, one stays."""
    rows = unequal_pairs(9)
    docs = spark.createDataFrame([(i, t, "xx", "s0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).select("doc_id").collect()} == want and len(want) < len(rows) - 40


def test_mix_stage(stages):
    sizes, got = Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += n_words(r["text"])
    copies = Counter(tuple(r) for r in stages[4])
    assert set(copies) <= {tuple(r) for r in stages[3]} and max(copies.values()) <= 2
    for r in stages[4]:
        got[r["source"]] += n_words(r["text"])
    assert all(abs(got[s] - t) <= 48 for s, t in fill(dict(sizes)).items())


def test_token_stage(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"]))) for r in stages[4])
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in stages[5]) == want
    assert all(r["round_trip"] for r in stages[5])


def test_run_is_the_stages(spark, folder, stages):
    got = Counter((r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == Counter((r["doc_id"], tuple(r["token_ids"])) for r in stages[5])
