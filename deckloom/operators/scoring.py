"""Slide and deck scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions import score as S
from deckloom.functions.text import content_words, idf_guess, jaccard, reading_grade, round_even, sentences, words


def slide_scores(slides: DataFrame) -> DataFrame:
    """Heuristic score of each slide (text only: no takeaway, layout or picture)."""
    plain = S.slide_score(F.col("title"), F.col("bullets"), F.lit(""), F.lit("MINIMAL_TEXT"), F.lit(False))
    return slides.select("doc_id", "slide_no", plain.alias("score"))


def deck_scores(slides: DataFrame) -> DataFrame:
    """Rounded mean of the slides' scores by deck."""
    found = slide_scores(slides).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_slides"), round_even(F.sum("score") / F.count(F.lit(1)), 0).alias("overall_score"))
    return found.select("doc_id", "n_slides", "overall_score")


def novelty(slides: DataFrame) -> DataFrame:
    """(doc_id, slide_no, concept, is_new): a concept is new on the first slide of its deck that has it."""
    named = slides.select("doc_id", "slide_no", F.explode(F.array_distinct(content_words(F.concat_ws(" ", "title", F.array_join("bullets", " "))))).alias("concept"))
    first = F.min("slide_no").over(Window.partitionBy("doc_id", "concept"))
    return named.select("doc_id", "slide_no", "concept", (F.col("slide_no") == first).alias("is_new"))


def _shaped(slides: DataFrame) -> DataFrame:
    """What the terms of fitness are made of; concepts of earlier slides of the deck are no news."""
    fresh = novelty(slides).where("is_new").groupBy("doc_id", "slide_no").agg(F.count(F.lit(1)).alias("n_new"), round_even(F.sum(idf_guess(F.col("concept"))), 6).alias("information"))
    body = F.array_join("bullets", " ")
    concepts = F.array_distinct(content_words(F.concat_ws(" ", "title", body)))
    return S.with_redundancy(slides).select("doc_id", "slide_no", "title", concepts.alias("concepts"), F.size("bullets").alias("n"), body.alias("body"), "redundancy").join(fresh, ["doc_id", "slide_no"], "left")


def _efficiency() -> Column:
    return S.efficiency(F.coalesce("information", F.lit(0.0)), F.col("redundancy"), F.col("n") == 0)


def _coherence() -> Column:
    return S.coherence(F.col("title"), F.col("body"), F.col("n"), F.col("concepts"))


def fitness_terms(slides: DataFrame) -> DataFrame:
    """Efficiency, load, coherence and fitness of each slide."""
    load = S.load(F.size("concepts").cast("double"), F.col("body"), F.col("n"), F.lit(0), F.lit(0.0))
    rows = _shaped(slides).select("doc_id", "slide_no", "concepts", F.coalesce("n_new", F.lit(0)).alias("n_new"), _efficiency().alias("e"), load.alias("l"), _coherence().alias("c"))
    return rows.withColumn("fit", S.fitness(F.col("e"), F.col("l"), F.col("c")))


def fitness_parts(slides: DataFrame) -> DataFrame:
    """(doc_id, slide_no, e, element, text, visual, split, c): the terms before they are weighed."""
    element, text, visual = S.load_terms(F.size("concepts").cast("double"), F.col("body"), F.col("n"), F.lit(0))
    return _shaped(slides).select("doc_id", "slide_no", _efficiency().alias("e"), element.alias("element"), text.alias("text"), visual.alias("visual"), F.lit(0.0).alias("split"), _coherence().alias("c"))


def fitness_slides(slides: DataFrame) -> DataFrame:
    rounded = {name: round_even(c, 4) for name, c in (("efficiency", "e"), ("load", "l"), ("coherence", "c"), ("fitness", "fit"))}
    return fitness_terms(slides).select("doc_id", "slide_no", "n_new", *[v.alias(k) for k, v in rounded.items()])


def flow(slides: DataFrame) -> DataFrame:
    """(doc_id, slide_no, overlap, flow): of a slide's concepts with those of the slide before; null for the first."""
    concepts = slides.select("doc_id", "slide_no", F.array_distinct(content_words(F.concat_ws(" ", "title", F.array_join("bullets", " ")))).alias("cs"))
    before = F.lag("cs").over(Window.partitionBy("doc_id").orderBy("slide_no"))
    rows = concepts.select("doc_id", "slide_no", jaccard(before, F.col("cs")).alias("overlap"), before.isNull().alias("first"))
    return rows.select("doc_id", "slide_no", F.when(~F.col("first"), F.col("overlap")).alias("overlap"), F.when(~F.col("first"), S.flow_value(F.col("overlap"))).alias("flow"))


def fitness_decks(slides: DataFrame) -> DataFrame:
    """Geometric mean of the slides' fitness times the mean flow (1 for a single slide)."""
    means = fitness_terms(slides).groupBy("doc_id").agg(F.exp(F.avg(F.log(F.greatest(round_even("fit", 4), F.lit(1e-6))))).alias("gm"))
    flows = flow(slides).groupBy("doc_id").agg(F.coalesce(F.avg("flow"), F.lit(1.0)).alias("fl"))
    return means.join(flows, "doc_id").select("doc_id", round_even("gm", 3).alias("geometric_mean"), round_even("fl", 4).alias("flow"), round_even(F.col("gm") * F.col("fl"), 3).alias("deck_fitness"))


def readability(docs: DataFrame) -> DataFrame:
    """Reading grade, its band, and the audit's verdict on it."""
    grade = reading_grade(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    rows = docs.select("doc_id", grade.alias("grade"))
    return rows.select("doc_id", "grade", F.when(F.col("grade") <= 14, "pass").otherwise("info").alias("status"))


def audit(slides: DataFrame) -> DataFrame:
    """Checks of each deck in rows (words a slide, bullets there, reading level): status and the count behind it."""
    shaped = slides.select("doc_id", F.size(F.filter(F.split(F.array_join("bullets", " "), r"\s+"), lambda x: x != "")).alias("n"), F.size("bullets").alias("b"))
    counted = shaped.groupBy("doc_id").agg(F.sum((F.col("n") > 150).cast("long")).alias("heavy"), F.sum((F.col("b") == 0).cast("long")).alias("quiet"))
    checks = F.array(
        F.struct(F.lit("words per slide").alias("name"), F.when(F.col("heavy") == 0, "pass").otherwise("warn").alias("status"), F.col("heavy").alias("n")),
        F.struct(F.lit("slides with points").alias("name"), F.when(F.col("quiet") == 0, "pass").otherwise("info").alias("status"), F.col("quiet").alias("n")),
    )
    rows = counted.select("doc_id", F.explode(checks).alias("c"))
    return rows.select("doc_id", F.col("c.name").alias("check_name"), "c.status", F.col("c.n").alias("n_slides"))


def word_stats(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size(words(text)).cast("long").alias("n_words"), F.size(F.array_distinct(content_words(text))).cast("long").alias("n_concepts"), F.size(sentences(F.regexp_replace(text, "\n", " "))).cast("long").alias("n_sentences"))


def concept_weights(docs: DataFrame) -> DataFrame:
    """Guessed information of each distinct content word, and in how many documents it is."""
    named = docs.select(F.explode(F.array_distinct(content_words(F.coalesce("text", F.lit(""))))).alias("concept"))
    return named.groupBy("concept").agg(F.count(F.lit(1)).alias("n_docs")).select("concept", "n_docs", round_even(idf_guess(F.col("concept")), 2).alias("weight"))
