"""Deck passes: passages, build-ups, agendas, cards, quizzes, repeated slides, and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.text import content_words, round_even, tokens
from deckloom.operators.extract import glossary


def distinct_passages(passages: DataFrame) -> DataFrame:
    """Sentences of four words or more, each once a slide by its first 80 word characters."""
    key = F.substring(F.regexp_replace(F.lower("sent"), r"[^a-z0-9_]+", ""), 1, 80)
    rows = passages.where(F.size(tokens(F.col("sent"))) >= 4).select("doc_id", "slide_no", "sent_no", "sent", key.alias("key"))
    once = F.row_number().over(Window.partitionBy("doc_id", "slide_no", "key").orderBy("sent_no"))
    return rows.withColumn("_n", once).where("_n = 1").select("doc_id", "slide_no", "sent_no", "sent")


def buildups(slides: DataFrame, share: float = 0.9) -> DataFrame:
    """Slides that the next one only adds to: same title, ``share`` of its words and strictly more of them."""
    order = Window.partitionBy("doc_id").orderBy("slide_no")
    rows = slides.select("doc_id", "slide_no", F.lower(F.trim("title")).alias("t"), F.array_distinct(tokens(F.lower("body"))).alias("w"))
    rows = rows.withColumns({"t2": F.lead("t").over(order), "w2": F.lead("w").over(order)})
    kept = F.size(F.array_intersect("w", "w2")).cast("double") / F.greatest(F.size("w"), F.lit(1))
    drop = (F.col("t") != "") & (F.col("t") == F.col("t2")) & (kept >= share) & (F.size("w2") > F.size("w"))
    return rows.select("doc_id", "slide_no", F.coalesce(drop, F.lit(False)).alias("is_buildup"))


def agenda(slides: DataFrame, least: int = 4, most: int = 8) -> DataFrame:
    """The first ``most`` different titles of a deck, part numbers removed, for decks with ``least`` or more."""
    title = F.trim(F.regexp_replace("title", r"(?i)\s*\((?:\d+/\d+|continued)\)\s*$", ""))
    rows = slides.select("doc_id", "slide_no", title.alias("title")).where("title <> ''")
    once = F.row_number().over(Window.partitionBy("doc_id", F.lower("title")).orderBy("slide_no"))
    rows = rows.withColumn("_n", once).where("_n = 1").drop("_n")
    place, total = F.row_number().over(Window.partitionBy("doc_id").orderBy("slide_no")), F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return rows.withColumns({"pos": place.cast("long"), "_total": total}).where((F.col("_total") >= least) & (F.col("pos") <= most)).select("doc_id", "pos", "title")


def flashcards(slides: DataFrame, most: int = 60) -> DataFrame:
    """Front and back of a deck's cards: its glossary."""
    return glossary(slides, most).select("doc_id", F.col("pos").alias("card_no"), F.col("term").alias("front"), F.col("definition").alias("back"))


def write_flashcards(cards: DataFrame, path: str, anki: bool = False) -> None:
    """CSV, or tab-separated text with the three head lines that Anki reads, one file a deck folder."""
    rows = cards.orderBy("doc_id", "card_no")
    if not anki:
        rows.select("doc_id", "front", "back").write.partitionBy("doc_id").option("header", True).csv(path)
        return
    clean = lambda c: F.regexp_replace(c, r"[\t\n]+", " ")
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("card_no", F.concat(clean("front"), F.lit("\t"), clean("back")).alias("l")))).alias("c"))
    text = F.concat(F.lit("#separator:tab\n#html:false\n#columns:Front\tBack\n"), F.array_join(F.transform("c", lambda x: x["l"]), "\n"))
    lines.select("doc_id", text.alias("value")).write.partitionBy("doc_id").text(path)


def quiz_words(slides: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent content words of five letters and more of each deck, ties by word."""
    named = slides.select("doc_id", F.explode(content_words(F.col("body"), longer_than=4)).alias("word"))
    counts = named.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)


def repeated_slides(slides: DataFrame, share: float = 0.7) -> DataFrame:
    """Slides of which ``share`` of the bullets' keys (letters and digits, 60 characters, six or more) are in one earlier slide of the deck.

    Keys meet by equality within the deck; slides are compared with all earlier ones.
    """
    keys = F.array_distinct(F.filter(F.transform("bullets", lambda b: F.substring(F.regexp_replace(F.lower(b), "[^a-z0-9]", ""), 1, 60)), lambda k: F.length(k) >= 6))
    rows = slides.select("doc_id", "slide_no", keys.alias("k")).where(F.size("k") > 0).select("doc_id", "slide_no", F.size("k").alias("n"), F.explode("k").alias("key"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("b.slide_no") < F.col("a.slide_no")))
    counted = met.groupBy("a.doc_id", "a.slide_no", "b.slide_no", "a.n").agg(F.count(F.lit(1)).alias("c")).toDF("doc_id", "slide_no", "of_slide", "n", "c")
    return counted.where(F.col("c") >= share * F.col("n")).groupBy("doc_id", "slide_no").agg(F.min("of_slide").alias("of_slide"))


def confusion(rows: DataFrame, want: str, got: str) -> DataFrame:
    """Counts of pairs of wanted and given labels, and the share of each wanted label."""
    counts = rows.groupBy(want, got).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(F.col(want).alias("_w")).agg(F.count(F.lit(1)).alias("_t"))
    return counts.join(totals, F.col(want).eqNullSafe(F.col("_w"))).select(want, got, "n", round_even(F.col("n").cast("double") / F.col("_t"), 4).alias("share"))


def phone(raw: Column) -> Column:
    """International form of a phone number: ten digits get +91; null if it is none."""
    digits = F.regexp_replace(raw, r"[^\d+]", "")
    full = F.when(digits.startswith("+"), digits).when(F.length(digits) == 10, F.concat(F.lit("+91"), digits)).otherwise(F.concat(F.lit("+"), digits))
    return F.when(full.rlike(r"^\+[1-9]\d{7,14}$"), full)


def slide_id(value: Column) -> tuple[Column, Column]:
    """Presentation id and slide number of ``XXX-PRES-0001-S03``."""
    pattern = r"^([A-Z]+-PRES-\d+)-S(\d+)$"
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1)), F.regexp_extract(value, pattern, 2).try_cast("long")
