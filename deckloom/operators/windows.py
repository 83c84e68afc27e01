"""Runs, numbering, pages and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.text import jaccard, round_even, tokens

# Titles that say nothing, and verbs by which a title says something.
GENERIC_TITLE = (
    r"(?i)^(?:introduction|overview|example|examples|summary|contd\.?|continued|notes?|slide \d+|untitled|"
    r"definition|definitions|types|advantages|disadvantages|applications?|problem|solution)$"
)
TITLE_VERB = (
    r"(?i)\b(?:is|are|was|were|has|have|uses?|makes?|gives?|shows?|predicts?|measures?|reduces?|increases?|changes?|depends?|means|keeps?|splits?|finds?|"
    r"chooses?|learns?|minimi[sz]es|maximi[sz]es|converts?|forms?|causes?|leads?|requires?|balances?|controls?|describes?|represents?|estimates?|works?|helps?)\b"
)


def run_numbers(slides: DataFrame) -> DataFrame:
    """Runs of slides of one deck with equal titles (case aside): number in the run and its length, and the title with ``(k/n)``."""
    order = Window.partitionBy("doc_id").orderBy("slide_no")
    key = F.lower(F.trim("title"))
    rows = slides.select("doc_id", "slide_no", "title", key.alias("key"))
    rows = rows.withColumn("run", F.sum(F.coalesce((F.col("key") != F.lag("key").over(order)).cast("int"), F.lit(1))).over(order))
    rows = rows.withColumns({"k": F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("slide_no")).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "run"))})
    label = F.when(F.col("n") > 1, F.concat(F.col("title"), F.lit(" ("), F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return rows.select("doc_id", "slide_no", "k", "n", label.alias("label"))


def carried_titles(slides: DataFrame, short: int = 12) -> DataFrame:
    """Titles where slides whose own is missing (here: under ``short`` characters) take the last one before."""
    order = Window.partitionBy("doc_id").orderBy("slide_no").rowsBetween(Window.unboundedPreceding, 0)
    real = F.when(F.length("title") >= short, F.col("title"))
    return slides.select("doc_id", "slide_no", F.coalesce(F.last(real, ignorenulls=True).over(order), F.col("title")).alias("title"))


def even_pages(slides: DataFrame, size: int = 4) -> DataFrame:
    """Page of each bullet when a slide's bullets are dealt evenly over ceil(n / size) pages, the first ones taking one more."""
    rows = slides.select("doc_id", "slide_no", F.size("bullets").alias("n"), F.posexplode("bullets").alias("i", "bullet"))
    pages = F.ceil(F.col("n") / size)
    rows = rows.withColumn("p", pages).withColumns({"b": F.expr("n div p"), "x": F.expr("n % p")})
    page = F.expr("CASE WHEN i < x * (b + 1) THEN i div (b + 1) ELSE x + (i - x * (b + 1)) div b END")
    return rows.select("doc_id", "slide_no", F.col("i").cast("long").alias("bullet_no"), (page + 1).cast("long").alias("page"), F.col("p").cast("long").alias("n_pages"))


def word_windows(docs: DataFrame, size: int = 150) -> DataFrame:
    """Chunks of ``size`` words of each document, in order."""
    words = tokens(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size))
    chunks = F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(size)))
    return rows.select("doc_id", F.posexplode(chunks).alias("chunk_no", "c")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size("c").cast("long").alias("n_words"), F.md5(F.array_join("c", " ")).alias("chunk_md5"))


def transitions(slides: DataFrame) -> DataFrame:
    """How a slide follows the one before, by the overlap of their words of four letters and more."""
    ws = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("body"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 3))
    order = Window.partitionBy("doc_id").orderBy("slide_no")
    rows = slides.select("doc_id", "slide_no", F.lower(F.trim("title")).alias("stem"), ws.alias("ws"))
    rows = rows.withColumns({"before": F.lag("ws").over(order), "stem0": F.lag("stem").over(order)})
    overlap = jaccard(F.col("before"), F.col("ws"))
    kind = F.when(F.col("before").isNull(), "fade").when(F.col("stem") == F.col("stem0"), "none").when(overlap >= 0.45, "fade").when(overlap >= 0.15, "slide").otherwise("convex")
    return rows.select("doc_id", "slide_no", F.when(F.col("before").isNotNull(), round_even(overlap, 6)).alias("overlap"), kind.alias("transition"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines (trimmed, lower case, eight characters or more) that a document has three times or more, in documents of eight lines or more."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    rows = docs.select("doc_id", lines.alias("l")).where(F.size("l") >= 8).select("doc_id", F.explode("l").alias("line")).where(F.length("line") >= 8)
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def furniture(docs: DataFrame, least: int = 3, share: float = 0.002) -> DataFrame:
    """Lines that many documents have: at least ``least`` and ``share`` of all; counted by partial sums, so a hot line is no hot task."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    counts = docs.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.join(F.broadcast(total)).where((F.col("n_docs") >= least) & (F.col("n_docs") >= share * F.col("total"))).select("line", "n_docs")


def junk_heading(text):
    """Whether a heading is really content: blank, an open formula, mostly no letters, one word repeated, or over 12 words."""
    t = F.trim(text)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    ws = F.filter(F.transform(F.split(t, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[:;,.]+|[:;,.]+$", ""))), lambda w: w != "")
    return (
        (t == "")
        | (t.rlike(r"[=+\-/*:]$") & F.contains(t, F.lit("=")))
        | (letters < F.greatest(F.lit(3.0), F.length(t) * 0.4))
        | ((F.size(ws) >= 2) & (F.size(F.array_distinct(ws)) == 1))
        | (F.size(ws) > 12)
    )


def headings(slides: DataFrame) -> DataFrame:
    """Titles judged as headings: junk, weak (generic, under five words or without a verb) and whether the slide is thin (under 60 words)."""
    t = F.regexp_replace(F.trim("title"), r"(?i)\s*\((?:\d+/\d+|continued)\)\s*$", "")
    weak = t.rlike(GENERIC_TITLE) | (F.size(tokens(t)) < 5) | ~t.rlike(TITLE_VERB)
    thin = F.size(tokens(F.col("body"))) < 60
    return slides.select("doc_id", "slide_no", junk_heading(F.col("title")).alias("junk"), weak.alias("weak"), thin.alias("thin"))


def escalations(slides: DataFrame, mode: str = "auto") -> DataFrame:
    """How many slides of a deck a model would be asked about (``auto``: the weak and thin ones) and how many not."""
    ask = F.lit(False) if mode == "off" else F.lit(True) if mode == "always" else F.col("weak") | F.col("thin")
    return headings(slides).groupBy("doc_id", F.when(ask, "model").otherwise("offline").alias("route")).agg(F.count(F.lit(1)).alias("n"))
