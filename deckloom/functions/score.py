"""Slide scores as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.text import clip01, content_words, jaccard, round_even, sentences, tokens, words


def density_points(n_words: Column) -> Column:
    n = n_words.cast("double")
    return F.when((n >= 20) & (n <= 130), 20.0).when(n < 20, F.greatest(F.lit(2.0), 20.0 * (n / 20.0))).when(n <= 220, F.greatest(F.lit(8.0), 20.0 * (1.0 - (n - 130.0) / 130.0))).otherwise(8.0)


def bullet_points(n: Column) -> Column:
    """No bullets at all fall into the last branch and score 38: kept, since published scores include it."""
    return F.when((n >= 2) & (n <= 6), 20.0).when(n == 7, 17.0).when(n == 1, 12.0).otherwise(F.greatest(F.lit(6.0), 20.0 - (n.cast("double") - 6.0) * 3.0))


def title_points(n_words: Column) -> Column:
    n = n_words.cast("double")
    return F.when((n >= 3) & (n <= 10), 15.0).when(n < 3, F.greatest(F.lit(2.0), 15.0 * (n / 3.0))).otherwise(F.greatest(F.lit(5.0), 15.0 * (1.0 - (n - 10.0) / 6.0)))


def takeaway_points(takeaway: Column) -> Column:
    return F.when(F.length(F.trim(takeaway)) > 5, 15.0).otherwise(0.0)


def readability_points(n_words: Column, n_chars: Column) -> Column:
    mean = n_chars.cast("double") / F.greatest(n_words.cast("double"), F.lit(1.0))
    return F.when(n_words == 0, 0.0).when(mean < 7.6, 15.0).when(mean < 10.0, F.greatest(F.lit(4.0), 15.0 * (1.0 - (mean - 7.6) / 2.4))).otherwise(4.0)


def visual_points(layout: Column, title: Column, takeaway: Column, has_image: Column) -> Column:
    drawn = layout.isin("FLOWCHART", "TABLE", "METRIC", "QUIZ", "TIMELINE", "PYRAMID", "VENN", "COMPARISON", "WORKED_EXAMPLE")
    prose = (F.trim(title) != "") & (F.length(F.trim(takeaway)) > 5)
    base = F.when(drawn, 10.0).when(layout == "CARD_GRID", 8.0).when(prose, 4.0).otherwise(0.0)
    return F.least(F.lit(15.0), base + F.when(has_image, 5.0).otherwise(0.0))


def slide_score(title: Column, bullets: Column, takeaway: Column, layout: Column, has_image: Column) -> Column:
    """0 to 100: six parts, each rounded to one place."""
    parts = tokens(F.array_join(bullets, " "))
    n, chars = F.size(parts), F.aggregate(F.transform(parts, F.length), F.lit(0), lambda a, x: a + x)
    points = (density_points(n), bullet_points(F.size(bullets)), title_points(F.size(tokens(title))), takeaway_points(takeaway), readability_points(n, chars), visual_points(layout, title, takeaway, has_image))
    return round_even(F.least(F.lit(100.0), sum((round_even(p, 1) for p in points), F.lit(0.0))), 0)


#: Weights of the fitness model (efficiency, load, coherence), load terms and their scales, and the band of good flow.
ALPHA, BETA, GAMMA = 0.40, 0.42, 0.18
HALF = 6.0
W_ELEMENT, W_TEXT, W_VISUAL, W_SPLIT, THETA = 1.10, 1.35, 0.85, 1.60, 2.30
ELEMENT_FULL, TEXT_FULL, VISUAL_FULL = 9.0, 16.0, 8.0
ON_TOPIC = 0.08
FLOW_LOW, FLOW_HIGH = 0.18, 0.55
SLIDE_COST, EMPTY_COST, OVER_COST = 0.35, 0.9, 0.25

# Words that relate elements to each other.
RELATIONAL = (
    r"(?i)\b(because|therefore|thus|hence|so that|due to|as a result|leads? to|causes?|results? in|depends? on|requires?|implies|if\b.+\bthen|"
    r"whereas|unlike|compared|in contrast|however|consequently|followed by|then|next|finally|first|second|third)\b"
)


def with_redundancy(slides: DataFrame) -> DataFrame:
    """Append ``redundancy``: the mean over the bullets of the larger of their overlaps with the title and with all other bullets.

    A bullet and the others together are always the whole slide, so the second overlap is the share of the slide's words
    that the bullet has in common with another bullet. Each array is made once, in a column of its own.
    """
    rows = slides.withColumns({"_sets": F.transform("bullets", lambda b: F.array_distinct(content_words(b))), "_head": F.array_distinct(content_words(F.col("title")))})
    rows = rows.withColumn("_sorted", F.sort_array(F.flatten("_sets")))
    rows = rows.withColumns({"_twice": F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", i - 1)))), "_n": F.size(F.array_distinct("_sorted"))})
    # an overlap is 0 if the bullet or the rest has no content words; then nothing is shared either
    # naming the arrays outside the lambda too keeps the optimiser from copying what makes them into it, once a bullet
    made = F.col("_head").isNotNull() & F.col("_twice").isNotNull()
    rows = rows.withColumn("_each", F.when(made, F.transform("_sets", lambda s: F.greatest(jaccard(s, F.col("_head")), F.when(F.col("_n") == 0, 0.0).otherwise(F.size(F.array_intersect(s, F.col("_twice"))).cast("double") / F.col("_n"))))))
    total = F.aggregate("_each", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("redundancy", F.when(F.size("bullets") == 0, 0.0).otherwise(total / F.size("bullets"))).drop("_sets", "_head", "_sorted", "_twice", "_n", "_each")


def efficiency(information: Column, redundant: Column, empty: Column) -> Column:
    """New information, saturating, less what is redundant; 0 for a slide without body."""
    return F.when(empty, 0.0).otherwise(clip01(information / (information + HALF) * (1.0 - redundant)))


def load_terms(n_concepts: Column, body: Column, n_bullets: Column, visual: Column) -> tuple[Column, Column, Column]:
    """Element interactivity, text and visual complexity, each from 0 to 1."""
    return _terms(n_concepts, F.regexp_count(body, F.lit(RELATIONAL)), F.size(words(body)), n_bullets, visual)


def _terms(n_concepts: Column, relations: Column, n_words: Column, n_bullets: Column, visual: Column) -> tuple[Column, Column, Column]:
    related = relations.cast("double") / F.greatest(n_bullets, F.lit(1))
    return clip01(n_concepts * (1.0 + related) / ELEMENT_FULL), clip01(n_words.cast("double") / TEXT_FULL), clip01(visual.cast("double") / VISUAL_FULL)


def load(n_concepts: Column, body: Column, n_bullets: Column, visual: Column, split: Column) -> Column:
    """Cognitive load by a logistic curve of element interactivity, text, visual complexity and split attention."""
    return load_of(n_concepts, F.regexp_count(body, F.lit(RELATIONAL)), F.size(words(body)), n_bullets, visual, split)


def load_of(n_concepts: Column, relations: Column, n_words: Column, n_bullets: Column, visual: Column, split: Column) -> Column:
    """``load`` of a text whose relating words and words are counted."""
    element, text, seen = _terms(n_concepts, relations, n_words, n_bullets, visual)
    z = W_ELEMENT * element + W_TEXT * text + W_VISUAL * seen + W_SPLIT * split - THETA
    return 1.0 / (1.0 + F.exp(-z))


def coherence(title: Column, body: Column, n_bullets: Column, concepts: Column) -> Column:
    """Mean of signalling, sentences on topic, no redundancy with a figure, and contiguity; for slides without figure or takeaway."""
    real = (F.trim(title) != "") & ~F.trim(title).rlike(r"(?i)^slide\s*\d+$")
    sets = F.transform(sentences(body), lambda s: content_words(s))
    near = F.transform(sets, lambda s: F.when((F.size(s) == 0) | (jaccard(s, concepts) >= ON_TOPIC), 1.0).otherwise(0.0))
    on_topic = F.when((n_bullets > 0) & (F.size(concepts) > 0), F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(near), F.lit(1))).otherwise(1.0)
    return (F.when(real, 0.5).otherwise(0.0) + on_topic + 1.0 + 0.5) / 4.0


def fitness(e: Column, load_: Column, c: Column) -> Column:
    low = F.lit(1e-6)
    return F.pow(F.greatest(e, low), F.lit(ALPHA)) * F.pow(F.greatest(1.0 - load_, low), F.lit(BETA)) * F.pow(F.greatest(c, low), F.lit(GAMMA))


def flow_value(overlap: Column) -> Column:
    return F.when(overlap < FLOW_LOW, 0.6 + 0.4 * (overlap / FLOW_LOW)).when(overlap <= FLOW_HIGH, 1.0).otherwise(F.greatest(F.lit(0.4), 1.0 - (overlap - FLOW_HIGH) / (1.0 - FLOW_HIGH)))
