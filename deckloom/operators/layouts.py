"""Layouts and figures by cues: what to do with a picture, which drawing a slide needs, layouts, metrics, dates, chart and node kinds, and a few extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.phrases import blanks, ends

# Marks of pictures, families that fill a slide, and the words that layouts, charts and nodes go by.
STRUCTURE = r"(?i)(→|->|=>|▶|➜|\bstep\s*\d|\bphase\s*\d|\|.*\|.*\||\byes\b\s*/\s*\bno\b|\bif\b.+\bthen\b|\d+\s*%|\baxis\b|\blegend\b)"
DECORATIVE = r"(?i)\b(logo|icon|clip[- ]?art|stock photo|watermark|shutterstock|getty|istock|banner|divider|bullet point|decorative)\b"
WIDE = (
    "COMPARE_TABLE ALGORITHM FLOWCHART TIMELINE STEPPER WORKED_EXAMPLE PROCESS_LINEAR PROCESS_CYCLIC CAUSE_EFFECT MATRIX_2X2 FUNNEL LAYERS OUTLINE COMPARE_VISUAL ALGORITHM_TRACE DATA_STRUCTURE "
    "FUNCTION_PLOT FIGURE"
).split()
NO_ART = r"(?i)^(?:agenda|contents?|outline|syllabus|references?|bibliography|thank you|questions?|key takeaways|summary|recap|glossary|key terms|checkpoint|quiz|exercise|assignment|lab manual)\b"
FLOW = r"\b(steps?|stages?|process|cycle|pipeline|flow|then|next|finally|workflow|procedure|mechanism|reaction)\b"
PLOT = r"\b(graph|plot|curve|axis|slope|line of best fit|regression|distribution|function|rate|trend|error|loss|gradient|probability|equation)\b|="
CONTRAST = r"\b(versus|vs\.?|compared|differ|advantages?|disadvantages?)\b"
ANATOMY = r"\b(types?|kinds?|parts?|components?|structure|layers?|organ|cell|anatomy|consists of|classif)\w*"
ORDINAL = r"\b(?:step\s*\d|first(?:ly)?[,: ]|second(?:ly)?[,: ]|third(?:ly)?[,: ]|fourth[,: ]|then\b|next\b|finally\b|stage\s*\d|phase\s*\d)"
OLD_FLOW = r"step\s*1|\bfirst,|\bsecond,|\bprocess\b|\bworkflow\b|\bcycle\b|\balgorithm\b|\bsequence\b|\bpipeline\b|\bstage\b|\bmechanism\b"
OLD_TABLE = r"\bvs\.?\b|\bversus\b|\bcomparison\b|\bcompared?\b|\bpros and cons\b|\bdifference between\b|\badvantages and disadvantages\b"
OLD_METRIC = r"\b\d+(?:\.\d+)?%|\b\d+\s*(?:percent|million|billion|k|x)\b"
METRIC = (
    r"(?i)(\b\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*[xX]|\$\s*\d+(?:[,\d]*)?(?:\.\d+)?(?:\s*[KMBT])?|\b\d+(?:[,\d]*)(?:\.\d+)?\s*(?:seconds?|mins?|hours?|days?|ms|GB|TB|MB)?|\b\d+(?:\.\d+)?)"
)
UNIT = r"(?i)\b(percent|seconds?|mins?|hours?|days?|x|ms|GB|TB|MB|KB|kg|km)\b"
UP = "increase growth improve higher up more gain rise".split()
DOWN = "decrease reduce drop lower down less fall decline".split()
DATE_WORD = r"(?i)(\b\d{4}\b|\bQ[1-4]\b|\bPhase\s*\d+\b|\bStep\s*\d+\b|\bWeek\s*\d+\b|\bMonth\s*\d+\b|\bDay\s*\d+\b)"
CHARTS = {
    "bar": ("distribution", "comparison", "count", "frequency", "volume"),
    "line": ("trend", "growth", "over time", "change", "rate", "timeline"),
    "pie": ("proportion", "share", "percentage", "breakdown", "composition"),
    "radar": ("performance", "skills", "attributes", "score", "dimensions"),
    "scatter": ("correlation", "relationship", "vs", "against", "plot"),
}
DECISION_WORDS = "if whether verify validate check decide choose compare evaluate test confirm else otherwise".split()
LINKS = (
    ("IS_A", ("is a", "is an", "are a", "are an")), ("PART_OF", ("is part of", "are part of", "belongs to")), ("CAUSES", ("causes", "caused by", "triggers")), ("LEADS_TO", ("leads to", "results in", "produces", "enables")),
    ("DEPENDS_ON", ("depends on", "requires", "relies on")), ("CONTRASTS_WITH", ("unlike", "versus", "compared to", "in contrast")), ("SUPPORTS", ("supports", "enhances", "improves")),
    ("DEFINED_BY", ("is defined as", "refers to", "means")), ("INCLUDES", ("includes", "contains", "consists of", "comprises")), ("FOLLOWS", ("follows", "precedes", "after", "before")),
)
FORMULA_SIGN = r"[A-Za-z0-9\s]+[=×÷^√∑∫±Δ→←↔≤≥≠∞∝∈∀∃][A-Za-z0-9\s+\-*/().]+"


def has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def picture_actions(pictures: DataFrame) -> DataFrame:
    """(id, action, confidence) of pictures (id, width, height, ocr, slide_text, referenced): dropped, rebuilt as structure, enhanced, drawn anew or kept."""
    ocr = F.trim(F.regexp_replace("ocr", r"(?i)\[(?:OCR|Extracted)[^\]]*\]", ""))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z\-']+"), F.lit(0))
    rows = pictures.select("id", "width", "height", "referenced", ocr.alias("ocr"), words(ocr).alias("w"), F.array_distinct(words(F.lower("slide_text"))).alias("own"))
    mine = F.array_distinct(F.transform("w", lambda x: F.lower(x)))
    rows = rows.select("id", "referenced", "ocr", F.size("w").alias("n"), (F.col("width").cast("long") * F.col("height") / 1e6).alias("mp"), F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(0.0).alias("aspect"), F.when((F.size(mine) > 0) & (F.size("own") > 0), F.size(F.array_intersect(mine, F.col("own"))).cast("double") / F.size(mine)).otherwise(0.0).alias("near"))
    marks, decor = F.regexp_count("ocr", F.lit(STRUCTURE)), F.col("ocr").rlike(DECORATIVE)
    tiny, low, banner = F.col("mp").between(1e-9, 0.02 - 1e-9), F.col("mp").between(1e-9, 0.12 - 1e-9), (F.col("aspect") != 0) & ((F.col("aspect") > 4) | (F.col("aspect") < 0.25))
    wanted = lambda least: (F.col("near") >= least) | F.col("referenced")
    out = lambda action, c: F.struct(F.lit(action).alias("action"), F.lit(c).alias("confidence"))
    found = (
        F.when((tiny | banner) & (F.col("n") < 8), out("DROP", 0.9))
        .when(decor & (F.col("near") < 0.15) & (marks == 0), out("DROP", 0.75))
        .when((marks >= 2) & (F.col("n") >= 8), out("SUMMARISE_TO_STRUCTURE", 0.82))
        .when((F.col("n") >= 40) & (F.col("near") >= 0.25), out("SUMMARISE_TO_STRUCTURE", 0.7))
        .when((low | (F.col("mp") == 0)) & wanted(0.2), out("ENHANCE", 0.6))
        .when(decor & wanted(0.15), out("REGENERATE", 0.55))
        .when(wanted(0.15) | (F.col("mp") >= 0.25), out("KEEP_AS_IS", 0.7))
        .otherwise(out("KEEP_AS_IS", 0.55))
    )
    return rows.select("id", found.alias("f")).select("id", "f.*")


def art_kind(title: Column, text: Column, family: Column) -> Column:
    """Which drawing a slide needs, or null where one would add nothing."""
    whole = F.concat_ws(" ", title, text)
    low = F.lower(whole)
    none = family.isin(WIDE) | F.startswith(family, F.lit("CHART_")) | F.trim(title).rlike(NO_ART) | (F.size(F.regexp_extract_all(whole, F.lit("[A-Za-z]{3,}"), F.lit(0))) < 6)
    return F.when(none, None).when(low.rlike(FLOW), "FLOW").when(low.rlike(PLOT), "PLOT").when((family == "SET_DIAGRAM") | low.rlike(CONTRAST), "COMPARE").when(low.rlike(ANATOMY), "ANATOMY").otherwise("SCENE")


def layout(bullets: Column) -> Column:
    """A layout only where a slide really has its structure: few short bullets."""
    joined = F.array_join(bullets, " ")
    low, n = F.lower(joined), F.size(bullets)
    words = F.size(blanks(joined))
    heavy = (n > 7) | (words / F.greatest(n, F.lit(1)) > 14)
    shares, both = F.regexp_count(low, F.lit(r"\b\d{1,3}(?:\.\d+)?\s?%")), F.regexp_count(low, F.lit(r"\b\d{1,3}(?:\.\d+)?\s?%|\b\d+\s?percent\b"))
    versus = F.regexp_count(low, F.lit(r"\bvs\.?\b|\bversus\b|\bwhereas\b|on the other hand"))
    named = F.size(F.filter(bullets, lambda b: b.rlike(r"^[A-Z][\w /&.\-]{1,32}:\s")))
    steps = (F.regexp_count(low, F.lit(ORDINAL)) >= 3) | low.rlike(r"(?s)step\s*1\b.*step\s*2\b")
    return (
        F.when(~heavy & steps, "FLOWCHART")
        .when(~heavy & (versus >= 2) & n.between(3, 8), "TABLE")
        .when(~heavy & (both >= 3) & (both >= 0.5 * F.greatest(n, F.lit(1))), "TABLE")
        .when((shares == 1) & (words < 40), "METRIC")
        .when(~heavy & named.between(3, 6) & (n <= 7), "CARD_GRID")
        .otherwise("MINIMAL_TEXT")
    )


def old_layout(text: Column, has_table: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(OLD_FLOW), "FLOWCHART").when(has_table | low.rlike(OLD_TABLE), "TABLE").when(low.rlike(OLD_METRIC), "METRIC").otherwise("MINIMAL_TEXT")


def metric(text: Column) -> Column:
    """(value, unit, label, trend) of a statistic, or null without a number."""
    raw = F.trim(F.regexp_extract(text, METRIC, 1))
    own, around = F.regexp_extract(raw, UNIT, 1), F.regexp_extract(text, UNIT, 1)
    value = F.trim(F.regexp_replace(raw, UNIT, ""))
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, METRIC, ""), r"^[ \-:—|]+|[ \-:—|]+$", ""), r"\s+", " ")
    trend = F.when(has_any(F.lower(text), UP), "up").when(has_any(F.lower(text), DOWN), "down").otherwise("flat")
    kept = F.substring(label, 1, 40)
    return F.when(raw != "", F.struct(F.when(value != "", value).otherwise(raw).alias("value"), F.when(own != "", own).otherwise(around).alias("unit"), F.when(kept != "", kept).otherwise("Metric").alias("label"), trend.alias("trend")))


def dated(text: Column, place: Column) -> Column:
    """(date, rest) of an item; without a date it is a phase by its place."""
    date = F.regexp_extract(text, DATE_WORD, 1)
    rest = F.regexp_replace(F.replace(text, date, F.lit("")), r"^[ \-:—|]+|[ \-:—|]+$", "")
    plain = F.trim(text)
    return F.when(date != "", F.struct(date.alias("date"), F.when(rest != "", rest).otherwise(plain).alias("rest"))).otherwise(F.struct(F.concat(F.lit("Phase "), (place + 1).cast("string")).alias("date"), plain.alias("rest")))


def chart_kind(text: Column) -> Column:
    """The kind with most of its words in the text, the first of equals; bar without any."""
    low = F.lower(text)
    scores = [F.struct((-sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))).alias("less"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(CHARTS.items())]
    return F.array_min(F.array(*scores))["name"]


def node_kind(label: Column, place: Column, total: Column) -> Column:
    return F.when(place == 0, "start").when(place == total - 1, "end").when(has_any(F.lower(label), DECISION_WORDS), "decision").otherwise("process")


def children(items: Column, branch: Column, branches: Column) -> Column:
    """Up to three items of a branch, dealt in turn."""
    return F.slice(F.filter(items, lambda _, i: (branches > 0) & (i % F.greatest(branches, F.lit(1)) == branch)), 1, 3)


def main_topic(title: Column, heads: Column, texts: Column) -> Column:
    """The title unless it is a number, else the first heading, else the first text."""
    named = (F.trim(title) != "") & ~F.trim(title).rlike(r"(?i)^slide\s+\d+$")
    return F.when(named, F.trim(title)).otherwise(F.coalesce(F.trim(F.get(heads, F.lit(0))), F.substring(F.trim(F.get(texts, F.lit(0))), 1, 80), F.lit("Untitled Slide")))


def key_concepts(heads: Column, title: Column) -> Column:
    """Parts of headings and names of several capitals in the title, each once, ten at most."""
    parts = F.flatten(F.transform(heads, lambda h: F.transform(F.split(h, r"[:\-–|/]"), ends)))
    every = F.filter(F.concat(parts, F.regexp_extract_all(title, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), F.lit(0))), lambda p: F.length(p) > 1)
    return F.slice(F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda o: F.lower(o) == F.lower(x))), 1, 10)


def relationships(sents: Column, concepts: Column) -> Column:
    """(subject, predicate, object) of sentences that name two known concepts: the first two, with the first linking verb; ten at most."""
    link = F.lit("UNKNOWN")

    def of(s: Column) -> Column:
        low = F.lower(s)
        found = F.filter(concepts, lambda c: F.contains(low, F.lower(c)))
        kind = link
        for name, verbs in reversed(LINKS):
            kind = F.when(has_any(low, verbs), name).otherwise(kind)
        return F.when(F.size(found) >= 2, F.struct(F.get(found, F.lit(0)).alias("subject"), kind.alias("predicate"), F.get(found, F.lit(1)).alias("object")))

    return F.slice(F.filter(F.transform(sents, of), lambda r: r.isNotNull()), 1, 10)


def formulas(text: Column) -> Column:
    """Inline formulas of 4 to 200 characters, each once, eight at most."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(FORMULA_SIGN), F.lit(0)), ends), lambda f: F.length(f).between(4, 200))
    return F.slice(F.array_distinct(found), 1, 8)


def question_answers(sents: Column) -> Column:
    """(question, answer): a sentence that asks takes the next one as its answer, which can't ask itself then; six at most. A fold over the sentences."""
    kind = "struct<out:array<struct<question:string,answer:string>>,waits:boolean>"

    def step(s: Column, x: Column) -> Column:
        last = F.element_at(s["out"], -1)
        head = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        answered = F.struct(F.concat(head, F.array(F.struct(last["question"].alias("question"), x.alias("answer")))).alias("out"), F.lit(False).alias("waits"))
        asked = F.struct(F.concat(s["out"], F.array(F.struct(x.alias("question"), F.lit("").alias("answer")))).alias("out"), F.lit(True).alias("waits"))
        return F.when(s["waits"], answered).when(x.rlike(r"\?$"), asked).otherwise(s).cast(kind)

    start = F.struct(F.array().cast("array<struct<question:string,answer:string>>").alias("out"), F.lit(False).alias("waits")).cast(kind)
    return F.slice(F.aggregate(sents, start, step, lambda s: s["out"]), 1, 6)
