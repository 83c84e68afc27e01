"""What a deck's own words add to its slides: terms of its glossary where they are met, sentences from elsewhere in it that a thin slide's title asks for, and pages made of its
terms and leads. Rows stream through tasks by deck and place with a small state (what was shown last, what was used); no deck is collected."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import blanks, ends, is_clean_sentence
from deckloom.functions.text import upper_letter
from deckloom.operators.extract import BEFORE_WORD

#: Terms of a slide, slides before a term is shown again, and from which share of at least how many slides a term is the deck's topic, shown once.
PER_SLIDE, REGAP, CENTRAL, LEAST_SLIDES = 2, 12, 0.3, 10
TABLE_MARK = "[TABLE DATA]"
# Words of a title that say nothing of its topic, the mark of a continued title, titles of a glossary, words that open a step.
TITLE_STOP = (
    "with", "from", "that", "this", "what", "which", "their", "there", "these", "those", "about", "into", "over", "under", "part",
    "slide", "lecture", "module", "introduction", "overview", "example", "examples", "types", "type", "using", "based",
)
CONTINUED = r"(?i)\s*\((?:\d+/\d+|continued)\)\s*$"
GLOSSARY_TITLE = r"(?i)key terms|glossary|terminology|vocabulary|key concepts|definitions"
OPENING = r"(?i)^(?:first(?:ly)?|second(?:ly)?|next|then|finally|however|also)\b[,:]?\s*"
#: Words of a slide that count as few, and of a lead.
THIN, LEAD_WORDS = 25, 20
AUTOMATA = 64


def _matcher(terms: list[dict]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t["term"], (t["term"], t["definition"], t["slide_no"]))
    found.make_automaton()
    return found


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def term_hits(slides: DataFrame, glossary: DataFrame) -> DataFrame:
    """(deck, slide_no, term, definition, source): the terms (lower case) of a deck's glossary that a slide's text holds as whole words, once each.

    One pass of an Aho-Corasick automaton a deck over each text finds all terms at once; slides meet their deck's terms as one row (``glossary`` has some tens of terms a deck), never each of them.
    """
    kind = slides.schema["deck"].dataType.simpleString()
    terms = glossary.where("term <> ''").groupBy(F.col("deck").alias("_deck")).agg(F.collect_list(F.struct("term", "definition", "slide_no")).alias("terms"))
    rows = slides.join(terms, F.col("deck") == F.col("_deck")).select("deck", F.col("slide_no").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict = OrderedDict()
        for batch in batches:
            rows, slide, term, definition, source = [], [], [], [], []
            decks = batch.column(0).to_pylist()
            for i, (deck, no, text) in enumerate(zip(decks, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if deck not in known:
                    known[deck] = _matcher(batch.column(3)[i].as_py())
                    if len(known) > AUTOMATA:
                        known.popitem(last=False)
                seen = set()
                for end, (t, d, s) in known[deck].iter(text):
                    if t not in seen and not _in_word(text, end + 1) and not _in_word(text, end - len(t)):
                        seen.add(t)
                        for out, v in ((rows, i), (slide, no), (term, t), (definition, d), (source, s)):
                            out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(slide, pa.int64()), pa.array(term, pa.string()), pa.array(definition, pa.string()), pa.array(source, pa.int64())], names=["deck", "slide_no", "term", "definition", "source"])

    return rows.mapInArrow(run, f"deck {kind}, slide_no long, term string, definition string, source long")


def key_terms(slides: DataFrame, glossary: DataFrame, per_slide: int = PER_SLIDE, regap: int = REGAP) -> DataFrame:
    """(deck, slide_no, rank, term, definition): up to ``per_slide`` terms that a slide (deck, slide_no, text) uses and another one defines, the longest first.

    A term is shown again after ``regap`` slides only, and a deck's topic (in over 30 % of at least ten slides) once. Slides with table data show none. Slide numbers are dense. Hits stream
    by deck and slide with the slide at which each term was shown last.
    """
    kind = slides.schema["deck"].dataType.simpleString()
    hits = term_hits(slides, glossary)
    sizes = slides.groupBy(F.col("deck").alias("_deck")).agg(F.count(F.lit(1)).alias("n"))
    often = hits.groupBy(F.col("deck").alias("_of"), F.col("term").alias("_term")).agg(F.count(F.lit(1)).alias("times"))
    topics = often.join(sizes, F.col("_of") == F.col("_deck")).select("_of", "_term", ((F.col("times") > CENTRAL * F.col("n")) & (F.col("n") >= LEAST_SLIDES)).alias("central"))
    tables = slides.where(F.contains("text", F.lit(TABLE_MARK))).select("deck", F.col("slide_no").cast("long").alias("slide_no"))
    rows = hits.where("source <> slide_no").join(topics, (F.col("deck") == F.col("_of")) & (F.col("term") == F.col("_term"))).join(tables, ["deck", "slide_no"], "left_anti")
    order = [F.col("deck"), F.col("slide_no"), F.length("term").desc(), F.col("term").desc(), F.col("definition").desc()]
    rows = rows.select("deck", "slide_no", "term", "definition", "central").repartition("deck").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, rank = object(), None, 0
        shown: dict[str, int] = {}  # as the slide before left it
        chosen: list[str] = []
        for batch in batches:
            keep, ranks = [], []
            for i, (deck, no, term, central) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if deck != own:
                    own, at, shown, chosen = deck, None, {}, []
                if no != at:
                    shown.update(dict.fromkeys(chosen, at))
                    at, rank, chosen = no, 0, []
                if rank < per_slide and not (term in shown and (central or no - shown[term] < regap)):
                    rank += 1
                    chosen.append(term)
                    keep.append(i)
                    ranks.append(rank)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ranks, pa.int32()), part.column(2), part.column(3)], names=["deck", "slide_no", "rank", "term", "definition"])

    found = rows.mapInArrow(run, f"deck {kind}, slide_no long, rank int, term string, definition string")
    name = F.when(F.length("term") < 4, F.col("term")).otherwise(F.concat(upper_letter(F.left("term", F.lit(1))), F.substring("term", 2, 200)))
    return found.withColumn("term", name)


def _ranked_terms(slides: DataFrame, glossary: DataFrame) -> DataFrame:
    """(deck, term, definition, times): how often a deck's lower-cased texts hold each term, anywhere. Terms meet their deck's slides once a slide, by its row of terms."""
    terms = glossary.groupBy(F.col("deck").alias("_deck")).agg(F.collect_list(F.struct("term", "definition")).alias("terms"))
    low = slides.select("deck", F.lower(F.coalesce("text", F.lit(""))).alias("low")).join(terms, F.col("deck") == F.col("_deck"))
    times = lambda t: ((F.length("low") - F.length(F.replace(F.col("low"), t["term"], F.lit("")))) / F.length(t["term"])).cast("long")
    each = low.select("deck", F.explode(F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["definition"].alias("definition"), times(t).alias("k")))).alias("t"))
    return each.groupBy("deck", F.col("t.term").alias("term"), F.col("t.definition").alias("definition")).agg(F.sum("t.k").alias("times"))


def _line(term: Column, definition: Column) -> Column:
    name = F.when(F.length(term) < 30, F.concat(upper_letter(F.left(term, F.lit(1))), F.substring(term, 2, 200))).otherwise(F.left(term, F.lit(30)))
    return F.concat(name, F.lit(": "), definition)


def glossary_pages(slides: DataFrame, glossary: DataFrame, per_page: int = 6, least: int = 4, most: int = 12) -> DataFrame:
    """(deck, page, title, lines): a deck's most frequent terms with a definition of three words or more, six a page; none for a deck with fewer than ``least``, or that has a page of terms already."""
    own = slides.where(F.col("title").rlike(GLOSSARY_TITLE)).select("deck").distinct()
    rows = _ranked_terms(slides, glossary).where(F.size(blanks(F.col("definition"))) >= 3).join(own, "deck", "left_anti")
    order = Window.partitionBy("deck").orderBy(F.desc("times"), F.desc("term"), F.desc("definition"))
    rows = rows.withColumn("at", F.row_number().over(order) - 1).where(F.col("at") < most)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("deck"))).where(F.col("n") >= least).withColumn("page", (F.floor(F.col("at") / per_page) + 1).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", _line(F.col("term"), F.col("definition")).alias("line")))), lambda x: x["line"])
    pages = rows.groupBy("deck", "page").agg(lines.alias("lines"), F.ceil(F.max("n") / per_page).cast("int").alias("pages"))
    title = F.when(F.col("pages") == 1, "Glossary").otherwise(F.concat(F.lit("Glossary ("), F.col("page").cast("string"), F.lit("/"), F.col("pages").cast("string"), F.lit(")")))
    return pages.select("deck", "page", title.alias("title"), "lines")


def matching_pairs(slides: DataFrame, glossary: DataFrame, pairs: int = 5, least: int = 4) -> DataFrame:
    """(deck, rank, term, definition) of an exercise to match terms: the most frequent short terms with definitions of 4 to 18 words, for decks with at least ``least``."""
    n = F.size(blanks(F.col("definition")))
    rows = _ranked_terms(slides, glossary).where(((F.size(blanks(F.col("term"))) == 3) | (F.length("term") <= 28)) & n.between(4, 18))
    order = Window.partitionBy("deck").orderBy(F.desc("times"), F.desc("term"), F.desc("definition"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pairs).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("deck")))
    name = F.concat(upper_letter(F.left("term", F.lit(1))), F.substring("term", 2, 200))
    return rows.where(F.col("n") >= least).select("deck", "rank", name.alias("term"), "definition")


def lead(bullets: Column, most: int = LEAD_WORDS) -> Column:
    """A slide's first bullet without a word of order, cut at a mark within ``most`` words if that keeps six, else with an ellipsis."""
    first = F.coalesce(F.get(F.filter(F.transform(bullets, ends), lambda b: (b != "") & ~F.startswith(b, F.lit("###"))), F.lit(0)), F.lit(""))
    first = F.regexp_replace(first, OPENING, "")
    words = blanks(first)
    cut = F.array_join(F.slice(words, 1, most), " ")
    whole = F.regexp_extract(cut, r"^.*[.;:]", 0)
    return F.when(F.size(words) <= most, first).when(F.size(blanks(whole)) >= 6, whole).otherwise(F.concat(F.regexp_replace(cut, "[,;: ]+$", ""), F.lit("…")))


def summary_lines(slides: DataFrame, most: int = 7, least: int = 3) -> DataFrame:
    """(deck, place, line) of a closing page: title and lead of the first slide of each title, an even sample where there are over ``most``; none for decks with fewer than ``least`` slides or lines."""
    rows = slides.select("deck", "slide_no", F.col("title").alias("whole"), F.trim(F.regexp_replace("title", r"\s*\(\d+/\d+\)$", "")).alias("title"), lead(F.col("bullets")).alias("lead"), F.count(F.lit(1)).over(Window.partitionBy("deck")).alias("slides"))
    first = F.row_number().over(Window.partitionBy("deck", "whole").orderBy("slide_no"))
    rows = rows.where(F.col("slides") >= least).withColumn("first", first).where("first = 1 AND lead <> '' AND title <> ''")
    order = Window.partitionBy("deck").orderBy("slide_no")
    rows = rows.withColumns({"at": (F.row_number().over(order) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy("deck"))}).where(F.col("n") >= least)
    # line k of the sample is pick floor(k * n / most): a pick is in it if some k falls on it
    k = F.ceil(F.col("at") * most / F.col("n")).cast("long")
    sampled = (F.col("n") <= most) | ((k < most) & (F.floor(k * F.col("n") / most) == F.col("at")))
    place = F.when(F.col("n") <= most, F.col("at")).otherwise(k)
    return rows.where(sampled).select("deck", (place + 1).cast("int").alias("place"), F.concat(F.left("title", F.lit(38)), F.lit(": "), "lead").alias("line"))


def title_keys(title: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.regexp_replace(title, CONTINUED, ""), F.lit(r"[A-Za-z][A-Za-z\-]{3,}"), F.lit(0)), lambda w: F.lower(w))
    return F.filter(found, lambda w: ~w.isin(list(TITLE_STOP)))


def signature(text: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(text), "[^a-z]", ""), F.lit(70))


def context_sentences(slides: DataFrame, thin: int = THIN) -> DataFrame:
    """(deck, slide_no, sentence, source): for each slide (deck, slide_no, title, bullets) of fewer than ``thin`` words the nearest clean sentence of another slide that names its topic and that no slide before it
    was given. A topic is the title's keywords, of which two have to be named where there are three or more.

    Slides and sentences meet by the first four letters of a keyword and of the sentence's words, not pair by pair. Candidates stream by deck, slide and distance; the state is the set of
    sentences that are used.
    """
    kind = slides.schema["deck"].dataType.simpleString()
    on_slide = F.array_join("bullets", " ")
    rows = slides.select("deck", F.col("slide_no").cast("long").alias("slide_no"), title_keys(F.col("title")).alias("keys"), on_slide.alias("on_slide"))
    parts = F.split(F.regexp_replace("on_slide", r"\s+", " "), r"(?<=[.!?])\s+")
    pool = rows.select("deck", F.col("slide_no").alias("source"), F.posexplode(parts).alias("pos", "sentence")).withColumn("sentence", ends(F.col("sentence"))).where(is_clean_sentence(F.col("sentence")))
    pool = pool.select("deck", "source", "pos", "sentence", signature(F.col("sentence")).alias("mark"), F.lower("sentence").alias("low"))
    heads = pool.select("*", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(BEFORE_WORD + r"(?=([a-z][a-z\-]{3}))"), F.lit(1)))).alias("head"))
    wants = rows.where((F.size(blanks(F.col("on_slide"))) < thin) & (F.size("keys") > 0)).withColumn("own", signature(F.col("on_slide")))
    asked = wants.select("deck", "slide_no", "keys", "own", F.explode(F.array_distinct(F.transform("keys", lambda k: F.left(k, F.lit(4))))).alias("head"))
    met = asked.join(heads, ["deck", "head"]).where("source <> slide_no").dropDuplicates(["deck", "slide_no", "source", "pos"])
    hits = F.size(F.filter("keys", lambda k: F.regexp_like("low", F.concat(F.lit(BEFORE_WORD), k))))
    need = F.when(F.size("keys") >= 3, 2).otherwise(1)
    known = F.contains("own", F.left("mark", F.lit(40)))
    met = met.where((hits >= need) & ((F.length(F.get("keys", F.lit(0))) >= 5) | (hits >= 2)) & ~known)
    near = met.select("deck", "slide_no", "sentence", "source", "mark", F.abs(F.col("source") - F.col("slide_no")).alias("far"), "pos")
    near = near.repartition("deck").sortWithinPartitions("deck", "slide_no", "far", "source", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given, used = object(), None, set()
        for batch in batches:
            keep = []
            for i, (deck, no, mark) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)), strict=True)):
                if deck != own:
                    own, given, used = deck, None, set()
                if no != given and mark not in used:
                    given = no
                    used.add(mark)
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(part.columns[:4], names=["deck", "slide_no", "sentence", "source"])

    return near.mapInArrow(run, f"deck {kind}, slide_no long, sentence string, source long")
