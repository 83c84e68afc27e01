"""Utterances to intents, and references to presentations: a table of rules as columns, and a cascade over a registry."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import blanks
from deckloom.operators.holding import held


class Rule(NamedTuple):
    """An utterance that matches ``pattern``, but not one after which ``unless`` follows, means ``intent``."""

    name: str
    pattern: str
    intent: str
    confidence: float
    unless: str = ""


# Spellings that are mended, and the rules in the order that decides between equals.
SPELLINGS = (
    (r"^(hey|ok|okay|hi|hello|yo)\s+assistant[,!.\s]*", ""),
    (r"^assistant[,!.\s]+", ""),
    (r"\b(pls|plz)\b", "please"),
    (r"\bpresntation\b|\bpresentaton\b|\bpresentaion\b|\bpresntn\b", "presentation"),
    (r"\bpres\b", "presentation"),
    (r"\bppt\b", "presentation"),
    (r"\bslde\b", "slide"),
    (r"\bnxt\b", "next"),
    (r"\bopn\b", "open"),
    (r"\bexplan\b|\bexplian\b", "explain"),
    (r"\bno\.?\s*(\d)", r"number $1"),
)
READY = r"pre[- ]?built|prebuilt|ready[- ]?made|readymade|pre[- ]?made|premade|off[- ]the[- ]shelf|already (?:have|got|has|made|created|exists?|there)|in the gallery|from the gallery"
RULES = (
    Rule("voice.stop", r"^(stop|shut up|be quiet|quiet|enough)$", "STOP_SPEAKING", 0.97),
    Rule("voice.pause", r"^(pause|hold on|wait)$", "PAUSE", 0.95),
    Rule("voice.resume", r"^(resume|continue|carry on|go on|keep going)$", "RESUME", 0.93),
    Rule("voice.repeat", r"^(repeat|repeat that|say (that|it) again|come again|what)$", "REPEAT_LAST", 0.9),
    Rule("voice.cancel", r"^(cancel|never mind|nevermind|forget it|abort)$", "CANCEL", 0.95),
    Rule("slide.next", r"^(next slide|next|next one|okay next|and next|forward|move on|advance( the slide)?|go forward|show the next( one| slide)?|continue to the next slide)$", "NEXT_SLIDE", 0.9),
    Rule(
        "slide.prev",
        r"^(previous slide|previous( one)?|go back|back|back up( one slide)?|prior slide|one back|go back one|back a slide|return to the previous slide|back to the previous slide)$",
        "PREVIOUS_SLIDE",
        0.88,
    ),
    Rule("slide.first", r"\b(first slide|go to (the )?first slide|slide one|slide 1)\b|^(go to the beginning|back to the start|start from the beginning|jump to the first slide|to the start)$", "FIRST_SLIDE", 0.9),
    Rule("slide.last", r"\b(last slide|final slide)\b|^(go to the end|jump to the end|show the last slide|to the end)$", "LAST_SLIDE", 0.9),
    Rule("slide.goto", r"\b(go to|goto|show|jump to|open|take me to|start (from|at))\s+slide\s+(?:number\s+)?(\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten)\b", "GO_TO_SLIDE", 0.93),
    Rule("slide.goto2", r"\bslide\s+(?:number\s+)?(\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b", "GO_TO_SLIDE", 0.82),
    Rule("slide.section", r"\b(go to|jump to|show me|take me to|open)\s+the\s+(.+?)\s+(section|part|slide)\b", "GO_TO_SECTION", 0.82),
    Rule("slide.repeat", r"\b(repeat (this|the) slide|show (this|it) again|stay here)\b", "REPEAT_SLIDE", 0.85),
    Rule("slide.read", r"\b(read (this|the) slide|read (this|it) (out|aloud)|read it to me)\b", "READ_SLIDE", 0.9),
    Rule(
        "slide.explain",
        r"\b(explain (this|the)( current)? slide|what('?s| is) (on )?this slide|what does this slide (say|mean)|what is this slide about|break down this slide|help me understand this slide)\b|"
        r"^(explain this|explain it|explain the current slide)$",
        "EXPLAIN_SLIDE",
        0.9,
    ),
    Rule(
        "visual.explain",
        r"\b(explain (this|the) (diagram|chart|image|figure|graph|picture)|what does this (diagram|chart|image|figure|arrow|box) (mean|show|represent)|what('?s| is) (happening )?(here|this)|what is this)\b",
        "EXPLAIN_VISUAL",
        0.85,
    ),
    Rule("pres.create", r"\b(create|make( me)?|build|generate|turn .* into)\b.*\b(presentation|deck|slides|slideshow|web deck)\b", "CREATE_PRESENTATION", 0.92),
    Rule("pres.webdeck", r"\b(web deck|interactive (deck|version|presentation)|web (version|presentation)|html (deck|version))\b", "GET_WEB_DECK", 0.9),
    Rule(
        "pres.start",
        r"\b(start|play|present|begin|run|kick off)\s+(presenting\s+)?(the\s+)?(presentation|deck|slideshow|slide\s?show)\b|\bstart presentation\b|\bpresent the\b|\blet'?s present\b",
        "START_PRESENTATION",
        0.92,
    ),
    Rule("pres.stop", r"\b(stop|end|close|exit|quit)\s+(the\s+)?(presentation|deck|slideshow)\b", "STOP_PRESENTATION", 0.9),
    Rule("pres.restart", r"\b(restart|start over|from the beginning)\b.*\b(presentation|deck)\b", "RESTART_PRESENTATION", 0.85),
    Rule("pres.resume", r"\b(resume|continue|go back to)\s+(the\s+)?(presentation|deck|where (i|we) (left off|were))\b", "RESUME_PRESENTATION", 0.8),
    Rule(
        "pres.download",
        r"\b(download|export|save)\b.*\b(presentation|deck|pptx|powerpoint|power point|pdf|file|slides)\b|\b(get|give) (me )?the (pptx|powerpoint|power point|pdf|file)\b",
        "DOWNLOAD_PRESENTATION",
        0.93,
    ),
    Rule("pres.delete", r"\b(delete|remove|trash|get rid of)\s+(the\s+)?(presentation|deck)\b", "DELETE_PRESENTATION", 0.85),
    Rule("pres.open", r"\b(open|show( me)?|launch|get|give me|take me to|bring up|pull up|i want|can i see|let'?s (see|open))\b.*\b(presentation|deck|[a-z]+-pres-\d+)\b", "OPEN_PRESENTATION", 0.85),
    Rule("pres.open_id", r"\b[a-z]+-pres-\d{3,}\b", "OPEN_PRESENTATION", 0.9),
    Rule(
        "pres.open_num",
        r"\b(open|show( me)?|launch|start|go to|bring up|pull up|let'?s (open|see))\s+(number\s+)?(\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten)\b",
        "OPEN_PRESENTATION",
        0.8,
        r".*\bslide\b",
    ),
    Rule(
        "pres.open_ord",
        r"\b(open|show( me)?|launch|start|go to|bring up)\s+the\s+(first|second|third|fourth|fifth|last|latest|newest|\d+(st|nd|rd|th))\s*(one|deck|presentation)?\b",
        "OPEN_PRESENTATION",
        0.78,
        r".*\bslide\b",
    ),
    Rule(
        "gallery.check",
        rf"\b({READY})\b.*\b(deck|decks|presentation|presentations|slides?|slideshow|lesson|topic)\b|\b(deck|decks|presentation|slides?|lesson)\b.*\b({READY})\b|"
        rf"\b(do you (?:have|already have)|is there|are there|have you got|got any|any)\b.*\b({READY}|gallery)\b",
        "CHECK_GALLERY",
        0.9,
    ),
    Rule(
        "gallery.check2",
        rf"\bcheck (?:if |whether |that )?.*\b({READY})\b|\b(gallery|ready[- ]made|pre[- ]built)\b.*\b(has|have|contains?|includes?)\b|\bis\s+(?:there\s+)?(?:a\s+)?.+\b({READY}|already (?:made|there|built))\b",
        "CHECK_GALLERY",
        0.84,
    ),
    Rule(
        "gallery.check3",
        r"\b(do you (?:have|got|offer)|have you (?:got|made)|is there|are there|got any|what (?:slides?|decks?|presentations?) do you have)\b.*"
        r"\b(slides?|decks?|presentation|presentations|lesson|material|deck)\b.*\b(on|about|for|covering|regarding)\b",
        "CHECK_GALLERY",
        0.8,
    ),
    Rule("pres.search", r"\b(find|search( for)?|list|show( me)?( all| my)?|which|do i have)\b.*\b(presentations?|decks?)\b", "SEARCH_PRESENTATION", 0.85),
    Rule("content.where", r"\b(where (is|do you|can i find|are|does)|which (presentation|deck|slide))\b", "WHERE_IS_TOPIC", 0.82),
    Rule("content.search", r"\b(search( for)?|look up|find (me )?(everything |all )?(about|on)?|look for)\b", "SEARCH_CONTENT", 0.78, r".*\b(presentations?|decks?)\b"),
    Rule("content.findabout", r"\b(show me all presentations related to|find presentations about|which decks are about|list decks covering)\b", "FIND_PRESENTATIONS_ABOUT", 0.85),
    Rule("pres.summarise", r"\b(summari[sz]e|give me a summary of|tl;?dr|short version of|quick summary of)\b", "SUMMARIZE_PRESENTATION", 0.9),
    Rule("pres.explain", r"\b(explain|walk me through|what('?s| is) in|give me an overview of|what does presentation \d+ cover)\b.*\b(presentation|deck)\b", "EXPLAIN_PRESENTATION", 0.86),
    Rule("quiz.start", r"\b(quiz me|test me|give me (a )?quiz|practi[sc]e questions?|give me \d+ questions|mcqs?|ask me (some )?questions)\b", "START_QUIZ", 0.9),
    Rule("quiz.next", r"\b(next question|another question|ask me (the )?next|continue the quiz)\b", "NEXT_QUIZ_QUESTION", 0.88),
    Rule("quiz.mistake", r"\b(why (is|was) (my answer|that) wrong|explain my mistake|why did i get (it|that) wrong)\b", "EXPLAIN_MISTAKE", 0.88),
    Rule("quiz.answer", r"^(the answer is|i think it'?s|my answer is|it'?s|answer:?)\s+(.+)$", "SUBMIT_QUIZ_ANSWER", 0.7),
    Rule("learn.teach", r"\b(teach me|help me (learn|understand)|i (want|need) to learn|start teaching me)\b", "TEACH_TOPIC", 0.9),
    Rule("learn.exam", r"\b(exam (prep|preparation)|prepare (me )?for (my|the) (exam|test)|revision|revise|i have (an|a) (exam|test)|help me (study|revise)|studying for)\b", "EXAM_PREP", 0.85),
    Rule("learn.easier", r"\b(easier example|simpler example|give me an easier|too hard|i don'?t (get|understand) (it|this))\b", "EASIER_EXAMPLE", 0.8),
    Rule("learn.harder", r"\b(harder example|more (difficult|advanced|challenging)|give me a tougher|too easy)\b", "HARDER_EXAMPLE", 0.82),
    Rule("edu.compare", r"\b(compare|difference between|vs\.?|versus|how (does|do) .* differ)\b", "COMPARE_CONCEPTS", 0.85),
    Rule("edu.rwexample", r"\b(real[- ]world example|everyday example|practical example|real life example|used in real life|real[- ]world use|where is .* used)\b", "REAL_WORLD_EXAMPLE", 0.86),
    Rule("edu.example", r"\b(give me (an|a) example|show me an example|for example|an example please|can you demonstrate|give an example|example of)\b", "GIVE_EXAMPLE", 0.84),
    Rule(
        "edu.simple",
        r"\b(explain\b.*\b(simply|in simple( terms)?|in easy|in plain (english|language))|like i'?m (a beginner|five|new|10)|make (this|it) (easier|simpler)|dumb it down|i don'?t understand( this)?$|simpler please)\b",
        "SIMPLIFY",
        0.88,
    ),
    Rule("edu.step", r"\b(step by step|step-by-step|one step at a time|break (it|this) down)\b", "STEP_BY_STEP", 0.85),
    Rule("edu.why", r"^why\b|\bwhy (do|does|is|are|did|would|should)\b", "WHY_QUESTION", 0.72),
    Rule("edu.next", r"\b(what (happens|comes) next|then what|and then|what'?s the next step|what happens after this)\b", "WHAT_NEXT", 0.86),
    Rule("edu.define", r"^(define|what does .* (mean|stand for)|meaning of)\b", "DEFINE_TERM", 0.75),
    Rule("edu.explain", r"^(explain|what (is|are|was)|tell me about|how (does|do|is)|describe)\b", "EXPLAIN_CONCEPT", 0.68),
    Rule(
        "vis.make",
        r"\b(make (this|it|.{1,20}) (more )?visual|turn (this|it|.{1,30}) into (a )?(diagram|visual|animation|flowchart|picture)|show (this|it) as a (diagram|chart|visual|flowchart)|"
        r"visuali[sz]e (this|it|.{1,20})|create a visual (explanation|of)|turn (this|the) (paragraph|text|content) into)\b",
        "MAKE_VISUAL",
        0.83,
    ),
    Rule("vis.anim", r"\b(add (an )?animation|animate (this|it)|make (this|it) animated)\b", "ADD_ANIMATION", 0.85),
    Rule("vis.interact", r"\b(make (this|it) interactive|add interactivity|interactive flowchart)\b", "MAKE_INTERACTIVE", 0.85),
    Rule("sys.help", r"^(help|what can you do|how do (i|you) work|commands|how do i use this)$", "HELP", 0.9),
    Rule("sys.translate", r"\b(translate|in (hindi|marathi|spanish|french|german|tamil|telugu)|explain (this|that) in )\b", "TRANSLATE", 0.72),
    Rule("sys.greet", r"^(hi|hello|hey|good (morning|afternoon|evening)|what'?s up|yo)$", "GREETING", 0.9),
)
QUESTION = r"^(what|why|how|when|who|which|is|are|can|does|do)\b"
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
REFERENCE_VERB = r"\b(?:open|show(?: me)?|launch|start|get|give me|take me to|go to|bring up|pull up|resume|restart|download|delete|i want)\s+(.+)$"
REFERENCE_LEAD = r"^(the\s+|me\s+the\s+|of\s+(the\s+)?|web deck of\s+|interactive version of\s+)"
REFERENCE_KIND = r"^(the\s+)?(web|interactive|html)\s+(deck|version|presentation)\s+(of\s+)?"
ORDINALS = {
    "first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "fifth": 5, "5th": 5, "sixth": 6, "seventh": 7, "eighth": 8,
    "ninth": 9, "tenth": 10, "last": -1, "latest": -1, "newest": -1,
}
REGISTRY_STOP = "the a an of on in to for and presentation deck slides slide ppt pptx web interactive about regarding covering".split()
REFERENCE_FILLER = (
    r"\b(open|show|launch|start|get|give me|take me to|go to|the|please|can you|could you|i want|bring up|web deck|deck|presentation|slides?|interactive|version|about|on|for)\b"
)
SUBJECT_HINTS = {
    "cybersecurity": "security cyber phishing malware attack encryption cryptography firewall vulnerability".split(),
    "networking": "network tcp ip router packet osi dns".split(),
    "machine learning": ["machine learning", "neural", "model", "training", "regression", "classifier", "deep learning"],
    "nlp": ["nlp", "natural language", "tokeniz", "lexical", "semantic", "syntactic", "language processing"],
    "operating systems": ["operating system", "process", "thread", "scheduler", "kernel", "deadlock", "paging"],
    "databases": ["database", "sql", "normalization", "transaction", "index"],
}


def normalised(text: Column) -> Column:
    """Lower case, the call of the assistant left out, common slips mended, single spaces."""
    t = F.trim(F.lower(text))
    for pattern, by in SPELLINGS:
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^[ ?!.]+|[ ?!.]+$", "")


def spoken_number(text: Column) -> Column:
    """The first number of up to three digits, else that of the first number word in counting order."""
    found = F.regexp_extract(text, r"\b(\d{1,3})\b", 1).try_cast("int")
    word = F.lit(None).cast("int")
    for k in range(len(NUMBER_WORDS), 0, -1):
        word = F.when(text.rlike(rf"\b{NUMBER_WORDS[k - 1]}\b"), k).otherwise(word)
    return F.coalesce(found, word)


def reference_of(text: Column) -> Column:
    """What an utterance calls the presentation that it is about."""
    after = F.regexp_extract(text, REFERENCE_VERB, 1)
    s = F.when(after != "", after).otherwise(text)
    s = F.trim(F.regexp_replace(F.regexp_replace(s, REFERENCE_LEAD, ""), REFERENCE_KIND, ""))
    return F.when(s != "", s).otherwise(text)


def compared(text: Column) -> tuple[Column, Column]:
    """The two things that an utterance compares."""
    between = r"(?:compare|difference between|between)\s+(.+?)\s+(?:and|vs\.?|versus|with)\s+(.+)$"
    versus = r"(.+?)\s+(?:vs\.?|versus)\s+(.+)$"
    pick = lambda k: F.when(text.rlike(between), F.regexp_extract(text, between, k)).otherwise(F.regexp_extract(text, versus, k))
    return tuple(F.nullif(F.regexp_replace(pick(k), r"^[ ?]+|[ ?]+$", ""), F.lit("")) for k in (1, 2))


def understood(utterances: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, normal, rule, intent, confidence, number, reference, concept, concept_b) of each utterance (id, text).

    The most confident of the rules that match, the first among equals. ``rules`` can be any table of that form. Patterns are
    literals, so each is compiled once a task; nothing is joined.
    """
    rows = utterances.select("id", "text", normalised(F.col("text")).alias("normal"))
    t = F.col("normal")
    hits = [
        F.when(t.rlike(r.pattern + (f"(?!{r.unless})" if r.unless else "")), F.struct(F.lit(-r.confidence).alias("less"), F.lit(k).alias("k"), F.lit(r.name).alias("rule"), F.lit(r.intent).alias("intent")))
        for k, r in enumerate(rules)
    ]
    asked = F.contains(F.col("text"), F.lit("?")) | t.rlike(QUESTION)

    def fallback(less: float, rule: str, intent: str) -> Column:
        return F.struct(F.lit(less).alias("less"), F.lit(len(rules)).alias("k"), F.lit(rule).alias("rule"), F.lit(intent).alias("intent"))

    other = F.when(asked, fallback(-0.45, "fallback.question", "EXPLAIN_CONCEPT")).when(t.rlike("presentation|deck"), fallback(-0.4, "fallback.presentation", "OPEN_PRESENTATION")).otherwise(fallback(-0.2, "none", "UNKNOWN"))
    best = F.when(t == "", fallback(0.0, "", "UNKNOWN")).otherwise(F.coalesce(F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull())), other))
    rows = rows.withColumn("best", best).select("id", "normal", "best.rule", "best.intent", (-F.col("best.less") + 0.0).alias("confidence"))
    numbered = F.col("rule").isin("slide.goto", "slide.goto2", "pres.open_num", "quiz.start")
    named = F.col("rule").isin("pres.webdeck", "pres.start", "pres.download", "pres.delete", "pres.open", "pres.summarise", "pres.explain", "fallback.presentation")
    ident = F.upper(F.regexp_extract(t, r"[a-z]+-pres-\d{3,}", 0))
    a, b = compared(t)
    is_compare = F.col("rule") == "edu.compare"
    reference = F.when(named, reference_of(t)).when(F.col("rule") == "pres.open_id", ident).when(F.col("rule") == "pres.open_num", spoken_number(t).cast("string"))
    return rows.select("*", F.when(numbered, spoken_number(t)).alias("number"), reference.alias("reference"), F.when(is_compare, a).alias("concept"), F.when(is_compare, b).alias("concept_b"))


def registry_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(REGISTRY_STOP))


def derived(entries: DataFrame) -> DataFrame:
    """``entries`` (title, subject, topic, ...) with their subject by hints where they have none, topic, tags and aliases."""
    blob = F.lower(F.concat_ws(" ", "title", "subject", "topic"))
    subject = F.lit("")
    for name, hints in reversed(SUBJECT_HINTS.items()):
        subject = F.when(blob.rlike("|".join(hints)), name).otherwise(subject)
    rows = entries.withColumns({"subject": F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).otherwise(subject), "topic": F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic")).otherwise(F.trim("title"))})
    title, words, low = F.col("title"), registry_tokens(F.col("title")), F.trim(F.lower("title"))
    tags = F.slice(F.array_sort(F.array_distinct(F.concat(words, registry_tokens(F.col("subject"))))), 1, 12)
    own = F.when(low != "", F.array(low, F.concat(low, F.lit(" presentation")), F.concat(low, F.lit(" deck")))).otherwise(F.array().cast("array<string>"))
    by_subject = F.when(F.col("subject") != "", F.array(F.concat(F.col("subject"), F.lit(" presentation")), F.concat(F.col("subject"), F.lit(" deck")))).otherwise(F.array().cast("array<string>"))
    by_word = F.when(F.size(words) > 0, F.array(F.concat(F.get(words, F.lit(0)), F.lit(" presentation")), F.array_join(F.slice(words, 1, 3), " "))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"tags": tags, "aliases": F.array_distinct(F.concat(own, by_subject, by_word)), "title": title})


def _hay(with_aliases: bool = True) -> Column:
    parts = [F.lower("title"), F.lower("subject"), F.lower("topic"), F.array_join("tags", " ")]
    return F.concat_ws(" ", *parts, *([F.array_join("aliases", " ")] if with_aliases else []))


def found_presentations(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, number, hits, rank): entries by how many of a query's words they hold, best first; an empty query takes all by number.

    Entries are read once for all words of all queries (``held``) and meet a query by a word that it has; only empty queries are given every entry, as they ask for it.
    """
    words = F.filter(blanks(F.trim(F.lower("query"))), lambda w: F.length(w) > 1)
    asked = queries.select("query_id", F.trim(F.lower("query")).alias("q"), words.alias("words"))
    each = asked.where("q <> ''").select("query_id", F.explode("words").alias("word"))
    found = held(entries.select("number", _hay().alias("hay")), "number", "hay", each, "word")
    hits = found.join(each, F.col("held") == F.col("word")).groupBy("query_id", "number").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    empty = asked.where("q = ''").agg(F.collect_list("query_id").alias("ids"))  # one row
    every = entries.select("number").join(F.broadcast(empty)).select(F.explode("ids").alias("query_id"), "number", F.lit(0).alias("hits"))
    rows = hits.unionByName(every)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "number"))
    return rows.select("query_id", "number", "hits", rank.alias("rank"))


def found_in_gallery(entries: DataFrame, queries: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, number, score, rank): catalogue entries whose title, subject or a tag holds the query, by words, 3 for the title, 2 if ready."""
    asked = queries.where(F.trim("query") != "").select("query_id", F.lower(F.trim("query")).alias("q"))
    known = entries.select("number", F.lower("title").alias("t"), F.lower("subject").alias("s"), "tags", "ready")
    # parts stand on lines of their own, so nothing is found across two of them
    found = held(known.select("number", F.concat_ws("\n", "t", "s", F.array_join("tags", "\n")).alias("hay")), "number", "hay", asked, "q")
    kept = found.join(asked, F.col("held") == F.col("q")).join(known, "number")
    hay = F.concat_ws(" ", "t", "s", F.array_join("tags", " "))
    words = F.filter(blanks(F.col("q")), lambda w: F.length(w) > 1)
    score = F.size(F.filter(words, lambda w: F.contains(hay, w))) + F.when(F.contains("t", F.col("q")), 3).otherwise(0) + F.when(F.col("ready"), 2).otherwise(0)
    scored = kept.select("query_id", "number", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "number"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def resolved(references: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref_id, status, number, confidence, reason) of each reference (ref_id, reference, current: a number or null) to an entry (number, pres_id, title, ...).

    In this order: a permanent id, a word for what is open, a number, an ordinal position, then titles, subjects, tags and aliases by shared words.
    Entries and references meet by a shared word or by the phrase that an entry holds; only scores of at least a third are ranked.
    """
    low = F.lower(F.trim("reference"))
    number = F.coalesce(
        F.regexp_extract(low, r"\b(?:presentation|deck|slide\s*deck|ppt|number|no\.?|#)\s*(\d{1,3})\b", 1).try_cast("int"),
        F.regexp_extract(low, r"^\s*(\d{1,3})\s*$", 1).try_cast("int"),
    )
    word = F.regexp_extract(low, r"\b(one|two|three|four|five|six|seven|eight|nine|ten)\b", 1)
    as_word = F.when(low.rlike(r"\b(presentation|deck|number|open|show|launch|start|go to|goto)\b") & (word != ""), F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), word).cast("int"))
    ordinal = F.regexp_extract(low, r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last|latest|newest|\d+)(?:\s+one)?\b", 1)
    place = ordinal.try_cast("int")
    for name, k in ORDINALS.items():
        place = F.when(ordinal == name, k).otherwise(place)
    place = F.when(low.rlike(r"\b(presentation|deck|one)\b"), place)
    phrase = F.trim(F.regexp_replace(low, REFERENCE_FILLER, " "))
    rows = references.select(
        "ref_id",
        F.trim("reference").alias("ref"),
        "current",
        F.upper(F.regexp_extract(F.trim("reference"), r"(?i)^([a-z]+-pres-\d{4,})$", 1)).alias("ident"),
        (low.rlike(r"\b(earlier|before|previous|last one|that one|it)\b") & ~low.rlike(r"\bslide\b")).alias("context"),
        F.coalesce(number, as_word).alias("wanted"),
        place.alias("place"),
        phrase.alias("phrase"),
        registry_tokens(F.when(phrase != "", phrase).otherwise(low)).alias("words"),
    )
    span = entries.agg(F.max("number").alias("last"), F.count(F.lit(1)).alias("n_entries"))
    place_in = F.row_number().over(Window.orderBy("number"))  # a person's registry: narrow rows
    known = entries.select("number", "pres_id", place_in.alias("at"))
    hay, own = _hay(), F.array_distinct(F.concat(registry_tokens(F.concat_ws(" ", "title", "subject", "topic")), F.col("tags"), registry_tokens(F.array_join("aliases", " "))))
    looked = entries.select("number", hay.alias("hay"), own.alias("own"))
    # an entry is near a reference if it shares a word with it or holds its phrase: those meet, no others
    by_word = looked.select("number", F.explode("own").alias("word")).join(rows.select("ref_id", F.explode(F.array_distinct("words")).alias("word")), "word").select("number", "ref_id")
    by_phrase = held(looked, "number", "hay", rows, "phrase").join(rows.select("ref_id", "phrase"), F.col("held") == F.col("phrase")).select("number", "ref_id")
    pairs = by_word.union(by_phrase).distinct().join(looked, "number").join(rows.select("ref_id", "phrase", "words"), "ref_id")
    overlap = F.when((F.size("words") == 0) | (F.size("own") == 0), 0.0).otherwise(F.size(F.array_intersect("words", "own")).cast("double") / F.size(F.array_distinct("words")))
    score = F.when((F.col("phrase") != "") & F.contains("hay", F.col("phrase")), 1.0).otherwise(overlap)
    near = pairs.select("ref_id", "number", score.alias("score")).where("score >= 0.34")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("score"), "number")))
    best = ranked.groupBy("ref_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("number"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.count(F.when(F.col("score") >= 0.5, 1)).alias("strong"),
    )
    by_id = known.select(F.col("pres_id").alias("ident"), F.col("number").alias("id_number"))
    by_number = known.select(F.col("number").alias("wanted"), F.col("number").alias("found_number"))
    by_place = known.select(F.col("at").alias("spot"), F.col("number").alias("place_number"))
    rows = rows.join(F.broadcast(span)).withColumn("spot", F.when(F.col("place") == -1, F.col("n_entries")).otherwise(F.col("place")))
    rows = rows.join(by_id, "ident", "left").join(by_number, "wanted", "left").join(by_place, "spot", "left").join(best, "ref_id", "left")

    def out(status: str, number_: Column, confidence, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), number_.cast("long").alias("number"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), F.lit(reason).alias("reason"))

    nothing = F.lit(None)
    clear = (F.col("strong") >= 2) & (F.col("s1") - F.col("s2") >= 0.34)
    found = (
        F.when((F.col("ref") == "") & F.col("current").isNotNull(), out("resolved", F.col("current"), 0.7, "current"))
        .when(F.col("ref") == "", out("not_found", nothing, 0.0, "no reference"))
        .when(F.col("ident") != "", F.when(F.col("id_number").isNotNull(), out("resolved", F.col("id_number"), 1.0, "id")).otherwise(out("not_found", nothing, 0.0, "id")))
        .when(F.col("context") & F.col("current").isNotNull(), out("resolved", F.col("current"), 0.75, "context"))
        .when(F.col("wanted").isNotNull(), F.when(F.col("found_number").isNotNull(), out("resolved", F.col("found_number"), 0.95, "number")).otherwise(out("not_found", nothing, 0.0, "number")))
        .when(F.col("place_number").isNotNull(), out("resolved", F.col("place_number"), 0.8, "position"))
        .when(F.col("strong") == 1, out("resolved", F.col("top"), F.bround(F.least(F.lit(0.95), 0.6 + F.col("s1") * 0.35), 6), "title"))
        .when(clear, out("resolved", F.col("top"), 0.8, "best title"))
        .when(F.col("strong") >= 2, out("ambiguous", nothing, 0.4, "several titles"))
        .when(F.col("s1").isNotNull(), out("resolved", F.col("top"), 0.55, "weak title"))
        .otherwise(out("not_found", nothing, 0.0, "nothing matches"))
    )
    return rows.select("ref_id", found.alias("f")).select("ref_id", "f.*")
