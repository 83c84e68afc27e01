"""Which picture a slide's content calls for: detectors as columns, each a struct of family, variant, confidence and items, or null; and the decision
among them.

Sentences are made once a slide, in a column of their own; every detector reads that column. Items are what the picture is drawn from: a head and a body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions import phrases as P
from deckloom.functions.phrases import let
from deckloom.operators.paging import unlike_sentences
from deckloom.operators.problems import named
from deckloom.operators.shapes import CAUSE, CYCLE, DATE, LABELLED, LOOP, MONTH, PROCEDURE, SHARE, STRONG_CAUSE, pipe_table

# Patterns of the cues and the words that detectors go by.
STEP_CUE = r"(?i)\b(step\s*\d|first(?:ly)?|second(?:ly)?|third(?:ly)?|next|then|finally|lastly|after that|stage\s*\d|phase\s*\d)\b"
DECIDE = (
    r"(?i)^(?:if|whether|check (?:if|whether|that)|test (?:if|whether)|is|are|does|do|has|have|can|was|were|did)\b|\?\s*$|\bif\b.+\b(?:then|otherwise|else)\b|\b(?:until|unless)\b"
)
BRANCH = r"(?i)\b(?:otherwise|else|until|unless|whether|repeat|go back|return to|loop back)\b|\?\s*$|^(?:check|test)\b"
LOOP_BACK = r"(?i)\b(?:repeat|go back|return to|loop back|iterate|again|until)\b"
WH = r"(?i)^(?:what|which|why|how|who|when|where|explain|define|describe|list|state|name|give)\b"
REPEATS = (
    r"(?i)\b(cycle|loop|process|it) (?:repeats|continues|begins again|starts again)|back to the (?:start|beginning)|repeats? (?:continuously|again|indefinitely)|the cycle continues"
)
REFERENCE_TITLE = r"(?i)\b(references?|bibliography|text ?books?|reference books?|further reading|suggested reading|recommended reading|citations|sources)\b"
LOG_LINE = r"(?i)\b(epoch|iteration|iter|step)\s*(\d+)\s*[|:,]?\s*(cost|loss|error|mse|accuracy|acc)\s*[=:]\s*(-?[\d.]+(?:e[-+]?\d+)?)"
QUESTION = (
    r"(?:(?<=^)|(?<=[.!?:]\s)|(?<=\s-\s))((?:Q\s*\d*[.:)]\s*)?(?:What|Which|Why|How|Who|When|Where|Explain|Define|Describe|Differentiate|Compare|List|State|Name|Give|Is|Are|Does|Do|Can)\b[^?]{3,200}\?)"
)
CODE_LINE = (
    r"(?i)^(?:step\s*\d+\b|input\b|output\b|begin\b|end\b|for\b|for each\b|foreach\b|while\b|repeat\b|until\b|do\b|if\b|else\b|elif\b|then\b|return\b|initiali[sz]e\b|init\b|set\b|update\b|compute\b|"
    r"calculate\b|let\b|loop\b|break\b|continue\b|print\b|def\b|function\b|procedure\b|call\b|swap\b|increment\b|decrement\b|append\b|push\b|pop\b|stop\b|exit\b|goto\b)|←|:=|==|\+=|-=|"
    r"\w\s*\[[^\]]*\]\s*=|\)\s*[:{]\s*$|;\s*$"
)
ALGORITHM_TITLE = r"(?i)\b(algorithms?|pseudo-?code|procedure|routine|function\s+\w+\(|code)\b"
MARKUP = r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>"
EQUATION_LINE = r"^[^.!?]{0,70}(?:=|≈|≤|≥|∝|→)[^.!?]{0,70}$"
MATHS_SIGN = r"[=+\-*/^Σ∑∂√θβαλσμ()\d]"
GRAPH_TEXT = r"\b(?:y|f\(x\))\s*=\s*([-+*/^()\d.\sx]+?)(?:\s+(?:has|is|with|where|and|for|gives|so)\b|[.;,]|$)"
GRAPH_WORD = r"(?i)\b(function|slope|intercept|graph|plot|curve|line|parabola|linear|quadratic)\b"
MATHS_VERB = (
    r"(?i)^(?:expand|solve|simplify|multiply|factor(?:ise|ize)?|combine|substitute|divide|subtract|add|differentiate|integrate|evaluate|compute|calculate|check|rearrange|collect|cancel|square|take)\b"
)
EXPRESSION = r"\d\s*[\^*/+\-=]\s*[\w(]|[a-z]\^\d|\)\s*\(|\d[a-z]\b"
TERM = r"\d*[A-Z][A-Za-z0-9₀-₉()]*|\d*[a-z]{3,9}"
REACTION = rf"(?:^|\W)(\d*[A-Z][A-Za-z0-9₀-₉()]*(?:\s*\+\s*(?:{TERM}))*\s*(?:<->|<=>|⇌|→|->|=>)\s*(?:{TERM})(?:\s*\+\s*(?:{TERM}))*)"
GLOSSARY_TITLE = r"(?i)key terms?|glossary|terminology|vocabulary|key concepts?|definitions?|important terms"
MEANING = r"^(?:(?:A|An|The)\s+)?([A-Z][\w'’()/ -]{1,42}?)\s+(?:is|are|means|refers to|denotes|states that|describes)\s+(?:(?:a|an|the)\s+)?(.+)$"
AGENDA_TITLE = (
    r"(?i)^\s*(?:content|contents|agenda|outline|syllabus|topics|table of contents|what we(?:'ll| will) cover|today(?:'s)? (?:topics|plan)|plan|overview of (?:the )?(?:module|unit|lecture|session))\s*:?\s*$"
)
VERSUS = r"(?i)\s+(?:vs\.?|versus|compared (?:to|with)|and|or|v)\s+"
NAMED_VERSUS = r"\b([A-Z][\w+#.-]*(?: [A-Z][\w+#.-]*)?)\s+(?:vs\.?|versus)\s+([A-Z][\w+#.-]*(?: [A-Z][\w+#.-]*)?)"
PARALLEL = r"^(?:The\s+)?([A-Z][\w+#.'-]*(?:\s+[A-Za-z][\w+#.'-]*){0,3}?)\s+(?:is|are|has|have|uses|provides|means|costs|takes|offers|runs|needs|requires|works)\s+(.+)$"
PRO = (
    r"(?i)\b(advantages?|benefits?|pros?|upsides?|strengths?|merits?|gives?|improves?|boosts?|widens?|saves?|increases?|enables?|reduces? (?:cost|risk)|flexib\w+|efficien\w+|low(?:er)? (?:cost|carbon))\b"
)
CON = (
    r"(?i)\b(disadvantages?|drawbacks?|cons?|downsides?|weakness(?:es)?|limitations?|risks?|harder|isolation|waste|expensive|cost(?:ly)?|difficult|challenges?|blurred|accidents?|however|but)\b"
)
CON_MARK = (
    r"(?i)^(?:however|but|unfortunately|on the (?:other hand|downside|flip side)|in contrast|the (?:main |major )?(?:drawbacks?|downsides?|disadvantages?|cons|limitations?|challenges?) (?:is|are)|"
    r"(?:drawbacks?|downsides?|disadvantages?|cons)\b)"
)
TWO_SIDED = r"(?i)advantage|disadvantage|benefit|drawback|downside|upside|\bpros?\b|\bcons?\b|strengths?|weakness|trade-?off|merits?"
ONE_SIDED, OTHER_SIDE = r"(?i)\b(?:disadvantages?|limitations?|challenges?|drawbacks?|demerits?)\b", r"(?i)(?:^|[^s])\badvantages?\b|\bbenefits?\b|\bmerits?\b|\bpros\b"
AXES, QUADRANT = r"(?i)\b(axes|axis|matrix|quadrant|2\s?x\s?2)\b", r"(?i)^(.*?\b(?:and|but|not|neither)\b.*?)\s+(?:tasks|items|things|ideas|projects|cases)?\s*(?:are|is|should be)\s+(.+?)\.?$"
BOTH, ONLY = r"(?i)\b(both|shared|in common|overlap)\b", r"(?i)\bonly\b"
DEFINES = (
    r"(?i)\b(is defined as|refers to|is a measure of|is a term|is known as|means|denotes|is the (?:process|study|science|ability|measure|degree)(?: of| by which)|"
    r"is a (?:type|kind|form|method|technique|set|branch|subfield|field|process|general))\b"
)
LAW = r"(?i)\b(law|theorem|principle|rule|equation|formula|postulate|axiom|identity|inequality)\b"
ASKS_MEANING = r"(?i)^\s*(?:what (?:is|are)|definition of|defining|meaning of|understanding)\b|\bdefined\b|\bdefinition\b"
EQUALS = r"\b([A-Z][a-z]+(?: [a-z]+)?)\s+equals\s+([a-z]+(?: [a-z]+)?)\s+(times|plus|minus|divided by|over)\s+([a-z]+(?: [a-z]+)?)"
SQUARES = r"(?i)\b([a-z]+(?: [a-z]+)?)\s+squared plus\s+([a-z]+(?: [a-z]+)?)\s+squared equals\s+([a-z]+(?: [a-z]+)?)\s+squared"
FORMULA = r"\b((?:[A-Z]|[A-Za-z]{1,3})\s*=\s*[^.;\n]{2,60})"
LEVEL = r"(?i)\b(layers?|levels?|tiers?|stages? of|base|foundation|beneath|below|above|top|apex|outer|inner|deepest|hierarch\w+)\b"
IN_PERIOD = rf"(?i)({P.FIGURE.removeprefix('(?i)')})\s*(?:[A-Za-z]+\s+){{0,2}}in\s+((?:Q[1-4](?:\s+\d{{4}})?)|(?:{MONTH}(?:\s+\d{{4}})?)|(?:19|20)\d{{2}})"
FUNNEL_TITLE = r"(?i)funnel|pipeline|conversion|stages|admission|hiring|recruit|sales"
IMPERATIVE = (
    r"(?i)^(?:review|use|teach|practice|sleep|keep|avoid|make|ensure|check|always|never|try|start|stop|write|read|set|plan|build|test|drink|eat|take|run|add|remove|define|choose|ask|learn|focus)\b"
)
LINKS = "|".join(words for _, words in P.CUES)
LINKED = rf"(?i)^.{{0,14}}\b(?:{LINKS})\b|^(?:this|these|those|such|it|they|its|their|that is|in other words|specifically|more precisely)\b|\b(?:whereas|while|unlike|however|because|due to|therefore|thus|hence|so that|for example|for instance|such as|e\.g\.|in order to|so as to|although|though|despite)\b"

#: One of these is in every match of STEP_CUE, and of CAUSE or STRONG_CAUSE.
STEP_WORDS = ("step", "first", "second", "third", "next", "then", "finally", "lastly", "after that", "stage", "phase")
CAUSE_WORDS = (
    "lead", "cause", "result", "therefore", "thus", "which in turn", "push", "raise", "drive", "trigger", "so that", "consequently", "due to", "reduce", "increase", "break", "turn", "then",
)

ITEMS = "array<struct<head:string,body:string>>"


def sentence_columns(slides: DataFrame) -> DataFrame:
    """``slides`` (id, title, text) with ``prose`` (lines that aren't piped), ``sents`` (distinct sentences of it that say something new), ``n`` and ``blob``."""
    prose = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.startswith(P.ends(x), F.lit("|")) & (P.ends(x) != "[TABLE DATA]")), "\n")
    rows = P.with_sentences(slides.select("id", "title", "text", prose.alias("prose")), "prose", "first")
    rows = rows.withColumn("sents", unlike_sentences(F.col("first"))).drop("first")
    title = F.when(F.col("title") == "", "Key idea").otherwise(F.col("title"))
    rows = rows.withColumn("sents", F.when(F.size("sents") == 0, F.array(title)).otherwise(F.col("sents")))
    rows = rows.withColumns({"n": F.size("sents"), "blob": F.array_join("sents", " ")})
    return rows.withColumns({"low": F.lower("blob"), "digit": F.col("blob").rlike(r"\d")})


def detection(ok: Column, family: str | Column, variant: str | Column, confidence: float | Column, items: Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(ok, named(family=as_column(family), variant=as_column(variant), confidence=as_column(confidence).cast("double"), items=items.cast(ITEMS)))


def items_of(sents: Column, most: int, head=None) -> Column:
    """The first sentences as items: a short label and the sentence without lead words."""
    label = head or (lambda s: P.short_label(s, 5))
    return F.transform(F.slice(sents, 1, most), lambda s: named(head=label(s), body=P.strip_end(F.regexp_replace(s, P.LEAD_CUE, ""))))


def counted(sents: Column, pattern: str) -> Column:
    return F.size(F.filter(sents, lambda s: s.rlike(pattern)))


def of_words(sents: Column, least: int) -> Column:
    return F.filter(sents, lambda s: F.size(P.blanks(s)) >= least)


def without_lead(s: Column) -> Column:
    return F.regexp_replace(s, P.LEAD_CUE, "")


def table() -> Column:
    def of(cells: Column) -> Column:
        rows = F.filter(F.slice(cells, 2, 1 << 20), lambda r: F.exists(r, lambda c: c != ""))
        return detection(F.size(rows) >= 1, "COMPARE_TABLE", "table", 0.95, F.transform(F.slice(rows, 1, 8), lambda r: named(head=F.get(r, F.lit(0)), body=F.array_join(F.slice(r, 2, 1 << 20), " | "))))

    return F.when(F.contains("text", F.lit("|")), let(pipe_table(F.col("text")), lambda c: F.when(c.isNotNull(), of(c))))


def sections() -> Column:
    chunks = F.slice(F.split("text", r"(?m)^###\s+"), 2, 1 << 20)
    made = F.transform(chunks, lambda c: named(head=P.ends(F.element_at(F.split(c, "\n", 2), 1)), body=P.ends(F.coalesce(F.get(F.split(c, "\n", 2), F.lit(1)), F.lit("")))))
    found = let(F.filter(made, lambda s: (s["head"] != "") & s["body"].rlike("[A-Za-z0-9]")), lambda s: detection(F.size(s) >= 2, "SECTIONS", "columns", 0.9, F.slice(s, 1, 3)))
    return F.when(F.contains("text", F.lit("###")), found)


def references() -> Column:
    lines = F.filter(F.transform(F.split("prose", r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    single = F.filter(F.transform(F.split(F.get(lines, F.lit(0)), r"(?<=\d{4})\.\s+(?=[A-Z])|(?<=\.)\s+(?=\d+\.\s)"), P.ends), lambda x: x != "")

    def of(found: Column) -> Column:
        cites = F.size(F.filter(found, P.is_citation))
        ok = (F.size(found) > 0) & ((F.col("title").rlike(REFERENCE_TITLE) & (cites >= 1)) | (cites >= F.greatest(F.lit(3), F.floor(F.size(found) * 0.6))))
        return detection(ok, "REFERENCES", "list", 0.93, F.transform(F.slice(found, 1, 12), lambda x: named(head=F.lit(""), body=P.strip_end(x))))

    # a line without a digit stays one, and without such a title it takes three
    several = F.contains("prose", F.lit("\n")) | F.col("prose").rlike(r"\d")
    return F.when(several | F.col("title").rlike(REFERENCE_TITLE), let(F.when(F.size(lines) == 1, single).otherwise(lines), of))


def series() -> Column:
    groups = [F.regexp_extract_all("text", F.lit(LOG_LINE), F.lit(k)).alias(n) for k, n in ((2, "s"), (4, "v"), (1, "x"))]
    points = F.array_sort(F.transform(F.arrays_zip(*groups), lambda p: named(s=p["s"].cast("int"), v=p["v"].try_cast("double"), x=p["x"])))

    def of(p: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.size(p) / 9)).cast("int")
        every = F.filter(p, lambda _, i: i % step == 0)
        kept = F.concat(F.slice(every, 1, 9), F.when(F.element_at(every, -1) != F.element_at(p, -1), F.array(F.element_at(p, -1))).otherwise(F.slice(p, F.lit(1), F.lit(0))))
        return detection(F.size(p) >= 4, "CHART_TREND", "line", 0.95, F.transform(kept, lambda q: named(head=F.concat(F.initcap(q["x"]), F.lit(" "), q["s"].cast("string")), body=F.bround(q["v"], 4).cast("string"))))

    return F.when(F.col("text").rlike(r"\d"), let(points, lambda p: F.when(F.size(p) > 0, of(p))))


def questions() -> Column:
    text = F.trim(F.regexp_replace("text", r"\s+", " "))

    def of(t: Column) -> Column:
        asked, gaps = F.regexp_extract_all(t, F.lit(QUESTION), F.lit(1)), F.split(t, QUESTION)
        pairs = F.transform(asked, lambda q, i: named(head=F.trim(F.regexp_replace(q, r"^Q\s*\d*[.:)]\s*", "")), body=P.ends(F.regexp_replace(F.coalesce(F.get(gaps, i + 1), F.lit("")), r"(?i)^\s*(?:ans(?:wer)?\s*[:.\-]\s*)", ""))))
        good = F.filter(pairs, lambda p: F.size(P.blanks(p["body"])).between(3, 70) & F.size(P.blanks(p["head"])).between(3, 25))
        return let(good, lambda g: detection(F.size(g) >= 2, "LIST_STRUCTURED", "qa", 0.92, F.slice(g, 1, 6)))

    return F.when(F.contains("text", F.lit("?")), let(text, of))


def algorithm() -> Column:
    """Markup, pseudocode or a run of equations, kept whole line by line."""
    raw = F.filter(F.split("text", "\n"), lambda x: (P.ends(x) != "") & ~F.startswith(P.ends(x), F.lit("|")) & (P.ends(x) != "[TABLE DATA]"))
    lines = F.transform(raw, lambda x: P.ends(F.regexp_replace(x, r"^\s*(?:[-*•▪◦]\s+|\d+[.)]\s+)", "")))
    lines = F.filter(lines, lambda x: ((F.length(x) > 3) | F.contains(x, F.lit("="))) & (x.rlike("[A-Za-z]") | F.contains(x, F.lit("="))))

    def of(ls: Column) -> Column:
        n = F.size(ls)
        markup = counted(ls, MARKUP)
        prose = lambda x: x.rlike(r"[.!]$") & (F.size(P.blanks(x)) >= 7) & ~x.rlike(r":=|←|==|[\[\]{}]|\w\(.*\)\s*$")
        code = F.size(F.filter(ls, lambda x: x.rlike(CODE_LINE) & ~prose(x)))
        is_eq = lambda x: x.rlike(EQUATION_LINE) & ~x.rlike("</?[A-Za-z]") & (F.regexp_count(x, F.lit(MATHS_SIGN)) >= 2) & (F.size(P.blanks(x)) <= 14)
        eqs = F.filter(ls, is_eq)
        titled = F.col("title").rlike(ALGORITHM_TITLE)
        shown = lambda items, most: F.transform(F.slice(items, 1, most), lambda x: named(head=F.lit(""), body=x))
        return F.when(
            n >= 3,
            F.coalesce(
                detection((markup >= 2) & (markup >= 0.5 * n), "ALGORITHM", "code", 0.9, shown(ls, 18)),
                detection((code >= 3) & ((code >= 0.5 * n) | (titled & (code >= 0.34 * n))), "ALGORITHM", "code", F.when(titled, 0.93).otherwise(0.88), shown(ls, 18)),
                detection((F.size(eqs) >= 3) & (F.size(eqs) >= 0.6 * n), "ALGORITHM", "math", 0.9, shown(eqs, 10)),
            ),
        )

    keyed = F.transform(lines, lambda x: named(k=F.regexp_replace(F.lower(x), r"\W+", ""), x=x))
    distinct = let(keyed, lambda ks: F.transform(F.filter(ks, lambda s, i: (s["k"] != "") & ~F.exists(F.slice(ks, F.lit(1), i), lambda o: o["k"] == s["k"])), lambda s: s["x"]))
    return F.when(F.size(F.split("text", "\n")) >= 3, let(distinct, of))


def function_plot() -> Column:
    expr = F.trim(F.regexp_extract("blob", GRAPH_TEXT, 1))
    return detection(F.contains("blob", F.lit("=")) & F.contains(expr, F.lit("x")) & F.col("blob").rlike(GRAPH_WORD), "FUNCTION_PLOT", "curve", 0.88, F.array(named(head=F.lit("y"), body=F.regexp_replace(expr, " ", ""))))


def worked() -> Column:
    steps = F.filter("sents", lambda s: s.rlike(MATHS_VERB) & s.rlike(EXPRESSION))

    def row(s: Column) -> Column:
        parts = F.split(s, ":", 2)
        return F.when(F.size(parts) == 2, named(head=P.strip_end(F.element_at(parts, 1)), body=P.strip_end(F.element_at(parts, 2)))).otherwise(named(head=F.lit(""), body=P.strip_end(s)))

    return F.when(F.col("n") >= 3, let(steps, lambda st: detection(F.size(st) >= 3, "WORKED_EXAMPLE", "steps", 0.9, F.transform(F.slice(st, 2, 10), row))))


def labelled() -> Column:
    lines = F.filter(F.transform(F.split("prose", r"\n|(?<=[.!?])\s+"), P.ends), lambda x: x.rlike(LABELLED))
    pairs = F.transform(lines, lambda x: named(k=F.concat(F.lower(F.regexp_extract(x, LABELLED, 1)), F.lit("|"), F.substring(F.regexp_replace(F.lower(F.regexp_extract(x, LABELLED, 2)), r"\W+", ""), 1, 60)), head=P.cap(F.regexp_extract(x, LABELLED, 1)), body=P.strip_end(F.regexp_extract(x, LABELLED, 2))))
    distinct = let(pairs, lambda ps: F.transform(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda o: o["k"] == p["k"])), lambda p: named(head=p["head"], body=p["body"])))
    sided = lambda d: F.coalesce(F.get(d, F.lit(0))["head"].rlike("(?i)^(advantages?|disadvantages?|pros?|cons?)$"), F.lit(False))
    return F.when(F.contains("prose", F.lit(":")), let(distinct, lambda d: detection((F.size(d) >= 3) & ~sided(d), "LIST_STRUCTURED", "cards", 0.86, F.slice(d, 1, 6))))


def equation() -> Column:
    hits = F.filter("sents", lambda s: F.contains(F.regexp_extract(s, REACTION, 1), F.lit("+")))
    arrow = F.contains("blob", F.lit("+")) & P.has_any(F.col("blob"), (">", "→", "⇌"))
    return F.when(arrow, let(hits, lambda h: detection(F.size(h) >= 1, "FORMULA_CALLOUT", "card", 0.9, F.array(named(head=F.col("title"), body=P.pretty_equation(F.regexp_extract(F.get(h, F.lit(0)), REACTION, 1)))))))


def glossary() -> Column:
    said = F.filter(F.transform("sents", P.strip_end), lambda s: s.rlike(MEANING))
    pairs = lambda found: F.filter(F.transform(found, lambda s: named(head=F.trim(F.regexp_extract(s, MEANING, 1)), body=P.strip_end(F.regexp_extract(s, MEANING, 2)))), lambda p: (p["head"] != "") & (F.size(P.blanks(p["head"])) <= 5))

    def of(p: Column) -> Column:
        ok = (F.size(p) >= 3) & (F.size(p) >= 0.75 * F.col("n")) & (counted(F.col("sents"), r"\d") < 2) & (F.col("title").rlike(GLOSSARY_TITLE) | (F.size(p) >= 4))
        return detection(ok, "LIST_STRUCTURED", "cards", 0.9, F.transform(F.slice(p, 1, 8), lambda q: named(head=P.cap(q["head"]), body=P.cap(q["body"]))))

    # each test that a pair has to pass is asked of the sentences first
    enough = lambda found: (F.size(found) >= 3) & (F.size(found) >= 0.75 * F.col("n"))
    return F.when((F.col("n") >= 4) | ((F.col("n") >= 3) & F.col("title").rlike(GLOSSARY_TITLE)), let(said, lambda found: F.when(enough(found), let(pairs(found), of))))


def agenda() -> Column:
    items = F.transform("sents", lambda s: F.regexp_replace(P.strip_end(s), r"^[➔→•\-\s]+", ""))
    parts = F.filter(F.transform(F.split(F.get(items, F.lit(0)), r"\s*[➔→>]+\s*|\s*;\s*"), lambda p: F.regexp_replace(p, r"^[ .;,]+|[ .;,]+$", "")), lambda p: p != "")
    several = F.when((F.size(items) == 1) & (F.size(parts) >= 3), parts).otherwise(items)
    found = let(several, lambda it: detection(F.size(it).between(3, 12), "PROCESS_LINEAR", "agenda", 0.92, F.transform(F.slice(it, 1, 10), lambda i: named(head=P.cap(F.substring(i, 1, 48)), body=F.lit("")))))
    return F.when(F.col("title").rlike(AGENDA_TITLE), found)


def compare() -> Column:
    halves = F.split(F.trim("title"), VERSUS, 2)
    from_title = F.when(F.size(halves) == 2, named(a=F.get(P.blanks(F.element_at(halves, 1)), F.lit(0)), b=F.get(P.blanks(F.element_at(halves, 2)), F.lit(0))))
    from_text = F.when(P.has_any(F.col("blob"), ("vs", "versus")) & F.col("blob").rlike(NAMED_VERSUS), named(a=F.regexp_extract("blob", NAMED_VERSUS, 1), b=F.regexp_extract("blob", NAMED_VERSUS, 2)))

    def of(s: Column) -> Column:
        word = lambda w: F.concat(F.lit(r"(?i)(?<![\w-])\Q"), w, F.lit(r"\E(?![\w-])"))
        has = lambda x, w: F.call_function("rlike", x, word(w))
        left, right = F.filter("sents", lambda x: has(x, s["a"])), F.filter("sents", lambda x: has(x, s["b"]))
        rows = F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda z: named(head=P.strip_end(F.coalesce(z["l"], F.lit(""))), body=P.strip_end(F.coalesce(z["r"], F.lit("")))))
        return detection(F.least(F.size(left), F.size(right)) >= 2, "COMPARE_TABLE", "comparison", 0.88, F.slice(rows, 1, 7))

    found = let(F.coalesce(from_title, from_text), lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull() & (s["a"] != "") & (s["b"] != ""), of(s)))
    return F.when(F.col("n") >= 2, found)


def parallel() -> Column:
    said = F.filter(F.transform("sents", P.strip_end), lambda s: s.rlike(PARALLEL))
    items = lambda found: F.filter(F.transform(found, lambda s: named(head=F.trim(F.regexp_extract(s, PARALLEL, 1)), body=F.trim(F.regexp_extract(s, PARALLEL, 2)))), lambda p: p["head"] != "")

    def of(it: Column) -> Column:
        names = F.transform(it, lambda p: F.lower(p["head"]))
        firsts, lasts = F.transform(names, lambda x: F.element_at(P.blanks(x), 1)), F.transform(names, lambda x: F.element_at(P.blanks(x), -1))
        alike = lambda ws: F.exists(ws, lambda w: F.size(F.filter(ws, lambda o: o == w)) >= 3)
        ok = (F.size(it) >= 3) & (F.size(it) >= 0.6 * F.col("n")) & (F.size(F.array_distinct(names)) == F.size(names)) & (alike(firsts) | alike(lasts))
        holds = lambda p: F.size(F.filter(it, lambda q: q["body"].rlike(p))) >= 2
        best = r"(?i)\b(?:used for|used in|suits?|suited (?:to|for)|best for|ideal for|good for|useful for)\s+(.+?)(?:[.;,]|$)|\bis\s+((?:usually|generally|often|typically)\s+(?:the\s+)?(?:fastest|best|slowest|cheapest|simplest)[^.;,]*)"
        columns = sum((holds(p).cast("int") for p in (r"O\([^)]*\)", r"(?i)\b(not stable|unstable|stable)\b", best)), F.lit(0))
        return detection(ok, "COMPARE_TABLE", "comparison", F.when(columns >= 2, 0.9).otherwise(0.82), F.transform(it, lambda p: named(head=P.cap(p["head"]), body=P.cap(F.array_join(F.slice(P.blanks(p["body"]), 1, 16), " ")))))

    enough = lambda found: (F.size(found) >= 3) & (F.size(found) >= 0.6 * F.col("n"))
    return F.when(F.col("n") >= 3, let(said, lambda found: F.when(enough(found), let(items(found), of))))


def pros_cons() -> Column:
    """Two sides of a thing: from a sentence that turns to the other side on, or by the words of each sentence, with the side carried on."""
    said = F.concat_ws(" ", "title", "blob").rlike(TWO_SIDED)
    one_sided = F.col("title").rlike(ONE_SIDED) & ~F.col("title").rlike(OTHER_SIDE)
    turn = F.array_position(F.transform("sents", lambda s, i: (i > 0) & P.ends(s).rlike(CON_MARK)), F.lit(True)).cast("int")

    def side(acc: Column, s: Column) -> Column:
        pro, con = s.rlike(PRO), s.rlike(CON)
        turned = s.rlike(r"(?i)^(?:however|but|on the other hand|in contrast)\b|disadvantage|drawback|downside|\bcons?\b")
        mode = F.when(turned, "con").when(s.rlike(r"(?i)advantage|benefit|\bpros?\b|upside"), "pro").otherwise(acc["mode"])
        own = F.when(con & ~pro, "con").when(pro & ~con, "pro").otherwise(mode)
        return named(mode=mode, sides=F.concat(acc["sides"], F.array(own)))

    start = named(mode=F.lit("pro"), sides=F.array().cast("array<string>"))
    by_words = F.aggregate("sents", start, side, lambda s: s["sides"])
    enough = (counted(F.col("sents"), PRO) >= 1) & (counted(F.col("sents"), CON) >= 2)
    by_turn = F.transform("sents", lambda s, i: F.when(i + 1 < turn, "pro").otherwise("con"))

    def of(sides: Column) -> Column:
        pros, cons = F.size(F.filter(sides, lambda x: x == "pro")), F.size(F.filter(sides, lambda x: x == "con"))
        items = F.zip_with(F.col("sents"), sides, lambda s, x: named(head=x, body=P.cap(P.strip_end(without_lead(s)))))
        return detection((pros >= 1) & (cons >= 1), "COMPARE_VISUAL", "pros_cons", 0.84, items)

    found = let(F.when(turn > 0, by_turn).when(enough, by_words), lambda x: F.when(x.isNotNull(), of(x)))
    return F.when((F.col("n") >= 3) & said & ~one_sided, found)


def matrix() -> Column:
    quads = F.filter("sents", lambda s: s.rlike(QUADRANT) & ~s.rlike("(?i)axes|axis"))
    return F.when((F.col("n") >= 3) & F.concat("blob", "title").rlike(AXES), let(quads, lambda q: detection(F.size(q) >= 3, "MATRIX_GRID", "quadrant_2x2", 0.93, F.transform(F.slice(q, 1, 4), lambda s: named(head=P.cap(F.regexp_extract(s, QUADRANT, 1)), body=P.cap(P.strip_end(F.regexp_extract(s, QUADRANT, 2))))))))


def timeline() -> Column:
    cited = F.size(F.filter("sents", P.is_citation))
    events = F.filter("sents", lambda s: s.rlike(DATE) & ~P.is_citation(s) & (F.length(F.regexp_replace(F.regexp_replace(s, DATE, ""), "[^A-Za-z]", "")) >= 4))
    ok = cited < F.greatest(F.lit(2), F.floor(F.col("n") / 2))
    found = let(events, lambda e: detection((F.size(e) >= 3) & ok, "TIMELINE", "dated", 0.9, F.transform(F.slice(e, 1, 8), lambda s: named(head=F.regexp_extract(s, DATE, 0), body=P.cap(P.strip_end(F.regexp_replace(s, DATE, "")))))))
    return F.when((F.col("n") >= 3) & F.col("digit"), found)


def subject(s: Column) -> Column:
    """What stands before a sentence's first common verb."""
    head = P.before(without_lead(s), P.VERBISH)
    return P.cap(F.substring(F.regexp_replace(F.regexp_replace(P.ends(head), r"(?i)^(?:the|a|an)\s+", ""), r"^[ ,;]+|[ ,;]+$", ""), 1, 40))


def chart() -> Column:
    # what needs a figure looks at the sentences that have a digit
    digits = F.filter("sents", lambda s: s.rlike(r"\d"))
    listed = F.filter(F.transform(digits, P.listed_pairs), lambda p: F.size(p) > 0)
    periods = F.transform(F.arrays_zip(F.regexp_extract_all("blob", F.lit(IN_PERIOD), F.lit(1)).alias("v"), F.regexp_extract_all("blob", F.lit(IN_PERIOD), F.lit(2)).alias("x")), lambda p: named(head=F.trim(p["x"]), body=P.figure_value(p["v"]).cast("string")))
    shares = F.transform(F.filter("sents", lambda s: s.rlike(SHARE)), lambda s: named(label=subject(s), value=F.regexp_extract(s, SHARE, 1).cast("double")))
    ones = F.filter(F.transform(digits, lambda s: let(P.figures(s), lambda f: F.when(F.size(f) == 1, named(label=subject(s), value=P.figure_value(F.get(f, F.lit(0))), unit=P.unit_of(F.get(f, F.lit(0))))))), lambda p: p.isNotNull() & (p["label"] != "") & p["value"].isNotNull() & (F.size(P.blanks(p["label"])) <= 4))
    total = lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["value"])
    shown = lambda ps: F.transform(F.slice(ps, 1, 8), lambda p: named(head=p["label"], body=p["value"].cast("string")))

    def first(ps: Column) -> Column:
        same = F.size(F.array_distinct(F.transform(ps, lambda p: p["unit"]))) == 1
        whole = same & (F.get(ps, F.lit(0))["unit"] == "pct") & total(ps).between(95.0, 105.0)
        return F.coalesce(detection(whole, "CHART_PART_TO_WHOLE", "pie", 0.9, shown(ps)), detection(same, "CHART_CATEGORICAL", "bar", 0.86, shown(ps)))

    def alone(ps: Column) -> Column:
        labels, units = F.transform(ps, lambda p: p["label"]), F.transform(ps, lambda p: p["unit"])
        ok = (F.size(ps) >= 3) & (F.size(F.array_distinct(labels)) == F.size(ps)) & (F.size(F.array_distinct(units)) == 1)
        return detection(ok, "CHART_CATEGORICAL", "bar", 0.84, shown(ps))

    found = F.coalesce(
        let(listed, lambda l: F.when(F.size(l) > 0, first(F.get(l, F.lit(0))))),  # noqa: E741
        let(shares, lambda ps: detection((F.size(ps) >= 3) & total(ps).between(95.0, 105.0), "CHART_PART_TO_WHOLE", "pie", 0.9, shown(ps))),
        let(periods, lambda ps: detection(F.size(ps) >= 3, "CHART_TREND", "line", 0.88, F.slice(ps, 1, 10))),
        let(ones, alone),
    )
    return F.when(F.col("digit"), found)


def funnel() -> Column:
    values = F.filter(F.flatten(F.transform("sents", lambda s: F.transform(F.filter(F.transform(P.figures(s), lambda f: F.regexp_replace(f, "[,. ]+$", "")), lambda f: ~f.rlike(P.YEAR)), lambda f: named(head=P.short_label(F.replace(s, f, F.lit("")), 5), v=P.figure_value(f))))), lambda p: p["v"].isNotNull())

    def of(v: Column) -> Column:
        falls = F.forall(F.sequence(F.lit(1), F.size(v)), lambda i: (i == 1) | (F.element_at(v, F.greatest(i - 1, F.lit(1)))["v"] >= F.element_at(v, i)["v"]))
        top, end = F.element_at(v, 1)["v"], F.element_at(v, -1)["v"]
        steep = (top > end * 4) | (F.col("title").rlike(FUNNEL_TITLE) & (top > end * 1.5))
        return detection(falls & steep, "FUNNEL", "funnel", 0.86, F.transform(F.slice(v, 1, 6), lambda p: named(head=p["head"], body=P.short_number(p["v"]))))

    return F.when(F.col("digit"), let(values, lambda v: F.when(F.size(v) >= 3, of(v))))


def venn() -> Column:
    return detection((F.col("n") >= 3) & F.contains("low", F.lit("only")) & F.col("blob").rlike(ONLY) & F.col("blob").rlike(BOTH), "SET_DIAGRAM", "venn2", 0.84, F.transform(F.slice("sents", 1, 8), lambda s: named(head=F.lit(""), body=P.strip_end(s))))


def formula_of(text: Column) -> Column:
    """A formula as it is written, or put in words; empty if there is none."""
    written = P.strip_end(F.element_at(F.split(F.regexp_extract(text, FORMULA, 1), r"\s+(?:gives|is|are|where|which|and|so|for|when|represents?|denotes?|means|that|if)\b|,\s", 2), 1))
    a, b, word, c = (F.regexp_extract(text, EQUALS, k) for k in range(1, 5))
    sign = F.when(word == "times", "×").when(word == "plus", "+").when(word == "minus", "−").otherwise("÷")
    x, y, z = (F.regexp_extract(text, SQUARES, k) for k in range(1, 4))
    squares = F.concat(x, F.lit("² + "), y, F.lit("² = "), z, F.lit("²"))
    said = F.when(text.rlike(EQUALS), F.concat(a, F.lit(" = "), b, F.lit(" "), sign, F.lit(" "), c)).when(text.rlike(SQUARES), squares).otherwise("")
    return let(written, lambda w: F.when(w != "", w).otherwise(said))


def definition() -> Column:
    first = F.get("sents", F.lit(0))
    formula = F.when(P.has_any(F.col("low"), ("=", "equals")), formula_of(F.col("blob"))).otherwise("")
    law = F.col("title").rlike(LAW)
    asks = F.col("title").rlike(ASKS_MEANING) & first.rlike(r"(?i)\b(is|are|refers?|means)\b")
    means = (first.rlike(DEFINES) | asks) & (F.col("n") <= 4)
    term = P.before(F.regexp_replace(P.strip_end(first), r"(?i)^(?:A|An|The)\s+", ""), r"(?i)\s+(?:is defined as|refers to|is a measure of|is known as|means|denotes|is)\s+")
    item = lambda head, body: F.array(named(head=head, body=body))
    return F.coalesce(
        detection((means | (F.col("n") <= 5)) & (formula != ""), "FORMULA_CALLOUT", "card", 0.86, item(P.cap(term), formula)),
        detection(means, "DEFINITION", "term", 0.85, item(P.cap(term), P.strip_end(first))),
        detection(law & (F.col("n") <= 3), "QUOTE", "statement", 0.78, item(F.col("title"), P.strip_end(first))),
    )


def layers() -> Column:
    lead = r"^(?:The|A|An)?\s*([A-Za-z\-]+(?: [A-Za-z\-]+)?)\s+(?:is|are|was|were|form|forms|has|have|come|comes|include|includes)\b"
    entity = lambda s: F.when(s.rlike(lead), P.cap(F.regexp_extract(s, lead, 1))).otherwise(P.short_label(s, 3))
    body = F.when(F.col("n") > 3, F.slice("sents", 2, 1 << 20)).otherwise(F.col("sents"))
    picked = let(of_words(body, 4), lambda b: F.when(F.size(b) >= 3, b).otherwise(of_words(F.col("sents"), 4)))
    pairs = F.transform(F.slice(picked, 1, 6), lambda s: let(entity(s), lambda e: named(k=F.lower(e), head=e, body=P.strip_end(s))))
    distinct = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda o: o["k"] == p["k"])))
    found = let(distinct, lambda d: detection(F.size(d) >= 3, "LAYERS", "stack", 0.84, F.transform(d, lambda p: named(head=p["head"], body=p["body"]))))
    return F.when((F.col("n") >= 3) & (F.regexp_count(F.concat_ws(" ", "blob", "title"), F.lit(LEVEL)) >= 2), found)


def cycle() -> Column:
    said = F.col("title").rlike(r"(?i)\b(cycle|loop)\b") | F.concat_ws(" ", "blob", "title").rlike(CYCLE)
    first = F.get("sents", F.lit(0))
    listed = F.filter(P.parts(F.regexp_extract(first, r"([A-Za-z][^.]*?(?:,\s*[^,.]+){2,}(?:,?\s*and\s+[^.]+)?)\.", 1), r",\s*(?:and\s+)?|\s+and\s+"), lambda p: F.size(P.blanks(p)) >= 2)
    whole = of_words(F.col("sents"), 3)
    items = F.when((F.size(whole) < 3) & F.size(listed).between(3, 6), listed).otherwise(whole)
    return F.when(said, let(items, lambda it: detection(F.size(it) >= 3, "PROCESS_CYCLIC", "cycle", 0.8, items_of(it, 6, lambda s: P.short_label(s, 4)))))


def flowchart() -> Column:
    steps = F.slice(of_words(F.col("sents"), 2), 1, 9)

    def of(st: Column) -> Column:
        asks = F.exists(st, lambda x: x.rlike(r"\?\s*$") & without_lead(x).rlike(WH))
        cued = F.filter(st, lambda x: x.rlike(STEP_CUE) | x.rlike(P.LEAD_CUE))
        decisions = F.filter(st, lambda x: without_lead(x).rlike(DECIDE) & without_lead(x).rlike(BRANCH))
        procedure = F.col("title").rlike(PROCEDURE)
        moves = procedure | (F.size(cued) >= 1) | F.array_join(st, " ").rlike(LOOP_BACK)
        ok = (F.size(st) >= 3) & (procedure | (F.size(cued) >= 2)) & ~asks & (F.size(decisions) >= 1) & (F.size(decisions) <= F.floor(F.size(st) / 2) + 1) & moves
        is_decision = lambda x: without_lead(x).rlike(DECIDE) & without_lead(x).rlike(BRANCH)
        return detection(ok, "FLOWCHART", "decision", 0.9, F.transform(st, lambda x: named(head=F.when(is_decision(x), "decision").otherwise("process"), body=P.cap(P.strip_end(without_lead(x))))))

    return F.when(F.col("n") >= 3, let(steps, of))


def process() -> Column:
    cued = F.when(P.has_any(F.col("low"), STEP_WORDS), counted(F.col("sents"), STEP_CUE)).otherwise(0)
    starts = counted(F.col("sents"), P.LEAD_CUE)
    body = of_words(F.col("sents"), 3)
    sparse = F.exists("sents", lambda s: s.rlike(r"(?i)^(?:finally|lastly|in the end)\b")) & (cued >= 2) & (F.size(body) >= 4)
    steps = F.when((cued >= 3) & ~sparse, F.filter(body, lambda s: s.rlike(STEP_CUE) | s.rlike(P.LEAD_CUE))).otherwise(body)
    loop = F.col("title").rlike(r"(?i)\b(cycle|loop)\b") | F.col("blob").rlike(REPEATS)
    confidence = F.bround(0.82 + F.least(cued, F.lit(5)) * 0.02, 6)
    ok = ((cued >= 3) | (starts >= 3) | sparse) & (F.size(body) >= 3)
    return F.when((F.col("n") >= 3) & ok, let(steps, lambda st: detection(F.size(st) >= 3, F.when(loop, "PROCESS_CYCLIC").otherwise("PROCESS_LINEAR"), F.when(loop, "cycle").otherwise("flowchart"), confidence, items_of(st, 8, lambda s: P.short_label(s, 5, True)))))


def process_implicit() -> Column:
    body = of_words(F.col("sents"), 3)
    mean = F.aggregate(F.transform(body, lambda s: F.size(P.blanks(s))), F.lit(0), lambda a, x: a + x) / F.greatest(F.size(body), F.lit(1))
    return F.when((F.col("n") >= 4) & F.col("title").rlike(PROCEDURE), let(body, lambda b: detection(F.size(b).between(4, 8) & (mean <= 20), "PROCESS_LINEAR", "flowchart", 0.7, items_of(b, 8, lambda s: P.short_label(s, 5, True)))))


def cause_effect() -> Column:
    said = (counted(F.col("sents"), CAUSE) >= 2) | (counted(F.col("sents"), STRONG_CAUSE) >= 1)
    ok = F.col("n").between(3, 7) & P.has_any(F.col("low"), CAUSE_WORDS) & said
    return detection(ok, "CAUSE_EFFECT", F.when(F.col("blob").rlike(LOOP), "loop").otherwise("chain"), 0.76, items_of(F.col("sents"), 6))


def stats() -> Column:
    """Headline figures with the sentence around them as their label."""
    equations = F.exists("sents", lambda s: s.rlike(r"[A-Za-z0-9)]\s*=\s*[A-Za-z0-9(]"))
    has_digit = lambda s: s.rlike(r"\d")
    fit = F.filter("sents", lambda s: (~has_digit(s) | (F.size(P.figures(s)) <= 3)) & ~F.contains(s, F.lit("|")))

    def of(ss: Column) -> Column:
        tiles = F.flatten(F.transform(F.filter(ss, has_digit), lambda s: F.transform(F.slice(P.figures(s), 1, 2), lambda f: named(head=P.pretty_value(f), body=P.short_label(F.replace(s, f, F.lit(" ")), 6)))))
        distinct = let(tiles, lambda ts: F.filter(ts, lambda t, i: ~F.exists(F.slice(ts, F.lit(1), i), lambda o: o["head"] == t["head"])))
        words = F.size(P.blanks(F.array_join(ss, " ")))
        with_one = F.size(F.filter(ss, lambda s: has_digit(s) & (F.size(P.figures(s)) > 0)))
        passing = (with_one / F.greatest(F.size(ss), F.lit(1)) < F.when(words >= 45, 0.6).otherwise(0.5)) & (words >= 30)
        enough = lambda d: (F.size(d) >= 3) | ((F.size(d) >= 2) & (words < 60)) | ((F.size(d) >= 1) & (words < 30))
        return let(distinct, lambda d: detection(~passing & enough(d), "STAT_TILES", "tiles", F.when(F.size(d) >= 3, 0.8).otherwise(0.74), F.slice(d, 1, 4)))

    return F.when(F.col("digit") & ~equations, let(fit, lambda ss: F.when(F.size(ss) > 0, of(ss))))


def base() -> Column:
    """What is drawn where nothing else fits: a checklist, connected prose, or cards."""
    src = of_words(F.col("sents"), 2)

    def of(ss: Column) -> Column:
        orders = F.size(F.filter(ss, lambda s: P.ends(s).rlike(IMPERATIVE)))
        mean = F.size(P.blanks(F.array_join(ss, " "))) / F.size(ss)
        linked = F.size(F.filter(F.slice(ss, 2, 1 << 20), lambda s: s.rlike(LINKED)))
        prose = (F.size(ss) < 3) | (mean >= 13) | (linked >= 2)
        flow = F.transform(ss, lambda s: named(head=F.lit(""), body=s))
        cards = F.transform(F.slice(ss, 1, 6), lambda s: named(head=P.heading(s), body=P.strip_end(s)))
        ticks = F.transform(F.slice(ss, 1, 8), lambda s: named(head=F.lit(""), body=P.strip_end(s)))
        return F.coalesce(
            detection(orders >= F.greatest(F.lit(3), F.floor(F.size(ss) * 0.6)), "CHECKLIST", "ticks", 0.8, ticks),
            detection(prose, "PROSE", "flow", 0.6, flow),
            detection(F.lit(True), "KEY_POINTS", "grid", 0.55, cards),
        )

    whole = detection(F.lit(True), "PROSE", "flow", 0.6, F.transform("sents", lambda s: named(head=F.lit(""), body=s)))
    return let(src, lambda ss: F.when(F.size(ss) >= 2, of(ss)).otherwise(whole))


#: Those that end the search, in order, and those that are weighed, in the order that decides between equals.
FIRST = {"table": table, "sections": sections, "references": references, "series": series, "questions": questions, "algorithm": algorithm}
WEIGHED = {
    "function_plot": function_plot, "worked": worked, "labelled": labelled, "equation": equation, "glossary": glossary, "agenda": agenda, "compare": compare, "parallel": parallel, "pros_cons": pros_cons,
    "matrix": matrix, "timeline": timeline, "chart": chart, "funnel": funnel, "venn": venn, "definition": definition, "layers": layers, "cycle": cycle, "flowchart": flowchart, "process": process,
    "process_implicit": process_implicit, "cause_effect": cause_effect, "stats": stats,
}
#: A family that is there, and the families that it excludes, in this order.
EXCLUDES = (
    (("CHART_PART_TO_WHOLE", "CHART_TREND"), ("STAT_TILES", "FUNNEL")),
    (("SET_DIAGRAM",), ("COMPARE_TABLE", "STAT_TILES")),
    (("FLOWCHART",), ("PROCESS_LINEAR", "PROCESS_CYCLIC", "CHECKLIST", "KEY_POINTS")),
    (("PROCESS_CYCLIC",), ("PROCESS_LINEAR",)),
    (("FUNNEL",), ("STAT_TILES",)),
    (("TIMELINE",), ("STAT_TILES", "CAUSE_EFFECT", "PROCESS_LINEAR")),
    (("LAYERS",), ("PROCESS_LINEAR",)),
    (("DEFINITION", "FORMULA_CALLOUT"), ("STAT_TILES", "CHART_CATEGORICAL", "CAUSE_EFFECT", "KEY_POINTS")),
)
MOST = 0.97


def detections(slides: DataFrame) -> DataFrame:
    """(id, title, sents, <detector> ...) of slides (id, title, text): each detector's struct or null in a column of its name, and ``base``."""
    rows = sentence_columns(slides)
    every = {**FIRST, **WEIGHED, "base": base}
    return rows.select("id", "title", "sents", *[f().alias(name) for name, f in every.items()])


def decided(slides: DataFrame) -> DataFrame:
    """(id, family, variant, confidence, items, others) of each slide: the first of those that end the search, else the surest of the others after
    exclusions, else the base; ``others`` are the next three families."""
    rows = detections(slides)
    checklist = F.when(F.col("base")["family"] == "CHECKLIST", F.col("base"))
    weighed = [F.when(F.col(n).isNotNull(), named(less=-F.col(n)["confidence"], k=F.lit(k), d=F.col(n))) for k, n in enumerate(WEIGHED)]
    weighed.append(F.when(checklist.isNotNull(), named(less=-checklist["confidence"], k=F.lit(len(WEIGHED)), d=checklist)))
    found = F.array_sort(F.filter(F.array(*weighed), lambda c: c.isNotNull()))
    rows = rows.select("id", F.coalesce(*FIRST).alias("first"), "base", found.alias("found"))
    families = F.transform("found", lambda c: c["d"]["family"])

    def allowed(c: Column) -> Column:
        ok = F.lit(True)
        for there, gone in EXCLUDES:
            present = F.arrays_overlap(families, F.array(*map(F.lit, there)))
            ok = ok & ~(present & c["d"]["family"].isin(*gone))
        return ok

    rows = rows.withColumn("kept", F.filter("found", allowed))
    best = F.coalesce("first", F.get("kept", F.lit(0))["d"], "base")
    others = F.when(F.col("first").isNull(), F.transform(F.slice("kept", 2, 3), lambda c: c["d"]["family"])).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", best.alias("d"), others.alias("others"))
    return rows.select("id", "d.family", "d.variant", F.least(F.lit(MOST), F.col("d.confidence")).alias("confidence"), "d.items", "others")


def takeaways(decisions: DataFrame) -> DataFrame:
    """(id, takeaway): one line made of a decision's items where the picture leaves something to say."""
    n, first, last = F.size("items"), F.get("items", F.lit(0)), F.element_at("items", -1)
    count = n.cast("string")
    quoted = lambda x: F.concat(F.lit("“"), x, F.lit("”"))
    steps = F.concat(count, F.lit(" steps — from "), quoted(first["head"]), F.lit(" to "), quoted(last["head"]))
    cases = (
        (F.col("variant") == "agenda", F.lit("")),
        (F.col("family") == "PROCESS_LINEAR", F.concat(steps, F.lit("."))),
        (F.col("family") == "PROCESS_CYCLIC", F.concat(steps, F.lit(", then it repeats."))),
        (F.col("family") == "TIMELINE", F.concat(count, F.lit(" milestones between "), first["head"], F.lit(" and "), last["head"], F.lit("."))),
        (F.col("family") == "COMPARE_TABLE", F.concat(count, F.lit(" rows compared."))),
        (F.col("family") == "STAT_TILES", F.concat(F.lit("Headline: "), first["head"], F.lit(" — "), F.lower(first["body"]), F.lit("."))),
        (F.col("family") == "DEFINITION", F.concat(first["body"], F.lit("."))),
        (F.col("family") == "FORMULA_CALLOUT", F.when(first["body"].rlike("[⇌→]"), "").otherwise(F.concat(F.lit("Remember: "), first["body"]))),
        (F.col("family") == "LAYERS", F.concat(count, F.lit(" levels, from "), F.lower(first["head"]), F.lit(" to "), F.lower(last["head"]), F.lit("."))),
        (F.col("family") == "CAUSE_EFFECT", F.concat(F.lit("One trigger sets off a chain of "), count, F.lit(" effects"), F.when(F.col("variant") == "loop", " that feeds back on itself.").otherwise("."))),
        (F.col("family") == "FUNNEL", F.concat(F.lit("From "), first["body"], F.lit(" "), F.lower(first["head"]), F.lit(" down to "), last["body"], F.lit("."))),
        (F.col("family") == "SET_DIAGRAM", F.lit("What the two sets share — and what is unique to each.")),
    )
    text = F.lit("")
    for test, value in reversed(cases):
        text = F.when(test, value).otherwise(text)
    return decisions.select("id", text.alias("takeaway"))
