"""Phrase functions as columns: sentences of slides, labels, headings, figures, equations, cue spans and other small parsers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.text import as_sql, upper_letter

# Words and patterns that labels and figures are cut by.
LABEL_STOP = "the a an of and or to in on at for by with is are was were be been it its this that these those as from which who".split()
DANGLING = (
    "may might could would shall favours favors gives makes causes leads shows has have can will must should does do uses needs requires "
    "helps allows lets means creates produces provides gets get"
).split()
#: White space as SQL has it: without the vertical tab.
SPACES = " \t\n\f\r"
LEAD_CUE = (
    r"(?i)^(?:(?:step|stage|phase)\s*\d+\s*[:.\-)]?\s*|(?:first(?:ly)?|second(?:ly)?|third(?:ly)?|fourth(?:ly)?|fifth|sixth|seventh|eighth|ninth|tenth|"
    r"to begin with|to start with|next|then|finally|lastly|after that|afterwards|meanwhile|however|in addition|also|therefore|thus|hence|as a result|"
    r"consequently|furthermore|moreover)\b[,:]?\s*)"
)
VERBISH = (
    r"(?i)\b(?:is|are|was|were|has|have|had|holds?|reach(?:ed|es)?|grew|grow(?:s|n)?|fell|rose|accounts?|added|adds?|became|become|improved?|reduced?|"
    r"increased?|decreased?|totall?ed|stands?|makes?|gives?|uses?|needs?|requires?|produces?|contains?|includes?)\b"
)
PARTICIPLE = r"(?i)^(?:\w+ed|taken|made|done|given|seen|known|shown|built|used|held|kept|sent|written|found|heated|cooled|set|put|read|cut)$"
PRONOUN = r"(?i)^(?:it|they|this|these|those|he|she|we|you|there)\s+(?:can|will|may|should|must|also|often|usually)?\s*"
CLAUSE = r"[;:,]| — | - |\bwhich\b|\bwhile\b|\bwhereas\b|\bbecause\b|\bso that\b"
LIST_MARK = r"^\s*(?:[-*•▪◦]|\d+[.)])\s+"
FIGURE = r"(?i)[$₹€£]?\s?\d[\d,]*(?:\.\d+)?\s?(?:%|percent|billion|million|thousand|trillion|bn|mn|k|m|x|×)?"
YEAR = r"^(?:1[0-9]{3}|20[0-9]{2})$"
REFERENCE = (
    r"(?i)\b(?:[QH][1-4]|FY\s?\d{2,4})\b|\b(?:tables?|figures?|fig\.?|sections?|pages?|steps?|chapters?|appendix|eq\.?|equations?|slides?)\s*\d+(?:\.\d+)*|"
    r"\[\d+(?:[,–-]\s*\d+)*\]|\(\d+\)"
)
ENUMERATOR = r"^\s*(?:\(?\d{1,2}[.)]|\(?[a-hA-H][.)])\s+"
MAGNITUDES = (("trillion", 1e12), ("billion", 1e9), ("bn", 1e9), ("million", 1e6), ("mn", 1e6), ("thousand", 1e3))
TAIL_VERBS = (
    "generated provided reached totalled totaled was were is are had has contributed earned made sold scored got gets recorded posted delivered brought "
    "produced came stood at of with for"
).split()
HEAD_FILLER = "the a an and while whereas but".split()
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
QUANTITY = (
    r"(?i)([$₹€£¥]\s?)?(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?(%|percent|percentage|x|k|bn|mn|m|cr|crore|lakh|years?|yrs?|months?|days?)?"
)
LEAD_MARKER = (
    r"(?i)^\s*(?:it (?:is|was) (?:important to note|worth noting|clear|evident|also) that|note that|in other words|that is to say|as (?:a|the) result|as such|"
    r"consequently|therefore|thus|hence|in addition|additionally|moreover|furthermore|however|nevertheless|nonetheless|on the other hand|"
    r"for (?:instance|example)|for this reason|in (?:fact|general|particular|essence|short|summary)|basically|essentially|fundamentally|generally speaking|"
    r"this means (?:that)?|this (?:is|shows|implies|indicates) (?:that)?|there(?:fore)? (?:is|are|exists?))\b[\s,:-]*"
)
PRONOUN_LEAD = (
    r"(?i)^\s*(?:it|this|that|these|those|they|there)\s+(?:is|are|was|were|consists? of|contains?|includes?|has|have|had|means|refers to|allows?|enables?|"
    r"involves?|requires?|provides?)\s+"
)
COPULA_LEAD = (
    r"(?i)^\s*(?:the |a |an )?[\w \-]{1,40}? (?:is|are) (?:the |a |an )?(?:process|study|measure|method|technique|approach|way|means|type|kind|form|result|"
    r"concept|idea|term|system) (?:of|for|by|that)\s+"
)
RELATIVE = r"(?i),?\s+(?:which|who|where|that)\s+.*$"
ABBREVIATIONS = "no nos fig eq vs etc approx eg ie cf dr mr mrs ms prof sr jr st vol ch sec min max avg std dept univ inc ltd co".split()
CITATION = (
    r"(?i)\b(?:edition|ed\.|press|publications?|publisher|isbn|wiley|mcgraw|springer|pearson|elsevier|oxford|cambridge|o'reilly|tata|phi learning|et al|"
    r"pp\.|vol\.|journal|proceedings|ieee|acm)\b"
)
LATEX = {
    r"\rightleftharpoons": "⇌", r"\rightarrow": "→", r"\leftarrow": "←", r"\degree": "°", r"\approx": "≈", r"\times": "×", r"\infty": "∞", r"\Delta": "Δ",
    r"\cdot": "·", r"\circ": "°", r"\leq": "≤", r"\geq": "≥", r"\neq": "≠", r"\sum": "Σ", r"\to": "→", r"\le": "≤", r"\ge": "≥", r"\pm": "±", r"\%": "%",
    r"\,": " ", r"\;": " ", r"\ ": " ",
}
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ",
    "tau": "τ", "phi": "φ", "omega": "ω",
}
OCR_BLOCK = (
    r"(?is)<<FIGURE_TEXT>>.*?<<END_FIGURE_TEXT>>|\[+\s*(?:Extracted OCR|OCR Transcription|Image Diagram Content)[^\]]*\]*|<<FIGURE_TEXT>>|<<END_FIGURE_TEXT>>"
)
#: Relations in the order of their test, with the cues of each; and cues that count anywhere in a sentence.
CUES = (
    ("contrast", r"however|but|whereas|while|unlike|in contrast|on the other hand|instead|rather than|conversely|yet"),
    ("concession", r"although|though|even though|despite|in spite of|nevertheless|nonetheless|still"),
    ("result", r"therefore|thus|hence|consequently|as a result|so that|which means|for this reason|accordingly"),
    ("cause", r"because|since|due to|owing to|as it|as they|this is why|which is why|given that"),
    ("example", r"for example|for instance|e\.g\.|such as|like|including|in particular|namely"),
    ("sequence", r"first(?:ly)?|second(?:ly)?|third(?:ly)?|next|then|after that|afterwards|finally|lastly|subsequently|before"),
    ("purpose", r"in order to|so as to|to ensure|to allow|to enable|to avoid|aims? to|designed to|intended to"),
    ("addition", r"also|moreover|furthermore|in addition|additionally|as well as|besides|similarly|likewise"),
)


def ends(text: Column) -> Column:
    """White space of both ends removed."""
    return F.trim(text, F.lit(SPACES))


def strip_end(text: Column) -> Column:
    return F.rtrim(F.ltrim(text, F.lit(SPACES)), F.lit(SPACES + ".;:,"))


def before(text: Column, pattern: str) -> Column:
    """What stands before the first match. ``split`` would compile its pattern anew for each text."""
    return F.regexp_replace(text, rf"(?:{pattern})(?s:.*)", "")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words anywhere: asked before a slow pattern that needs one of them."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def cap(text: Column) -> Column:
    # worked out once: its letter and its rest would each make the whole text anew
    return let(ends(text), lambda t: F.concat(upper_letter(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))


def parts(text: Column, pattern: str) -> Column:
    """Trimmed pieces between matches, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), ends), lambda x: x != "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named: inside a lambda the optimiser shares nothing."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blanks(text: Column) -> Column:
    """Pieces between white space."""
    return F.regexp_extract_all(text, F.lit(as_sql(r"\S+")), F.lit(0))


def squeezed(text: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def first_run(items: Column, keep) -> Column:
    """The items up to the last that ``keep`` (of item and place) takes."""
    last = lambda xs: F.array_max(F.transform(xs, lambda x, i: F.when(keep(x, i), i + 1).otherwise(0)))
    return let(items, lambda xs: F.slice(xs, F.lit(1), F.coalesce(last(xs), F.lit(0))))


def without_head(items: Column, drop) -> Column:
    """The items from the first that ``drop`` doesn't take."""
    first = lambda xs: F.array_position(F.transform(xs, lambda x: ~drop(x)), F.lit(True)).cast("int")
    return let(items, lambda xs: let(first(xs), lambda at: F.when(at > 0, F.slice(xs, F.greatest(at, F.lit(1)), F.size(xs))).otherwise(F.slice(xs, F.lit(1), F.lit(0)))))


def clauses(text: Column) -> Column:
    """Sentences of a text: lines without list marks, cut after an end before a capital, digit or quote; a sentence of three or more
    clauses that all have a figure and a verb becomes one sentence a clause."""
    blocks = F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.regexp_replace(ends(x), LIST_MARK, "")), lambda x: x != "")
    sents = F.flatten(F.transform(blocks, lambda b: parts(b, r"(?<=[.!?])\s+(?=[A-Z0-9\"“(])")))

    def of(s: Column, found: Column) -> Column:
        listed = (F.size(found) >= 3) & F.forall(found, lambda p: p.rlike(r"\d") & p.rlike(VERBISH))
        return F.when(listed, F.transform(found, lambda p: F.concat(cap(strip_end(p)), F.lit(".")))).otherwise(F.array(s))

    def split(s: Column) -> Column:
        found = parts(s, r",\s*(?:and\s+)?|\s+and\s+(?=[A-Z]\w*\s+(?:has|have|holds?|is|are)\b)")
        # only what has three figures apart can be three clauses with a figure each
        return F.when(s.rlike(r"\d\D+\d+\D+\d"), let(found, lambda f: of(s, f))).otherwise(F.array(s))

    return F.flatten(F.transform(sents, split))


def with_sentences(rows: DataFrame, text: str = "text", name: str = "sents") -> DataFrame:
    """Append ``name``: the sentences (``clauses``) of a text column, each once by its letters and digits."""
    return with_once(rows.withColumn(name, clauses(F.col(text))), name, squeezed)


def sentence_rows(rows: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep, pos from 1, sent): a row a sentence.

    Exploded with nulls, which are left out then: a plain explode makes the optimiser test sizes first, which would make all arrays twice.
    """
    spread = with_sentences(rows, text).select(*keep, F.posexplode_outer("sents").alias("pos", "sent")).where("sent IS NOT NULL")
    return spread.select(*keep, (F.col("pos") + 1).alias("pos"), "sent")


def with_once(rows: DataFrame, name: str, key) -> DataFrame:
    """The array column ``name`` without items whose ``key`` is empty or that of an earlier one.

    Keys are a column of their own, named outside the lambda too: so the optimiser doesn't make them anew for each item.
    """
    keyed = rows.withColumn("_once", F.transform(name, key))
    fresh = F.filter(name, lambda x, i: (F.get("_once", i) != "") & (F.array_position("_once", F.get("_once", i)) == i + 1))
    # most arrays repeat nothing, which one pass over the keys tells; looking for each key's first place takes n of them
    named = F.filter(name, lambda x, i: F.get("_once", i) != "")
    return keyed.withColumn(name, F.when(F.size(F.array_distinct("_once")) == F.size("_once"), named).when(F.col("_once").isNotNull(), fresh)).drop("_once")


def short_sentences(text: Column) -> Column:
    """Sentences of three words or more with a full stop at the end of each that has none."""
    found = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?])[\"'”’)\]]?\s+(?=[A-Z0-9“\"'(])")
    found = F.transform(found, lambda p: F.regexp_replace(p, r"^[ .;:]+|[ .;:]+$", ""))
    kept = F.filter(found, lambda p: F.size(blanks(p)) >= 3)
    return F.transform(kept, lambda p: F.when(p.rlike(r"[.!?]$"), p).otherwise(F.concat(p, F.lit("."))))


def whole_sentences(text: Column) -> Column:
    """Sentences that don't end after an abbreviation, an initial or a number, nor before a small letter."""
    marked = F.trim(F.regexp_replace(text, r"\s+", " "))
    marked = F.regexp_replace(marked, r"([.!?])(?= )", "$1\u0001")
    pieces = F.split(marked, "\u0001")

    def real(i: Column) -> Column:
        body = F.regexp_replace(F.element_at(pieces, i + 1), r"[.!?]$", "")
        token = F.regexp_extract(body, r"([A-Za-z0-9.]+)$", 1)
        then = F.ltrim(F.get(pieces, i + 1))
        starts_small = then.rlike(r"^\p{Ll}")
        known = F.lower(F.replace(token, F.lit("."), F.lit(""))).isin(ABBREVIATIONS)
        return ~(starts_small | token.rlike(r"\d$") | token.rlike("^[A-Z]$") | known)

    n = F.size(pieces)
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i < n - 1) & real(i), F.concat(F.element_at(pieces, i + 1), F.lit("\u0002"))).otherwise(F.element_at(pieces, i + 1)))
    sents = F.transform(F.split(F.array_join(cuts, ""), "\u0002"), lambda p: F.regexp_replace(p, r"^[ .;:]+|[ .;:]+$", ""))
    return F.filter(sents, lambda p: p != "")


def label_words(text: Column) -> Column:
    """The words of which a sentence's label is made: without lead words, up to a clause's end."""
    return blanks(before(F.regexp_replace(strip_end(text), LEAD_CUE, ""), CLAUSE))


def short_label(text: Column, most: int = 6, drop_aux: bool = False, words: Column | None = None) -> Column:
    """A heading for a sentence: lead words removed, cut at a clause's end and ``most`` words, no word left hanging. ``words``: its ``label_words``, if they are at hand."""
    words = label_words(text) if words is None else words
    if drop_aux:
        plain = lambda ws: F.filter(ws, lambda w, i: ~(F.lower(w).isin("is", "are", "was", "were", "gets", "get") & F.coalesce(F.get(ws, i + 1).rlike(PARTICIPLE), F.lit(False))))
        words = let(words, plain)
        words = let(words, lambda ws: F.when(F.lower(F.get(ws, F.lit(0))).isin("the", "a", "an") & (F.size(ws) > 3), F.slice(ws, 2, 1 << 20)).otherwise(ws))
    hanging = list(dict.fromkeys(LABEL_STOP + DANGLING))
    kept = first_run(F.slice(words, 1, most), lambda w, i: ~F.lower(w).isin(hanging))
    return let(cap(F.array_join(kept, " ")), lambda label: F.when(label != "", label).otherwise(cap(F.substring(strip_end(text), 1, 40))))


def heading(text: Column, words: Column | None = None) -> Column:
    """Two or three words that head a sentence; its label if there are none (``words``: as in ``short_label``)."""
    t = F.regexp_replace(F.regexp_replace(strip_end(text), LEAD_CUE, ""), PRONOUN, "")
    own = F.slice(without_head(blanks(t), lambda w: F.lower(w).isin(LABEL_STOP)), 1, 3)
    more_open = lambda w: F.length(F.replace(w, F.lit(")"), F.lit(""))) > F.length(F.replace(w, F.lit("("), F.lit("")))
    opened = lambda ws: F.array_position(F.transform(ws, more_open), F.lit(True)).cast("int")
    closed = let(own, lambda ws: let(opened(ws), lambda at: F.when(at > 0, F.slice(ws, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(ws)))
    hanging = list(dict.fromkeys([*LABEL_STOP, *DANGLING, "not", "also", "only", "very"]))
    kept = first_run(closed, lambda w, i: ~(F.lower(w).isin(hanging) | (F.lower(w).endswith("ly") & (i > 0))))
    return let(cap(F.array_join(kept, " ")), lambda found: F.when(found != "", found).otherwise(short_label(text, 3, words=words)))


def sentence_labels(sents: DataFrame) -> DataFrame:
    """(id, pos, label, step, head) of sentences (id, pos, sent); a sentence is cut into words once for all three."""
    rows = sents.withColumn("_words", label_words(F.col("sent")))
    text, words = F.col("sent"), F.col("_words")
    return rows.select("id", "pos", short_label(text, words=words).alias("label"), short_label(text, 5, True, words).alias("step"), heading(text, words).alias("head"))


def figures(text: Column) -> Column:
    """Quantities as they are written; list marks, cross-references and years are none."""
    s = F.regexp_replace(F.regexp_replace(text, ENUMERATOR, ""), REFERENCE, " ")
    found = F.transform(F.regexp_extract_all(s, F.lit(FIGURE), F.lit(0)), ends)
    return F.filter(found, lambda t: ~t.rlike(YEAR))


def figure_value(token: Column) -> Column:
    """A figure as a number: trillions, billions, millions and thousands multiplied."""
    t = F.regexp_replace(F.lower(token), "[,$₹€£]", "")
    value = F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    times = F.lit(1.0)
    for word, by in reversed(MAGNITUDES):
        times = F.when(F.contains(t, F.lit(word)), by).otherwise(times)
    return value * times


def short_number(v: Column) -> Column:
    """Billions as B, millions as M, ten thousands as K, whole numbers with commas, others with six digits at most."""

    def scaled(by: float, mark: str) -> Column:
        return F.concat(F.regexp_replace(F.bround(v / by, 1).cast("string"), r"\.0$", ""), F.lit(mark))

    plain = F.when(v >= 1000, F.bround(v, 2)).when(v >= 100, F.bround(v, 3)).when(v >= 10, F.bround(v, 4)).when(v >= 1, F.bround(v, 5)).otherwise(F.bround(v, 6))
    thousands = F.concat(F.bround(v / 1e3, 0).cast("long").cast("string"), F.lit("K"))
    return F.when(v >= 1e9, scaled(1e9, "B")).when(v >= 1e6, scaled(1e6, "M")).when(v >= 1e4, thousands).when(v == F.floor(v), F.format_number(v, 0)).otherwise(plain.cast("string"))


def pretty_value(token: Column) -> Column:
    return F.regexp_replace(ends(token), r"(?i)\s*percent\b", "%")


def pretty_equation(text: Column) -> Column:
    """Arrows as signs and digits after a letter or bracket as subscripts."""
    t = F.regexp_replace(F.regexp_replace(text, "<->|<=>", "⇌"), "->|=>", "→")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    pieces = F.regexp_extract_all(t, F.lit(r"[A-Za-z)]\d+|."), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[A-Za-z)]\d+$"), F.translate(p, "0123456789", SUBSCRIPTS)).otherwise(p)), "")


def unit_of(token: Column) -> Column:
    """Kind of a figure: pct, cur, a magnitude's word, or plain."""
    t = F.lower(token)
    word = F.regexp_extract(t, r"(trillion|billion|million|thousand|bn|mn|k)\b", 1)
    return F.when(t.rlike("%|percent"), "pct").when(t.rlike("[$₹€£]"), "cur").when(word != "", word).otherwise("plain")


def listed_pairs(sentence: Column) -> Column:
    """(label, value, unit) of a sentence that is a list of at least three names with one figure each; else an empty array."""
    segments = parts(strip_end(sentence), r",\s*(?:and\s+)?|\s+and\s+(?=[A-Za-z][\w ]{0,30}?\s+\W?\d)")

    def pair(s: Column) -> Column:
        found = figures(s)
        words = F.regexp_extract_all(before(s, FIGURE), F.lit(r"[\w'’+#./&-]+"), F.lit(0))
        words = without_head(first_run(words, lambda w, i: ~F.lower(w).isin(TAIL_VERBS)), lambda w: F.lower(w).isin(HEAD_FILLER))
        label = F.array_join(F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4)), " ")
        token = F.lower(F.get(found, F.lit(0)))
        value = F.replace(F.regexp_extract(token, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")
        ok = (F.size(found) == 1) & (label != "")
        return F.when(ok, F.struct(cap(label).alias("label"), value.alias("value"), unit_of(token).alias("unit")))

    found = F.transform(segments, pair)
    labels = F.transform(found, lambda p: F.lower(p["label"]))
    ok = (F.size(found) >= 3) & F.forall(found, lambda p: p.isNotNull()) & (F.size(F.array_distinct(labels)) == F.size(labels))
    return F.when(ok, found).otherwise(F.slice(found, F.lit(1), F.lit(0)))


def quantity(text: Column) -> Column:
    """The first quantity of a text with its currency and unit, or an empty string."""
    currency, number, unit = (F.regexp_extract(text, QUANTITY, k) for k in (1, 2, 3))
    space = F.when(unit.isin("", "%"), "").otherwise(" ")
    return F.concat(F.trim(currency), number, space, unit)


def compressed(sentence: Column, most: int = 16) -> Column:
    """A sentence without lead words, pronoun leads and copulas; over ``most`` words without its relative clause, then cut."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(ends(sentence), LEAD_MARKER, ""), PRONOUN_LEAD, ""), COPULA_LEAD, "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")
    s = F.concat(upper_letter(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
    trimmed = F.regexp_replace(F.regexp_replace(s, RELATIVE, ""), r"^[ ,;:]+|[ ,;:]+$", "")
    s = F.when((F.size(blanks(s)) > most) & F.size(blanks(trimmed)).between(-(-most // 2), most + 4), trimmed).otherwise(s)
    head = F.array_join(F.slice(blanks(s), 1, most + 3), " ")
    last = F.length(head) - F.length(F.regexp_extract(head, r"^(?s:.*)([,;:]\s.*)$", 1))
    cut = F.when(head.rlike(r"[,;:]\s") & (last > F.length(head) * 0.5), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.size(blanks(s)) > most + 3, F.regexp_replace(cut, r"[ ,;:]+$", "")).otherwise(s)


def delatex(text: Column) -> Column:
    """LaTeX in plain text as readable signs."""
    t = F.replace(text, F.lit("$"), F.lit(""))
    for _ in range(3):
        t = F.regexp_replace(t, r"\\(?:text|mathrm|mathbf|textbf|mathit|operatorname)\{([^{}]*)\}", "$1")
        t = F.regexp_replace(t, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)")
        t = F.regexp_replace(t, r"\\sqrt\{([^{}]*)\}", "√($1)")
    for k, v in LATEX.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    for k, v in GREEK.items():
        t = F.regexp_replace(t, rf"\\{k}\b", v)
    for mark, signs in (("_", SUBSCRIPTS), (r"\^", SUPERSCRIPTS)):
        pieces = F.regexp_extract_all(t, F.lit(rf"(?s){mark}\{{?\d+\}}?|."), F.lit(0))
        t = F.array_join(F.transform(pieces, _raised(mark, signs)), "")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[A-Za-z]+", ""), "[{}]", "")
    plain = ~(F.contains(text, F.lit("\\")) | F.contains(text, F.lit("$")))
    return F.when(plain, text).otherwise(F.trim(F.regexp_replace(t, r"\s{2,}", " ")))


def _raised(mark: str, signs: str):
    return lambda p: F.when(p.rlike(rf"^{mark}\{{?\d+\}}?$"), F.translate(F.regexp_replace(p, r"[_^{}]", ""), "0123456789", signs)).otherwise(p)


def readable(text: Column, least: float = 0.7) -> Column:
    """Whether most tokens of three letters or more look like words: a vowel and no letter three times in a row."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    long = F.filter(words, lambda w: F.length(w) >= 3)
    good = F.filter(long, lambda w: w.rlike("[aeiouy]") & ~w.rlike("|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")))
    noise = F.regexp_count(text, F.lit(r"[^\w\s.,;:()'\-%/]")).cast("double") / F.greatest(F.length(text), F.lit(1))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2)).cast("double") / F.greatest(F.size(words), F.lit(1))
    return (F.size(long) >= 3) & (F.size(good) >= least * F.size(long)) & (noise <= 0.08) & (short <= 0.45)


def without_ocr(text: Column) -> Column:
    return ends(F.regexp_replace(F.regexp_replace(text, OCR_BLOCK, ""), r"\n{3,}", "\n\n"))


def is_citation(line: Column) -> Column:
    numbered = line.rlike(r"^\s*\[\d{1,3}\]\s+\S") & line.rlike(r"\b(?:1[89]\d{2}|20\d{2})\b")
    return numbered | (line.rlike(r"(?i)\b(?:1[89]\d{2}|20\d{2})\b|\bed(?:ition)?\b") & line.rlike(CITATION))


def is_clean_sentence(text: Column) -> Column:
    """Prose of 9 to 32 words that starts with a capital, ends as a sentence and has a common verb."""
    n = F.size(blanks(text))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    # word bounds are ASCII, as in SQL: Java's know all letters
    before, after = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    verb = before + r"(?:is|are|was|were|has|have|can|will|uses?|means?|gives?|makes?|helps?|depends?|refers?|shows?|takes?|works?|needs?|allows?|produces?)" + after
    shape = text.rlike(r"^[A-Z“\"(]") & text.rlike(r"[a-z][.!?]\z") & ~text.rlike(r"[⇒→←<>|{}=_]|--|\s/\s|" + before + "(?:wf|pos|lemma|lexsn)" + after)
    return n.between(9, 32) & shape & (letters >= 0.75 * F.length(F.replace(text, F.lit(" "), F.lit("")))) & text.rlike(verb)


def cue_spans(sentence: Column) -> Column:
    """(start, stop, relation) of the connectives in a sentence, in order; an earlier relation's span wins where two begin."""
    found = F.array().cast("array<struct<start:int,stop:int,relation:string>>")
    for name, words in CUES:
        pattern = rf"(?i)\b({words})\b"
        texts = F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))
        gaps = F.split(sentence, pattern)

        mine = F.filter(F.transform(texts, _span(gaps, texts, name)), lambda s: s["stop"] - s["start"] >= 3)
        found = F.concat(found, F.filter(mine, _apart(found)))
    return F.array_sort(found)


def _span(gaps: Column, texts: Column, name: str):
    def length(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda a, x: a + F.length(x))

    def span(t: Column, i: Column) -> Column:
        start = length(F.slice(gaps, F.lit(1), i + 1)) + length(F.slice(texts, F.lit(1), i))
        return F.struct(start.cast("int").alias("start"), (start + F.length(t)).cast("int").alias("stop"), F.lit(name).alias("relation"))

    return span


def _apart(others: Column):
    return lambda s: ~F.exists(others, lambda b: (b["start"] <= s["start"]) & (s["start"] < b["stop"]))


def title_key(title: Column) -> Column:
    """A heading without marks of continuation."""
    t = F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(?:cont(?:inued|d)?|part|contd)\b", " "), r"\s+", " "))


def same_heading(a: Column, b: Column) -> Column:
    """Whether two headings name one topic: equal, nested with at least 75 % of the words, or 80 % of at least three words shared."""
    ka, kb = title_key(a), title_key(b)
    wa, wb = F.array_distinct(blanks(ka)), F.array_distinct(blanks(kb))
    most, least = F.greatest(F.size(wa), F.size(wb)), F.least(F.size(wa), F.size(wb))
    nested = (F.contains(ka, kb) | F.contains(kb, ka)) & (least >= 0.75 * most)
    shared = (most >= 3) & (F.size(F.array_intersect(wa, wb)) >= 0.8 * most)
    return (ka != "") & (kb != "") & ((ka == kb) | nested | shared)


def json_object(raw: Column) -> Column:
    """The first that is a JSON object: the text, the text without code fences, what is between the outermost braces; else null."""
    whole = ends(raw)
    bare = ends(F.regexp_replace(raw, r"(?i)```(?:json)?\s*", ""))
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    ok = lambda t: F.try_parse_json(t).isNotNull() & F.startswith(t, F.lit("{"))
    return F.when(ok(whole), whole).when(ok(bare), bare).when(ok(inner), inner)
