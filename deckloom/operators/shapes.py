"""Which picture a slide's text calls for, pipe tables, cleaned bullets, solved problems and colours: all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.text import sentences, tokens

# Patterns of the cues.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"\b(?:{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|{MONTH}\s+\d{{4}}|1[0-9]{{3}}|20[0-9]{{2}}|\d{{1,2}}(?:st|nd|rd|th)\s+century)\b"
SHARE = r"(\d{1,3}(?:\.\d+)?)\s?(?:%|percent)"
CAUSE = (
    r"(?i)\b(leads? to|causes?|results? in|as a result|therefore|thus|which in turn|pushes?|raises?|drives?|triggers?|so that|consequently|because|due to|reduces?|increases?|breaks?|turns? into|then)\b"
)
STRONG_CAUSE = r"(?i)\b(as a result|therefore|thus|leads? to|causes?|results? in|consequently|which in turn|so that)\b"
LOOP = r"(?i)\b(again|in turn|repeat|loop|spiral|vicious|feedback)\b"
CYCLE = r"(?i)\b(?:the )?(?:cycle|loop|process) (?:repeats|continues|begins again|starts again)|back to the (?:start|beginning)|repeats? (?:continuously|again|indefinitely)"
LABELLED = r"^\s*(?:[-*•]\s*)?([A-Z][\w /&-]{1,32}?):\s+(.{8,})$"
PROCEDURE = r"(?i)\b(how|steps?|process|procedure|mak(?:e|es|ing)|work(?:s|ing)?|method|workflow|recipe|install\w*|set ?up|lifecycle|stages|guide|instructions)\b"


def _count(parts: Column, pattern: str) -> Column:
    return F.size(F.filter(parts, lambda s: s.rlike(pattern)))


def pipe_table(text: Column) -> Column:
    """Cells of the first pipe table of a text (rows of the first unbroken run, rows of marks left out, padded to one width); null if there
    is none: it needs three piped lines, a row of ``---`` and two other rows."""
    lines = F.split(text, "\n")
    piped = F.transform(lines, lambda x: F.trim(x).rlike(r"^\|.*\|$"))
    first = F.array_position(piped, F.lit(True)).cast("int")
    rest = F.slice(piped, F.greatest(first, F.lit(1)), F.size(piped))
    stop = F.array_position(rest, F.lit(False)).cast("int")
    run = F.slice(lines, F.greatest(first, F.lit(1)), F.when(stop > 0, stop - 1).otherwise(F.size(rest)))
    cells = F.transform(run, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)))
    marks = lambda r: F.forall(r, lambda c: (c == "") | c.rlike("^:?-{2,}:?$"))
    rows = F.filter(cells, lambda r: ~marks(r))
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    ok = (first > 0) & (F.size(F.filter(piped, lambda x: x)) >= 3) & F.exists(cells, marks) & (F.size(rows) >= 2)
    return F.when(ok, padded)


def table_cells(texts: DataFrame) -> DataFrame:
    """(id, row_no, col_no, cell) of each text's first pipe table; row 0 is the head."""
    rows = texts.select("id", F.posexplode(pipe_table(F.col("text"))).alias("row_no", "r"))
    return rows.select("id", "row_no", F.posexplode("r").alias("col_no", "cell")).select("id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "cell")


def families(slides: DataFrame) -> DataFrame:
    """(id, family, variant, confidence, size): the first shape that a slide's (id, title, text) has, in the order of their confidence; KEY_POINTS else."""
    rows = slides.select("id", "title", "text", F.filter(F.flatten(F.transform(F.split("text", "\n"), lambda x: sentences(F.trim(x)))), lambda s: s != "").alias("s"))
    rows = rows.withColumns({"cells": pipe_table(F.col("text")), "blob": F.array_join("s", " "), "n": F.size("s")})
    shares = F.transform(F.filter("s", lambda x: x.rlike(SHARE)), lambda x: F.regexp_extract(x, SHARE, 1).cast("double"))
    rows = rows.withColumn("shares", shares)
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    dated = F.size(F.filter("s", lambda x: x.rlike(DATE) & (F.length(F.regexp_replace(F.regexp_replace(x, DATE, ""), "[^A-Za-z]", "")) >= 4)))
    labelled = F.filter(F.split("text", "\n"), lambda x: F.trim(x).rlike(LABELLED))
    causes, strong = _count(F.col("s"), CAUSE), _count(F.col("s"), STRONG_CAUSE)
    mean = F.aggregate(F.transform("s", lambda x: F.size(tokens(x))), F.lit(0), lambda a, x: a + x) / F.greatest(F.col("n"), F.lit(1))
    options = [
        (F.col("cells").isNotNull(), "COMPARE_TABLE", F.lit("table"), 0.95, F.size("cells") - 1),
        ((F.size("shares") >= 3) & total.between(95.0, 105.0), "CHART_PART_TO_WHOLE", F.lit("pie"), 0.90, F.size("shares")),
        (dated >= 3, "TIMELINE", F.lit("dated"), 0.90, F.least(dated, F.lit(8))),
        (F.size(labelled) >= 3, "LIST_STRUCTURED", F.lit("cards"), 0.86, F.least(F.size(labelled), F.lit(6))),
        (F.col("blob").rlike(r"(?i)\b(both|shared|in common|overlap)\b") & F.col("blob").rlike(r"(?i)\bonly\b") & (F.col("n") >= 3), "SET_DIAGRAM", F.lit("venn2"), 0.84, F.least(F.col("n"), F.lit(8))),
        ((F.col("title").rlike(r"(?i)\b(cycle|loop)\b") | F.concat_ws(" ", "blob", "title").rlike(CYCLE)) & (F.col("n") >= 3), "PROCESS_CYCLIC", F.lit("cycle"), 0.80, F.least(F.col("n"), F.lit(6))),
        (((causes >= 2) | (strong >= 1)) & F.col("n").between(3, 7), "CAUSE_EFFECT", F.when(F.col("blob").rlike(LOOP), "loop").otherwise("chain"), 0.76, F.least(F.col("n"), F.lit(6))),
        (F.col("title").rlike(PROCEDURE) & F.col("n").between(4, 8) & (mean <= 20), "PROCESS_LINEAR", F.lit("flowchart"), 0.70, F.col("n")),
    ]
    found = F.struct(F.lit("KEY_POINTS").alias("family"), F.lit("grid").alias("variant"), F.lit(0.55).alias("confidence"), F.least(F.col("n"), F.lit(6)).cast("long").alias("size"))
    for test, family, variant, confidence, size in reversed(options):
        found = F.when(test, F.struct(F.lit(family).alias("family"), variant.alias("variant"), F.lit(confidence).alias("confidence"), size.cast("long").alias("size"))).otherwise(found)
    return rows.select("id", found.alias("f")).select("id", "f.*")


def plain_text(text: Column) -> Column:
    """Inline markdown, code ticks and escapes removed, white space made single."""
    out = F.regexp_replace(text, r"(?s)\*\*(.+?)\*\*", "$1")
    out = F.regexp_replace(out, r"(?s)__(.+?)__", "$1")
    out = F.regexp_replace(out, r"`([^`]+)`", "$1")
    out = F.regexp_replace(out, r"\*\*|__", "")
    out = F.regexp_replace(out, r"\\+(\s|$)", " ")
    out = F.regexp_replace(out, r"(^|[^\w*_])[*_]+", "$1")
    out = F.regexp_replace(out, r"[*_]+([^\w*_]|$)", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_bullet(text: Column) -> Column:
    out = F.regexp_replace(text, r"^\s*#{1,6}\s*", "")
    return plain_text(F.regexp_replace(out, r"(?i)^\s*(?:[-*+•]|\d+[.)]|step\s*\d+\s*[:.\-])\s*", ""))


def truncated(text: Column, limit: int) -> Column:
    """Cut at a word's end within ``limit`` characters if that keeps over 60 % of them, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    kept = F.when((F.instr(cut, " ") > 0) & (at > limit * 0.6), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(kept, r"[ ,;:—–.]+$", ""), F.lit("…")))


def solve_linear(problem: Column) -> Column:
    """x of ``ax + b = cx + d`` as written with x, or null."""
    text = F.regexp_replace(F.regexp_extract(problem, r"([-+\d.x\s]*x[-+\d.x\s]*=[-+\d.x\s]*|[-+\d.\s]*=[-+\d.x\s]*x[-+\d.x\s]*)", 1), r"\s+", "")

    def side(s: Column) -> tuple[Column, Column]:
        xs = F.transform(F.regexp_extract_all(s, F.lit(r"([+-]?\d*\.?\d*)x"), F.lit(1)), lambda c: F.when(c.isin("", "+"), 1.0).when(c == "-", -1.0).otherwise(c.cast("double")))
        rest = F.regexp_extract_all(F.regexp_replace(s, r"[+-]?\d*\.?\d*x", ""), F.lit(r"[+-]?\d+\.?\d*"), F.lit(0))
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
        return add(xs), add(F.transform(rest, lambda c: c.cast("double")))

    a, b = side(F.split_part(text, F.lit("="), F.lit(1)))
    c, d = side(F.split_part(text, F.lit("="), F.lit(2)))
    return F.when((text != "") & (a != c), F.try_divide(d - b, a - c))


def solve_percent(problem: Column) -> Column:
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*%\s*of\s*\$?(\d[\d,]*(?:\.\d+)?)"
    asks = problem.rlike(r"(?i)\b(what is|find|calculate|compute|how much)\b")
    number = lambda k: F.replace(F.regexp_extract(problem, pattern, k), F.lit(","), F.lit("")).try_cast("double")
    return F.when(asks & problem.rlike(pattern), number(1) / 100.0 * number(2))


def solve_interest(problem: Column) -> Column:
    """The interest of a principal at a yearly rate: compound if it says so, else simple."""
    number = lambda p: F.replace(F.regexp_extract(problem, p, 1), F.lit(","), F.lit("")).try_cast("double")
    principal, rate, span = number(r"\$\s?(\d[\d,]*(?:\.\d+)?)"), number(r"(\d+(?:\.\d+)?)\s*%"), number(r"(?i)(\d+(?:\.\d+)?)\s*(?:year|yr|month)")
    years = F.when(problem.rlike(r"(?i)\d\s*month"), span / 12.0).otherwise(span)
    compound = principal * F.pow(1.0 + rate / 100.0, years) - principal
    return F.when(problem.rlike("(?i)interest"), F.when(problem.rlike("(?i)compound"), compound).otherwise(principal * rate / 100.0 * years))


def solve_speed(problem: Column) -> Column:
    """Distance of a speed held for some hours."""
    number = lambda p: F.regexp_extract(problem, p, 1).try_cast("double")
    return F.when(problem.rlike(r"(?i)how far|distance"), number(r"(\d+(?:\.\d+)?)\s*(?:km/h|mph|kmph)") * number(r"(?i)(\d+(?:\.\d+)?)\s*hours?"))


def solved(problems: DataFrame) -> DataFrame:
    """(id, kind, answer) of each problem: the first solver that knows it."""
    p = F.col("text")
    kinds = (("interest", solve_interest(p)), ("percent", solve_percent(p)), ("linear", solve_linear(p)), ("speed", solve_speed(p)))
    rows = problems.select("id", *[v.alias(k) for k, v in kinds])
    kind = F.lit("unknown")
    for k, _ in reversed(kinds):
        kind = F.when(F.col(k).isNotNull(), k).otherwise(kind)
    return rows.select("id", kind.alias("kind"), F.bround(F.coalesce(*[F.col(k) for k, _ in kinds]), 4).alias("answer"))


def luminance(colour: Column) -> Column:
    """Relative luminance of a ``#rrggbb`` colour."""
    parts = []
    for at, weight in ((2, 0.2126), (4, 0.7152), (6, 0.0722)):
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255.0
        parts.append(weight * F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    return parts[0] + parts[1] + parts[2]


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def page_sections(pages: DataFrame) -> DataFrame:
    """Of each page's html: its first heading, and counts of paragraphs, items and links outside scripts, styles, comments, navigation and footers."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>|<footer.*?</footer>", " ")
    rows = pages.select("page_id", html.alias("h"))
    text = F.trim(F.regexp_replace(F.regexp_replace("h", r"(?s)<[^>]*>", " "), r"\s+", " "))
    title = F.trim(F.regexp_replace(F.regexp_extract("h", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", ""))
    count = lambda p: F.regexp_count("h", F.lit(p)).cast("long")
    return rows.select("page_id", title.alias("title"), count(r"(?i)<p[ >]").alias("n_paragraphs"), count(r"(?i)<li[ >]").alias("n_items"), count(r"(?i)<a ").alias("n_links"), F.length(text).cast("long").alias("n_chars"))
