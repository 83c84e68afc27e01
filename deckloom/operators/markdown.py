"""Markdown as rows of lines: outlines, clean-up, sections, paragraphs, tables and chunks. Order is kept within a document, by windows over its lines or
folds over its sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import blanks, ends, same_heading
from deckloom.functions.text import upper_letter
from deckloom.operators.windows import junk_heading

HEADING = r"^(#{1,6})\s+(.*)$"
PIPED = r"^\s*\|.*\|\s*$"
TABLE_MARK = "[TABLE DATA]"
# Patterns of lines that are no content, and sizes.
PICTURE = r"(?i)^\s*[\w\-. ]+\.(?:png|jpe?g|gif|bmp|tiff?|webp|emf|wmf|svg)\s*$|^\s*!\[[^\]]*\]\([^)]*\)\s*$"
OCR_MARK = r"(?i)^\s*\[*\s*(?:Extracted\s+OCR|OCR\s+Transcription|OCR\s*&\s*Image|Image\s+Diagram\s+Content|Local)\b.*$"
PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?\d{1,3}\s*$"
FOOTER = r"(?i)^(?:dr\.?|prof\.?|mr\.?|ms\.?|shri)\b.*\b\d{4}[-/]\d{2,4}\b|\bsem\.?\s*[-.]?\s*[iv\d]+\s*$"
TRAILING = r"\s*(?:Dr\.?|Prof\.?|Mr\.?|Ms\.?)\s+[A-Z].{0,60}?\b\d{4}[-/]\d{2,4}\b.*$"
UNIT_LINE = r"(?i)^(?:unit|chapter|module|lesson|week|topic)\s+\w+"
NUMBERED_LINE = r"^\d+(?:\.\d+)*[.)]\s+[A-Z][^.!?]{2,70}$"
PAGE_TITLE = r"(?i)^(?:page|section|slide)\s*\d+$"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$"
MERGED_CHARS, CHUNK_WORDS = 6000, 180


def lines_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """(doc, no, line): the lines of each text, from 0."""
    # exploded as outer, so that no test of sizes splits the texts once more
    return texts.select("doc", F.posexplode_outer(F.split(text, "\n")).alias("no", "line")).where("no IS NOT NULL")


def joined(lines: DataFrame) -> DataFrame:
    """(doc, text): lines (doc, no, line, or with ``sub``) put together in order."""
    order = [c for c in ("no", "sub") if c in lines.columns]
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"])
    return lines.groupBy("doc").agg(F.array_join(body, "\n").alias("text"))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital and small letters after it."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(upper_letter(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def outline_to_markdown(text: Column) -> Column:
    """A plain outline: short lines in capitals, numbered ones and those that name a unit become headings."""

    def line(x: Column) -> Column:
        s, kept = ends(x), F.regexp_replace(x, r"\s+$", "")
        capitals = (F.upper(s) == s) & (F.lower(s) != s)
        short = F.size(blanks(s)) <= 9
        heading = F.when(capitals, F.concat(F.lit("## "), title_case(F.regexp_replace(s, r"^\d+(?:\.\d+)*[.)]\s+", "")))).otherwise(F.concat(F.lit("## "), s))
        return F.when(s == "", "").when(s.rlike(r"^#{1,6}\s"), s).when(short & (capitals | s.rlike(UNIT_LINE) | s.rlike(NUMBERED_LINE)), heading).otherwise(kept)

    return ends(F.array_join(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), line), "\n"))


def from_typed(texts: DataFrame, name: str = "Typed Input") -> DataFrame:
    """Typed texts as documents: (doc, markdown, source_name, converter)."""
    return texts.select("doc", F.col("text").alias("markdown"), F.lit(name).alias("source_name"), F.lit("typed").alias("converter"))


def without_pictures(text: Column) -> Column:
    """Lines that only name or show a picture left out, blank runs shortened."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(PICTURE))
    return ends(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def without_boilerplate(texts: DataFrame) -> DataFrame:
    """(doc, no, line): lines without running heads, page numbers, footers and blank ones; texts of under eight lines stay whole.

    Repeated lines are counted by a window over the document's lines, so nothing is joined.
    """
    rows = lines_of(texts).withColumn("s", ends(F.col("line")))
    is_heading = F.col("s").rlike(HEADING)
    key = F.lower(F.regexp_replace(F.regexp_replace("s", r"^[-*+•\d.)\s]+", ""), r"\s+", " "))
    rows = rows.withColumns({"heading": is_heading, "key": F.when(~is_heading & (F.length(key) >= 8), key)})
    whole = Window.partitionBy("doc")
    rows = rows.withColumns(
        {
            "n_lines": F.count(F.lit(1)).over(whole),
            "floor": F.greatest(F.lit(3), F.expr("CAST(greatest(1, count_if(heading) OVER (PARTITION BY doc)) DIV 8 AS INT)")),
            "times": F.when(F.col("key").isNotNull(), F.count("key").over(Window.partitionBy("doc", "key"))).otherwise(0),
        }
    )
    body = F.regexp_replace("s", r"^[-*+•>\d.)\s]+", "")
    own = F.lower(F.regexp_replace(body, r"\s+", " "))
    chrome = ((F.col("times") >= F.col("floor")) & (own == F.col("key"))) | F.col("s").rlike(PAGE_NUMBER) | body.rlike(FOOTER)
    cut = F.regexp_replace(F.regexp_replace("line", TRAILING, ""), r"\s+$", "")
    line = F.when((F.col("n_lines") < 8) | F.col("heading"), F.col("line")).otherwise(cut)
    mark = F.col("s").rlike(OCR_MARK) | F.col("s").isin("]", "]]")
    keep = (F.col("n_lines") < 8) | (~mark & (F.col("heading") | (~F.coalesce(chrome, F.lit(False)) & (ends(cut) != ""))))
    return rows.where(keep).select("doc", "no", line.alias("line"))


def without_fake_tables(lines: DataFrame) -> DataFrame:
    """Lines (doc, no, line) where a run of piped ones is no table (an empty first cell, or 30 % of cells that say nothing) become list items:
    (doc, no, sub, line)."""
    rows = lines.withColumn("piped", F.col("line").rlike(PIPED))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("no")) - F.row_number().over(Window.partitionBy("doc", "piped").orderBy("no"))
    rows = rows.withColumn("run", place)
    s = ends(F.col("line"))
    cells = F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), ends)
    rule = F.col("line").rlike(r"^\s*\|?[\s:|-]+\|?\s*$")
    rows = rows.withColumn("cells", F.when(F.col("piped") & ~rule, cells))
    junk = lambda c: c.isin("", "•", "-", "*", "Ø") | (F.length(c) <= 1)
    run = Window.partitionBy("doc", "piped", "run")
    n_junk = F.sum(F.coalesce(F.size(F.filter("cells", junk)), F.lit(0))).over(run)
    n_real = F.sum(F.coalesce(F.size(F.filter("cells", lambda c: ~junk(c))), F.lit(0))).over(run)
    lead = F.max(F.when(F.col("cells").isNotNull(), s.rlike(r"^(?:\|\||\|•|\| \|)")).otherwise(False)).over(run)
    fake = F.col("piped") & (n_real > 0) & (lead | (n_junk >= 0.3 * (n_junk + n_real)))
    rows = rows.withColumn("fake", fake)
    items = F.transform(F.filter(F.coalesce("cells", F.array().cast("array<string>")), lambda c: ~junk(c)), lambda c: F.concat(F.lit("- "), c))
    return rows.select("doc", "no", F.posexplode(F.when(F.col("fake"), items).otherwise(F.array("line"))).alias("sub", "line"))


def with_whole_headings(lines: DataFrame) -> DataFrame:
    """Lines (doc, no, line) with headings that are wrapped put together: one of one or two words after another of the same level that doesn't end
    in ``: . ? )``. Runs come from a window over the lines that are not blank."""
    solid = lines.where(ends(F.col("line")) != "")
    level, text = F.regexp_extract(ends(F.col("line")), HEADING, 1), F.trim(F.regexp_extract(ends(F.col("line")), HEADING, 2))
    rows = solid.withColumns({"level": level, "text": text})
    order = Window.partitionBy("doc").orderBy("no")
    wraps = (F.col("level") != "") & (F.col("level") == F.lag("level").over(order)) & (F.size(blanks(F.col("text"))) <= 2) & ~F.col("text").rlike(r"[:.?]$") & ~F.lag("text").over(order).rlike(r"[:.?)]$")
    rows = rows.withColumn("fresh", (~F.coalesce(wraps, F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s["text"])
    merged = rows.groupBy("doc", "run").agg(F.min("no").alias("no"), F.count(F.lit(1)).alias("n"), F.min_by("line", "no").alias("line"), F.first("level").alias("level"), F.array_join(whole, " ").alias("text"))
    line = F.when(F.col("n") > 1, F.concat_ws(" ", "level", "text")).otherwise(F.col("line"))
    last = rows.groupBy("doc", "run").agg(F.max("no").alias("end"), F.min("no").alias("no"))
    blank = lines.where(ends(F.col("line")) == "").select("doc", "no", "line")
    inside = last.where("end > no").select("doc", F.col("no").alias("lo"), F.col("end").alias("hi"))
    # blank lines between the parts of one heading go with them: a document has few such runs
    gone = blank.alias("b").join(inside.alias("i"), (F.col("b.doc") == F.col("i.doc")) & (F.col("b.no") > F.col("i.lo")) & (F.col("b.no") < F.col("i.hi")), "left_anti")
    return merged.select("doc", "no", line.alias("line")).unionByName(gone)


def sections_of(texts: DataFrame, max_level: int = 2) -> DataFrame:
    """(doc, section, title, level, text): a heading up to ``max_level`` that is no junk opens a section; what stands before the first is kept if it is
    not blank. Sections without a title, or called a page, take the last real one before."""
    rows = lines_of(texts).withColumn("s", ends(F.col("line")))
    level, title = F.length(F.regexp_extract("s", HEADING, 1)), F.trim(F.regexp_extract("s", HEADING, 2))
    rows = rows.withColumns({"level": level, "title": title})
    rows = rows.withColumn("opens", F.col("level").between(1, max_level) & ~junk_heading(F.col("title")))
    order = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum(F.col("opens").cast("int")).over(order))
    body = F.when(F.col("opens"), F.lit(None)).when(F.col("level") > 0, F.col("title")).otherwise(F.col("line"))
    rows = rows.withColumn("body", body)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("no", "body")))), lambda x: x["body"]), "\n")
    made = rows.groupBy("doc", "part").agg(F.coalesce(F.max(F.when(F.col("opens"), F.col("title"))), F.lit("")).alias("title"), F.coalesce(F.max(F.when(F.col("opens"), F.col("level"))), F.lit(0)).alias("level"), ends(text).alias("text"))
    kept = made.where("title <> '' OR text <> ''")
    real = F.when((F.col("title") != "") & ~F.col("title").rlike(PAGE_TITLE), F.col("title"))
    seen = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inherited = F.coalesce(real, F.last(real, ignorenulls=True).over(seen), F.col("title"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("part"))
    return kept.select("doc", place.alias("section"), inherited.alias("title"), "level", "text")


def merged_sections(sections: DataFrame, most: int = MERGED_CHARS) -> DataFrame:
    """(doc, section, title, text): runs of equal titles put together while their text has room for it: a fold over a document's sections."""
    kind = "array<struct<title:string,text:string>>"
    rows = sections.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "title", "text"))), lambda s: F.struct(s["title"], s["text"])).cast(kind).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (x["title"] != "") & (F.lower(F.trim(x["title"])) == F.lower(F.trim(last["title"]))) & (F.length(last["text"]) + F.length(x["text"]) <= most)
        text = F.when(x["text"] == "", last["text"]).otherwise(ends(F.concat(F.regexp_replace(last["text"], r"\s+$", ""), F.lit("\n"), x["text"])))
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["title"].alias("title"), text.alias("text"))))
        return F.when(same, merged).otherwise(F.concat(acc, F.array(x)))

    folded = F.aggregate("s", F.array().cast(kind), step)
    return rows.select("doc", F.posexplode(folded).alias("p", "x")).select("doc", (F.col("p") + 1).alias("section"), "x.title", "x.text")


def parsed_units(sections: DataFrame) -> DataFrame:
    """Sections as units: number, title (``Section n`` where there is none) and how many lines have text."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: ends(x) != ""))
    return sections.select("doc", F.col("section").alias("unit"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Section "), F.col("section").cast("string"))).alias("title"), lines.alias("n_lines"), "text")


def paragraphs(units: DataFrame) -> DataFrame:
    """(doc, unit, para, text): blank lines and headings part paragraphs; a list's items keep their lines and take in lines that go on; a table is whole
    up to a blank line or heading. A fold over a unit's lines with what is open and of what kind."""
    kind = "struct<out:array<string>,cur:array<string>,mode:string>"
    item = lambda x: x.rlike(LIST_ITEM)

    def close(s: Column) -> Column:
        text = F.when(s["mode"] == "text", F.array_join(s["cur"], " ")).otherwise(F.array_join(s["cur"], "\n"))
        return F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(text))).otherwise(s["out"])

    def state(out: Column, cur: Column, mode: str) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), F.lit(mode).alias("mode"))

    def step(s: Column, x: Column) -> Column:
        t, none = ends(x), F.array().cast("array<string>")
        body = F.trim(F.regexp_extract(x, LIST_ITEM, 1))
        add = F.when(body != "", F.array(body)).otherwise(none)
        in_table, in_list = s["mode"] == "table", s["mode"] == "list"
        onward = F.concat(F.slice(s["cur"], F.lit(1), F.greatest(F.size(s["cur"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(s["cur"], -1), F.lit(" "), t)))
        return (
            F.when(in_table & F.startswith(t, F.lit("##")), state(close(s), F.array(t), "text"))
            .when(in_table & (t == ""), state(close(s), none, "text"))
            .when(in_table, state(s["out"], F.concat(s["cur"], F.array(t)), "table"))
            .when(item(x) & in_list, state(s["out"], F.concat(s["cur"], add), "list"))
            .when(item(x), state(close(s), add, "list"))
            .when(in_list & (t != ""), F.when(F.size(s["cur"]) > 0, state(s["out"], onward, "list")).otherwise(s))
            .when(t == TABLE_MARK, state(close(s), F.array(t), "table"))
            .when(F.startswith(t, F.lit("## ")), state(close(s), F.array(F.trim(F.regexp_replace(t, "^[# ]+", ""))), "text"))
            .when(t == "", state(close(s), none, "text"))
            .otherwise(state(s["out"], F.concat(s["cur"], F.array(t)), "text"))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit("text").alias("mode")).cast(kind)
    found = F.filter(F.aggregate(F.split("text", "\n"), start, lambda s, x: step(s, x).cast(kind), close), lambda p: ends(p) != "")
    rows = units.select("doc", "unit", F.posexplode_outer(found).alias("para", "text")).where("text IS NOT NULL")
    return rows.select("doc", "unit", (F.col("para") + 1).alias("para"), "text")


def chunks(paras: DataFrame, most: int = CHUNK_WORDS) -> DataFrame:
    """(doc, unit, para, piece, text): paragraphs of up to ``most`` words and tables whole; longer ones by lines, filled up in order, or one line by windows."""
    words = lambda t: F.size(blanks(t))
    lines = F.filter(F.split("text", "\n"), lambda x: ends(x) != "")
    kind = "array<struct<text:string,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        last, n = F.element_at(acc, -1), words(x)
        fits = (F.size(acc) > 0) & (last["n"] + n <= most)
        grown = F.struct(F.concat(last["text"], F.lit("\n"), x).alias("text"), (last["n"] + n).alias("n"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(x.alias("text"), n.alias("n"))))).cast(kind)

    by_line = F.transform(F.aggregate(lines, F.array().cast(kind), step), lambda s: s["text"])
    all_words = blanks(F.col("text"))
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_words) - 1, F.lit(0)), F.lit(most)), lambda i: F.array_join(F.slice(all_words, i + 1, F.lit(most)), " "))
    whole = F.startswith("text", F.lit(TABLE_MARK)) | F.contains("text", F.lit(" | ")) | (words(F.col("text")) <= most)
    pieces = F.when(whole, F.array("text")).when(F.size(lines) > 1, by_line).otherwise(windows)
    return paras.select("doc", "unit", "para", F.posexplode(pieces).alias("piece", "text"))


def chunks_by_heading(chunk_rows: DataFrame) -> DataFrame:
    """(doc, place, title, text): chunks (doc, source, chunk, title, text) of one source put together in order, then neighbours of one heading, under the
    longer of their titles: a fold over a document's sources."""
    kind = "array<struct<title:string,text:string>>"
    body = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda s: s["text"]), lambda t: t != "")
    sources = chunk_rows.groupBy("doc", "source").agg(F.min("chunk").alias("first"), F.min_by("title", "chunk").alias("title"), F.array_join(body, "\n").alias("text"))
    rows = sources.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "title", "text"))), lambda s: F.struct(s["title"], s["text"])).cast(kind).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        text = F.when(x["text"] == "", last["text"]).otherwise(F.concat(last["text"], F.lit("\n"), x["text"]))
        title = F.when(F.length(x["title"]) > F.length(last["title"]), x["title"]).otherwise(last["title"])
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(title.alias("title"), text.alias("text"))))
        return F.when((F.size(acc) > 0) & same_heading(last["title"], x["title"]), merged).otherwise(F.concat(acc, F.array(x)))

    return rows.select("doc", F.posexplode(F.aggregate("s", F.array().cast(kind), step)).alias("place", "x")).select("doc", "place", "x.title", "x.text")


def table_segments(texts: DataFrame) -> DataFrame:
    """(doc, segment, kind, caption, n_rows, text): runs of piped lines that are tables (a row of marks and two others) with the bold line before them as
    their caption, and the prose between."""
    rows = lines_of(texts).withColumn("s", ends(F.col("line"))).where(F.col("s") != TABLE_MARK)
    rows = rows.withColumn("piped", F.col("s").rlike(r"^\|.*\|$"))
    cells = F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), ends)
    rows = rows.withColumn("marks", F.col("piped") & F.forall(cells, lambda c: (c == "") | c.rlike(r"^:?-{2,}:?$")))
    order = Window.partitionBy("doc").orderBy("no")
    rows = rows.withColumn("run", F.row_number().over(order) - F.row_number().over(Window.partitionBy("doc", "piped").orderBy("no")))
    run = Window.partitionBy("doc", "piped", "run")
    table = F.col("piped") & F.max("marks").over(run) & (F.sum((~F.col("marks")).cast("int")).over(run) >= 2) & (F.count(F.lit(1)).over(run) >= 3)
    rows = rows.withColumn("table", table)
    rows = rows.withColumn("fresh", (F.col("table") != F.coalesce(F.lag("table").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("fresh", F.when(F.col("table") & (F.col("fresh") == 0) & (F.col("run") != F.lag("run").over(order)), 1).otherwise(F.col("fresh")))
    rows = rows.withColumn("seg", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])
    segs = rows.groupBy("doc", "seg").agg(F.max("table").alias("table"), F.sum((F.col("table") & ~F.col("marks")).cast("int")).alias("n"), body.alias("lines"))
    by_seg = Window.partitionBy("doc").orderBy("seg")
    text = ends(F.array_join("lines", "\n"))
    last = F.regexp_extract(text, r"(?:^|\n)[ \t]*\*\*([^\n]+)\*\*[ \t]*$", 1)
    segs = segs.withColumns({"text": text, "bold": F.when(~F.col("table"), last).otherwise("")})
    segs = segs.withColumns({"caption": F.when(F.col("table"), F.coalesce(F.lag("bold").over(by_seg), F.lit(""))).otherwise(""), "before_table": F.coalesce(F.lead("table").over(by_seg), F.lit(False))})
    prose = F.when(F.col("before_table") & (F.col("bold") != ""), ends(F.regexp_replace("text", r"(?:^|\n)[ \t]*\*\*[^\n]+\*\*[ \t]*$", ""))).otherwise(F.col("text"))
    kept = segs.select("doc", "seg", "table", "caption", F.when(F.col("table"), F.col("n") - 1).otherwise(0).alias("n_rows"), F.when(F.col("table"), F.col("text")).otherwise(prose).alias("text")).where("table OR text <> ''")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("seg"))
    return kept.select("doc", place.alias("segment"), F.when(F.col("table"), "table").otherwise("prose").alias("kind"), "caption", "n_rows", "text")


def loose_table(text: Column) -> Column:
    """Rows of cells of all lines with two pipes or more, padded to one width, rows of marks left out; null under two rows."""
    piped = F.filter(F.transform(F.split(text, "\n"), ends), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)
    cells = F.transform(piped, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), ends))
    rows = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")) & F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(rows, F.size))
    return F.when(F.size(rows) >= 2, F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(doc, markdown) of pages (doc, page, kind, title, items: level and text): a heading a page, its items as nested lists; title pages are left out and
    a page without a title goes on with the last."""
    seen = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    own = F.nullif(F.coalesce("title", F.lit("")), F.lit(""))
    title = F.coalesce(own, F.last(own, ignorenulls=True).over(seen), F.concat(F.lit("Slide "), F.col("page").cast("string")))
    rows = pages.withColumn("head", title).where("kind <> 'title'")
    items = F.transform("items", lambda it: F.concat(F.repeat(F.lit("  "), it["level"]), F.lit("- "), it["text"]))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.col("head")), F.lit("")), items, F.array(F.lit(""))), "\n")
    body = F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("b")))), lambda s: s["b"])
    return rows.groupBy("doc").agg(ends(F.array_join(body, "\n")).alias("markdown"))


def without_fragments(lines: DataFrame, tables: DataFrame, share: float = 0.85) -> DataFrame:
    """Lines (doc, no, line) without those of whose words ``share`` are words of the document's tables (doc, cell): a broken copy of them. Headings and
    lines without words stay."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    known = tables.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list(words(F.col("cell"))))).alias("known"))
    rows = lines.join(known, "doc", "left").withColumn("w", words(F.col("line")))
    rows = rows.withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    inside = F.size(F.filter("w", lambda x: F.array_contains("known", x)))
    copied = (F.size("w") > 0) & (inside >= share * F.size("w")) & ~F.startswith("line", F.lit("##"))
    return rows.where(~copied).select("doc", "no", "line")
