"""Enumerations in texts: runs of marked lines, claims of a number of things, lists within a sentence, blocks of short lines, headers with what follows; and texts
whose items have explanations of their own as an overview and a section an item. Lines are numbered islands of windows over a document; what depends on what was
kept before is a fold over the document's own headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import blanks, ends
from deckloom.functions.text import as_sql, upper_letter
from deckloom.operators.markdown import lines_of

# Number words, the nouns that announce items, marks of items, and the patterns that hold them.
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
KINDS = (
    r"phases?|stages?|steps?|levels?|types?|kinds?|categories|category|classes|components?|elements?|parts?|layers?|methods?|techniques?|approaches?|applications?|advantages?|benefits?|disadvantages?|limitations?|"
    r"drawbacks?|features?|properties|principles?|rules?|factors?|characteristics?|examples?|forms?|models?|algorithms?|tasks?"
)
CLAIM = (
    r"(?i)((?:there\s+are|there\s+exist|has|have|the|following)\s+(?:are\s+)?(\d{1,2}|" + "|".join(NUMBER_WORDS) + r")\s+(?:main\s+|key\s+|basic\s+|core\s+|primary\s+|major\s+)?(" + KINDS + r")\b[^.:\n]*)[:.]?"
)
HEADER = r"(?i)^\s*((?:the\s+)?(?:main\s+|key\s+|core\s+)?(?:[\p{L}\p{N}_ /&'-]+\s+)?(" + KINDS + r")(?:\s+(?:of|in|for)\s+[\p{L}\p{N}_ /&'-]+)?)\s*[:：]\s*$"
MARKED = r"^\s*(?:\(?(\d{1,2})[.)]\s+|([a-hA-H])[.)]\s+|[-*+•▪◦‣]\s+)(.+)$"
BETWEEN = r"\s*(?:,|;| and | or |&)\s*"
LED = (
    r"\b([\p{L}\p{N}_ /&'-]{2,50}?\s+(?:[Ii]nvolves?|[Ii]ncludes?|[Cc]onsists?\s+of|[Cc]omprises?|[Cc]ontains?|[Cc]overs?|are|namely|such\s+as|like)\s*[:—-]?)\s+"
    r"([A-Z][\p{L}\p{N}_()'’./&\- ]+(?:\s*(?:,|;| and | or )\s*[A-Za-z(][\p{L}\p{N}_()'’./&\- ]+){2,})"
)
#: What every text with a match of ``LED`` and every line with one of ``HEADER`` has; cheap to ask first.
LED_CUE = r"\s(?:[Ii]nvolves?|[Ii]ncludes?|[Cc]onsists?\s+of|[Cc]omprises?|[Cc]ontains?|[Cc]overs?|are|namely|such\s+as|like)\s*[:—-]?\s+[A-Z]"
HEADER_END = r"[:：]\s*$"
ITEM_MARKS = r"^\s*(?:\(?\d{1,2}[.)]\s*|[a-hA-H][.)]\s*|[-*+•▪◦‣]\s*)+"
JOINING, AND_SO_ON = r"(?i)^\s*(?:and|or)\s+", r"(?i)\s+(?:etc\.?|and\s+so\s+on)\s*$"
AND_SO_ON_LINE = r"(?i)\s+(?:etc\.?|and\s+so\s+on\.?)\s*$"
RIM = r"^[ \t.;:\-–—•]+|[ \t.;:\-–—•]+$"
LABEL = r"^([A-Z][\p{L}\p{N}_()/&'’.\- ]{1,44}?)\s*[-–—:]\s+\S"
SPLIT_KINDS = r"(?i)\b(phase|stage|step|level|method|technique|approach|type|kind|component|category|class|layer|model|algorithm)s?\b"
NUMBER_MARK = r"(?i)^\s*(?:\(?\d{1,2}[.)]|[ivx]+[.)]|[-*+•])\s+"
PREDICATE = r"(?i)\b(involves?|includes?|consists?|uses?|helps?|allows?|enables?|provides?|refers?|means|describes?|acts?|converts?|performs?|following|such as|for example|e\.?g\.?|there (?:is|are))\b"
SUBJECTS = r"(?i)\b(analysis|parsing|integration|translation|recognition|retrieval|generation|understanding|disambiguation|tokeniz[\p{L}\p{N}_]+|embedding)\b"
STEP = r"(?i)^\s*(?:(?:step|phase|stage|part|item|point)\s*\d+|\d+[.:)]\s+|[a-z][.:)]\s+|[ivxlcdm]+[.:)]\s+|\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b)"
TAIL, AHEAD, STEPS = 400, 13, 10

STYLES = ("run", "claim", "inline", "block", "header")


def clean_item(text: Column) -> Column:
    """An item without marks, joining words and rims; only its label where an explanation follows one of up to six words."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, as_sql(ITEM_MARKS), ""), as_sql(JOINING), ""), as_sql(AND_SO_ON), ""), as_sql(RIM), "")
    label = ends(F.regexp_extract(s, as_sql(LABEL), 1))
    return F.when((label != "") & (F.size(blanks(label)) <= 6), label).otherwise(s)


def item_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def distinct_items(items: Column) -> Column:
    """The first of items that are alike but for case and signs; those without letters or digits go."""
    keys = F.transform(items, item_key)
    return F.filter(items, lambda x, i: (item_key(x) != "") & (F.array_position(keys, item_key(x)) == i + 1))


def kind_of(lead: Column) -> Column:
    return F.lower(F.regexp_extract(lead, as_sql(f"(?i)({KINDS})"), 1))


def _alpha(x: Column) -> Column:
    return x.rlike(r"^\p{L}")


def _marked_runs(rows: DataFrame) -> DataFrame:
    """Runs of marked lines of each document: a run starts at the first marked line of an island without blank lines and headings; lines without a mark go on with the item before."""
    order = Window.partitionBy("doc").orderBy("no")
    stop = (F.trim("line") == "") | F.startswith("line", F.lit("#"))
    before = [F.nullif(ends(F.lag("line", k).over(order)), F.lit("")) for k in (1, 2, 3)]
    rows = rows.withColumns({"stop": stop, "marked": F.col("line").rlike(as_sql(MARKED)), "lead": F.regexp_replace(F.coalesce(*before, F.lit("")), as_sql("[:.]+$"), "")})
    rows = rows.withColumn("island", F.sum(F.col("stop").cast("int")).over(order)).where("NOT stop")
    inside = Window.partitionBy("doc", "island").orderBy("no")
    rows = rows.withColumn("item", F.sum(F.col("marked").cast("int")).over(inside)).where("item > 0")
    text = F.when(F.col("marked"), clean_item(F.regexp_extract("line", as_sql(MARKED), 3))).otherwise(ends(F.col("line")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))), lambda p: p["t"])
    items = rows.groupBy("doc", "island", "item").agg(F.min("no").alias("no"), F.min_by("lead", "no").alias("lead"), F.min_by("line", "no").alias("line"), ends(F.array_join(parts, " ")).alias("text"))
    every = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda p: p["text"]), lambda x: F.length(x) >= 2)
    found = items.groupBy("doc", "island").agg(F.min("no").cast("long").alias("at"), F.min_by("lead", "no").alias("lead"), F.min_by("line", "no").alias("line"), distinct_items(every).alias("items"))
    style = F.when(F.col("line").rlike(as_sql(r"^\s*\(?\d")), "numbered").otherwise("bulleted")
    return found.select("doc", F.lit(0).alias("source"), "at", style.alias("style"), kind_of(F.col("lead")).alias("kind"), "lead", F.lit(None).cast("int").alias("claimed"), "items")


def _short_lines(rows: DataFrame) -> DataFrame:
    """Islands of at least three short lines that end like no sentence, of which 70 % begin with a capital."""
    s = F.regexp_replace(ends(F.col("line")), as_sql(AND_SO_ON_LINE), "")
    n = F.size(blanks(s))
    short = (s != "") & n.between(1, 8) & ~s.rlike(as_sql(r"[.!?]$")) & ~F.startswith(s, F.lit("#")) & (F.length(s) <= 60)
    # lines are numbered without gaps, so only short ones need to meet
    rows = rows.withColumns({"s": s, "short": short}).where("short").select("doc", "no", "s")
    rows = rows.withColumn("island", F.col("no") - F.row_number().over(Window.partitionBy("doc").orderBy("no")))
    every = F.transform(F.array_sort(F.collect_list(F.struct("no", "s"))), lambda p: clean_item(p["s"]))
    found = rows.groupBy("doc", "island").agg(F.min("no").cast("long").alias("at"), F.count(F.lit(1)).alias("n"), distinct_items(every).alias("items")).where("n >= 3")
    kept = F.filter("items", lambda x: F.size(blanks(x)).between(1, 7) & _alpha(x))
    found = found.select("doc", F.lit(3).alias("source"), "at", F.lit("list").alias("style"), F.lit("").alias("kind"), F.lit("").alias("lead"), F.lit(None).cast("int").alias("claimed"), kept.alias("items"))
    return found.where(F.size(F.filter("items", lambda x: x.rlike(r"^\p{Lu}"))) >= 0.7 * F.size("items"))


def _headed(rows: DataFrame) -> DataFrame:
    """What follows a line like ``Types of x:`` within ``AHEAD`` lines, up to a blank line or heading once there is something."""
    ahead = Window.partitionBy("doc").orderBy("no").rowsBetween(1, AHEAD)
    rows = rows.withColumn("next", F.collect_list("line").over(ahead)).where(F.col("line").rlike(as_sql(HEADER)))
    flags = F.array_join(F.transform("next", lambda x: F.when((ends(x) == "") | F.startswith(ends(x), F.lit("#")), "0").otherwise("1")), "")
    skipped, taken = F.length(F.regexp_extract(flags, "^(0*)(1*)", 1)), F.length(F.regexp_extract(flags, "^(0*)(1*)", 2))
    block = distinct_items(F.transform(F.slice("next", skipped + 1, taken), lambda x: clean_item(ends(x))))
    items = F.filter(block, lambda x: (F.length(x) >= 2) & (F.size(blanks(x)) <= 12))
    return rows.select("doc", F.lit(4).alias("source"), F.col("no").cast("long").alias("at"), F.lit("header").alias("style"), F.lower(F.regexp_extract("line", as_sql(HEADER), 2)).alias("kind"), F.trim(F.regexp_extract("line", as_sql(HEADER), 1)).alias("lead"), F.lit(None).cast("int").alias("claimed"), items.alias("items"))


def _claims(texts: DataFrame) -> DataFrame:
    """Sentences that claim a number of things, with the list that follows in the same sentence: the claim closes it at one item more than it counts."""
    marked = F.split(F.regexp_replace("text", as_sql(CLAIM), "\u0001$0\u0003"), "\u0001")
    rows = texts.select("doc", marked.alias("p")).select("doc", "p", F.posexplode_outer("p").alias("at", "x")).where("at > 0")
    match, gap = F.split_part("x", F.lit("\u0003"), F.lit(1)), F.split_part("x", F.lit("\u0003"), F.lit(2))
    later = F.replace(F.array_join(F.slice("p", F.col("at") + 2, F.size("p")), ""), F.lit("\u0003"), F.lit(""))
    tail = F.split_part(F.substring(F.concat(gap, later), 1, TAIL), F.lit("."), F.lit(1))
    items = distinct_items(F.filter(F.transform(F.split(tail, as_sql(BETWEEN)), clean_item), lambda x: F.size(blanks(x)).between(1, 8) & _alpha(x)))
    count = F.lower(F.regexp_extract(match, as_sql(CLAIM), 2))
    n = F.coalesce(count.try_cast("int"), F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), count).cast("int") + 1)
    rows = rows.select("doc", F.lit(1).alias("source"), F.col("at").cast("long").alias("at"), F.lit("inline").alias("style"), F.lower(F.regexp_extract(match, as_sql(CLAIM), 3)).alias("kind"), ends(F.regexp_extract(match, as_sql(CLAIM), 1)).alias("lead"), n.alias("claimed"), items.alias("items"))
    return rows.where((F.col("claimed") > 0) & (F.size("items") >= F.greatest(F.lit(3), F.col("claimed") - 1))).withColumn("items", F.slice("items", F.lit(1), F.col("claimed") + 1))


def _led_lists(texts: DataFrame) -> DataFrame:
    """Lists within a sentence after words like ``includes``."""
    # what leads is found first: few texts have any, and only those are read for what follows
    led = texts.where(F.col("text").rlike(as_sql(LED_CUE))).select("doc", "text", F.regexp_extract_all("text", F.lit(as_sql(LED)), F.lit(1)).alias("lead"))
    pairs = F.when(F.size("lead") > 0, F.arrays_zip("lead", F.regexp_extract_all("text", F.lit(as_sql(LED)), F.lit(2)).alias("body")))
    rows = led.select("doc", F.posexplode_outer(pairs).alias("at", "p")).where("at IS NOT NULL")
    items = distinct_items(F.filter(F.transform(F.split("p.body", as_sql(BETWEEN)), clean_item), lambda x: _alpha(x) & F.size(blanks(x)).between(1, 6)))
    lead = F.regexp_replace("p.lead", as_sql("^[ :—-]+|[ :—-]+$"), "")
    return rows.select("doc", F.lit(2).alias("source"), F.col("at").cast("long").alias("at"), F.lit("inline").alias("style"), kind_of(F.col("p.lead")).alias("kind"), lead.alias("lead"), F.lit(None).cast("int").alias("claimed"), items.alias("items"))


def _with_line(texts: DataFrame, pattern: str, needed: str | None = None) -> DataFrame:
    """(doc, no, line) of the texts that have a line of a pattern (asked only of lines with the ``needed`` one): windows over lines are kept to those."""
    has = lambda x: F.regexp_replace(x, as_sql(r"\s+$"), "").rlike(as_sql(pattern))
    return _lines(texts.where(F.exists(F.split("text", "\n"), lambda x: has(x) if needed is None else x.rlike(as_sql(needed)) & has(x))))


def _lines(texts: DataFrame) -> DataFrame:
    return lines_of(texts).withColumn("line", F.regexp_replace("line", as_sql(r"\s+$"), ""))


def enumerations(texts: DataFrame) -> DataFrame:
    """(doc, place, style, kind, lead, claimed, items, reliable) of every enumeration of the texts (doc, text): three items at least, as they are written, once each; of equal sets of items
    the first. ``reliable``: as many items as claimed, give or take one. Null and empty texts have none."""
    texts = texts.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    found = _marked_runs(_with_line(texts, MARKED))
    for part in (_claims(texts), _led_lists(texts), _short_lines(_lines(texts)), _headed(_with_line(texts, HEADER, HEADER_END))):
        found = found.unionByName(part)
    found = found.where(F.size("items") >= 3).withColumn("key", F.array_join(F.array_sort(F.array_distinct(F.transform("items", item_key))), "|"))
    first = F.row_number().over(Window.partitionBy("doc", "key").orderBy("source", "at"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("source", "at"))
    found = found.withColumn("first", first).where("first = 1").withColumn("place", place)
    reliable = F.col("claimed").isNull() | (F.abs(F.col("claimed") - F.size("items")) <= 1)
    return found.select("doc", "place", "style", "kind", "lead", "claimed", "items", reliable.alias("reliable"))


def _is_heading(line: Column, after: Column) -> Column:
    """Whether a line names an item and the next one explains it."""
    s = F.regexp_replace(ends(F.regexp_replace(line, as_sql(NUMBER_MARK), "")), as_sql(":+$"), "")
    n, n_after = F.size(blanks(s)), F.coalesce(F.size(blanks(after)), F.lit(0))
    words = F.filter(blanks(s), _alpha)
    numbered = line.rlike(as_sql(NUMBER_MARK))
    label = numbered | F.coalesce(F.get(words, F.lit(0)).rlike(r"^\p{Lu}"), F.lit(False)) | s.rlike(as_sql(SPLIT_KINDS)) | s.rlike(as_sql(SUBJECTS))
    names = n.between(1, 7) & (F.length(s) <= 60) & ~s.rlike(as_sql(r"[.!?]$")) & ~((n >= 4) & s.rlike(as_sql(PREDICATE))) & (F.size(words) > 0) & label
    return names & ((n_after >= 6) | (numbered & (n_after >= 4)))


def item_sections(texts: DataFrame) -> DataFrame:
    """(doc, place, total, kind, title, text, overview) of the texts (doc, title, text) that explain the items of an enumeration one by one: an overview of what stands before and the items' names, then
    a section an item. Texts of another shape have no rows.

    A heading counts once: one whose letters lie in an earlier one's, or hold them, goes on with it. Every line of such a text is in the overview or in one section.
    """
    texts = texts.select("doc", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    hinted = enumerations(texts.select("doc", "text")).where(F.when(F.col("kind") != "", F.col("kind")).otherwise(F.col("lead")).rlike(as_sql(SPLIT_KINDS)) & (F.col("kind") != ""))
    hinted = hinted.groupBy("doc").agg(F.min_by("kind", "place").alias("hint"))
    lines = F.filter(F.transform(F.split("text", "\n"), ends), lambda x: x != "")
    rows = texts.withColumn("lines", lines).where(F.size("lines") >= 6).join(hinted, "doc", "left")
    kind = F.coalesce(F.nullif(kind_of(F.col("title")), F.lit("")), F.col("hint"), F.lit(""))
    in_title = F.regexp_extract("title", as_sql(SPLIT_KINDS), 0)
    rows = rows.withColumn("kind", kind).where(F.col("kind").rlike(as_sql(SPLIT_KINDS)) | (in_title != "")).withColumn("kind", F.when(F.col("kind") != "", F.col("kind")).otherwise(in_title))
    heads = F.transform("lines", lambda x, i: F.struct(i.alias("i"), _is_heading(x, F.get("lines", i + 1)).alias("head"), F.regexp_replace(ends(F.regexp_replace(x, as_sql(NUMBER_MARK), "")), as_sql("[:.]+$"), "").alias("label")))
    own = item_key(F.col("title"))
    named = F.filter(heads, lambda h: h["head"] & (item_key(h["label"]) != "") & (item_key(h["label"]) != own))
    rows = rows.withColumn("named", named)
    kind_of_state = "array<struct<i:int,head:boolean,label:string>>"

    def step(kept: Column, h: Column) -> Column:
        known = F.exists(kept, lambda k: F.contains(item_key(k["label"]), item_key(h["label"])) | F.contains(item_key(h["label"]), item_key(k["label"])))
        return F.when(known, kept).otherwise(F.array_append(kept, h))

    rows = rows.withColumn("heads", F.aggregate("named", F.array().cast(kind_of_state), step)).where(F.size("heads") >= 3)
    spans = F.transform(F.slice("heads", F.lit(1), F.size("heads") - 1), lambda h, k: F.get("heads", k + 1)["i"] - h["i"])
    rows = rows.where(F.size(F.filter(spans, lambda s: s >= 2)) >= 0.6 * (F.size("heads") - 1))
    n = F.size("heads")
    before = F.slice("lines", F.lit(1), F.get("heads", F.lit(0))["i"])
    overview = F.struct(F.lit(0).alias("place"), F.trim(F.concat("title", F.lit(" — the "), n.cast("string"), F.lit(" "), "kind")).alias("title"), F.array_join(F.concat(before, F.transform("heads", lambda h: F.concat(F.lit("- "), h["label"]))), "\n").alias("text"))
    word = F.regexp_replace("kind", "s+$", "")
    word = F.concat(upper_letter(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 100)))

    def section(h: Column, k: Column) -> Column:
        end = F.when(k + 1 < n, F.get("heads", k + 1)["i"]).otherwise(F.size("lines"))
        title = F.concat(word, F.lit(" "), (k + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit(": "), h["label"])
        return F.struct((k + 1).alias("place"), title.alias("title"), F.array_join(F.slice("lines", h["i"] + 1, end - h["i"]), "\n").alias("text"))

    every = F.concat(F.array(overview), F.transform("heads", section))
    rows = rows.select("doc", n.alias("total"), "kind", F.explode(every).alias("s"))
    return rows.select("doc", "s.place", "total", "kind", "s.title", "s.text", (F.col("s.place") == 0).alias("overview"))


def steps(texts: DataFrame, most: int = STEPS) -> DataFrame:
    """(doc, pos, item) of lines that begin as steps (``Step 1``, ``2)``, ``iv.``, ``third``): first without their marks, then as they are written where they are no headings; each once, case aside, the first ``most``."""
    rows = lines_of(texts.select("doc", F.coalesce("text", F.lit("")).alias("text"))).withColumn("s", ends(F.col("line"))).where(F.col("s").rlike(as_sql(STEP)))
    bare = rows.where(F.length("s") > 4).select("doc", F.lit(0).alias("source"), "no", ends(F.regexp_replace("s", as_sql(STEP), "")).alias("item")).where("item <> ''")
    whole = rows.where(~F.startswith("s", F.lit("#"))).select("doc", F.lit(1).alias("source"), "no", F.col("s").alias("item"))
    found = bare.unionByName(whole)
    once = F.row_number().over(Window.partitionBy("doc", F.lower("item")).orderBy("source", "no"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("source", "no"))
    return found.withColumn("once", once).where("once = 1").select("doc", place.alias("pos"), "item").where(F.col("pos") <= most)
