"""Decks to pages: redundant bullets, groups of sentences, siblings, thin and repeated slides, pages of bullets and tables.

What depends on the order of what was kept before is a fold over a deck's (or slide's) own array, never over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import LABEL_STOP, blanks, ends, let

# Sentences that lean on the one before, ones that announce what follows, names that say nothing.
CONTINUES = (
    r"(?i)^(?:however|therefore|thus|hence|consequently|as a result|for example|for instance|in addition|moreover|furthermore|also|similarly|likewise|otherwise|instead|nevertheless|in contrast|"
    r"on the other hand|this|these|those|such|it|they|its|their|both|each of|in other words|that is|as a consequence|because of this|to do this|to achieve this)\b"
)
INTRO = r"(?i)[:]\s*$|\b(?:following|as follows|below|these are)\b[^.]*$"
NUMBERED = r"^\s*(\d+)(?:\.\d+)*[.)]?\s"
PART = r"\s*\(\d+/\d+\)\s*$"
GENERIC = r"(?i)^(?:section|page|slide|overview|contents?|course contents?|agenda|outline|index)\s*\d*$"
UNNAMED = r"(?i)^(?:section|page|slide)\s*\d+$"
#: Words of a part, of a thin slide, and bullets of a merged one.
MAX_WORDS, THIN_WORDS, MERGED_BULLETS = 110, 24, 6

STRINGS = "array<string>"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def _without_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def _words(items: Column) -> Column:
    return F.size(blanks(F.array_join(items, " ")))


def unrepeated_bullets(bullets: Column) -> Column:
    """Bullets that say something beside those kept before: not empty or equal, no fragment of up to six words of another, and not another with up to
    fourteen characters more."""
    kind = "array<struct<raw:string,norm:string,n:int,few:boolean>>"
    wide = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    inside = lambda s, t: F.contains(wide(t), wide(s))

    def step(kept: Column, x: Column) -> Column:
        # lengths and words are counted once a bullet, not for each pair
        shorter = lambda k: (x["n"] >= 4) & x["few"] & (x["n"] <= k["n"]) & inside(x["norm"], k["norm"])
        longer = lambda k: (k["n"] >= 4) & (x["n"] > k["n"]) & (x["n"] <= k["n"] + 14) & inside(k["norm"], x["norm"])
        said = F.exists(kept, lambda k: (k["norm"] == "") | (k["norm"] == x["norm"]) | shorter(k) | longer(k))
        return F.when((x["norm"] == "") | said, kept).otherwise(F.concat(kept, F.array(x)))

    norms = F.transform(bullets, lambda b: F.struct(b.alias("raw"), plain(b).alias("norm")))
    pairs = F.transform(norms, lambda p: F.struct(p["raw"].alias("raw"), p["norm"].alias("norm"), F.length(p["norm"]).alias("n"), (F.size(blanks(p["norm"])) <= 6).alias("few"))).cast(kind)
    return F.transform(F.aggregate(pairs, F.array().cast(kind), step), lambda k: k["raw"])


def unlike_sentences(sents: Column, share: float = 0.75) -> Column:
    """Sentences of whose content words less than ``share`` are in one that was kept before."""
    kind = "array<struct<s:string,w:array<string>>>"
    words = lambda s: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda w: ~w.isin(LABEL_STOP)))

    def step(kept: Column, x: Column) -> Column:
        # a list that is too short can't hold the share: sizes are compared before the words
        said = (F.size(x["w"]) > 0) & F.exists(kept, lambda k: (F.size(k["w"]) > 0) & (F.size(k["w"]) >= share * F.size(x["w"])) & (F.size(F.array_intersect(x["w"], k["w"])) >= share * F.size(x["w"])))
        return F.when(said, kept).otherwise(F.concat(kept, F.array(x)))

    pairs = F.transform(sents, lambda s: F.struct(s.alias("s"), words(s).alias("w"))).cast(kind)
    kept = F.transform(F.aggregate(pairs, F.array().cast(kind), step), lambda k: k["s"])
    return F.when(F.size(sents) <= 1, sents).otherwise(kept)


def sentence_groups(sents: Column, most: int = MAX_WORDS) -> Column:
    """Groups of sentences: a new one begins beyond ``most`` words, or where a sentence shares no topic with the last three after 45 words, unless it leans
    on the one before and fits into a third more; a short last group joins the one before."""
    kind = "struct<groups:array<array<string>>,cur:array<string>,n:int>"
    content = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z][a-z'\-]*"), F.lit(0)), lambda w: ~w.isin(LABEL_STOP)))
    least = max(30, int(most * 0.4))

    def step(s: Column, x: Column) -> Column:
        n = F.size(blanks(x))
        recent = content(F.array_join(F.slice(s["cur"], F.greatest(F.size(s["cur"]) - 2, F.lit(1)), F.lit(3)), " "))
        own = content(x)
        overlap = F.size(F.array_intersect(recent, own)).cast("double") / F.greatest(F.size(F.array_union(recent, own)), F.lit(1))
        shift = (F.size(s["cur"]) > 0) & (s["n"] >= 45) & (overlap < 0.04)
        leans = ends(x).rlike(CONTINUES) | F.coalesce(_last(s["cur"]).rlike(INTRO), F.lit(False))
        cut = (F.size(s["cur"]) > 0) & ((s["n"] + n > most) | shift) & ~(leans & (s["n"] + n <= most * 1.35))
        fresh = F.struct(F.concat(s["groups"], F.array(s["cur"])).alias("groups"), F.array(x).alias("cur"), n.alias("n"))
        return F.when(cut, fresh).otherwise(F.struct(s["groups"].alias("groups"), F.concat(s["cur"], F.array(x)).alias("cur"), (s["n"] + n).alias("n"))).cast(kind)

    def finish(s: Column) -> Column:
        joined = F.concat(_without_last(s["groups"]), F.array(F.concat(_last(s["groups"]), s["cur"])))
        return F.when(F.size(s["cur"]) == 0, s["groups"]).when((F.size(s["groups"]) > 0) & (s["n"] < least), joined).otherwise(F.concat(s["groups"], F.array(s["cur"])))

    start = F.struct(F.array().cast("array<array<string>>").alias("groups"), F.array().cast(STRINGS).alias("cur"), F.lit(0).alias("n")).cast(kind)
    return F.aggregate(sents, start, step, finish)


def section_number(title: Column) -> Column:
    return F.regexp_extract(title, NUMBERED, 1)


def packed_siblings(entries: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(deck, page, titles, bullets): up to three neighbouring entries of one numbered section on a page while they fit ``most`` words and none has over 70 %
    of it; others alone."""
    kind = "array<struct<titles:array<string>,bullets:array<string>,section:string,n:int,open:boolean>>"
    n = _words(F.col("bullets"))
    entry = F.struct(F.col("slide_no"), F.array("title").alias("titles"), "bullets", section_number(F.col("title")).alias("section"), n.alias("n"), ((section_number(F.col("title")) != "") & (n <= most * 0.7)).alias("open"))
    rows = entries.select("deck", entry.alias("e")).groupBy("deck").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["titles"], e["bullets"], e["section"], e["n"], e["open"])).cast(kind).alias("e"))

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc)
        fits = (F.size(acc) > 0) & last["open"] & x["open"] & (last["section"] == x["section"]) & (F.size(last["titles"]) < 3) & (last["n"] + x["n"] <= most)
        merged = F.struct(F.concat(last["titles"], x["titles"]).alias("titles"), F.concat(last["bullets"], x["bullets"]).alias("bullets"), last["section"].alias("section"), (last["n"] + x["n"]).alias("n"), last["open"].alias("open"))
        return F.when(fits, F.concat(_without_last(acc), F.array(merged))).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return rows.select("deck", F.posexplode(F.aggregate("e", F.array().cast(kind), step)).alias("page", "p")).select("deck", (F.col("page") + 1).alias("page"), F.array_join("p.titles", " · ").alias("titles"), "p.bullets")


def without_bare_headings(entries: DataFrame) -> DataFrame:
    """Entries without those whose text only repeats their title, and headings of a numbered section with under eight words before another of it."""
    after = F.lead(section_number(F.col("title"))).over(Window.partitionBy("deck").orderBy("slide_no"))
    body, own = plain(F.array_join("bullets", " ")), section_number(F.col("title"))
    rows = entries.withColumn("_after", after)
    echo = (body != "") & (body == plain(F.col("title")))
    bare = (_words(F.col("bullets")) < 8) & (own != "") & (own == F.coalesce("_after", F.lit("")))
    return rows.where(~echo & ~bare).drop("_after")


def merged_parts(entries: DataFrame) -> DataFrame:
    """(deck, place, title, bullets): neighbouring thin slides of one topic become one of up to six bullets; the parts that remain are numbered anew."""
    kind = "array<struct<title:string,bullets:array<string>>>"
    rows = entries.groupBy("deck").agg(F.transform(F.array_sort(F.collect_list(F.struct("slide_no", "title", "bullets"))), lambda e: F.struct(e["title"], e["bullets"])).cast(kind).alias("e"))
    base = lambda t: F.lower(F.trim(F.regexp_replace(t, PART, "")))
    thin = lambda b: _words(b).between(1, THIN_WORDS - 1)

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc)
        both = F.concat(last["bullets"], F.filter(x["bullets"], lambda b: ~F.array_contains(last["bullets"], b)))
        fits = (F.size(acc) > 0) & thin(last["bullets"]) & thin(x["bullets"]) & (base(last["title"]) == base(x["title"])) & (F.size(both) <= MERGED_BULLETS)
        return F.when(fits, F.concat(_without_last(acc), F.array(F.struct(last["title"].alias("title"), both.alias("bullets"))))).otherwise(F.concat(acc, F.array(x))).cast(kind)

    spread = rows.select("deck", F.posexplode(F.aggregate("e", F.array().cast(kind), step)).alias("place", "x")).select("deck", (F.col("place") + 1).alias("place"), "x.title", "x.bullets")
    part = F.col("title").rlike(PART)
    group = Window.partitionBy("deck", "part", "base")
    spread = spread.withColumns({"part": part, "base": base(F.col("title"))})
    k, n = F.row_number().over(group.orderBy("place")), F.count(F.lit(1)).over(group)
    plain_title = F.regexp_replace("title", PART, "")
    title = F.when(~F.col("part"), F.col("title")).when(n == 1, plain_title).otherwise(F.concat(plain_title, F.lit(" ("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")")))
    return spread.select("deck", "place", title.alias("title"), "bullets")


def same_topic(a: Column, b: Column) -> Column:
    """Equal titles, or 90 % of the longer one's words of at least three shared."""
    wa, wb = F.array_distinct(blanks(a)), F.array_distinct(blanks(b))
    longer = F.greatest(F.size(wa), F.size(wb))
    return (a != "") & (b != "") & ((a == b) | ((F.size(F.array_intersect(wa, wb)) >= 0.9 * longer) & (longer >= 3)))


def folded_titles(entries: DataFrame) -> DataFrame:
    """(deck, place, title, bullets): neighbours of one topic under the first one's title, with each bullet once."""
    kind = "array<struct<title:string,norm:string,bullets:array<string>>>"
    norm = plain(F.regexp_replace("title", r"\s+", " "))
    rows = entries.withColumn("norm", norm).groupBy("deck").agg(F.transform(F.array_sort(F.collect_list(F.struct("slide_no", "title", "norm", "bullets"))), lambda e: F.struct(e["title"], e["norm"], e["bullets"])).cast(kind).alias("e"))

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc)
        known = F.transform(last["bullets"], plain)
        fresh = F.filter(x["bullets"], lambda b, i: ~F.array_contains(known, plain(b)) & ~F.exists(F.slice(x["bullets"], F.lit(1), i), lambda c: plain(c) == plain(b)))
        merged = F.struct(last["title"].alias("title"), last["norm"].alias("norm"), F.concat(last["bullets"], fresh).alias("bullets"))
        return F.when((F.size(acc) > 0) & same_topic(last["norm"], x["norm"]), F.concat(_without_last(acc), F.array(merged))).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return rows.select("deck", F.posexplode(F.aggregate("e", F.array().cast(kind), step)).alias("place", "x")).select("deck", (F.col("place") + 1).alias("place"), "x.title", "x.bullets")


def real_bullets(bullets: Column) -> Column:
    """Bullets of three words or more that aren't a page number with a text."""
    return F.filter(bullets, lambda b: (F.size(blanks(b)) >= 3) & ~ends(b).rlike(r"^\d+\s.*$"))


def has_content(title: Column, bullets: Column, visual: Column, takeaway: Column, image: Column) -> Column:
    """Whether a slide shows something: real bullets (one that echoes the title is none), a visual, a takeaway, or a figure under a real name."""
    real = real_bullets(bullets)
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{3,}"), F.lit(0)))
    only = words(F.get(real, F.lit(0)))
    echoes = (F.size(only) == 0) | (F.size(F.array_intersect(only, words(title))) >= 0.6 * F.size(only))
    named = ~F.regexp_replace(F.trim(title), ":+$", "").rlike(GENERIC)
    return (F.size(real) > 1) | ((F.size(real) == 1) & ~echoes) | visual | (F.trim(takeaway) != "") | (image & named)


def without_empty(slides: DataFrame) -> DataFrame:
    """(deck, slide_no, title): slides with content; an untitled one takes the title of what was dropped right before it."""
    order = Window.partitionBy("deck").orderBy("slide_no")
    rows = slides.withColumn("full", has_content(F.col("title"), F.col("bullets"), F.col("visual"), F.col("takeaway"), F.col("image")))
    rows = rows.withColumn("gap", F.coalesce(F.sum(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.when(~F.col("full") & (F.trim("title") != "") & ~F.trim("title").rlike(UNNAMED), F.trim("title"))
    carried = F.last(own, ignorenulls=True).over(Window.partitionBy("deck", "gap").orderBy("slide_no").rowsBetween(Window.unboundedPreceding, -1))
    title = F.when(F.trim("title") == "", F.coalesce(carried, F.col("title"))).otherwise(F.col("title"))
    return rows.withColumn("_title", title).where("full").select("deck", "slide_no", F.col("_title").alias("title"))


def folded_thin(slides: DataFrame, least: int = 4) -> DataFrame:
    """(deck, slide_no, bullets): fragments (no real bullet, no visual, not the last slide) of decks of ``least`` slides or more give their bullets to the next
    slide that stays."""
    whole = Window.partitionBy("deck")
    rows = slides.select("deck", "slide_no", "bullets", (F.size(real_bullets(F.col("bullets"))) == 0).alias("hollow"), "visual")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(whole), "last": F.max("slide_no").over(whole)})
    rows = rows.withColumn("gone", (F.col("n") >= least) & F.col("hollow") & ~F.col("visual") & (F.col("slide_no") < F.col("last")))
    after = Window.partitionBy("deck").orderBy("slide_no").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("to", F.min(F.when(~F.col("gone"), F.col("slide_no"))).over(after))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slide_no", "bullets"))), lambda s: s["bullets"]))
    return rows.groupBy("deck", F.col("to").alias("slide_no")).agg(body.alias("bullets"))


def bullet_keys(bullets: Column) -> Column:
    keys = F.transform(bullets, lambda b: F.substring(F.regexp_replace(F.lower(b), "[^a-z0-9]", ""), 1, 60))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 6))


def unrepeated_slides(slides: DataFrame, share: float = 0.7) -> DataFrame:
    """(deck, slide_no) of slides that aren't covered to ``share`` by one that was kept before; continued ones stay and cover nothing, ones with a visual stay."""
    kind = "array<struct<slide_no:long,keys:array<string>,counts:boolean>>"
    entry = F.struct("slide_no", bullet_keys(F.col("bullets")).alias("keys"), F.col("continued"), F.col("visual"))
    rows = slides.select("deck", entry.alias("e")).groupBy("deck").agg(F.array_sort(F.collect_list("e")).alias("e"))

    def step(kept: Column, x: Column) -> Column:
        covered = F.exists(kept, lambda k: k["counts"] & (F.size(k["keys"]) > 0) & (F.size(F.array_intersect(x["keys"], k["keys"])) >= share * F.size(x["keys"])))
        drop = ~x["continued"] & (F.size(x["keys"]) > 0) & covered & ~x["visual"]
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(F.struct(x["slide_no"].alias("slide_no"), x["keys"].alias("keys"), (~x["continued"]).alias("counts"))))).cast(kind)

    return rows.select("deck", F.explode(F.aggregate("e", F.array().cast(kind), step)).alias("k")).select("deck", "k.slide_no")


def _even_page(i: Column, n: Column, size: int) -> tuple[Column, Column]:
    """Page (from 0) of item i of n, pages as even as can be, and how many pages."""
    pages = F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    base = F.floor(n / pages)
    extra = n - base * pages
    page = F.when(i < extra * (base + 1), F.floor(i / (base + 1))).otherwise(extra + F.floor((i - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    return page.cast("long"), pages


def part_title(title: Column, page: Column, pages: Column) -> Column:
    base = F.trim(F.regexp_replace(title, PART, ""))
    return F.when(pages <= 1, title).otherwise(F.concat(base, F.lit(" ("), (page + 1).cast("string"), F.lit("/"), pages.cast("string"), F.lit(")")))


def paged(slides: DataFrame, extras: DataFrame | None = None, size: int = 16) -> DataFrame:
    """(deck, slide_no, part, title, bullets, continued): slides of over ``size`` bullets on pages as even as can be. Redundant bullets and ones that restate
    the title go first; ``extras`` (deck, slide_no, extra) are joined by place and come last."""
    rows = slides.select("deck", "slide_no", "title", unrepeated_bullets(F.col("bullets")).alias("bullets"))
    # title and bullets are made plain once each: inside a lambda the optimiser would make them anew wherever they are named
    same = lambda p, t: (p != "") & (t != "") & ((p == t) | ((F.length(p) >= 8) & F.contains(t, p)))
    others = lambda t: F.filter("bullets", lambda b: ~let(plain(b), lambda p: same(p, t)))
    rows = rows.withColumn("bullets", let(plain(F.col("title")), others))
    if extras is not None:
        rows = rows.join(extras, ["deck", "slide_no"], "left").withColumn("bullets", F.concat("bullets", F.when(F.col("extra").isNotNull(), F.array("extra")).otherwise(F.array().cast(STRINGS)))).drop("extra")
    spread = rows.select("deck", "slide_no", "title", F.size("bullets").cast("long").alias("n"), F.posexplode_outer("bullets").alias("i", "bullet"))
    page, pages = _even_page(F.coalesce("i", F.lit(0)).cast("long"), F.col("n"), size)
    spread = spread.withColumns({"part": page, "pages": pages})
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("bullet").isNotNull(), F.struct("i", "bullet")))), lambda s: s["bullet"])
    made = spread.groupBy("deck", "slide_no", "title", "part", "pages").agg(body.alias("bullets"))
    return made.select("deck", "slide_no", "part", part_title(F.col("title"), F.col("part"), F.col("pages")).alias("title"), "bullets", (F.col("part") > 0).alias("continued"))


def paged_tables(tables: DataFrame, rows_a_page: int = 4, leads_a_page: int = 3) -> DataFrame:
    """(table_id, part, title, headers, rows, leads): a table's rows on even pages with its head on each, its lead bullets paged beside them: pages of rows and of
    leads meet by number, full outer; a page without rows has no head."""

    def pages_of(column: str, size: int, name: str) -> DataFrame:
        spread = tables.select("table_id", F.size(column).cast("long").alias("n"), F.posexplode(column).alias("i", "x"))
        page, pages = _even_page(F.col("i").cast("long"), F.col("n"), size)
        spread = spread.withColumns({"part": page})
        return spread.groupBy("table_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))

    parts = pages_of("rows", rows_a_page, "row_page").join(pages_of("leads", leads_a_page, "lead_page"), ["table_id", "part"], "full_outer")
    total = F.count(F.lit(1)).over(Window.partitionBy("table_id"))
    made = parts.withColumn("pages", total).join(tables.select("table_id", "title", "headers"), "table_id")
    none = F.array().cast(STRINGS)
    return made.select("table_id", "part", part_title(F.col("title"), F.col("part"), F.col("pages")).alias("title"), F.when(F.col("row_page").isNotNull(), F.col("headers")).otherwise(none).alias("headers"), F.coalesce("row_page", none).alias("rows"), F.coalesce("lead_page", none).alias("leads"))


def planned(entries: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(deck, slide_no, part, parts, bullets): entries of over ``most`` words split into groups of sentences, bare headings and empty ones left out."""
    rows = without_bare_headings(entries).where(F.size("bullets") > 0)
    groups = F.when(_words(F.col("bullets")) > most, sentence_groups(F.col("bullets"), most)).otherwise(F.array("bullets"))
    rows = rows.withColumn("groups", groups)
    return rows.select("deck", "slide_no", F.size("groups").alias("parts"), F.posexplode_outer("groups").alias("part", "bullets")).where("bullets IS NOT NULL").select("deck", "slide_no", "part", "parts", "bullets")


def planned_to_budget(entries: DataFrame, target: int, most: int = MAX_WORDS, ceiling: int = 230) -> tuple[DataFrame, int]:
    """The plan, with the words of a slide raised by 15 % until it has at most 12 % more slides than ``target`` or they reach the ceiling: a few counts."""
    while True:
        plan = planned(entries, most)
        if most >= ceiling or plan.count() <= target * 1.12:
            return plan, most
        most = min(ceiling, int(most * 1.15) + 1)
