"""Queries of ``sources.office``: files made of pages and documents and read back, and the SQL of what they have to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.functions import phrases as P
from deckloom.plans import sqltext as q
from deckloom.plans.marked import _PAGE, page_text
from deckloom.plans.phrased import ends
from deckloom.sources import office as O
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def page_files(spark, sf_dir):
    """Every page as a Word file: its markdown lines as headings, items and paragraphs."""
    lines = F.filter(F.transform(F.split(page_text(F.coalesce("html", F.lit(""))), "\n"), P.ends), lambda x: x != "")
    item = F.lit("^- ")

    def part(x):
        level = F.length(F.regexp_extract(x, r"^(#+) ", 1))
        block = F.when(level > 0, "heading").when(F.regexp_like(x, item), "item").otherwise("paragraph")
        text = F.regexp_replace(x, r"^#+ |^- ", "")
        return F.struct(block.alias("block"), F.when(level > 0, level).otherwise(0).alias("level"), text.alias("text"), F.lit(None).cast("array<string>").alias("cells"))

    parts = F.filter(F.transform(lines, part), lambda p: P.ends(p["text"]) != "")
    return O.office_files(table(spark, sf_dir, "pages").select("page_id", parts.alias("parts")), "page_id", "docx")


def deck_files(spark, sf_dir):
    """Every document as a PowerPoint file: its lines as slides."""
    rows = slides(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slide_no", "title", "bullets"))), lambda s: F.struct(s["title"].alias("title"), s["bullets"].alias("bullets"))).alias("parts"))
    return O.office_files(rows, "doc_id", "pptx")


_SQUEEZED = lambda x: rf"trim(regexp_replace(regexp_replace({x}, {q.text(CONTROL)}, '', 'g'), '\s+', ' ', 'g'))"
_LINES = rf"""l0 AS (SELECT page_id, list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: {ends('x')}), lambda x: x <> '' AND {ends("regexp_replace(x, '^#+ |^- ', '')")} <> '') AS l FROM pages),
l1 AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM l0),
l2 AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS place, CASE WHEN regexp_matches(x, '^#+ ') THEN 'heading' WHEN prefix(x, '- ') THEN 'item' ELSE 'paragraph' END AS block, length(regexp_extract(x, '^(#+) ', 1))::INT AS level, {_SQUEEZED("regexp_replace(x, '^#+ |^- ', '')")} AS text FROM l1 WHERE {_SQUEEZED("regexp_replace(x, '^#+ |^- ', '')")} <> '')"""
QUERIES["word_blocks"] = lambda spark, sf_dir: O.parsed_files(page_files(spark, sf_dir), "page_id").select("page_id", "place", "block", "level", "text")
ORACLE["word_blocks"] = f"WITH {_LINES} SELECT page_id, place, block, level, text FROM l2"
QUERIES["word_markdown"] = lambda spark, sf_dir: O.blocks_to_markdown(O.parsed_files(page_files(spark, sf_dir), "page_id"), "page_id")
ORACLE["word_markdown"] = f"""WITH {_LINES}, t AS (SELECT *, min(CASE WHEN block = 'heading' THEN level END) OVER (PARTITION BY page_id) AS top FROM l2)
SELECT page_id, string_agg(CASE block WHEN 'heading' THEN repeat('#', level - top + 2) || ' ' || text WHEN 'item' THEN '- ' || text ELSE text END, chr(10) ORDER BY place) AS markdown FROM t GROUP BY 1"""
_PLAIN = lambda x: rf"regexp_replace({x}, {q.text(CONTROL)}, '', 'g')"
QUERIES["deck_blocks"] = lambda spark, sf_dir: O.parsed_files(deck_files(spark, sf_dir), "doc_id").select("doc_id", "unit", "place", "block", "text")
ORACLE["deck_blocks"] = rf"""WITH {q.SLIDES}, s AS (SELECT doc_id, slide_no, list_concat([CASE WHEN {ends(_PLAIN('title'))} = '' THEN 'Slide ' || slide_no ELSE {ends(_PLAIN('title'))} END], list_filter(list_transform(bullets, lambda b: {ends(_PLAIN('b'))}), lambda b: b <> '')) AS x FROM slides)
SELECT doc_id, slide_no::INT AS unit, (generate_subscripts(x, 1) - 1)::INT AS place, CASE WHEN generate_subscripts(x, 1) = 1 THEN 'heading' ELSE 'item' END AS block, unnest(x) AS text FROM s"""
QUERIES["file_kinds"] = lambda spark, sf_dir: (
    page_files(spark, sf_dir).select(F.col("page_id").alias("id"), F.explode(F.array(F.struct(F.lit("docx").alias("kind"), F.col("content").alias("c")), F.struct(F.lit("pptx").alias("kind"), F.lit("moved").cast("binary").alias("c")), F.struct(F.lit("pdf").alias("kind"), F.concat(F.lit(" \n%PDF-"), F.col("page_id").cast("string")).cast("binary").alias("c")), F.struct(F.lit("txt").alias("kind"), F.col("content").alias("c")))).alias("f"))
    .select("id", "f.kind", O.looks_like(F.col("f.c"), F.col("f.kind")).alias("fits"))
)
ORACLE["file_kinds"] = "SELECT page_id AS id, kind, kind <> 'pptx' AS fits FROM pages, (SELECT unnest(['docx', 'pptx', 'pdf', 'txt']) AS kind)"
