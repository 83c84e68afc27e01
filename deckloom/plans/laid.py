"""Queries of ``operators.geometry`` and ``operators.layouts`` over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import geometry as E
from deckloom.operators import layouts as Y
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import SENTENCES, STATED, STATED_SQL, blanks, ends, stated, values
from deckloom.functions.text import sentences
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}
WIDTH, HEIGHT = 600.0, 800.0


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _spans(spark, sf_dir):
    """Lines of orders as spans: the order's hundred is the document, the order the page."""
    li, x = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 8 * 70.0
    y = F.col("l_suppkey") % 20 * 40.0
    width = F.when(F.col("l_linenumber") == 1, 500.0).otherwise(180.0)
    return li.select(F.floor(F.col("l_orderkey") / 100).alias("doc"), F.col("l_orderkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + width).alias("x1"), (y + 12.0).alias("y1"), (F.col("l_quantity") % 7 + 8.0).alias("size"), F.concat("l_linestatus", F.lit(" "), F.col("l_linenumber").cast("string")).alias("text"))


_SPANS = """spans AS (SELECT l_orderkey // 100 AS doc, l_orderkey AS page, l_partkey % 8 * 70.0::DOUBLE AS x0, l_suppkey % 20 * 40.0::DOUBLE AS y0, l_partkey % 8 * 70.0::DOUBLE + CASE WHEN l_linenumber = 1 THEN 500.0 ELSE 180.0 END::DOUBLE AS x1,
 l_suppkey % 20 * 40.0::DOUBLE + 12.0::DOUBLE AS y1, l_quantity % 7 + 8.0::DOUBLE AS size, l_linestatus || ' ' || l_linenumber AS text FROM lineitem)"""


@query("band_furniture", rf"""WITH {_SPANS}, s AS (SELECT doc, page, CASE WHEN y1 < {HEIGHT * E.TOP} THEN 'top' WHEN y0 > {HEIGHT * E.BOTTOM} THEN 'bottom' END AS band, trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS norm FROM spans),
p AS (SELECT doc, count(DISTINCT page) AS n FROM spans GROUP BY doc), c AS (SELECT doc, band, norm, count(DISTINCT page) AS k FROM s WHERE band IS NOT NULL AND norm <> '' GROUP BY ALL)
SELECT c.doc, band, norm, k AS "on" FROM c JOIN p ON p.doc = c.doc WHERE k >= 3 AND k >= floor(0.3::DOUBLE * n)""")
def band_furniture(spark, sf_dir):
    return E.band_furniture(_spans(spark, sf_dir), HEIGHT)


@query("body_sizes", f"""WITH {_SPANS}, c AS (SELECT doc, round_even(size, 0) AS s, sum(length(text)) AS n FROM spans GROUP BY ALL)
SELECT doc, modal, middle FROM (SELECT doc, max_by(s, (n, s)) AS modal FROM c GROUP BY doc) JOIN (SELECT doc, quantile_cont(size, 0.5) AS middle FROM spans GROUP BY doc) USING (doc)""")
def body_sizes(spark, sf_dir):
    return E.body_sizes(_spans(spark, sf_dir))


@query("decorations", f"""WITH {_SPANS}, p AS (SELECT doc, count(DISTINCT page) AS n FROM spans GROUP BY doc), c AS (SELECT doc, text AS digest, count(DISTINCT page) AS k FROM spans GROUP BY ALL) SELECT doc, digest FROM c JOIN p USING (doc) WHERE k >= 3 AND k >= 0.2 * n""")
def decorations(spark, sf_dir):
    return E.decorations(_spans(spark, sf_dir).select("doc", "page", F.col("text").alias("digest")))


_KIND = f"CASE WHEN x1 - x0 > {WIDTH * E.WIDE} THEN 'wide' WHEN x1 < {WIDTH / 2 * 1.06} THEN 'left' WHEN x0 > {WIDTH / 2 * 0.94} THEN 'right' END"
_TWO = "l + r >= 4 AND l >= 2 AND r >= 2 AND w <= (l + r) * 0.5"


@query("page_columns", f"WITH {_SPANS}, k AS (SELECT doc, page, {_KIND} AS k FROM spans), c AS (SELECT doc, page, count(*) FILTER (k = 'left') AS l, count(*) FILTER (k = 'right') AS r, count(*) FILTER (k = 'wide') AS w FROM k GROUP BY ALL) SELECT doc, page, CASE WHEN {_TWO} THEN 2 ELSE 1 END AS columns FROM c")
def page_columns(spark, sf_dir):
    return E.page_columns(_spans(spark, sf_dir), WIDTH)


@query("reading_order", f"""WITH {_SPANS}, k AS (SELECT *, {_KIND} AS k FROM spans), c AS (SELECT *, count(*) FILTER (k = 'left') OVER p AS l, count(*) FILTER (k = 'right') OVER p AS r, count(*) FILTER (k = 'wide') OVER p AS w FROM k WINDOW p AS (PARTITION BY doc, page)),
o AS (SELECT *, CASE WHEN NOT ({_TWO}) OR coalesce(k, '') = 'wide' THEN 0 WHEN x1 < {WIDTH / 2 * 1.06} THEN 1 ELSE 2 END AS col FROM c)
SELECT page, text, col AS "column", (row_number() OVER (PARTITION BY doc, page ORDER BY col, round_even(y0, 1), x0, text))::INT AS place FROM o""")
def reading_order(spark, sf_dir):
    return E.reading_order(_spans(spark, sf_dir), WIDTH).select("page", "text", "column", "place")


@query("indent_levels", f"""WITH {_SPANS}, x AS (SELECT doc, page, list_sort(list(DISTINCT x0)) AS xs FROM spans GROUP BY ALL), a AS (SELECT *, list_reduce(xs, lambda acc, v: CASE WHEN len(acc) > 0 AND v - acc[-1] <= {E.TOLERANCE} THEN acc ELSE list_append(acc, v) END, []::DOUBLE[]) AS anchors FROM x),
u AS (SELECT doc, page, anchors, unnest(xs) AS x0 FROM a) SELECT doc, page, x0, least(3, list_position(list_transform(anchors, lambda v: abs(v - x0)), list_min(list_transform(anchors, lambda v: abs(v - x0)))) - 1)::INT AS level FROM u""")
def indent_levels(spark, sf_dir):
    return E.indent_levels(_spans(spark, sf_dir))


@query("outside_tables", f"""WITH {_SPANS}, t AS (SELECT o_orderkey // 100 AS doc, o_orderkey AS page, (o_custkey % 4) * 100.0::DOUBLE AS bx0, 100.0::DOUBLE AS by0, (o_custkey % 4) * 100.0::DOUBLE + 200.0 AS bx1, 500.0::DOUBLE AS by1 FROM orders)
SELECT page, text FROM spans s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = s.doc AND t.page = s.page AND (x0 + x1) / 2 BETWEEN bx0 - 2 AND bx1 + 2 AND (y0 + y1) / 2 BETWEEN by0 - 2 AND by1 + 2)""")
def outside_tables(spark, sf_dir):
    x = F.col("o_custkey") % 4 * 100.0
    boxes = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("doc"), F.col("o_orderkey").alias("page"), x.alias("bx0"), F.lit(100.0).alias("by0"), (x + 200.0).alias("bx1"), F.lit(500.0).alias("by1"))
    return E.outside_tables(_spans(spark, sf_dir), boxes).select("page", "text")


@query("chapters", r"""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'Chapter ' || o_orderkey ELSE o_orderpriority END AS title FROM orders),
c AS (SELECT *, sum(regexp_matches(title, '(?i)^(?:chapter|unit|module)\s+\d+')::INT) OVER w AS chapter, last_value(CASE WHEN regexp_matches(title, '(?i)^(?:chapter|unit|module)\s+\d+') THEN title END IGNORE NULLS) OVER w AS head FROM p WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, chapter::BIGINT AS chapter, coalesce(max(head), 'Front matter') AS title, min(page) AS first_page, count(*) AS n_pages FROM c GROUP BY doc, chapter""")
def chapters(spark, sf_dir):
    title = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Chapter "), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderpriority"))
    return E.chapters(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), title.alias("title")))


@query("slide_style", f"""WITH p AS (SELECT doc_id % 12 AS doc, doc_id AS page, {blanks("coalesce(text, '')")} AS w FROM documents), r AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n, len(w) AS words FROM p),
s AS (SELECT * FROM r WHERE i % greatest(1, n // 15) = 0 AND i // greatest(1, n // 15) < 15) SELECT doc, max(n) >= 12 AND count(*) FILTER (words <= 140) >= 0.7 * count(*) AS slide_style FROM s GROUP BY doc""")
def slide_style(spark, sf_dir):
    return E.is_slide_style(table(spark, sf_dir, "documents").select((F.col("doc_id") % 12).alias("doc"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text")))


PICTURES = (
    (1, 100, 100, "x", "cells divide", False), (2, 2000, 300, "", "cells", False), (3, 800, 600, "Company logo", "cells divide", False), (4, 800, 600, "step 1 mix the flour and water -> step 2 bake it for an hour 50 %", "bread", False),
    (5, 300, 300, "cells divide fast", "cells divide in two", False), (6, 0, 0, "", "cells", True), (7, 900, 700, "icon of cells that divide", "cells divide", False), (8, 900, 700, "", "cells", False), (9, 400, 400, "words here", "other text", False),
    (10, 900, 900, " ".join(["cells divide"] * 25), "cells divide", False),
)
#: A slide's bullets as what is read on its picture, beside its title.
_FROM_DOCS = f"(WITH {q.SLIDES} SELECT -1 - (doc_id * 1000 + slide_no), (length(body) * 3)::INT, (length(body) * 2)::INT, array_to_string(bullets, ' '), title, contains(lower(title), 'the') FROM slides WHERE len(bullets) > 0)"
_OCR = r"trim(regexp_replace(ocr, '(?i)\[(?:OCR|Extracted)[^\]]*\]', '', 'g'))"
_WD = lambda x: rf"regexp_extract_all({x}, '[A-Za-z][A-Za-z\-'']+')"


@query("picture_actions", f"""WITH p AS (SELECT id, width, height, referenced, {_OCR} AS ocr, {_WD(_OCR)} AS w, list_distinct({_WD('lower(slide_text)')}) AS own FROM (SELECT * FROM {values(PICTURES, 'id, width, height, ocr, slide_text, referenced')} UNION ALL {_FROM_DOCS})),
m AS (SELECT id, referenced, len(w) AS n, width * height / 1e6 AS mp, CASE WHEN height > 0 THEN width / height::DOUBLE ELSE 0.0 END AS aspect, list_distinct(list_transform(w, lambda x: lower(x))) AS mine, own, len(regexp_extract_all(ocr, {q.text(Y.STRUCTURE)})) AS marks, regexp_matches(ocr, {q.text(Y.DECORATIVE)}) AS decor FROM p),
r AS (SELECT *, CASE WHEN len(mine) > 0 AND len(own) > 0 THEN len(list_intersect(mine, own))::DOUBLE / len(mine) ELSE 0.0 END AS near FROM m),
f AS (SELECT id, CASE WHEN ((mp > 0 AND mp < 0.02) OR (aspect <> 0 AND (aspect > 4 OR aspect < 0.25))) AND n < 8 THEN ('DROP', 0.9) WHEN decor AND near < 0.15 AND marks = 0 THEN ('DROP', 0.75) WHEN marks >= 2 AND n >= 8 THEN ('SUMMARISE_TO_STRUCTURE', 0.82) WHEN n >= 40 AND near >= 0.25 THEN ('SUMMARISE_TO_STRUCTURE', 0.7)
 WHEN mp < 0.12 AND (near >= 0.2 OR referenced) THEN ('ENHANCE', 0.6) WHEN decor AND (near >= 0.15 OR referenced) THEN ('REGENERATE', 0.55) WHEN near >= 0.15 OR referenced OR mp >= 0.25 THEN ('KEEP_AS_IS', 0.7) ELSE ('KEEP_AS_IS', 0.55) END AS f FROM r)
SELECT id::BIGINT AS id, f[1] AS action, f[2]::DOUBLE AS confidence FROM f""")
def picture_actions(spark, sf_dir):
    deck = slides(table(spark, sf_dir, "documents")).where("size(bullets) > 0")
    size = F.length("body").cast("int")
    shown = deck.select((-1 - (F.col("doc_id") * 1000 + F.col("slide_no"))).alias("id"), (size * 3).cast("int"), (size * 2).cast("int"), F.array_join("bullets", " "), F.col("title"), F.lower("title").contains("the"))
    return Y.picture_actions(spark.createDataFrame(list(PICTURES), "id long, width int, height int, ocr string, slide_text string, referenced boolean").union(shown))


_FAM = "['PROSE', 'SET_DIAGRAM', 'TIMELINE', 'CHART_TREND'][(slide_no % 4 + 1)::INT]"


@query("art_kinds", f"""WITH {q.SLIDES}, a AS (SELECT doc_id, slide_no, title, body, {_FAM} AS family, title || ' ' || body AS whole FROM slides)
SELECT doc_id, slide_no, CASE WHEN list_contains({q.listed(Y.WIDE)}, family) OR prefix(family, 'CHART_') OR regexp_matches(trim(title), {q.text(Y.NO_ART)}) OR len(regexp_extract_all(whole, '[A-Za-z]{{3,}}')) < 6 THEN NULL WHEN regexp_matches(lower(whole), {q.text(Y.FLOW)}) THEN 'FLOW' WHEN regexp_matches(lower(whole), {q.text(Y.PLOT)}) THEN 'PLOT'
 WHEN family = 'SET_DIAGRAM' OR regexp_matches(lower(whole), {q.text(Y.CONTRAST)}) THEN 'COMPARE' WHEN regexp_matches(lower(whole), {q.text(Y.ANATOMY)}) THEN 'ANATOMY' ELSE 'SCENE' END AS art FROM a""")
def art_kinds(spark, sf_dir):
    family = F.element_at(F.array(*map(F.lit, ("PROSE", "SET_DIAGRAM", "TIMELINE", "CHART_TREND"))), (F.col("slide_no") % 4 + 1).cast("int"))
    return slides(table(spark, sf_dir, "documents")).select("doc_id", "slide_no", Y.art_kind(F.col("title"), F.col("body"), family).alias("art"))


LAYOUTS = (
    (1, ["First, mix it", "Then, bake it", "Finally, eat it"]), (2, ["A vs B in cost", "A versus B in size", "C"]), (3, ["10% here", "20% there", "30% too"]), (4, ["It grew by 42% in a year"]), (5, ["One: first", "Two: second", "Three: third"]), (6, ["Plain point", "Other point"]),
    (7, [f"bullet {k} then next" for k in range(9)]), (8, []), (9, ["step 1 do it", "step 2 rest"]),
)
_LROWS = ", ".join(f"({i}, [{q.quoted(b)}]::VARCHAR[])" for i, b in LAYOUTS)
_CNT = lambda p: f"len(regexp_extract_all(low, {q.text(p)}))"


@query("layouts", rf"""WITH l AS (SELECT id, b, lower(array_to_string(b, ' ')) AS low, len({blanks("array_to_string(b, ' ')")}) AS words, len(b) AS n FROM (SELECT id, b FROM (VALUES {_LROWS}) AS v(id, b) UNION ALL SELECT -1 - (conv_id * 1000 + turn), {q.sentences("coalesce(text, '')")} FROM conversations)), h AS (SELECT *, n > 7 OR words / greatest(n, 1)::DOUBLE > 14 AS heavy, len(list_filter(b, lambda x: regexp_matches(x, '^[A-Z][\w /&.\-]{{1,32}}:\s'))) AS named FROM l)
SELECT id::BIGINT AS id, CASE WHEN NOT heavy AND ({_CNT(Y.ORDINAL)} >= 3 OR regexp_matches(low, '(?s)step\s*1\b.*step\s*2\b')) THEN 'FLOWCHART' WHEN NOT heavy AND {_CNT(chr(92) + 'bvs' + chr(92) + '.?' + chr(92) + 'b|' + chr(92) + 'bversus' + chr(92) + 'b|' + chr(92) + 'bwhereas' + chr(92) + 'b|on the other hand')} >= 2 AND n BETWEEN 3 AND 8 THEN 'TABLE'
 WHEN NOT heavy AND {_CNT(r'\b\d{1,3}(?:\.\d+)?\s?%|\b\d+\s?percent\b')} >= greatest(3, 0.5 * greatest(n, 1)) THEN 'TABLE' WHEN {_CNT(r'\b\d{1,3}(?:\.\d+)?\s?%')} = 1 AND words < 40 THEN 'METRIC' WHEN NOT heavy AND named BETWEEN 3 AND 6 AND n <= 7 THEN 'CARD_GRID' ELSE 'MINIMAL_TEXT' END AS layout FROM h""")
def layouts(spark, sf_dir):
    return spark.createDataFrame(list(LAYOUTS), "id long, b array<string>").union(_turn_sentences(spark, sf_dir)).select("id", Y.layout(F.col("b")).alias("layout"))


@query("old_layouts", f"SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), {q.text(Y.OLD_FLOW)}) THEN 'FLOWCHART' WHEN regexp_matches(lower(coalesce(text, '')), {q.text(Y.OLD_TABLE)}) THEN 'TABLE' WHEN regexp_matches(lower(coalesce(text, '')), {q.text(Y.OLD_METRIC)}) THEN 'METRIC' ELSE 'MINIMAL_TEXT' END AS layout FROM documents")
def old_layouts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Y.old_layout(F.coalesce("text", F.lit("")), F.lit(False)).alias("layout"))


_STATED = STATED_SQL
_RAW, _UNITS = f"trim(regexp_extract(text, {q.text(Y.METRIC)}, 1))", lambda x: f"regexp_extract({x}, {q.text(Y.UNIT)}, 1)"
_ANY = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"
_LBL = rf"left(regexp_replace(regexp_replace(regexp_replace(text, {q.text(Y.METRIC)}, '', 'g'), '^[ \-:—|]+|[ \-:—|]+$', '', 'g'), '\s+', ' ', 'g'), 40)"


@query("metrics", f"""SELECT id::BIGINT AS id, CASE WHEN trim(regexp_replace({_RAW}, {q.text(Y.UNIT)}, '', 'g')) <> '' THEN trim(regexp_replace({_RAW}, {q.text(Y.UNIT)}, '', 'g')) ELSE {_RAW} END AS value, CASE WHEN {_UNITS(_RAW)} <> '' THEN {_UNITS(_RAW)} ELSE {_UNITS('text')} END AS unit,
 CASE WHEN {_LBL} <> '' THEN {_LBL} ELSE 'Metric' END AS label, CASE WHEN {_ANY(Y.UP)} THEN 'up' WHEN {_ANY(Y.DOWN)} THEN 'down' ELSE 'flat' END AS trend FROM {_STATED} WHERE {_RAW} <> ''""")
def metrics(spark, sf_dir):
    return stated(spark, sf_dir).select("id", Y.metric(F.col("text")).alias("m")).where("m IS NOT NULL").select("id", "m.*")


_DT = f"regexp_extract(text, {q.text(Y.DATE_WORD)}, 1)"
_RST = f"regexp_replace(replace(text, {_DT}, ''), '^[ \\-:—|]+|[ \\-:—|]+$', '', 'g')"


@query("dated_items", f"SELECT id::BIGINT AS id, CASE WHEN {_DT} <> '' THEN {_DT} ELSE 'Phase ' || (id + 1) END AS date, CASE WHEN {_DT} = '' THEN trim(text) WHEN {_RST} <> '' THEN {_RST} ELSE trim(text) END AS rest FROM {_STATED}")
def dated_items(spark, sf_dir):
    return stated(spark, sf_dir).select("id", Y.dated(F.col("text"), F.col("id")).alias("d")).select("id", "d.*")


_SC = [f"{{'l': -({' + '.join(f'contains(lower(text), {q.text(w)})::INT' for w in ws)}), 'k': {k}, 'n': '{n}'}}" for k, (n, ws) in enumerate(Y.CHARTS.items())]


@query("chart_kinds", f"SELECT doc_id, list_sort([{', '.join(_SC)}])[1].n AS chart FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - id, text FROM {values(STATED, 'id, text')})")
def chart_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).union(spark.createDataFrame(STATED, "id long, text string").select(-1 - F.col("id"), "text"))
    return docs.select("doc_id", Y.chart_kind(F.col("text")).alias("chart"))


@query("node_kinds", f"""WITH {q.SLIDES}, b AS (SELECT doc_id, slide_no, unnest(bullets) AS b, generate_subscripts(bullets, 1) - 1 AS i, len(bullets) AS n FROM slides)
SELECT doc_id, slide_no, i::INT AS place, CASE WHEN i = 0 THEN 'start' WHEN i = n - 1 THEN 'end' WHEN {' OR '.join(f"contains(lower(b), '{w}')" for w in Y.DECISION_WORDS)} THEN 'decision' ELSE 'process' END AS kind FROM b""")
def node_kinds(spark, sf_dir):
    rows = slides(table(spark, sf_dir, "documents")).select("doc_id", "slide_no", F.size("bullets").alias("n"), F.posexplode("bullets").alias("place", "b"))
    return rows.select("doc_id", "slide_no", "place", Y.node_kind(F.col("b"), F.col("place"), F.col("n")).alias("kind"))


@query("branch_children", f"WITH {q.SLIDES}, b AS (SELECT doc_id, slide_no, bullets, unnest([0, 1, 2]) AS branch FROM slides) SELECT doc_id, slide_no, branch, array_to_string(list_filter(bullets, lambda x, i: (i - 1) % 3 = branch)[1:3], '|') AS items FROM b")
def branch_children(spark, sf_dir):
    rows = slides(table(spark, sf_dir, "documents")).select("doc_id", "slide_no", "bullets", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("branch"))
    return rows.select("doc_id", "slide_no", "branch", F.array_join(Y.children(F.col("bullets"), F.col("branch"), F.lit(3)), "|").alias("items"))


_HEADS = "list_transform(sents[1:3], lambda s: substr(s, 1, 40))"
_KC = rf"list_filter(list_concat(flatten(list_transform({_HEADS}, lambda h: list_transform(regexp_split_to_array(h, '[:\-–|/]'), lambda e: {ends('e')}))), regexp_extract_all(title, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+')), lambda p: length(p) > 1)"


@query("topics_and_concepts", rf"""WITH {q.SLIDES}, a AS (SELECT doc_id, slide_no, title, {_KC} AS e FROM slides)
SELECT doc_id, slide_no, CASE WHEN trim(title) <> '' AND NOT regexp_matches(trim(title), '(?i)^slide\s+\d+$') THEN trim(title) ELSE 'Untitled Slide' END AS topic, array_to_string(list_filter(e, lambda x, i: list_position(list_transform(e, lambda o: lower(o)), lower(x)) = i)[1:10], '|') AS concepts FROM a""")
def topics_and_concepts(spark, sf_dir):
    heads = F.transform(F.slice("sents", 1, 3), lambda s: F.substring(s, 1, 40))
    none = F.array().cast("array<string>")
    return slides(table(spark, sf_dir, "documents")).select("doc_id", "slide_no", Y.main_topic(F.col("title"), none, none).alias("topic"), F.array_join(Y.key_concepts(heads, F.col("title")), "|").alias("concepts"))


CONCEPTS = ("the", "cat", "tests", "process", "plants", "cells", "light", "energy", "sunlight", "figure")
_FC = f"list_filter({q.listed(CONCEPTS)}, lambda c: contains(lower(text), c))"
_PRED = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {q.text(v)})" for v in vs) + f" THEN '{n}'" for n, vs in Y.LINKS) + " ELSE 'UNKNOWN' END"


@query("relationships", f"SELECT id::BIGINT AS id, {_FC}[1] AS subject, {_PRED} AS predicate, {_FC}[2] AS object FROM {_STATED} WHERE len({_FC}) >= 2")
def relationships(spark, sf_dir):
    rows = stated(spark, sf_dir).select("id", Y.relationships(F.array("text"), F.array(*map(F.lit, CONCEPTS))).alias("r"))
    return rows.select("id", F.explode("r").alias("r")).select("id", "r.*")


@query("formulas", rf"WITH f AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, {q.text(Y.FORMULA_SIGN)}), lambda e: {ends('e')}), lambda e: length(e) BETWEEN 4 AND 200) AS f FROM {_STATED}) SELECT id::BIGINT AS id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i)[1:8], '|') AS formulas FROM f")
def formulas(spark, sf_dir):
    return stated(spark, sf_dir).select("id", F.array_join(Y.formulas(F.col("text")), "|").alias("formulas"))


def _turn_sentences(spark, sf_dir):
    """The sentences of every turn, under negative ids."""
    return table(spark, sf_dir, "conversations").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("id"), sentences(F.coalesce("text", F.lit(""))))


TALKS = ((1, ["What is it?", "A list.", "Why?", "Where?", "There.", "End?"]), (2, ["No question."]), (3, []), (4, [s for s in SENTENCES[:3]] + ["Ok?"]))
_TROWS = ", ".join(f"({i}, [{q.quoted(b)}]::VARCHAR[])" for i, b in TALKS)


@query("question_answers", rf"""WITH t AS (SELECT id, list_reduce(s, lambda a, x: CASE WHEN a.w THEN {{'o': list_append(a.o[:-2], {{'q': a.o[-1].q, 'a': x}}), 'w': false}} WHEN regexp_matches(x, '\?$') THEN {{'o': list_append(a.o, {{'q': x, 'a': ''}}), 'w': true}} ELSE a END,
 {{'o': []::STRUCT(q VARCHAR, a VARCHAR)[], 'w': false}}).o[1:6] AS o FROM (SELECT id, s FROM (VALUES {_TROWS}) AS v(id, s) UNION ALL SELECT -1 - (conv_id * 1000 + turn), {q.sentences("coalesce(text, '')")} FROM conversations)) SELECT id::BIGINT AS id, unnest(o).q AS question, unnest(o).a AS answer FROM t""")
def question_answers(spark, sf_dir):
    rows = spark.createDataFrame(list(TALKS), "id long, s array<string>").union(_turn_sentences(spark, sf_dir)).select("id", F.explode(Y.question_answers(F.col("s"))).alias("p"))
    return rows.select("id", "p.question", "p.answer")
