"""Queries of ``operators.paging`` over all documents as decks and a few stated ones, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.functions.phrases import LABEL_STOP
from deckloom.operators import paging as P
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import blanks, ends
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

STATED = (
    (1, "1. Methods", ["Short intro"]), (2, "1.1 Sorting", ["Bubble sort swaps neighbours again and again", "Merge sort splits and joins"]), (3, "1.2 Searching", ["Binary search halves the range each time"]),
    (4, "2. Results", ["2. Results"]), (5, "2.1 Speed (1/3)", ["Fast runs", "were seen"]), (6, "2.1 Speed (2/3)", ["Fast runs", "in all cases"]), (7, "2.1 Speed (3/3)", ["And one more point here"]),
    (8, "Introduction to the new methods", ["Key inputs", "Key Inputs for Capital Budgeting Decisions", "Capital Budgeting Decisions"]), (9, "Introduction to the new methods", ["Key inputs", "Another point of it"]),
    (10, "Contents", []), (11, "", ["12 pages left", "ok"]), (12, "Energy", ["Energy"]), (13, "", ["Bubble sort swaps neighbours again and again", "Merge sort splits and joins"]), (14, "Last words", []),
)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _decks(spark, sf_dir):
    """Stated slides as deck -1, every document as a deck; every third slide has a visual, every fourth an image, every fifth goes on."""
    docs = slides(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("deck"), F.col("slide_no").cast("long").alias("slide_no"), "title", "bullets")
    stated = spark.createDataFrame([(-1, *r) for r in STATED], "deck long, slide_no long, title string, bullets array<string>")
    n = F.col("slide_no")
    return stated.union(docs).withColumns({"visual": (n % 3 == 0) & (F.col("deck") >= 0), "image": n % 4 == 2, "continued": (n % 5 == 0) & (F.col("deck") >= 0), "takeaway": F.when(n % 7 == 0, "Point").otherwise("")})


_ROWS = ", ".join(f"(-1, {n}, {q.text(t)}, [{q.quoted(b)}]::VARCHAR[])" for n, t, b in STATED)
_DECKS = f"""{q.SLIDES}, decks AS (SELECT *, slide_no % 3 = 0 AND deck >= 0 AS visual, slide_no % 4 = 2 AS image, slide_no % 5 = 0 AND deck >= 0 AS continued, CASE WHEN slide_no % 7 = 0 THEN 'Point' ELSE '' END AS takeaway
 FROM (SELECT deck::BIGINT AS deck, slide_no::BIGINT AS slide_no, title, bullets FROM (VALUES {_ROWS}) AS v(deck, slide_no, title, bullets) UNION ALL SELECT doc_id, slide_no, title, bullets FROM slides))"""
_PLAIN = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'))"
_IN = lambda s, t: f"(length({s}) >= 4 AND contains(' ' || {t} || ' ', ' ' || {s} || ' '))"
_UNREPEATED = f"""list_transform(list_reduce(list_transform(bullets, lambda b: {{'raw': b, 'norm': {_PLAIN('b')}}}), lambda kept, x: CASE WHEN x.norm = '' OR len(list_filter(kept, lambda k: k.norm = '' OR k.norm = x.norm OR
 (length(x.norm) <= length(k.norm) AND len({blanks('x.norm')}) <= 6 AND {_IN('x.norm', 'k.norm')}) OR (length(x.norm) > length(k.norm) AND length(x.norm) <= length(k.norm) + 14 AND {_IN('k.norm', 'x.norm')}))) > 0 THEN kept ELSE list_append(kept, x) END,
 []::STRUCT(raw VARCHAR, norm VARCHAR)[]), lambda k: k.raw)"""


@query("unrepeated_bullets", f"WITH {_DECKS} SELECT deck, slide_no, array_to_string({_UNREPEATED}, '|') AS bullets FROM decks")
def unrepeated_bullets(spark, sf_dir):
    return _decks(spark, sf_dir).select("deck", "slide_no", F.array_join(P.unrepeated_bullets(F.col("bullets")), "|").alias("bullets"))


_CW = f"list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({q.listed(LABEL_STOP)}, w)))"


@query("unlike_sentences", f"""WITH {_DECKS} SELECT deck, slide_no, array_to_string(list_transform(list_reduce(list_transform(bullets, lambda s: {{'s': s, 'w': {_CW}}}),
 lambda kept, x: CASE WHEN len(x.w) > 0 AND len(list_filter(kept, lambda k: len(k.w) > 0 AND len(list_intersect(x.w, k.w)) >= 0.75 * len(x.w))) > 0 THEN kept ELSE list_append(kept, x) END, []::STRUCT(s VARCHAR, w VARCHAR[])[]), lambda k: k.s), '|') AS sents FROM decks""")
def unlike_sentences(spark, sf_dir):
    return _decks(spark, sf_dir).select("deck", "slide_no", F.array_join(P.unlike_sentences(F.col("bullets")), "|").alias("sents"))


_CONT = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z][a-z''\\-]*'), lambda w: NOT list_contains({q.listed(LABEL_STOP)}, w)))"
_MOST, _LEAST = P.MAX_WORDS, max(30, int(P.MAX_WORDS * 0.4))
_NX, _RECENT = f"len({blanks('x')})", _CONT("array_to_string(s.cur[greatest(len(s.cur) - 2, 1):], ' ')")
_CUT = f"""(len(s.cur) > 0 AND (s.n + {_NX} > {_MOST} OR (s.n >= 45 AND len(list_intersect({_RECENT}, {_CONT('x')}))::DOUBLE / greatest(len(list_distinct(list_concat({_RECENT}, {_CONT('x')}))), 1) < 0.04))
 AND NOT ((regexp_matches({ends('x')}, {q.text(P.CONTINUES)}) OR coalesce(regexp_matches(s.cur[-1], {q.text(P.INTRO)}), false)) AND s.n + {_NX} <= {_MOST} * 1.35::DOUBLE))"""
_GROUPED = f"""gf AS (SELECT deck, slide_no, list_reduce(bullets, lambda s, x: CASE WHEN {_CUT} THEN {{'groups': list_append(s.groups, s.cur), 'cur': [x], 'n': {_NX}}} ELSE {{'groups': s.groups, 'cur': list_append(s.cur, x), 'n': s.n + {_NX}}} END,
  {{'groups': []::VARCHAR[][], 'cur': []::VARCHAR[], 'n': 0::BIGINT}}) AS s FROM entries),
grouped AS (SELECT deck, slide_no, CASE WHEN len(s.cur) = 0 THEN s.groups WHEN len(s.groups) > 0 AND s.n < {_LEAST} THEN list_append(s.groups[:-2], list_concat(s.groups[-1], s.cur)) ELSE list_append(s.groups, s.cur) END AS groups FROM gf)"""


@query("sentence_groups", f"WITH {_DECKS}, entries AS (SELECT * FROM decks), {_GROUPED} SELECT deck, slide_no, (generate_subscripts(groups, 1) - 1)::INT AS place, array_to_string(unnest(groups), '|') AS sents FROM grouped")
def sentence_groups(spark, sf_dir):
    rows = _decks(spark, sf_dir).select("deck", "slide_no", P.sentence_groups(F.col("bullets")).alias("g"))
    return rows.select("deck", "slide_no", F.posexplode_outer("g").alias("place", "g")).where("g IS NOT NULL").select("deck", "slide_no", "place", F.array_join("g", "|").alias("sents"))


_SEC = lambda x: f"regexp_extract({x}, {q.text(P.NUMBERED)}, 1)"
_NB = f"len({blanks(chr(97) + 'rray_to_string(bullets, ' + chr(39) + ' ' + chr(39) + ')')})"


@query("packed_siblings", f"""WITH {_DECKS}, e AS (SELECT deck, list({{'titles': [title], 'bullets': bullets, 'section': {_SEC('title')}, 'n': {_NB}, 'open': {_SEC('title')} <> '' AND {_NB} <= {_MOST} * 0.7::DOUBLE}} ORDER BY slide_no) AS e FROM decks GROUP BY deck),
f AS (SELECT deck, list_reduce(e, lambda acc, x: CASE WHEN len(acc) > 0 AND acc[-1].open AND x.open AND acc[-1].section = x.section AND len(acc[-1].titles) < 3 AND acc[-1].n + x.n <= {_MOST}
  THEN list_append(acc[:-2], {{'titles': list_concat(acc[-1].titles, x.titles), 'bullets': list_concat(acc[-1].bullets, x.bullets), 'section': acc[-1].section, 'n': acc[-1].n + x.n, 'open': acc[-1].open}}) ELSE list_append(acc, x) END,
  []::STRUCT(titles VARCHAR[], bullets VARCHAR[], section VARCHAR, n BIGINT, "open" BOOLEAN)[]) AS p FROM e)
SELECT deck, generate_subscripts(p, 1)::INT AS page, array_to_string(unnest(p).titles, ' · ') AS titles, array_to_string(unnest(p).bullets, '|') AS bullets FROM f""")
def packed_siblings(spark, sf_dir):
    return P.packed_siblings(_decks(spark, sf_dir)).withColumn("bullets", F.array_join("bullets", "|"))


_BARE = f"""bare AS (SELECT *, lead({_SEC('title')}) OVER (PARTITION BY deck ORDER BY slide_no) AS after, {_PLAIN("array_to_string(bullets, ' ')")} AS body FROM decks),
kept AS (SELECT * FROM bare WHERE NOT (body <> '' AND body = {_PLAIN('title')}) AND NOT ({_NB} < 8 AND {_SEC('title')} <> '' AND {_SEC('title')} = coalesce(after, '')))"""


@query("without_bare_headings", f"WITH {_DECKS}, {_BARE} SELECT deck, slide_no, title FROM kept")
def without_bare_headings(spark, sf_dir):
    return P.without_bare_headings(_decks(spark, sf_dir)).select("deck", "slide_no", "title")


_BASE = lambda x: f"lower(trim(regexp_replace({x}, {q.text(P.PART)}, '')))"
_THIN = lambda b: f"(len({blanks(f'array_to_string({b}, ' + chr(39) + ' ' + chr(39) + ')')}) BETWEEN 1 AND {P.THIN_WORDS - 1})"
_BOTH = "list_concat(acc[-1].bullets, list_filter(x.bullets, lambda b: NOT list_contains(acc[-1].bullets, b)))"


@query("merged_parts", f"""WITH {_DECKS}, e AS (SELECT deck, list({{'title': title, 'bullets': bullets}} ORDER BY slide_no) AS e FROM decks GROUP BY deck),
f AS (SELECT deck, list_reduce(e, lambda acc, x: CASE WHEN len(acc) > 0 AND {_THIN('acc[-1].bullets')} AND {_THIN('x.bullets')} AND {_BASE('acc[-1].title')} = {_BASE('x.title')} AND len({_BOTH}) <= {P.MERGED_BULLETS}
  THEN list_append(acc[:-2], {{'title': acc[-1].title, 'bullets': {_BOTH}}}) ELSE list_append(acc, x) END, []::STRUCT(title VARCHAR, bullets VARCHAR[])[]) AS p FROM e),
s AS (SELECT deck, generate_subscripts(p, 1)::INT AS place, unnest(p).title AS title, unnest(p).bullets AS bullets FROM f), g AS (SELECT *, regexp_matches(title, {q.text(P.PART)}) AS part, {_BASE('title')} AS base FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY deck, part, base ORDER BY place) AS k, count(*) OVER (PARTITION BY deck, part, base) AS n FROM g)
SELECT deck, place, CASE WHEN NOT part THEN title WHEN n = 1 THEN regexp_replace(title, {q.text(P.PART)}, '') ELSE regexp_replace(title, {q.text(P.PART)}, '') || ' (' || k || '/' || n || ')' END AS title, array_to_string(bullets, '|') AS bullets FROM n""")
def merged_parts(spark, sf_dir):
    return P.merged_parts(_decks(spark, sf_dir)).withColumn("bullets", F.array_join("bullets", "|"))


_WA, _WB = f"list_distinct({blanks('acc[-1].norm')})", f"list_distinct({blanks('x.norm')})"
_TOPIC = f"(acc[-1].norm <> '' AND x.norm <> '' AND (acc[-1].norm = x.norm OR (len(list_intersect({_WA}, {_WB})) >= 0.9 * greatest(len({_WA}), len({_WB})) AND greatest(len({_WA}), len({_WB})) >= 3)))"
_FRESH = f"list_filter(x.bullets, lambda b, i: NOT list_contains(list_transform(acc[-1].bullets, lambda c: {_PLAIN('c')}), {_PLAIN('b')}) AND list_position(list_transform(x.bullets, lambda c: {_PLAIN('c')}), {_PLAIN('b')}) = i)"


@query("folded_titles", rf"""WITH {_DECKS}, e AS (SELECT deck, list({{'title': title, 'norm': {_PLAIN("regexp_replace(title, '" + chr(92) + "s+', ' ', 'g')")}, 'bullets': bullets}} ORDER BY slide_no) AS e FROM decks GROUP BY deck),
f AS (SELECT deck, list_reduce(e, lambda acc, x: CASE WHEN len(acc) > 0 AND {_TOPIC} THEN list_append(acc[:-2], {{'title': acc[-1].title, 'norm': acc[-1].norm, 'bullets': list_concat(acc[-1].bullets, {_FRESH})}}) ELSE list_append(acc, x) END,
  []::STRUCT(title VARCHAR, norm VARCHAR, bullets VARCHAR[])[]) AS p FROM e) SELECT deck, generate_subscripts(p, 1)::INT AS place, unnest(p).title AS title, array_to_string(unnest(p).bullets, '|') AS bullets FROM f""")
def folded_titles(spark, sf_dir):
    return P.folded_titles(_decks(spark, sf_dir)).withColumn("bullets", F.array_join("bullets", "|"))


_REAL = rf"list_filter(bullets, lambda b: len({blanks('b')}) >= 3 AND NOT regexp_matches({ends('b')}, '^\d+\s.*$'))"
_AZ = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}'))"
_FULL = f"""full_ AS (SELECT *, len(r) > 1 OR (len(r) = 1 AND NOT (len({_AZ('r[1]')}) = 0 OR len(list_intersect({_AZ('r[1]')}, {_AZ('title')})) >= 0.6 * len({_AZ('r[1]')}))) OR visual OR trim(takeaway) <> ''
 OR (image AND NOT regexp_matches(regexp_replace(trim(title), ':+$', ''), {q.text(P.GENERIC)})) AS filled FROM (SELECT *, {_REAL} AS r FROM decks))"""


@query("slides_with_content", f"WITH {_DECKS}, {_FULL} SELECT deck, slide_no, filled AS has_content FROM full_")
def slides_with_content(spark, sf_dir):
    return _decks(spark, sf_dir).select("deck", "slide_no", P.has_content(*map(F.col, ("title", "bullets", "visual", "takeaway", "image"))).alias("has_content"))


@query("without_empty_slides", f"""WITH {_DECKS}, {_FULL}, g AS (SELECT *, coalesce(sum(filled::INT) OVER (PARTITION BY deck ORDER BY slide_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM full_),
c AS (SELECT *, last_value(CASE WHEN NOT filled AND trim(title) <> '' AND NOT regexp_matches(trim(title), {q.text(P.UNNAMED)}) THEN trim(title) END IGNORE NULLS) OVER (PARTITION BY deck, gap ORDER BY slide_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM g)
SELECT deck, slide_no, CASE WHEN trim(title) = '' THEN coalesce(carried, title) ELSE title END AS title FROM c WHERE filled""")
def without_empty_slides(spark, sf_dir):
    return P.without_empty(_decks(spark, sf_dir))


@query("folded_thin_slides", f"""WITH {_DECKS}, g AS (SELECT deck, slide_no, bullets, count(*) OVER (PARTITION BY deck) >= 4 AND len({_REAL}) = 0 AND NOT visual AND slide_no < max(slide_no) OVER (PARTITION BY deck) AS gone FROM decks),
t AS (SELECT *, min(CASE WHEN NOT gone THEN slide_no END) OVER (PARTITION BY deck ORDER BY slide_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM g)
SELECT deck, target AS slide_no, array_to_string(flatten(list(bullets ORDER BY slide_no)), '|') AS bullets FROM t GROUP BY deck, target""")
def folded_thin_slides(spark, sf_dir):
    return P.folded_thin(_decks(spark, sf_dir)).withColumn("bullets", F.array_join("bullets", "|"))


_KEYS = "list_distinct(list_filter(list_transform(bullets, lambda b: substr(regexp_replace(lower(b), '[^a-z0-9]', '', 'g'), 1, 60)), lambda k: length(k) >= 6))"


@query("unrepeated_slides", f"""WITH {_DECKS}, e AS (SELECT deck, list({{'slide_no': slide_no, 'keys': {_KEYS}, 'continued': continued, 'visual': visual}} ORDER BY slide_no) AS e FROM decks GROUP BY deck),
f AS (SELECT deck, list_reduce(list_transform(e, lambda x: {{'slide_no': x.slide_no, 'keys': x.keys, 'counts': NOT x.continued, 'visual': x.visual}}), lambda kept, x: CASE WHEN x.counts AND len(x.keys) > 0 AND NOT x.visual
  AND len(list_filter(kept, lambda k: k.counts AND len(k.keys) > 0 AND len(list_intersect(x.keys, k.keys)) >= 0.7 * len(x.keys))) > 0 THEN kept ELSE list_append(kept, x) END, []::STRUCT(slide_no BIGINT, keys VARCHAR[], counts BOOLEAN, visual BOOLEAN)[]) AS k FROM e)
SELECT deck, unnest(k).slide_no AS slide_no FROM f""")
def unrepeated_slides(spark, sf_dir):
    return P.unrepeated_slides(_decks(spark, sf_dir))


def _even(i: str, n: str, size: int) -> tuple[str, str]:
    pages = f"greatest(ceil({n} / {size}.0)::BIGINT, 1)"
    base = f"({n} // {pages})"
    extra = f"({n} - {base} * {pages})"
    return f"(CASE WHEN {i} < {extra} * ({base} + 1) THEN {i} // ({base} + 1) ELSE {extra} + ({i} - {extra} * ({base} + 1)) // greatest({base}, 1) END)", pages


def _part(page: str, pages: str) -> str:
    return f"CASE WHEN {pages} <= 1 THEN title ELSE trim(regexp_replace(title, {q.text(P.PART)}, '')) || ' (' || ({page} + 1) || '/' || {pages} || ')' END"


_PB = _PLAIN("b")
_PG, _PS = _even("i", "n", 4)


@query("paged_slides", f"""WITH {_DECKS}, u AS (SELECT deck, slide_no, title, list_filter({_UNREPEATED}, lambda b: NOT ({_PB} <> '' AND {_PLAIN('title')} <> '' AND ({_PB} = {_PLAIN('title')} OR (length({_PB}) >= 8 AND contains({_PLAIN('title')}, {_PB}))))) AS b0 FROM decks),
x AS (SELECT deck, slide_no, title, CASE WHEN slide_no % 6 = 1 THEN list_append(b0, 'Example: ' || title) ELSE b0 END AS b FROM u), r AS (SELECT deck, slide_no, title, len(b) AS n, unnest(CASE WHEN len(b) = 0 THEN [NULL] ELSE b END) AS bullet, generate_subscripts(CASE WHEN len(b) = 0 THEN [NULL] ELSE b END, 1) - 1 AS i FROM x),
p AS (SELECT *, {_PG} AS part, {_PS} AS pages FROM r)
SELECT deck, slide_no, part::BIGINT AS part, {_part('part', 'pages')} AS title, coalesce(string_agg(bullet, '|' ORDER BY i), '') AS bullets, part > 0 AS continued FROM p GROUP BY deck, slide_no, title, part, pages""")
def paged_slides(spark, sf_dir):
    decks = _decks(spark, sf_dir)
    extras = decks.where("slide_no % 6 = 1").select("deck", "slide_no", F.concat(F.lit("Example: "), "title").alias("extra"))
    return P.paged(decks, extras, 4).withColumn("bullets", F.array_join("bullets", "|"))


TABLES = ((1, "Costs", ["Plan", "Price"], [f"row {k}" for k in range(9)], ["lead a", "lead b"]), (2, "Leads only (1/2)", ["H"], [], [f"lead {k}" for k in range(7)]), (3, "Small", ["A"], ["x"], []))
_TROWS = ", ".join(f"({i}, {q.text(t)}, [{q.quoted(h)}], [{q.quoted(r)}]::VARCHAR[], [{q.quoted(ld)}]::VARCHAR[])" for i, t, h, r, ld in TABLES)
_R, _ = _even("i", "n", 4)
_L, _ = _even("i", "n", 3)


@query("paged_tables", f"""WITH t AS (SELECT * FROM (VALUES {_TROWS}) AS v(table_id, title, headers, rows, leads) UNION ALL SELECT -1 - o_custkey, 'Orders of ' || o_custkey, ['Order', 'Status'], list(o_orderkey || ' ' || o_orderstatus ORDER BY o_orderkey), []::VARCHAR[] FROM orders GROUP BY o_custkey),
r AS (SELECT table_id, len(rows) AS n, unnest(rows) AS x, generate_subscripts(rows, 1) - 1 AS i FROM t), rp AS (SELECT table_id, part, string_agg(x, '|' ORDER BY i) AS r FROM (SELECT *, {_R} AS part FROM r) GROUP BY 1, 2),
l AS (SELECT table_id, len(leads) AS n, unnest(leads) AS x, generate_subscripts(leads, 1) - 1 AS i FROM t), lp AS (SELECT table_id, part, string_agg(x, '|' ORDER BY i) AS l FROM (SELECT *, {_L} AS part FROM l) GROUP BY 1, 2),
j AS (SELECT coalesce(rp.table_id, lp.table_id) AS table_id, coalesce(rp.part, lp.part) AS part, r, l FROM rp FULL JOIN lp ON rp.table_id = lp.table_id AND rp.part = lp.part), k AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS pages FROM j)
SELECT k.table_id::BIGINT AS table_id, part::BIGINT AS part, {_part('part', 'pages')} AS title, CASE WHEN r IS NOT NULL THEN array_to_string(headers, '|') ELSE '' END AS headers, coalesce(r, '') AS rows, coalesce(l, '') AS leads FROM k JOIN t ON t.table_id = k.table_id""")
def paged_tables(spark, sf_dir):
    key = F.col("o_custkey")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda o: F.concat_ws(" ", o["o_orderkey"].cast("string"), o["o_orderstatus"]))
    bought = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(lines.alias("rows")).select(-1 - key, F.concat(F.lit("Orders of "), key.cast("string")), F.array(F.lit("Order"), F.lit("Status")), "rows", F.array().cast("array<string>"))
    made = P.paged_tables(spark.createDataFrame(list(TABLES), "table_id long, title string, headers array<string>, rows array<string>, leads array<string>").union(bought))
    return made.select("table_id", "part", "title", *[F.array_join(c, "|").alias(c) for c in ("headers", "rows", "leads")])


@query("planned_slides", f"""WITH {_DECKS}, {_BARE}, entries AS (SELECT * FROM kept WHERE len(bullets) > 0), {_GROUPED}, w AS (SELECT e.deck, e.slide_no, CASE WHEN {_NB.replace('bullets', 'e.bullets')} > {_MOST} THEN groups ELSE [e.bullets] END AS g FROM entries e JOIN grouped USING (deck, slide_no))
SELECT deck, slide_no, (generate_subscripts(g, 1) - 1)::INT AS part, len(g)::INT AS parts, array_to_string(unnest(g), '|') AS bullets FROM w""")
def planned_slides(spark, sf_dir):
    return P.planned(_decks(spark, sf_dir)).withColumn("bullets", F.array_join("bullets", "|"))
