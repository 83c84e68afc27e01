"""Queries of ``operators.markdown`` over stated markdown, over documents too where plain text will do, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import markdown as M
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import blanks, ends, values
from deckloom.plans.service import _junk
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

LONG = " ".join(f"word{k}" for k in range(400))
MARKDOWN = (
    (1, "Preamble line\n\n# Biology 101\nIntro text.\n## Cells\n- first item\n- second item\n  goes on\n\n### Nucleus\nHolds the code.\n## Cells\nMore on cells.\n## Page 4\nA page without a name.\n## x = y + \nformula junk\n## Plants\n"),
    (2, "UNIT ONE: BASICS\nchapter two begins\n1.2) Numbered Heading here\nplain sentence that is not a heading at all.\n\nA long line that holds more than nine words and so it is plain text\n# kept"),
    (3, "## Table page\n**Costs in euro**\n| Plan | Price |\n| --- | --- |\n| Basic | 5 |\n| Team | 20 |\nAfter the table\nphoto.png\n![alt](x.jpg)\n\n\n\nEnd of it\n| a | b |\n| c | d |"),
    (4, "## Introduction to Natural Language\n\n## Processing\nBody one\n## Rule-based Systems\n## Next (a)\n## Part\nProf. A. Writer 2019-20\nRunning head line\nText a\nRunning head line\nText b Dr. Who 2020-21 room\nRunning head line\n12\npage 7\n[Extracted OCR: x]\n]"),
    (5, "|•||NLP basics|\n|•||Tokens and tags|\nBetween\n| Name | Use |\n| - | - |\n| Cell | Life |\n[TABLE DATA]\n| h | i |\n| j | k |\n\nlast words here"),
    (6, ""),
    (7, f"## Long one\n{LONG}\n\n- item one {LONG[:400]}\n- item two {LONG[:900]}\n- item three\n\nshort end"),
    (8, "## Stages in NLP\nfirst\n## Stages in NLP, cont.\nsecond\n## Other\n## Other thing entirely\nx"),
)
# Html as plain markdown: what is no content goes, headings and list items get their marks, other blocks begin a line, tags go.
HTML_STEPS = (
    (r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", ""),
    (r"(?i)<h1[^>]*>", "\n# "),
    (r"(?i)<h2[^>]*>|<footer[^>]*>", "\n## "),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<p[^>]*>|<br[^>]*>|</(?:h[1-6]|ul|ol|nav|div)>|<article[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
)


def page_text(html):
    """A page's html as markdown, by ``HTML_STEPS``."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    return html


_PAGE = "coalesce(html, '')"
for _pattern, _by in HTML_STEPS:
    _by = f"chr(10) || {q.text(_by[1:])}" if _by else "''"
    _PAGE = f"regexp_replace({_PAGE}, {q.text(_pattern)}, {_by}, 'g')"
#: The stated markdown, and all pages under negative ids.
_M = f"(SELECT id::BIGINT AS doc, text FROM {values(MARKDOWN, 'id, text')} UNION ALL SELECT -1 - page_id, {_PAGE} FROM pages)"
_LINES = rf"""l AS (SELECT doc::BIGINT AS doc, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS no FROM {_M}),
s AS (SELECT doc, no, line, {ends('line')} AS s, length(regexp_extract({ends('line')}, '^(#{{1,6}})\s+(.*)$', 1)) AS level, trim(regexp_extract({ends('line')}, '^(#{{1,6}})\s+(.*)$', 2)) AS title FROM l)"""
PAGES = ((1, 1, "title", "Deck", []), (1, 2, "content", "Cells", [(0, "one"), (1, "one a")]), (1, 3, "content", "", [(0, "two")]), (1, 4, "content", None, []), (2, 1, "content", "", [(2, "deep")]), (2, 2, "figure", "Plot", []))


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _texts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc"), page_text(F.coalesce("html", F.lit(""))).alias("text"))
    return spark.createDataFrame(list(MARKDOWN), "doc long, text string").union(pages)


_TITLE = r"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"
_HEAD = f"CASE WHEN upper(x) = x AND lower(x) <> x THEN '## ' || {_TITLE.format(x=chr(114)+chr(101)+chr(103)+chr(101)+chr(120)+chr(112)+'_replace(x, ' + q.text(chr(94)+chr(92)+'d+(?:'+chr(92)+'.'+chr(92)+'d+)*[.)]'+chr(92)+'s+') + ', ' + chr(39)*2 + ')')} ELSE '## ' || x END"


@query("outlines", rf"""WITH t AS (SELECT doc, text FROM {_M} UNION ALL SELECT -1 - doc_id, coalesce(text, '') FROM documents),
u AS (SELECT doc, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda y: list_transform([{ends('y')}], lambda x: CASE WHEN x = '' THEN '' WHEN regexp_matches(x, '^#{{1,6}}\s') THEN x
  WHEN len({blanks('x')}) <= 9 AND ((upper(x) = x AND lower(x) <> x) OR regexp_matches(x, {q.text(M.UNIT_LINE)}) OR regexp_matches(x, {q.text(M.NUMBERED_LINE)})) THEN {_HEAD} ELSE regexp_replace(y, '\s+$', '') END)[1]) AS l FROM t)
SELECT doc, {ends("array_to_string(l, chr(10))")} AS markdown FROM u""")
def outlines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return _texts(spark, sf_dir).union(docs).select("doc", M.outline_to_markdown(F.col("text")).alias("markdown"))


@query("typed_documents", "SELECT doc_id AS doc, text AS markdown, 'Typed Input' AS source_name, 'typed' AS converter FROM documents")
def typed_documents(spark, sf_dir):
    return M.from_typed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("without_pictures", rf"SELECT doc::BIGINT AS doc, {ends('regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, ' + q.text(M.PICTURE) + ')), chr(10)), ' + q.text(chr(92) + 'n{3,}') + ', chr(10) || chr(10), ' + q.text('g') + ')')} AS text FROM {_M}")
def without_pictures(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc", M.without_pictures(F.col("text")).alias("text"))


@query("without_boilerplate", rf"""WITH {_LINES}, k AS (SELECT *, level > 0 AS heading, CASE WHEN level = 0 AND length(lower(regexp_replace(regexp_replace(s, '^[-*+•\d.)\s]+', ''), '\s+', ' ', 'g'))) >= 8 THEN lower(regexp_replace(regexp_replace(s, '^[-*+•\d.)\s]+', ''), '\s+', ' ', 'g')) END AS key,
  regexp_replace(s, '^[-*+•>\d.)\s]+', '') AS body, regexp_replace(regexp_replace(line, {q.text(M.TRAILING)}, ''), '\s+$', '') AS cut FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, greatest(3, greatest(1, count(*) FILTER (heading) OVER (PARTITION BY doc)) // 8) AS least_n, CASE WHEN key IS NOT NULL THEN count(key) OVER (PARTITION BY doc, key) ELSE 0 END AS times FROM k)
SELECT doc, no, CASE WHEN n < 8 OR heading THEN line ELSE cut END AS line FROM c WHERE n < 8 OR (NOT (regexp_matches(s, {q.text(M.OCR_MARK)}) OR s IN (']', ']]')) AND (heading OR
 (NOT coalesce((times >= least_n AND lower(regexp_replace(body, '\s+', ' ', 'g')) = key) OR regexp_matches(s, {q.text(M.PAGE_NUMBER)}) OR regexp_matches(body, {q.text(M.FOOTER)}), false) AND {ends('cut')} <> '')))""")
def without_boilerplate(spark, sf_dir):
    return M.without_boilerplate(_texts(spark, sf_dir))


_CELLS = rf"list_transform(string_split(regexp_replace(s, '^\|+|\|+$', '', 'g'), '|'), lambda c: {ends('c')})"
_JUNK = "(c IN ('', '•', '-', '*', 'Ø') OR length(c) <= 1)"


@query("without_fake_tables", rf"""WITH {_LINES}, p AS (SELECT doc, no, line, s, regexp_matches(line, {q.text(M.PIPED)}) AS piped FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY no) - row_number() OVER (PARTITION BY doc, piped ORDER BY no) AS run,
  CASE WHEN piped AND NOT regexp_matches(line, '^\s*\|?[\s:|-]+\|?\s*$') THEN {_CELLS} END AS cells FROM p),
f AS (SELECT *, sum(coalesce(len(list_filter(cells, lambda c: {_JUNK})), 0)) OVER w AS nj, sum(coalesce(len(list_filter(cells, lambda c: NOT {_JUNK})), 0)) OVER w AS nr, bool_or(cells IS NOT NULL AND regexp_matches(s, '^(?:\|\||\|•|\| \|)')) OVER w AS lead FROM r WINDOW w AS (PARTITION BY doc, piped, run)),
x AS (SELECT doc, no, CASE WHEN piped AND nr > 0 AND (lead OR nj >= 0.3 * (nj + nr)) THEN list_transform(list_filter(coalesce(cells, []::VARCHAR[]), lambda c: NOT {_JUNK}), lambda c: '- ' || c) ELSE [line] END AS x FROM f)
SELECT doc, no, (generate_subscripts(x, 1) - 1)::INT AS sub, unnest(x) AS line FROM x""")
def without_fake_tables(spark, sf_dir):
    return M.without_fake_tables(M.lines_of(_texts(spark, sf_dir)))


@query("whole_headings", rf"""WITH {_LINES}, b AS (SELECT *, lag(level) OVER o AS pl, lag(title) OVER o AS pt FROM s WHERE s <> '' WINDOW o AS (PARTITION BY doc ORDER BY no)),
w AS (SELECT *, coalesce(level > 0 AND level = pl AND len({blanks('title')}) <= 2 AND NOT regexp_matches(title, '[:.?]$') AND NOT regexp_matches(pt, '[:.?)]$'), false) AS wraps FROM b),
r AS (SELECT *, sum((NOT wraps)::INT) OVER (PARTITION BY doc ORDER BY no) AS run FROM w),
g AS (SELECT doc, run, min(no) AS lo, max(no) AS hi, count(*) AS n, min_by(line, no) AS line, repeat('#', any_value(level)::INT) || ' ' || string_agg(title, ' ' ORDER BY no) AS whole FROM r GROUP BY doc, run)
SELECT doc, lo AS no, CASE WHEN n > 1 THEN whole ELSE line END AS line FROM g UNION ALL SELECT doc, no, line FROM s WHERE s = '' AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = s.doc AND hi > lo AND s.no > lo AND s.no < hi)""")
def whole_headings(spark, sf_dir):
    return M.with_whole_headings(M.lines_of(_texts(spark, sf_dir)))


_SECTIONS = rf"""{_LINES}, o AS (SELECT *, level BETWEEN 1 AND 2 AND NOT {_junk('title')} AS opens FROM s), p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY no) AS part FROM o),
g AS (SELECT doc, part, coalesce(max(title) FILTER (opens), '') AS title, coalesce(max(level) FILTER (opens), 0) AS level, {ends("coalesce(string_agg(CASE WHEN level > 0 THEN title ELSE line END, chr(10) ORDER BY no) FILTER (NOT opens), '')")} AS text FROM p GROUP BY doc, part),
k AS (SELECT *, CASE WHEN title <> '' AND NOT regexp_matches(title, {q.text(M.PAGE_TITLE)}) THEN title END AS real FROM g WHERE title <> '' OR text <> ''),
sections AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY part))::INT AS section, coalesce(real, last_value(real IGNORE NULLS) OVER (PARTITION BY doc ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), title) AS title, level::INT AS level, text FROM k)"""


@query("markdown_sections", f"WITH {_SECTIONS} SELECT doc, section, title, level, text FROM sections")
def markdown_sections(spark, sf_dir):
    return M.sections_of(_texts(spark, sf_dir))


@query("parsed_units", f"WITH {_SECTIONS} SELECT doc, section AS unit, coalesce(nullif(title, ''), 'Section ' || section) AS title, len(list_filter(string_split(text, chr(10)), lambda x: {ends('x')} <> ''))::INT AS n_lines, text FROM sections")
def parsed_units(spark, sf_dir):
    return M.parsed_units(M.sections_of(_texts(spark, sf_dir)))


_LAST = "acc[-1]"
_MERGED = rf"""{_SECTIONS}, sl AS (SELECT doc, list({{'title': title, 'text': text}} ORDER BY section) AS s FROM sections GROUP BY doc),
mf AS (SELECT doc, list_reduce(s, lambda acc, x: CASE WHEN len(acc) > 0 AND x.title <> '' AND lower(trim(x.title)) = lower(trim({_LAST}.title)) AND length({_LAST}.text) + length(x.text) <= {M.MERGED_CHARS}
  THEN list_append(acc[:-2], {{'title': {_LAST}.title, 'text': CASE WHEN x.text = '' THEN {_LAST}.text ELSE {ends("regexp_replace(" + _LAST + ".text, '" + chr(92) + "s+$', '') || chr(10) || x.text")} END}}) ELSE list_append(acc, x) END, []::STRUCT(title VARCHAR, "text" VARCHAR)[]) AS s FROM sl)"""


@query("merged_sections", f"WITH {_MERGED} SELECT doc, generate_subscripts(s, 1)::INT AS section, unnest(s).title AS title, unnest(s).text AS text FROM mf")
def merged_sections(spark, sf_dir):
    return M.merged_sections(M.sections_of(_texts(spark, sf_dir)))


def _state(out: str, cur: str, mode: str) -> str:
    return f"{{'out': {out}, 'cur': {cur}, 'mode': '{mode}'}}"


_CLOSED = "CASE WHEN len(a.cur) > 0 THEN list_append(a.out, CASE WHEN a.mode = 'text' THEN array_to_string(a.cur, ' ') ELSE array_to_string(a.cur, chr(10)) END) ELSE a.out END"
_T, _ITEM, _NONE = ends("x"), f"regexp_matches(x, {q.text(M.LIST_ITEM)})", "[]::VARCHAR[]"
_BODY = f"trim(regexp_extract(x, {q.text(M.LIST_ITEM)}, 1))"
_ADD = f"CASE WHEN {_BODY} <> '' THEN [{_BODY}] ELSE {_NONE} END"
_STEP = f"""CASE WHEN a.mode = 'table' AND prefix({_T}, '##') THEN {_state(_CLOSED, f'[{_T}]', 'text')} WHEN a.mode = 'table' AND {_T} = '' THEN {_state(_CLOSED, _NONE, 'text')} WHEN a.mode = 'table' THEN {_state('a.out', f'list_append(a.cur, {_T})', 'table')}
 WHEN {_ITEM} AND a.mode = 'list' THEN {_state('a.out', f'list_concat(a.cur, {_ADD})', 'list')} WHEN {_ITEM} THEN {_state(_CLOSED, _ADD, 'list')}
 WHEN a.mode = 'list' AND {_T} <> '' THEN CASE WHEN len(a.cur) > 0 THEN {_state('a.out', f"list_append(a.cur[:-2], a.cur[-1] || ' ' || {_T})", 'list')} ELSE a END
 WHEN {_T} = '{M.TABLE_MARK}' THEN {_state(_CLOSED, f'[{_T}]', 'table')} WHEN prefix({_T}, '## ') THEN {_state(_CLOSED, f"[trim(regexp_replace({_T}, '^[# ]+', ''))]", 'text')} WHEN {_T} = '' THEN {_state(_CLOSED, _NONE, 'text')} ELSE {_state('a.out', f'list_append(a.cur, {_T})', 'text')} END"""
_PARAS = f"""pf AS (SELECT doc, section AS unit, list_reduce(string_split(text, chr(10)), lambda a, x: {_STEP}, {_state(_NONE, _NONE, 'text')}) AS a FROM sections),
pg AS (SELECT doc, unit, list_filter({_CLOSED}, lambda p: {ends('p')} <> '') AS p FROM pf), paras AS (SELECT doc, unit, generate_subscripts(p, 1)::INT AS para, unnest(p) AS text FROM pg)"""


@query("section_paragraphs", f"WITH {_SECTIONS}, {_PARAS} SELECT doc, unit, para, text FROM paras")
def section_paragraphs(spark, sf_dir):
    return M.paragraphs(M.sections_of(_texts(spark, sf_dir)).select("doc", F.col("section").alias("unit"), "text"))


_N = lambda x: f"len({blanks(x)})"
_CHUNKS = f"""cl AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: {ends('x')} <> '') AS l, {blanks('text')} AS w FROM paras),
cf AS (SELECT doc, unit, para, CASE WHEN prefix(text, '{M.TABLE_MARK}') OR contains(text, ' | ') OR len(w) <= {M.CHUNK_WORDS} THEN [text]
  WHEN len(l) > 1 THEN list_transform(list_reduce(l, lambda acc, x: CASE WHEN len(acc) > 0 AND acc[-1].n + {_N('x')} <= {M.CHUNK_WORDS} THEN list_append(acc[:-2], {{'t': acc[-1].t || chr(10) || x, 'n': acc[-1].n + {_N('x')}}}) ELSE list_append(acc, {{'t': x, 'n': {_N('x')}}}) END, []::STRUCT(t VARCHAR, n BIGINT)[]), lambda s: s.t)
  ELSE list_transform(range(0, len(w), {M.CHUNK_WORDS}), lambda i: array_to_string(w[i + 1:i + {M.CHUNK_WORDS}], ' ')) END AS c FROM cl),
chunks AS (SELECT doc, unit, para, (generate_subscripts(c, 1) - 1)::INT AS piece, unnest(c) AS text FROM cf)"""


def _paras(spark, sf_dir):
    return M.paragraphs(M.sections_of(_texts(spark, sf_dir)).select("doc", F.col("section").alias("unit"), "text"))


@query("section_chunks", f"WITH {_SECTIONS}, {_PARAS}, {_CHUNKS} SELECT doc, unit, para, piece, text FROM chunks")
def section_chunks(spark, sf_dir):
    return M.chunks(_paras(spark, sf_dir))


def _key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\b(?:cont(?:inued|d)?|part|contd)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _same(a: str, b: str) -> str:
    ka, kb = _key(a), _key(b)
    wa, wb = f"list_distinct({blanks(ka)})", f"list_distinct({blanks(kb)})"
    return f"""({ka} <> '' AND {kb} <> '' AND ({ka} = {kb} OR ((contains({ka}, {kb}) OR contains({kb}, {ka})) AND least(len({wa}), len({wb})) >= 0.75 * greatest(len({wa}), len({wb})))
 OR (greatest(len({wa}), len({wb})) >= 3 AND len(list_intersect({wa}, {wb})) >= 0.8 * greatest(len({wa}), len({wb})))))"""


@query("chunks_by_heading", rf"""WITH {_SECTIONS}, {_PARAS}, {_CHUNKS}, c AS (SELECT chunks.doc, unit AS source, title, chunks.text, row_number() OVER (PARTITION BY chunks.doc ORDER BY unit, para, piece) AS chunk FROM chunks JOIN sections ON sections.doc = chunks.doc AND section = unit),
b AS (SELECT doc, source, min(chunk) AS f, min_by(title, chunk) AS title, coalesce(string_agg(text, chr(10) ORDER BY chunk) FILTER (text <> ''), '') AS text FROM c GROUP BY doc, source), sl AS (SELECT doc, list({{'title': title, 'text': text}} ORDER BY f) AS s FROM b GROUP BY doc),
mf AS (SELECT doc, list_reduce(s, lambda acc, x: CASE WHEN len(acc) > 0 AND {_same('acc[-1].title', 'x.title')} THEN list_append(acc[:-2], {{'title': CASE WHEN length(x.title) > length(acc[-1].title) THEN x.title ELSE acc[-1].title END, 'text': CASE WHEN x.text = '' THEN acc[-1].text ELSE acc[-1].text || chr(10) || x.text END}})
  ELSE list_append(acc, x) END, []::STRUCT(title VARCHAR, "text" VARCHAR)[]) AS s FROM sl)
SELECT doc, (generate_subscripts(s, 1) - 1)::INT AS place, unnest(s).title AS title, unnest(s).text AS text FROM mf""")
def chunks_by_heading(spark, sf_dir):
    from pyspark.sql import Window

    pieces = M.chunks(_paras(spark, sf_dir)).join(M.sections_of(_texts(spark, sf_dir)).select("doc", F.col("section").alias("unit"), "title"), ["doc", "unit"])
    number = F.row_number().over(Window.partitionBy("doc").orderBy("unit", "para", "piece"))
    return M.chunks_by_heading(pieces.select("doc", F.col("unit").alias("source"), number.alias("chunk"), "title", "text"))


@query("table_segments", rf"""WITH {_LINES}, p AS (SELECT doc, no, line, regexp_matches(s, '^\|.*\|$') AS piped, {_CELLS} AS cells FROM s WHERE s <> '{M.TABLE_MARK}'),
m AS (SELECT *, piped AND len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, '^:?-{{2,}}:?$'))) = 0 AS marks, row_number() OVER (PARTITION BY doc ORDER BY no) - row_number() OVER (PARTITION BY doc, piped ORDER BY no) AS run FROM p),
t AS (SELECT *, piped AND bool_or(marks) OVER w AND sum((NOT marks)::INT) OVER w >= 2 AND count(*) OVER w >= 3 AS tab FROM m WINDOW w AS (PARTITION BY doc, piped, run)),
f AS (SELECT *, CASE WHEN tab <> coalesce(lag(tab) OVER o, false) OR (tab AND run <> lag(run) OVER o) THEN 1 ELSE 0 END AS fresh FROM t WINDOW o AS (PARTITION BY doc ORDER BY no)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY no) AS seg FROM f),
h AS (SELECT doc, seg, bool_or(tab) AS tab, sum((tab AND NOT marks)::INT) AS n, {ends('string_agg(line, chr(10) ORDER BY no)')} AS text FROM g GROUP BY doc, seg),
i AS (SELECT *, CASE WHEN NOT tab THEN regexp_extract(text, '(?:^|\n)[ \t]*\*\*([^\n]+)\*\*[ \t]*$', 1) ELSE '' END AS bold FROM h),
j AS (SELECT *, CASE WHEN tab THEN coalesce(lag(bold) OVER o, '') ELSE '' END AS caption, coalesce(lead(tab) OVER o, false) AS bt FROM i WINDOW o AS (PARTITION BY doc ORDER BY seg)),
k AS (SELECT doc, seg, tab, caption, CASE WHEN tab THEN n - 1 ELSE 0 END AS n_rows, CASE WHEN NOT tab AND bt AND bold <> '' THEN {ends("regexp_replace(text, '(?:^|" + chr(92) + "n)[ " + chr(92) + "t]*" + chr(92) + "*" + chr(92) + "*[^" + chr(92) + "n]+" + chr(92) + "*" + chr(92) + "*[ " + chr(92) + "t]*$', '')")} ELSE text END AS text FROM j)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY seg))::INT AS segment, CASE WHEN tab THEN 'table' ELSE 'prose' END AS kind, caption, n_rows::BIGINT AS n_rows, text FROM k WHERE tab OR text <> ''""")
def table_segments(spark, sf_dir):
    return M.table_segments(_texts(spark, sf_dir))


@query("loose_tables", rf"""WITH p AS (SELECT doc, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {ends('x')}), lambda x: length(x) - length(replace(x, '|', '')) >= 2),
   lambda s: {_CELLS}), lambda r: len(list_filter(r, lambda c: NOT regexp_matches(c, '^[-: ]+$'))) > 0 AND len(list_filter(r, lambda c: c <> '')) > 0) AS r FROM {_M}),
u AS (SELECT doc, unnest(r) AS row, (generate_subscripts(r, 1) - 1)::INT AS row_no, list_max(list_transform(r, lambda x: len(x))) AS w FROM p WHERE len(r) >= 2)
SELECT doc::BIGINT AS doc, row_no, array_to_string(list_resize(row, w, ''), '|') AS cells FROM u""")
def loose_tables(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc", F.posexplode(M.loose_table(F.col("text"))).alias("row_no", "row")).select("doc", "row_no", F.array_join("row", "|").alias("cells"))


_PG = ", ".join(f"({d}, {p}, '{k}', {'NULL' if t is None else q.text(t)}, [{', '.join(f'{{{chr(39)}level{chr(39)}: {lv}, {chr(39)}text{chr(39)}: {q.text(tx)}}}' for lv, tx in it)}]::STRUCT(level INT, \"text\" VARCHAR)[])" for d, p, k, t, it in PAGES)


@query("page_markdown", f"""WITH {q.SLIDES}, p AS (SELECT * FROM (VALUES {_PG}) AS v(doc, page, kind, title, items) UNION ALL SELECT -1 - doc_id, slide_no::INT, 'content', CASE WHEN len(bullets) > 0 THEN title ELSE '' END, list_transform(bullets, lambda b, i: {{'level': ((i - 1) % 3)::INT, 'text': b}}) FROM slides), h AS (SELECT *, coalesce(nullif(title, ''), last_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Slide ' || page) AS head FROM p),
b AS (SELECT doc, page, array_to_string(list_concat(list_concat(['## ' || head, ''], list_transform(items, lambda i: repeat('  ', i.level) || '- ' || i.text)), ['']), chr(10)) AS b FROM h WHERE kind <> 'title')
SELECT doc::BIGINT AS doc, {ends("string_agg(b, chr(10) ORDER BY page)")} AS markdown FROM b GROUP BY doc""")
def page_markdown(spark, sf_dir):
    items = F.transform("bullets", lambda b, i: F.struct((i % 3).cast("int").alias("level"), b.alias("text")))
    decks = slides(table(spark, sf_dir, "documents")).select((-1 - F.col("doc_id")).alias("doc"), F.col("slide_no").cast("int"), F.lit("content"), F.when(F.size("bullets") > 0, F.col("title")).otherwise(""), items)
    return M.pages_to_markdown(spark.createDataFrame(list(PAGES), "doc long, page int, kind string, title string, items array<struct<level:int,text:string>>").union(decks))


FRAGMENTS = ((3, "Plan Price Basic 5"), (3, "Team"), (1, "Cells"))


@query("without_fragments", rf"""WITH {_LINES}, t AS (SELECT doc, list_distinct(flatten(list(regexp_extract_all(lower(cell), '[a-z0-9]+')))) AS known FROM {values(FRAGMENTS, 'doc, cell')} GROUP BY doc),
w AS (SELECT l.doc, no, line, regexp_extract_all(lower(line), '[a-z0-9]+') AS w, coalesce(known, []::VARCHAR[]) AS known FROM l LEFT JOIN t ON t.doc = l.doc)
SELECT doc, no, line FROM w WHERE NOT (len(w) > 0 AND len(list_filter(w, lambda x: list_contains(known, x))) >= 0.85 * len(w) AND NOT prefix(line, '##'))""")
def without_fragments(spark, sf_dir):
    return M.without_fragments(M.lines_of(_texts(spark, sf_dir)), spark.createDataFrame(list(FRAGMENTS), "doc long, cell string"))
