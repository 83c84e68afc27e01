"""Queries of ``operators.enumerations`` over stated texts, pages as markdown and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import enumerations as N
from deckloom.plans import sqltext as q
from deckloom.plans.marked import _PAGE, page_text
from deckloom.plans.phrased import blanks, ends, values
from deckloom.sources.tables import table

QUERIES, ORACLE = {}, {}

TEXTS = (
    (1, "Phases of NLP", "The phases of NLP\n1. Lexical analysis - splits the text\n2. Syntactic analysis\nwhich goes on here\n3) Semantic analysis\n(4) Discourse integration\n5. Pragmatic analysis etc.\n\n# Next\n- one\n- two"),
    (2, "Sorting", "There are four types of sorting: bubble sort, merge sort, quick sort and heap sort. The three main steps are compare, swap and repeat until done."),
    (3, "Uses", "A toolkit includes Hammers, Saws, Nails and Screws. Pets such as Cats, Dogs or Birds are kept."),
    (4, "Applications", "Machine Translation\nChat Bots\nSpell Checking\nText Summaries etc.\nA full sentence ends this block."),
    (5, "Parts", "Components of a plant:\n\nRoot\nStem: holds it up\nLeaf - makes sugar\nroot\n\nnot this"),
    (6, "Two only", "- a thing\n- another thing\n"),
    (7, "Methods", "Two methods are named.\nThe two methods are fast, slow"),
    (8, "Phases of NLP", "There are five phases of language work in all.\nLexical Analysis\nIt splits the text into words and names each of them.\nSyntactic Analysis\nIt finds how the words of a sentence hang together.\nA tree is drawn for it.\nSemantic Analysis:\nIt looks for what the sentence means on its own.\nSyntactic Syntax Analysis\nAn example page that shows the same idea once more.\nDiscourse Integration\nIt uses what was said before to read what comes next.\nPragmatic Analysis\nIt asks what is meant when something is said here.\nEnd"),
    (9, "Types of memory", "Intro line about memory in general terms here\n1. Working memory\nholds a few things for a short time\n2. Episodic memory\nkeeps what happened to us and when\n3. Semantic memory\nkeeps facts that we know of the world\nmore on facts"),
    (10, "Short", "One\nTwo"),
    (11, "", ""),
    (12, "Levels", "a) ground level\nb) first level\nc) top level\n* extra\n\nThe four levels are: ground, first, second, top"),
)
_T = f"""(SELECT id::BIGINT AS doc, title, text FROM {values(TEXTS, 'id, title, text')} UNION ALL SELECT -1 - page_id * 2, 'Steps of page ' || page_id, {_PAGE} FROM pages UNION ALL SELECT -2 - doc_id * 2, 'Types of text', coalesce(text, '') FROM documents)"""


def texts(spark, sf_dir):
    """The stated texts, and all pages and documents under negative ids."""
    pages = table(spark, sf_dir, "pages").select(-1 - F.col("page_id") * 2, F.concat(F.lit("Steps of page "), F.col("page_id").cast("string")), page_text(F.coalesce("html", F.lit(""))))
    docs = table(spark, sf_dir, "documents").select(-2 - F.col("doc_id") * 2, F.lit("Types of text"), F.coalesce("text", F.lit("")))
    return spark.createDataFrame(list(TEXTS), "doc long, title string, text string").union(pages).union(docs)


def clean(x: str) -> str:
    """SQL of the cleaned item."""
    s = x
    for p in (N.ITEM_MARKS, N.JOINING, N.AND_SO_ON, N.RIM):
        s = f"regexp_replace({s}, {q.text(p)}, '', 'g')"
    label = ends(f"regexp_extract(cs, {q.text(N.LABEL)}, 1)")
    return f"list_transform([{s}], lambda cs: list_transform([{label}], lambda cl: CASE WHEN cl <> '' AND len({blanks('cl')}) <= 6 THEN cl ELSE cs END)[1])[1]"


key = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
once = lambda xs: f"list_filter({xs}, lambda x, i: {key('x')} <> '' AND list_position(list_transform({xs}, lambda z: {key('z')}), {key('x')}) = i)"
kind = lambda x: f"lower(regexp_extract({x}, {q.text(f'(?i)({N.KINDS})')}, 1))"
n_words = lambda x: f"len({blanks(x)})"
_ALPHA = r"regexp_matches(x, '^\p{L}')"
_SHORT = rf"s <> '' AND {n_words('s')} BETWEEN 1 AND 8 AND NOT regexp_matches(s, '[.!?]$') AND NOT prefix(s, '#') AND length(s) <= 60"
_NUMBERS = q.listed(N.NUMBER_WORDS)
ENUMERATIONS_SQL = rf"""texts AS {_T},
l AS (SELECT doc, regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS no FROM texts),
r0 AS (SELECT *, trim(line) = '' OR prefix(line, '#') AS stop, regexp_matches(line, {q.text(N.MARKED)}) AS marked, regexp_replace(coalesce(nullif({ends('lag(line, 1) OVER o')}, ''), nullif({ends('lag(line, 2) OVER o')}, ''), nullif({ends('lag(line, 3) OVER o')}, ''), ''), '[:.]+$', '') AS lead FROM l WINDOW o AS (PARTITION BY doc ORDER BY no)),
r1 AS (SELECT *, sum(stop::INT) OVER (PARTITION BY doc ORDER BY no) AS island FROM r0), r2 AS (SELECT *, sum(marked::INT) OVER (PARTITION BY doc, island ORDER BY no) AS item FROM r1 WHERE NOT stop),
r3 AS (SELECT doc, island, item, min(no) AS no, min_by(lead, no) AS lead, min_by(line, no) AS line, {ends(f"string_agg(CASE WHEN marked THEN {clean(f'regexp_extract(line, {q.text(N.MARKED)}, 3)')} ELSE {ends('line')} END, ' ' ORDER BY no)")} AS text FROM r2 WHERE item > 0 GROUP BY 1, 2, 3),
r4 AS (SELECT doc, min(no) AS no, min_by(lead, no) AS lead, min_by(line, no) AS line, list_filter(list(text ORDER BY item), lambda x: length(x) >= 2) AS xs FROM r3 GROUP BY doc, island),
c0 AS (SELECT doc, string_split(regexp_replace(text, {q.text(N.CLAIM)}, chr(1) || '\0' || chr(3), 'g'), chr(1)) AS p FROM texts), c1 AS (SELECT doc, p, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS n FROM c0),
c2 AS (SELECT doc, n, split_part(x, chr(3), 1) AS m, split_part(left(split_part(x, chr(3), 2) || replace(array_to_string(p[n + 2:], ''), chr(3), ''), {N.TAIL}), '.', 1) AS tail FROM c1 WHERE n > 0),
c3 AS (SELECT doc, n, m, lower(regexp_extract(m, {q.text(N.CLAIM)}, 2)) AS c, list_filter(list_transform(regexp_split_to_array(tail, {q.text(N.BETWEEN)}), lambda x: {clean('x')}), lambda x: {n_words('x')} BETWEEN 1 AND 8 AND {_ALPHA}) AS xs FROM c2),
c4 AS (SELECT doc, n, m, coalesce(try_cast(c AS INT), list_position({_NUMBERS}, c) + 1, 0)::INT AS claimed, {once('xs')} AS xs FROM c3),
i0 AS (SELECT doc, unnest(regexp_extract_all(text, {q.text(N.LED)}, 1)) AS lead, unnest(regexp_extract_all(text, {q.text(N.LED)}, 2)) AS body, generate_subscripts(regexp_extract_all(text, {q.text(N.LED)}, 1), 1) - 1 AS n FROM texts),
i1 AS (SELECT doc, n, lead, list_filter(list_transform(regexp_split_to_array(body, {q.text(N.BETWEEN)}), lambda x: {clean('x')}), lambda x: {_ALPHA} AND {n_words('x')} BETWEEN 1 AND 6) AS xs FROM i0),
b0 AS (SELECT doc, no, regexp_replace({ends('line')}, {q.text(N.AND_SO_ON_LINE)}, '') AS s FROM l), b1 AS (SELECT *, {_SHORT} AS short FROM b0),
b2 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY no) - row_number() OVER (PARTITION BY doc, short ORDER BY no) AS island FROM b1),
b3 AS (SELECT doc, min(no) AS no, list({clean('s')} ORDER BY no) AS xs FROM b2 WHERE short GROUP BY doc, island HAVING count(*) >= 3), b4 AS (SELECT doc, no, list_filter({once('xs')}, lambda x: {n_words('x')} BETWEEN 1 AND 7 AND {_ALPHA}) AS xs FROM b3),
h0 AS (SELECT doc, no, line, list(line) OVER (PARTITION BY doc ORDER BY no ROWS BETWEEN 1 FOLLOWING AND {N.AHEAD} FOLLOWING) AS nx FROM l), h1 AS (SELECT doc, no, line, coalesce(nx, []) AS nx FROM h0 WHERE regexp_matches(line, {q.text(N.HEADER)})),
h2 AS (SELECT *, array_to_string(list_transform(nx, lambda x: CASE WHEN {ends('x')} = '' OR prefix({ends('x')}, '#') THEN '0' ELSE '1' END), '') AS f FROM h1),
h3 AS (SELECT doc, no, line, list_transform(nx[length(regexp_extract(f, '^(0*)(1*)', 1)) + 1:length(regexp_extract(f, '^(0*)(1*)', 1)) + length(regexp_extract(f, '^(0*)(1*)', 2))], lambda x: {clean(ends('x'))}) AS xs FROM h2),
found AS (SELECT doc, 0 AS source, no::BIGINT AS place0, CASE WHEN regexp_matches(line, '^\s*\(?\d') THEN 'numbered' ELSE 'bulleted' END AS style, {kind('lead')} AS kind, lead, NULL::INT AS claimed, {once('xs')} AS items FROM r4
UNION ALL SELECT doc, 1, n, 'inline', lower(regexp_extract(m, {q.text(N.CLAIM)}, 3)), {ends(f'regexp_extract(m, {q.text(N.CLAIM)}, 1)')}, claimed, xs[1:claimed + 1] FROM c4 WHERE claimed > 0 AND len(xs) >= greatest(3, claimed - 1)
UNION ALL SELECT doc, 2, n, 'inline', {kind('lead')}, regexp_replace(lead, '^[ :—-]+|[ :—-]+$', '', 'g'), NULL, {once('xs')} FROM i1
UNION ALL SELECT doc, 3, no, 'list', '', '', NULL, xs FROM b4 WHERE len(list_filter(xs, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 0.7 * len(xs)
UNION ALL SELECT doc, 4, no, 'header', lower(regexp_extract(line, {q.text(N.HEADER)}, 2)), trim(regexp_extract(line, {q.text(N.HEADER)}, 1)), NULL, list_filter({once('xs')}, lambda x: length(x) >= 2 AND {n_words('x')} <= 12) FROM h3),
keyed AS (SELECT *, array_to_string(list_sort(list_distinct(list_transform(items, lambda x: {key('x')}))), '|') AS k FROM found WHERE len(items) >= 3),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY doc, k ORDER BY source, place0) = 1),
enums AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY source, place0))::INT AS place, style, kind, lead, claimed, items FROM firsts)"""


def enumerations(spark, sf_dir):
    return N.enumerations(texts(spark, sf_dir).select("doc", "text")).withColumn("items", F.array_join("items", "|"))


QUERIES["enumerations"] = enumerations
ORACLE["enumerations"] = f"WITH {ENUMERATIONS_SQL} SELECT doc, place, style, kind, lead, claimed, array_to_string(items, '|') AS items, claimed IS NULL OR abs(claimed - len(items)) <= 1 AS reliable FROM enums"

_S = lambda x: f"regexp_replace({ends(f'regexp_replace({x}, {q.text(N.NUMBER_MARK)}, {chr(39) * 2})')}, ':+$', '')"
_LABEL = lambda x: f"regexp_replace({ends(f'regexp_replace({x}, {q.text(N.NUMBER_MARK)}, {chr(39) * 2})')}, '[:.]+$', '')"
has = lambda p, x: f"regexp_matches({x}, {q.text(p)})"
_CAP = r"coalesce(regexp_matches(wl[1], '^\p{Lu}'), false)"
_AFTER = "coalesce(" + n_words("af") + ", 0)"
QUERIES["item_sections"] = lambda spark, sf_dir: N.item_sections(texts(spark, sf_dir))
ORACLE["item_sections"] = rf"""WITH {ENUMERATIONS_SQL}, hint AS (SELECT doc, min_by(kind, place) AS hint FROM enums WHERE kind <> '' AND {has(N.SPLIT_KINDS, 'kind')} GROUP BY doc),
t0 AS (SELECT t.doc, title, list_filter(list_transform(string_split(text, chr(10)), lambda x: {ends('x')}), lambda x: x <> '') AS ls, coalesce(nullif({kind('title')}, ''), hint, '') AS k0 FROM texts t LEFT JOIN hint ON hint.doc = t.doc),
t1 AS (SELECT doc, title, ls, CASE WHEN k0 <> '' THEN k0 ELSE regexp_extract(title, {q.text(N.SPLIT_KINDS)}) END AS kind FROM t0 WHERE len(ls) >= 6 AND ({has(N.SPLIT_KINDS, 'k0')} OR {has(N.SPLIT_KINDS, 'title')})),
u0 AS (SELECT doc, title, unnest(ls) AS x, unnest(list_append(ls[2:], NULL)) AS af, generate_subscripts(ls, 1) - 1 AS i FROM t1), u1 AS (SELECT *, {_S('x')} AS s, {_LABEL('x')} AS label, {has(N.NUMBER_MARK, 'x')} AS numbered FROM u0),
u2 AS (SELECT *, {n_words('s')} AS n, list_filter({blanks('s')}, lambda x: {_ALPHA}) AS wl FROM u1),
u3 AS (SELECT doc, title, i, label FROM u2 WHERE n BETWEEN 1 AND 7 AND length(s) <= 60 AND NOT regexp_matches(s, '[.!?]$') AND NOT (n >= 4 AND {has(N.PREDICATE, 's')}) AND len(wl) > 0 AND (numbered OR {_CAP} OR {has(N.SPLIT_KINDS, 's')} OR {has(N.SUBJECTS, 's')})
 AND ({_AFTER} >= 6 OR (numbered AND {_AFTER} >= 4)) AND {key('label')} <> '' AND {key('label')} <> {key('title')}),
v0 AS (SELECT doc, list({{'i': i::INT, 'label': label}} ORDER BY i) AS hs FROM u3 GROUP BY doc),
v1 AS (SELECT doc, list_reduce(hs, lambda kept, h: CASE WHEN len(list_filter(kept, lambda k: contains({key('k.label')}, {key('h.label')}) OR contains({key('h.label')}, {key('k.label')}))) > 0 THEN kept ELSE list_append(kept, h) END, []::STRUCT(i INT, label VARCHAR)[]) AS h FROM v0),
v2 AS (SELECT t1.doc, title, ls, kind, h, len(h) AS n FROM t1 JOIN v1 ON v1.doc = t1.doc WHERE len(h) >= 3), v3 AS (SELECT * FROM v2 WHERE len(list_filter(range(1, n), lambda k: h[k + 1].i - h[k].i >= 2)) >= 0.6 * (n - 1)),
w AS (SELECT *, regexp_replace(kind, 's+$', '') AS kw FROM v3),
o AS (SELECT doc, 0 AS place, n, kind, trim(title || ' — the ' || n || ' ' || kind) AS title, array_to_string(list_concat(ls[1:h[1].i], list_transform(h, lambda x: '- ' || x.label)), chr(10)) AS text FROM w
UNION ALL SELECT doc, k, n, kind, upper(left(kw, 1)) || lower(substr(kw, 2)) || ' ' || k || ' of ' || n || ': ' || h[k].label, array_to_string(ls[h[k].i + 1:CASE WHEN k < n THEN h[k + 1].i ELSE len(ls) END], chr(10)) FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM w))
SELECT doc, place::INT AS place, n::INT AS total, kind, title, text, place = 0 AS overview FROM o"""

QUERIES["steps"] = lambda spark, sf_dir: N.steps(texts(spark, sf_dir))
ORACLE["steps"] = f"""WITH texts AS {_T}, l AS (SELECT doc, {ends('unnest(string_split(text, chr(10)))')} AS s, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM texts), m AS (SELECT * FROM l WHERE {has(N.STEP, 's')}),
f AS (SELECT doc, 0 AS source, no, {ends(f"regexp_replace(s, {q.text(N.STEP)}, '')")} AS item FROM m WHERE length(s) > 4 UNION ALL SELECT doc, 1, no, s FROM m WHERE NOT prefix(s, '#')),
o AS (SELECT * FROM f WHERE item <> '' QUALIFY row_number() OVER (PARTITION BY doc, lower(item) ORDER BY source, no) = 1)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY source, no))::INT AS pos, item FROM o QUALIFY pos <= {N.STEPS}"""
