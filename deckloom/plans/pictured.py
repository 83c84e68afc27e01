"""Queries of ``operators.engine`` over stated slides and the documents' slides, and the SQL that states the rule of each detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.functions import phrases as P
from deckloom.operators import engine as G
from deckloom.operators import shapes as H
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import VISUAL_SENTENCES_SQL, blanks, ends, figure_value, figures, strip_end, values
from deckloom.plans.shaped import TEXTS
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

SLIDES = (
    *[(i, t, x) for i, t, x in TEXTS],
    (11, "References", "[1] A. Smith, Methods, Springer, 2010.\n[2] B. Jones, Journal of Tests, 2012.\nnot one of them"),
    (12, "Training", "Epoch 1 | loss = 2.5\nEpoch 2 | loss = 1.5\nEpoch 3 | loss = 1.25\nEpoch 4 | loss = 1.0"),
    (13, "Viva", "What is a stack? It is a last in first out list. Why use a queue? It keeps the order of arrival intact."),
    (14, "Bubble sort algorithm", "for i in range(n):\n  swap a[i]\nif done:\n  return a\nend"),
    (15, "Energies", "E = mc^2 + 1\nF = m * a\nv = u + a * t"),
    (16, "A line", "The function y = 2x + 1 has slope two. Its graph is a line."),
    (17, "Worked", "Expand (x+1)^2. Simplify: x^2 + 2x + 1. Substitute x = 3: 9 + 6 + 1. Check 4^2 = 16."),
    (18, "Ammonia", "The overall equation is N2 + 3H2 <-> 2NH3. Iron speeds it up."),
    (19, "Key terms", "Equilibrium is a state of balance in a system. A catalyst is a substance that speeds a reaction. Entropy means the spread of energy."),
    (20, "Agenda", "Sorting; Searching; Graphs; Trees"),
    (21, "Cats vs Dogs", "Cats sleep all day long. Dogs like to run outside. Cats wash themselves. Dogs need a bath."),
    (22, "Sorts", "Bubble sort is stable and used for teaching. Merge sort is stable and used for lists. Quick sort is unstable and used for arrays."),
    (23, "Remote work", "The main benefit is flexible hours and it saves cost. However, the drawback is isolation at home. Another risk is that work is hard to end."),
    (24, "Task matrix", "The axes are urgency and importance. Urgent and important tasks are done now. Important but not urgent tasks are planned. Neither urgent nor important tasks are dropped."),
    (25, "Sales funnel", "The site had 8,000 visitors. Of these 1,400 asked for a demo. In the end 120 bought."),
    (26, "Photosynthesis", "Photosynthesis is the process of turning light into sugar. Plants do it all day."),
    (27, "Hooke's law", "The force is F = kx, where k is the constant. It holds for small stretch."),
    (28, "Layers of the earth", "The earth has layers. The crust is the outer layer. The mantle is below the crust. The core is the deepest layer."),
    (29, "How to check a bill", "First, read the total of the bill. If the total is wrong, call the shop; otherwise pay it. Then file the bill."),
    (30, "Steps of brewing", "First, heat the water. Next, add the tea. Then, wait four minutes. Finally, pour the tea."),
    (31, "Growth", "Revenue grew to $5 million. Costs fell by 12 percent. Staff reached 40."),
    (32, "Good habits", "Review notes daily. Use flash cards. Sleep eight hours. Drink water."),
    (33, "Regions", "North America $5.6 million, Europe $3.9 million and Asia $2.1 million."),
    (34, "Quarters", "Sales were $2 million in Q1 and $3 million in Q2 and $5 million in Q3."),
    (35, "Parts", "### One\nFirst part text.\n### Two\nSecond part text.\n### Three\nThird."),
    (36, "", ""),
)


def _stated(spark):
    return spark.createDataFrame(list(SLIDES), "id long, title string, text string")


def _slides(spark, sf_dir):
    """The stated slides, and all slides of the documents under negative ids."""
    decks = slides(table(spark, sf_dir, "documents")).select((-1 - (F.col("doc_id") * 100000 + F.col("slide_no"))).alias("id"), "title", F.col("body").alias("text"))
    # a slide costs far more than its row: slides are dealt evenly, so one long document is not one task
    return _stated(spark).union(decks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")


def _detections(spark, sf_dir):
    names = [*G.FIRST, *G.WEIGHED, "base"]
    rows = G.detections(_slides(spark, sf_dir))
    each = F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("detector"), F.col(f"{n}.family"), F.col(f"{n}.variant"), F.col(f"{n}.confidence"), F.size(f"{n}.items").alias("size"))) for n in names])
    return rows.select("id", F.explode(F.filter(each, lambda d: d.isNotNull())).alias("d")).select("id", "d.*")


QUERIES["slide_detections"] = _detections
QUERIES["slide_decisions"] = lambda spark, sf_dir: G.decided(_slides(spark, sf_dir)).select("id", "family", "variant", "confidence", F.array_join(F.transform("items", lambda i: F.concat_ws(": ", F.nullif(i["head"], F.lit("")), i["body"])), " | ").alias("items"), F.array_join("others", ",").alias("others"))
QUERIES["slide_takeaways"] = lambda spark, sf_dir: G.takeaways(G.decided(_slides(spark, sf_dir)))

_KEYS = q.listed(P.LABEL_STOP)
_CWORDS = f"list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({_KEYS}, w)))"
has = lambda p, x: f"regexp_matches({x}, {q.text(p)})"
n_of = lambda p, xs="s": f"len(list_filter({xs}, lambda e: {has(p, 'e')}))"
wc = lambda x: f"len({blanks(x)})"
lead = lambda x: f"regexp_replace({x}, {q.text(P.LEAD_CUE)}, '')"
_CITE = lambda x: rf"((regexp_matches({x}, '^\s*\[\d{{1,3}}\]\s+\S') AND regexp_matches({x}, '\b(?:1[89]\d{{2}}|20\d{{2}})\b')) OR ({has(P.CITATION, x)} AND regexp_matches({x}, '(?i)\b(?:1[89]\d{{2}}|20\d{{2}})\b|\bed(?:ition)?\b')))"
_BASE = f"""{q.SLIDES}, src AS (SELECT id::BIGINT AS id, title, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT prefix({ends('x')}, '|') AND {ends('x')} <> '[TABLE DATA]'), chr(10)) AS prose FROM (SELECT * FROM {values(SLIDES, 'id, title, text')} UNION ALL SELECT -1 - (doc_id * 100000 + slide_no), title, body FROM slides)),
texts AS (SELECT id, prose AS text FROM src), {VISUAL_SENTENCES_SQL},
agg AS (SELECT id, list(sent ORDER BY pos) AS f FROM sents GROUP BY id),
uni AS (SELECT id, list_transform(list_reduce(list_transform(f, lambda s: {{'s': s, 'w': {_CWORDS}}}), lambda kept, x: CASE WHEN len(x.w) > 0 AND len(list_filter(kept, lambda k: len(k.w) > 0 AND len(list_intersect(x.w, k.w)) >= 0.75 * len(x.w))) > 0 THEN kept ELSE list_append(kept, x) END, []::STRUCT(s VARCHAR, w VARCHAR[])[]), lambda k: k.s) AS s FROM agg),
r0 AS (SELECT src.*, coalesce(s, [CASE WHEN title = '' THEN 'Key idea' ELSE title END]) AS s FROM src LEFT JOIN uni ON uni.id = src.id), r AS (SELECT *, len(s) AS n, array_to_string(s, ' ') AS blob FROM r0)"""


def det(name: str, source: str, ok: str, family: str, variant: str, confidence: str, size: str) -> str:
    return f"SELECT id, '{name}' AS detector, {family} AS family, {variant} AS variant, ({confidence})::DOUBLE AS confidence, ({size})::INT AS size FROM {source} WHERE {ok}"


_W = lambda least, xs="s": f"list_filter({xs}, lambda e: {wc('e')} >= {least})"
_PIECES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(l[1], '(\d{4})\.\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\.\s+(\d+\.\s)', '.' || chr(1) || '\1', 'g'), chr(1)), lambda e: trim(e)), lambda e: e <> '')"
_LAB = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(prose, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda e: {ends('e')}), lambda e: {has(H.LABELLED, 'e')})"
_LABKEY = f"lower(regexp_extract(e, {q.text(H.LABELLED)}, 1)) || '|' || substr(regexp_replace(lower(regexp_extract(e, {q.text(H.LABELLED)}, 2)), '\\W+', '', 'g'), 1, 60)"
_SE = strip_end("e")
_QRE = r"((?:Q\s*\d*[.:)]\s*)?(?:What|Which|Why|How|Who|When|Where|Explain|Define|Describe|Differentiate|Compare|List|State|Name|Give|Is|Are|Does|Do|Can)\b[^?]{3,200}\?)"
_ALG = f"list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda e: {ends('e')} <> '' AND NOT prefix({ends('e')}, '|') AND {ends('e')} <> '[TABLE DATA]'), lambda e: {ends(chr(114) + 'egexp_replace(e, ' + q.text(chr(94) + chr(92) + 's*(?:[-*•▪◦]' + chr(92) + 's+|' + chr(92) + 'd+[.)]' + chr(92) + 's+)') + ', ' + chr(39) * 2 + ')')}), lambda e: (length(e) > 3 OR contains(e, '=')) AND (regexp_matches(e, '[A-Za-z]') OR contains(e, '=')))"
_NOPROSE = r"NOT (regexp_matches(e, '[.!]$') AND " + wc("e") + r" >= 7 AND NOT regexp_matches(e, ':=|←|==|[\[\]{}]|\w\(.*\)\s*$'))"
_ISEQ = f"({has(G.EQUATION_LINE, 'e')} AND NOT regexp_matches(e, '</?[A-Za-z]') AND len(regexp_extract_all(e, {q.text(G.MATHS_SIGN)})) >= 2 AND {wc('e')} <= 14)"
_DECI = f"({has(G.DECIDE, lead('e'))} AND {has(G.BRANCH, lead('e'))})"
_PAR = f"list_filter(list_transform(s, lambda e: {{'h': trim(regexp_extract({_SE}, {q.text(G.PARALLEL)}, 1)), 'b': trim(regexp_extract({_SE}, {q.text(G.PARALLEL)}, 2))}}), lambda p: p.h <> '')"
_BEST = r"(?i)\b(?:used for|used in|suits?|suited (?:to|for)|best for|ideal for|good for|useful for)\s+(.+?)(?:[.;,]|$)|\bis\s+((?:usually|generally|often|typically)\s+(?:the\s+)?(?:fastest|best|slowest|cheapest|simplest)[^.;,]*)"
_HOLDS = lambda p: f"(len(list_filter(it, lambda q: {has(p, 'q.b')})) >= 2)::INT"
_FIG = lambda x: f"list_filter(list_transform({figures(x)}, lambda e: regexp_replace(e, '[,. ]+$', '')), lambda e: NOT regexp_matches(e, {q.text(P.YEAR)}))"
_FORM = rf"regexp_replace(regexp_split_to_array(regexp_extract(blob, {q.text(G.FORMULA)}, 1), '\s+(?:gives|is|are|where|which|and|so|for|when|represents?|denotes?|means|that|if)\b|,\s')[1], '^\s+|[\s.;:,]+$', '', 'g')"
_MEANS = f"(({has(G.DEFINES, 's[1]')} OR ({has(G.ASKS_MEANING, 'title')} AND regexp_matches(s[1], '(?i)\\b(is|are|refers?|means)\\b'))) AND n <= 4)"
_FORMULA = f"({_FORM} <> '' OR {has(G.EQUALS, 'blob')} OR {has(G.SQUARES, 'blob')})"
_SIDE = f"CASE WHEN {has(G.CON, 'x')} AND NOT {has(G.PRO, 'x')} THEN 'con' WHEN {has(G.PRO, 'x')} AND NOT {has(G.CON, 'x')} THEN 'pro' ELSE NULL END"
_TURNED = r"regexp_matches(x, '(?i)^(?:however|but|on the other hand|in contrast)\b|disadvantage|drawback|downside|\bcons?\b')"
_MODE = f"CASE WHEN {_TURNED} THEN 'con' WHEN regexp_matches(x, '(?i)advantage|benefit|\\bpros?\\b|upside') THEN 'pro' ELSE a.mode END"
_SAID = f"({has(G.TWO_SIDED, chr(116) + 'itle || chr(32) || blob')} AND NOT ({has(G.ONE_SIDED, 'title')} AND NOT {has(G.OTHER_SIDE, 'title')}))"
_ITEMS_CYC = r"list_filter(list_filter(list_transform(regexp_split_to_array(regexp_extract(s[1], '([A-Za-z][^.]*?(?:,\s*[^,.]+){2,}(?:,?\s*and\s+[^.]+)?)\.', 1), ',\s*(?:and\s+)?|\s+and\s+'), lambda e: trim(e)), lambda e: e <> ''), lambda e: " + wc("e") + " >= 2)"
_CUED, _STARTS = n_of(G.STEP_CUE), n_of(P.LEAD_CUE)
_SPARSE = f"(len(list_filter(s, lambda e: regexp_matches(e, '(?i)^(?:finally|lastly|in the end)\\b'))) > 0 AND {_CUED} >= 2 AND len({_W(3)}) >= 4)"
_LOOPS = f"(regexp_matches(title, '(?i)\\b(cycle|loop)\\b') OR {has(G.REPEATS, 'blob')})"
_CASES = [
    f"SELECT id, 'sections', 'SECTIONS', 'columns', 0.9::DOUBLE, least(3, k)::INT FROM (SELECT id, len(list_filter(list_transform(regexp_split_to_array(text, '(?m)^###\\s+')[2:], lambda c: [{ends('string_split(c, chr(10))[1]')}, array_to_string(string_split(c, chr(10))[2:], chr(10))]), lambda p: p[1] <> '' AND regexp_matches(p[2], '[A-Za-z0-9]'))) AS k FROM r) WHERE k >= 2",
    det("references", f"(SELECT id, title, CASE WHEN len(l) = 1 THEN {_PIECES} ELSE l END AS l FROM (SELECT id, title, list_filter(list_transform(regexp_split_to_array(prose, '\\n+'), lambda e: trim(regexp_replace(e, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''))), lambda e: e <> '') AS l FROM r))", f"len(l) > 0 AND (({has(G.REFERENCE_TITLE, 'title')} AND len(list_filter(l, lambda e: {_CITE('e')})) >= 1) OR len(list_filter(l, lambda e: {_CITE('e')})) >= greatest(3, floor(len(l) * 0.6)))", "'REFERENCES'", "'list'", "0.93", "least(12, len(l))"),
    det("series", f"(SELECT id, len(regexp_extract_all(text, {q.text(G.LOG_LINE)})) AS k FROM r)", "k >= 4", "'CHART_TREND'", "'line'", "0.95", "least(9, ceil(k / greatest(1, k // 9)::DOUBLE)) + CASE WHEN (k - 1) % greatest(1, k // 9) = 0 THEN 0 ELSE 1 END"),
    f"SELECT id, 'questions', 'LIST_STRUCTURED', 'qa', 0.92::DOUBLE, least(6, count(*))::INT FROM (SELECT id, unnest(string_split(m, chr(1))[2:]) AS p FROM (SELECT id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(^|[.!?:]\\s|\\s-\\s){_QRE}', '\\1' || chr(1) || '\\2' || chr(2), 'g') AS m FROM r)) WHERE {wc('string_split(p, chr(2))[1]')} BETWEEN 3 AND 25 AND {wc('string_split(p, chr(2))[2]')} BETWEEN 3 AND 70 GROUP BY id HAVING count(*) >= 2",
    f"""SELECT id, 'algorithm', 'ALGORITHM', CASE WHEN m OR c THEN 'code' ELSE 'math' END, CASE WHEN m THEN 0.9 WHEN c THEN CASE WHEN titled THEN 0.93 ELSE 0.88 END ELSE 0.9 END::DOUBLE, CASE WHEN m OR c THEN least(18, k) ELSE least(10, e) END::INT FROM (SELECT id, len(l) AS k, titled, {n_of(G.MARKUP, 'l')} >= 2 AND {n_of(G.MARKUP, 'l')} >= 0.5 * len(l) AS m,
 code >= 3 AND (code >= 0.5 * len(l) OR (titled AND code >= 0.34 * len(l))) AS c, eqs AS e FROM (SELECT id, l, {has(G.ALGORITHM_TITLE, 'title')} AS titled, len(list_filter(l, lambda e: {has(G.CODE_LINE, 'e')} AND {_NOPROSE})) AS code, len(list_filter(l, lambda e: {_ISEQ})) AS eqs
 FROM (SELECT id, title, list_filter(l, lambda e, i: regexp_replace(lower(e), '\\W+', '', 'g') <> '' AND list_position(list_transform(l, lambda o: regexp_replace(lower(o), '\\W+', '', 'g')), regexp_replace(lower(e), '\\W+', '', 'g')) = i) AS l FROM (SELECT id, title, {_ALG} AS l FROM r)))) WHERE k >= 3 AND (m OR c OR (e >= 3 AND e >= 0.6 * k))""",
    det("function_plot", "r", f"contains(regexp_extract(blob, {q.text(G.GRAPH_TEXT)}, 1), 'x') AND {has(G.GRAPH_WORD, 'blob')}", "'FUNCTION_PLOT'", "'curve'", "0.88", "1"),
    det("worked", f"(SELECT id, len(list_filter(s, lambda e: {has(G.MATHS_VERB, 'e')} AND {has(G.EXPRESSION, 'e')})) AS k FROM r)", "k >= 3", "'WORKED_EXAMPLE'", "'steps'", "0.9", "least(10, k - 1)"),
    det("labelled", f"(SELECT id, list_filter(l, lambda e, i: list_position(list_transform(l, lambda e: {_LABKEY}), {_LABKEY}) = i) AS l FROM (SELECT id, {_LAB} AS l FROM r))", f"len(l) >= 3 AND NOT regexp_matches(regexp_extract(l[1], {q.text(H.LABELLED)}, 1), '(?i)^(advantages?|disadvantages?|pros?|cons?)$')", "'LIST_STRUCTURED'", "'cards'", "0.86", "least(6, len(l))"),
    det("equation", "r", f"len(list_filter(s, lambda e: contains(regexp_extract(e, {q.text(G.REACTION)}, 1), '+'))) > 0", "'FORMULA_CALLOUT'", "'card'", "0.9", "1"),
    det("glossary", f"(SELECT id, title, n, s, len(list_filter(s, lambda e: regexp_extract({_SE}, {q.text(G.MEANING)}, 1) <> '' AND {wc('trim(regexp_extract(' + _SE + ', ' + q.text(G.MEANING) + ', 1))')} <= 5)) AS k FROM r)", f"k >= 3 AND k >= 0.75 * n AND {n_of(chr(92) + 'd')} < 2 AND ({has(G.GLOSSARY_TITLE, 'title')} OR k >= 4)", "'LIST_STRUCTURED'", "'cards'", "0.9", "least(8, k)"),
    det("agenda", f"(SELECT id, title, CASE WHEN len(s) = 1 AND len(p) >= 3 THEN len(p) ELSE len(s) END AS k FROM (SELECT id, title, s, list_filter(list_transform(regexp_split_to_array(regexp_replace({strip_end('s[1]')}, '^[➔→•\\-\\s]+', ''), '\\s*[➔→>]+\\s*|\\s*;\\s*'), lambda e: regexp_replace(e, '^[ .;,]+|[ .;,]+$', '', 'g')), lambda e: e <> '') AS p FROM r))", f"{has(G.AGENDA_TITLE, 'title')} AND k BETWEEN 3 AND 12", "'PROCESS_LINEAR'", "'agenda'", "0.92", "least(10, k)"),
    det("parallel", f"(SELECT *, list_transform(it, lambda p: lower(p.h)) AS nm FROM (SELECT id, n, {_PAR} AS it FROM r))", f"len(it) >= 3 AND len(it) >= 0.6 * n AND len(list_distinct(nm)) = len(nm) AND (len(list_filter(nm, lambda x: len(list_filter(nm, lambda y: {blanks('y')}[1] = {blanks('x')}[1])) >= 3)) > 0 OR len(list_filter(nm, lambda x: len(list_filter(nm, lambda y: {blanks('y')}[-1] = {blanks('x')}[-1])) >= 3)) > 0)", "'COMPARE_TABLE'", "'comparison'", f"CASE WHEN {_HOLDS(chr(79) + chr(92) + '([^)]*' + chr(92) + ')')} + {_HOLDS('(?i)' + chr(92) + 'b(not stable|unstable|stable)' + chr(92) + 'b')} + {_HOLDS(_BEST)} >= 2 THEN 0.9 ELSE 0.82 END", "len(it)"),
    det("matrix", f"(SELECT id, blob, title, len(list_filter(s, lambda e: {has(G.QUADRANT, 'e')} AND NOT regexp_matches(e, '(?i)axes|axis'))) AS k FROM r)", f"{has(G.AXES, 'blob || title')} AND k >= 3", "'MATRIX_GRID'", "'quadrant_2x2'", "0.93", "least(4, k)"),
    det("timeline", f"(SELECT id, n, len(list_filter(s, lambda e: {_CITE('e')})) AS c, len(list_filter(s, lambda e: NOT {_CITE('e')} AND {has(H.DATE, 'e')} AND length(regexp_replace(regexp_replace(e, {q.text(H.DATE)}, '', 'g'), '[^A-Za-z]', '', 'g')) >= 4)) AS k FROM r)", "c < greatest(2, floor(n / 2)) AND k >= 3", "'TIMELINE'", "'dated'", "0.9", "least(8, k)"),
    det("funnel", f"(SELECT id, title, v FROM (SELECT id, title, flatten(list_transform(s, lambda x: list_transform({_FIG('x')}, lambda f: {figure_value('f')}))) AS v FROM r))", f"len(v) >= 3 AND len(list_filter(v, lambda x, i: i > 1 AND v[i - 1] < x)) = 0 AND (v[1] > v[-1] * 4 OR ({has(G.FUNNEL_TITLE, 'title')} AND v[1] > v[-1] * 1.5))", "'FUNNEL'", "'funnel'", "0.86", "least(6, len(v))"),
    det("venn", "r", f"{has(G.BOTH, 'blob')} AND {has(G.ONLY, 'blob')} AND n >= 3", "'SET_DIAGRAM'", "'venn2'", "0.84", "least(8, n)"),
    det("definition", "r", f"({_MEANS} OR n <= 5) AND {_FORMULA}", "'FORMULA_CALLOUT'", "'card'", "0.86", "1"),
    det("definition", "r", f"NOT (({_MEANS} OR n <= 5) AND {_FORMULA}) AND {_MEANS}", "'DEFINITION'", "'term'", "0.85", "1"),
    det("definition", "r", f"NOT (({_MEANS} OR n <= 5) AND {_FORMULA}) AND NOT {_MEANS} AND {has(G.LAW, 'title')} AND n <= 3", "'QUOTE'", "'statement'", "0.78", "1"),
    det("pros_cons", f"(SELECT *, len(list_filter(d, lambda x: x = 'pro')) AS p, len(list_filter(d, lambda x: x = 'con')) AS c FROM (SELECT *, CASE WHEN k > 0 THEN list_transform(s, lambda e, i: CASE WHEN i < k THEN 'pro' ELSE 'con' END) WHEN {n_of(G.PRO)} >= 1 AND {n_of(G.CON)} >= 2 THEN list_reduce(s, lambda a, x: {{'mode': {_MODE}, 'd': list_append(a.d, coalesce({_SIDE}, {_MODE}))}}, {{'mode': 'pro', 'd': []::VARCHAR[]}}).d END AS d FROM (SELECT *, coalesce(list_position(list_transform(s, lambda e, i: i > 1 AND {has(G.CON_MARK, ends('e'))}), true), 0) AS k FROM r)))", f"d IS NOT NULL AND {_SAID} AND p >= 1 AND c >= 1 AND n >= 3", "'COMPARE_VISUAL'", "'pros_cons'", "0.84", "len(d)"),
    det("cycle", f"(SELECT *, CASE WHEN len({_W(3)}) < 3 AND len({_ITEMS_CYC}) BETWEEN 3 AND 6 THEN len({_ITEMS_CYC}) ELSE len({_W(3)}) END AS k FROM r)", f"(regexp_matches(title, '(?i)\\b(cycle|loop)\\b') OR {has(H.CYCLE, chr(98) + 'lob || chr(32) || title')}) AND k >= 3", "'PROCESS_CYCLIC'", "'cycle'", "0.8", "least(6, k)"),
    det("flowchart", f"(SELECT *, {_W(2)}[1:9] AS st FROM r)", f"len(st) >= 3 AND len(list_filter(st, lambda e: regexp_matches(e, '\\?\\s*$') AND {has(G.WH, lead('e'))})) = 0 AND (len(list_filter(st, lambda e: {has(G.STEP_CUE, 'e')} OR {has(P.LEAD_CUE, 'e')})) >= 2 OR {has(H.PROCEDURE, 'title')}) AND len(list_filter(st, lambda e: {_DECI})) BETWEEN 1 AND len(st) // 2 + 1 AND ({has(H.PROCEDURE, 'title')} OR len(list_filter(st, lambda e: {has(G.STEP_CUE, 'e')} OR {has(P.LEAD_CUE, 'e')})) >= 1 OR {has(G.LOOP_BACK, chr(97) + 'rray_to_string(st, chr(32))')})", "'FLOWCHART'", "'decision'", "0.9", "len(st)"),
    det("process", f"(SELECT *, CASE WHEN {_CUED} >= 3 AND NOT {_SPARSE} THEN list_filter({_W(3)}, lambda e: {has(G.STEP_CUE, 'e')} OR {has(P.LEAD_CUE, 'e')}) ELSE {_W(3)} END AS st FROM r)", f"({_CUED} >= 3 OR {_STARTS} >= 3 OR {_SPARSE}) AND len({_W(3)}) >= 3 AND len(st) >= 3", f"CASE WHEN {_LOOPS} THEN 'PROCESS_CYCLIC' ELSE 'PROCESS_LINEAR' END", f"CASE WHEN {_LOOPS} THEN 'cycle' ELSE 'flowchart' END", f"round_even(0.82::DOUBLE + least({_CUED}, 5) * 0.02::DOUBLE, 6)", "least(8, len(st))"),
    det("process_implicit", f"(SELECT *, {_W(3)} AS b FROM r)", f"{has(H.PROCEDURE, 'title')} AND len(b) BETWEEN 4 AND 8 AND list_sum(list_transform(b, lambda e: {wc('e')})) / len(b) <= 20", "'PROCESS_LINEAR'", "'flowchart'", "0.7", "len(b)"),
    det("cause_effect", "r", f"({n_of(H.CAUSE)} >= 2 OR {n_of(H.STRONG_CAUSE)} >= 1) AND n BETWEEN 3 AND 7", "'CAUSE_EFFECT'", f"CASE WHEN {has(H.LOOP, 'blob')} THEN 'loop' ELSE 'chain' END", "0.76", "least(6, n)"),
    f"""SELECT id, 'base', CASE WHEN len(b) < 2 THEN 'PROSE' WHEN o >= greatest(3, floor(len(b) * 0.6)) THEN 'CHECKLIST' WHEN m >= 13 OR k >= 2 OR len(b) < 3 THEN 'PROSE' ELSE 'KEY_POINTS' END, CASE WHEN len(b) < 2 THEN 'flow' WHEN o >= greatest(3, floor(len(b) * 0.6)) THEN 'ticks' WHEN m >= 13 OR k >= 2 OR len(b) < 3 THEN 'flow' ELSE 'grid' END,
 CASE WHEN len(b) < 2 THEN 0.6 WHEN o >= greatest(3, floor(len(b) * 0.6)) THEN 0.8 WHEN m >= 13 OR k >= 2 OR len(b) < 3 THEN 0.6 ELSE 0.55 END::DOUBLE, CASE WHEN len(b) < 2 THEN n WHEN o >= greatest(3, floor(len(b) * 0.6)) THEN least(8, len(b)) WHEN m >= 13 OR k >= 2 OR len(b) < 3 THEN len(b) ELSE least(6, len(b)) END::INT
 FROM (SELECT *, len(list_filter(b, lambda e: {has(G.IMPERATIVE, ends('e'))})) AS o, {wc("array_to_string(b, ' ')")}::DOUBLE / greatest(len(b), 1) AS m, len(list_filter(b[2:], lambda e: {has(G.LINKED, 'e')})) AS k FROM (SELECT *, {_W(2)} AS b FROM r))""",
]
#: Detectors whose rule the SQL states; the others (tables of pipes, charts, layers, comparisons, tiles) need the labels of their items.
BY_SQL = ("sections", "references", "series", "questions", "algorithm", "function_plot", "worked", "labelled", "equation", "glossary", "agenda", "parallel", "matrix", "timeline", "funnel", "venn", "definition", "pros_cons", "cycle", "flowchart", "process", "process_implicit", "cause_effect", "base")
QUERIES["ruled_detections"] = lambda spark, sf_dir: _detections(spark, sf_dir).where(F.col("detector").isin(*BY_SQL))
ORACLE["ruled_detections"] = f"WITH {_BASE} SELECT * FROM (SELECT NULL::BIGINT AS id, '' AS detector, '' AS family, '' AS variant, 0.0::DOUBLE AS confidence, 0 AS size WHERE false UNION ALL " + "\nUNION ALL ".join(_CASES) + ")"
