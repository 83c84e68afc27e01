"""Queries of the extractors and their SQL."""

from __future__ import annotations

from deckloom.operators import extract as X
from deckloom.plans import sqltext as q
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}


#: Texts of the kinds that the corpus lacks.
STATED = (
    (-1, "Unlike cats, dogs like water. Tea is hot whereas juice is cold.\nCompared to rock, sand is soft. It is the same as before."),
    (-2, "Floods came because rain fell. Demand grew therefore prices rose. Due to frost, the crop failed.\nHeat leads to wear. The pump stopped since power failed."),
    (-3, "In 1969 sales grew 12% to 1.5 million, then 1969 again. Force is F = ma and it grows.\n### Marker\nThe World Wide Web opened at CERN | NASA in 2,000 places. (IBM); x = y + 2 gives z"),
)
_DOCS = "(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM (VALUES " + ", ".join(f"({i}, {q.text(t)})" for i, t in STATED).replace("\n", "' || chr(10) || '") + ") AS v(doc_id, text))"


def _with_stated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(list(STATED), "doc_id long, text string"))


def add(name: str, run, sql: str | None = None) -> None:
    if name in ("comparisons", "cause_effect"):
        QUERIES[name] = lambda spark, sf_dir: run(slides(_with_stated(spark, sf_dir)))
        ORACLE[name] = sql.replace("FROM documents)", f"FROM {_DOCS})")
        return
    QUERIES[name] = lambda spark, sf_dir: run(slides(table(spark, sf_dir, "documents")))
    if sql:
        ORACLE[name] = sql


_LONG = f"{q.SLIDES}, ls AS (SELECT * FROM (SELECT doc_id, slide_no, unnest(sents) AS sent, generate_subscripts(sents, 1)::BIGINT AS sent_no FROM slides) WHERE length(sent) > 3)"


def _any(low: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({low}, {q.text(p)})" for p in phrases) + ")"


_MARKED = " UNION ALL ".join(
    [f"SELECT doc_id, slide_no, sent_no, sent AS item, '{k}' AS kind, {n} AS most FROM ls WHERE {_any('lower(sent)', p)}" for k, (n, p) in X.PHRASES.items()]
    + [f"SELECT doc_id, slide_no, 1048576, body, '{k}', {X.PHRASES[k][0]} FROM slides WHERE len(sents) > 1 AND {_any('lower(body)', X.PHRASES[k][1])}" for k in ("advantage", "disadvantage")]
)
add("marked_sentences", X.marked_sentences, f"""WITH {_LONG}, m AS ({_MARKED}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no, kind, lower(item) ORDER BY sent_no) AS once FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no, kind ORDER BY sent_no) AS pos FROM o WHERE once = 1)
SELECT doc_id, slide_no, kind, pos, item FROM p WHERE pos <= most""")


def _split(phrases, width: int) -> tuple[str, str, str]:
    phrase = f"list_filter({q.listed(phrases)}, lambda p: contains(lower(sent), p))[1]"
    at = f"instr(lower(sent), {phrase})"
    left = f"regexp_replace(trim(substr(sent, 1, {at} - 1)), '[,;]+$', '')"
    right = f"regexp_replace(trim(substr(sent, {at} + length({phrase}))), '^[,;]+', '')"
    return f"CASE WHEN {phrase} IS NOT NULL AND {left} <> '' AND {right} <> '' THEN {phrase} END", f"substr({left}, 1, {width})", f"substr({right}, 1, {width})"


_C = _split(X.COMPARISONS, 100)
add("comparisons", X.comparisons, f"""WITH {_LONG}, c AS (SELECT doc_id, slide_no, sent_no, {_C[0]} AS aspect, {_C[1]} AS left_side, {_C[2]} AS right_side FROM ls),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY sent_no) AS pos FROM c WHERE aspect IS NOT NULL)
SELECT doc_id, slide_no, aspect, left_side, right_side, pos FROM p WHERE pos <= 6""")

_K, _E = _split(X.CAUSES, 150), _split(X.EFFECTS, 150)
add("cause_effect", X.cause_effect, f"""WITH {_LONG},
c AS (SELECT doc_id, slide_no, sent_no, 1 AS o, {_K[2]} AS cause, {_K[1]} AS effect FROM ls WHERE ({_K[0]}) IS NOT NULL
  UNION ALL SELECT doc_id, slide_no, sent_no, 2, {_E[1]}, {_E[2]} FROM ls WHERE ({_E[0]}) IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no, cause, effect ORDER BY sent_no, o) AS once FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY sent_no, o) AS pos FROM d WHERE once = 1 OR o = 1)
SELECT doc_id, slide_no, pos, cause, effect FROM p WHERE pos <= 6""")

_DEF = rf"""
f0 AS (SELECT doc_id, slide_no, unnest(regexp_extract_all(body, {q.text(X.DEFINITION)}, 1)) AS t, unnest(regexp_extract_all(body, {q.text(X.DEFINITION)}, 2)) AS d,
  generate_subscripts(regexp_extract_all(body, {q.text(X.DEFINITION)}, 1), 1) AS n FROM slides),
f1 AS (SELECT doc_id, slide_no, n, trim(regexp_replace(trim(t), '(?i)\s+(a|an|the)\s*$', '')) AS term, substr(trim(d), 1, 300) AS definition FROM f0 WHERE length(trim(t)) >= 3 AND length(trim(d)) >= 5
  UNION ALL SELECT doc_id, slide_no, -1, trim(regexp_extract(body, {q.text(X.COLON)}, 1)), substr(trim(regexp_extract(body, {q.text(X.COLON)}, 2)), 1, 300) FROM slides WHERE regexp_matches(body, {q.text(X.COLON)})),
defs AS (SELECT doc_id, slide_no, term, definition FROM f1 QUALIFY row_number() OVER (PARTITION BY doc_id, slide_no, term ORDER BY n DESC) = 1)"""
add("definitions", X.definitions, f"WITH {q.SLIDES}, {_DEF} SELECT * FROM defs")
add("glossary", X.glossary, f"""WITH {q.SLIDES}, {_DEF},
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY slide_no, term) AS once FROM defs),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY slide_no, term) AS pos FROM g WHERE once = 1)
SELECT doc_id, pos, term, definition, slide_no FROM p WHERE pos <= 80""")
add("chronology", X.chronology, rf"""WITH {_LONG}, c AS (SELECT doc_id, slide_no, sent_no, trim(substr(sent, 1, 150)) AS item FROM ls WHERE regexp_matches(lower(sent), '\b({X.ORDINALS})\b')),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, slide_no, lower(item) ORDER BY sent_no) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY sent_no) AS pos FROM o) SELECT doc_id, slide_no, pos, item FROM p WHERE pos <= 10""")
add("complexity", X.complexity, f"""WITH {q.SLIDES}, w AS (SELECT doc_id, slide_no, regexp_extract_all(lower(body), '[a-z'']+') AS ws, len(list_filter(sents, lambda s: length(s) > 3)) AS n_sents FROM slides),
a AS (SELECT doc_id, slide_no, n_sents, greatest(len(ws), 1)::DOUBLE AS n, round_even(len(list_distinct(ws)) / greatest(len(ws), 1)::DOUBLE, 4) AS richness, len(list_filter(ws, lambda w: list_contains({q.listed(X.TECHNICAL)}, w)))::DOUBLE AS tech FROM w),
b AS (SELECT doc_id, slide_no, richness, round_even(CASE WHEN n_sents > 0 THEN n / greatest(n_sents, 1) ELSE 0.0 END::DOUBLE, 2) AS sentence_length, round_even(tech / (n / 100.0), 2) AS density FROM a),
c AS (SELECT *, round_even(round_even(least(10.0, least(2.0::DOUBLE, richness * 2.5::DOUBLE) + least(2.0::DOUBLE, sentence_length / 25.0::DOUBLE * 2.0::DOUBLE) + least(2.5::DOUBLE, density / 5.0::DOUBLE * 2.5::DOUBLE) + 0.1::DOUBLE), 6), 1)::DOUBLE AS complexity FROM b)
SELECT *, CASE WHEN complexity <= 2.5 THEN 'INTRODUCTORY' WHEN complexity <= 5.5 THEN 'INTERMEDIATE' WHEN complexity <= 8.0 THEN 'ADVANCED' ELSE 'EXPERT' END AS band FROM c""")


def _score(words) -> str:
    hits = " + ".join(f"contains(low, {q.text(w)})::INT" for w in words)
    return f"round_even(least(1.0::DOUBLE, ({hits})::DOUBLE / {max(1.0, len(words) * 0.3)!r}::DOUBLE) * 0.6::DOUBLE, 4)"


_INTENT_ROWS = " UNION ALL ".join(f"SELECT doc_id, slide_no, {k} AS k, '{n}' AS intent, {_score(p)} AS score FROM t" for k, (n, p) in enumerate(X.INTENTS.items()))
add("slide_intents", X.intents, f"""WITH {q.SLIDES}, t AS (SELECT doc_id, slide_no, lower(title || ' ' || body) AS low FROM slides), i AS ({_INTENT_ROWS}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY score DESC, k) AS rank FROM i WHERE score >= 0.2)
SELECT doc_id, slide_no, rank, intent, score FROM r WHERE rank <= 4
UNION ALL SELECT doc_id, slide_no, 1, 'GENERAL', 0.1::DOUBLE FROM slides WHERE (doc_id, slide_no) NOT IN (SELECT (doc_id, slide_no) FROM r)""")
_MARKS = r"regexp_replace(replace(coalesce(text, ''), '[TABLE DATA]', ' '), '(?m)^###\s+.*$', ' ', 'g')"
_ALL = lambda p: f"regexp_extract_all(t, {q.text(p)})"
QUERIES["facts"] = lambda spark, sf_dir: X.facts(_with_stated(spark, sf_dir))
ORACLE["facts"] = rf"""WITH d AS (SELECT doc_id, replace({_MARKS}, '|', ' ; ') AS t FROM {_DOCS}),
k AS (SELECT doc_id, 0 AS o, 'formula' AS kind, list_transform({_ALL(X.FORMULA)}, lambda x: regexp_split_to_array(x, {q.text(X.FORMULA_END)})[1]) AS found FROM d
  UNION ALL SELECT doc_id, 1, 'date', {_ALL(chr(92) + 'b' + X.YEAR + chr(92) + 'b')} FROM d
  UNION ALL SELECT doc_id, 2, 'figure', list_filter(list_transform({_ALL(X.FIGURE)}, lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^{X.YEAR}$') AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 1 AND (regexp_matches(x, {q.text(X.FIGURE_MARK)}) OR length(x) >= 3)) FROM d
  UNION ALL SELECT doc_id, 3, 'term', list_filter({_ALL(chr(92) + 'b' + X.NAME + chr(92) + 'b')}, lambda x: length(x) > 3) FROM d),
u AS (SELECT doc_id, o, kind, regexp_replace(unnest(found), '^[ .,;:()]+|[ .,;:()]+$', '', 'g') AS value, generate_subscripts(found, 1) AS n FROM k),
a AS (SELECT * FROM u WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, kind, regexp_replace(lower(value), '[\s,]+', '', 'g') ORDER BY n) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, n) AS pos FROM a) SELECT doc_id, pos, kind, value FROM p WHERE pos <= 40"""
_OWN = "list_distinct(regexp_extract_all(lower({}), '[a-z'']+'))"
add("supporting_points", X.supporting, f"""WITH {q.SLIDES}, b AS (SELECT doc_id, slide_no, title, unnest(bullets) AS sent, generate_subscripts(bullets, 1) AS n FROM slides),
f AS (SELECT doc_id, slide_no, n, substr(sent, 1, 120) AS item FROM b WHERE length(sent) >= 5 AND {q.jaccard(_OWN.format('sent'), _OWN.format('title'))} <= 0.7),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, slide_no, lower(item) ORDER BY n) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY n) AS pos FROM o) SELECT doc_id, slide_no, pos, item FROM p WHERE pos <= 8""")
