"""Queries of ``functions.phrases`` over stated texts and the turns of conversations or the documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.functions import phrases as P
from deckloom.plans import sqltext as q
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

SENTENCES = (
    "First, chlorophyll absorbs sunlight in the thylakoid membranes.",
    "Step 2: run the automated tests, which takes an hour.",
    "Nitrogen is taken from the air and heated.",
    "The cat has 4 legs, The hen has 2 legs, and The spider has 8 legs.",
    "Brazil has 9 plants and Chile has 4 plants and Peru has 7 plants.",
    "North America $5.6 million, Europe $3.9 million and Asia $2.1 million.",
    "Coal gave 62 percent, gas 24 percent and wind 14 percent.",
    "In 1969 sales grew 12% to 1,250 units; see Figure 3.",
    "(a) Revenue rose to 3.5 billion in Q3 (4).",
    "It can often quickly (also slowly) change.",
    "Therefore, this is the process of turning light into energy, which plants do, so that they live on.",
    "As a result, the method is a measure of how far a long chain of loosely connected parts bends, and it grows, and it shrinks, and it ends; all of it over twenty words.",
    "However, whereas the first group rested, the second one ran because it rained; for example, in the park.",
    "N2 + 3H2 <-> 2NH3 and C6H12O6 -> 2C2H5OH",
    r"The rate is $\frac{a}{b} \times 10^{12}$ \text{mol}_2 per \alpha \unknown{x}",
    "Total no. of rows is 3. 5 more were found by Dr. Smith. J. Doe agrees vs. others. then a small one follows.",
    "[12] A. Author, Some Title, 2015.",
    "Wiley, 3rd edition",
    "xxx vvv bcd qrst ee M=1 tt",
    "The quick brown fox jumps over the lazy dog near the old river bank today.",
    "A price of $250,000 over 12 years, or 15%.",
    "no figure here",
    "<<FIGURE_TEXT>> axis ticks <<END_FIGURE_TEXT>>\n\n\n\nKept text\n- one item\n2) two items",
    "A system is used when the load that it needs is high and everyone uses it.",
    "The the of",
    "In 1066 and 2024 there were 2,000,000 k people and 5 m of rope x.",
    "",
)
PAIRS = (
    ("Stages in NLP", "Stages in NLP, cont."),
    ("The Water Cycle and Photosynthesis", "The water cycle"),
    ("Types of Sorting Algorithms", "Sorting algorithms: types of"),
    ("Part 2", "Continued"),
    ("Cells", "Cells"),
    ("One two three four five", "one two three four six"),
)
RAW = ('{"a": 1}', 'Here: {"a": {"b": [1, 2]}} done', "```json\n{\"k\": \"v\"}\n```", "[1, 2]", "no object", '{"broken": ', "  {} ")
NUMBERS = (0.5, 3.0, 12.5, 999.0, 1250.0, 9999.0, 12000.0, 56789.0, 1500000.0, 2000000.0, 3210000000.0, 7.25, 123.4567)


def values(rows, names: str) -> str:
    """SQL of a table of those rows; numbers as they are, None as NULL."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else q.text(v).replace("\n", "' || chr(10) || '")

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names}))"


STATED = [(i, s) for i, s in enumerate(SENTENCES)]
#: The stated texts, and all turns of conversations under negative ids.
STATED_SQL = f"(SELECT id::BIGINT AS id, text FROM {values(STATED, 'id, text')} UNION ALL SELECT -1 - (conv_id * 1000 + turn), coalesce(text, '') FROM conversations)"


def only_stated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATED, "id long, text string")


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated texts and all turns of conversations."""
    turns = table(spark, sf_dir, "conversations")
    return only_stated(spark).union(turns.select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("id"), F.coalesce("text", F.lit(""))))


def with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated texts and all documents, under negative ids."""
    docs = table(spark, sf_dir, "documents")
    return only_stated(spark).union(docs.select((-1 - F.col("doc_id")).alias("id"), F.coalesce("text", F.lit(""))))


WITH_DOCUMENTS_SQL = f"(SELECT id::BIGINT AS id, text FROM {values(STATED, 'id, text')} UNION ALL SELECT -1 - doc_id, coalesce(text, '') FROM documents)"


# ---- pieces of SQL


def ends(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_end(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|[\s.;:,]+$', '', 'g')"


def cap(x: str) -> str:
    return f"(upper(left({ends(x)}, 1)) || substr({ends(x)}, 2))"


def blanks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda e: e <> '')"


def cut(x: str, marked: str) -> str:
    """Trimmed non-empty pieces of ``marked``, a text with chr(1) at the cuts."""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda e: {ends('e')}), lambda e: e <> '')"


def sub(x: str, pattern: str, by: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q.text(pattern)}, {by}, '{flags}')"


def once(items: str, key) -> str:
    keys = f"list_transform({items}, lambda z: {key('z')})"
    return f"list_filter({items}, lambda x, i: {key('x')} <> '' AND list_position({keys}, {key('x')}) = i)"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def label(x: str, most: int, drop_aux: bool = False) -> str:
    """SQL of a subquery that gives the label of the expression ``x``."""
    stop = q.listed(P.LABEL_STOP + P.DANGLING)
    words = blanks(f"regexp_split_to_array({sub(strip_end(x), P.LEAD_CUE)}, {q.text(P.CLAUSE)})[1]")
    if drop_aux:
        aux = q.listed("is are was were gets get".split())
        step = f"(SELECT list_filter(w, lambda y, i: NOT (list_contains({aux}, lower(y)) AND coalesce(regexp_matches(w[i + 1], {q.text(P.PARTICIPLE)}), false))) AS w FROM (SELECT {words} AS w))"
        step = f"(SELECT CASE WHEN len(w) > 3 AND list_contains(['the', 'a', 'an'], lower(w[1])) THEN w[2:] ELSE w END AS w FROM {step})"
    else:
        step = f"(SELECT {words} AS w)"
    kept = f"w[1:coalesce(list_max(list_transform(w[1:{most}], lambda y, i: CASE WHEN list_contains({stop}, lower(y)) THEN 0 ELSE i END)), 0)]"
    made = cap(f"array_to_string({kept}, ' ')")
    return f"(SELECT CASE WHEN {made} <> '' THEN {made} ELSE {cap(f'left({strip_end(x)}, 40)')} END FROM {step})"


def heading(x: str) -> str:
    stop = q.listed(P.LABEL_STOP)
    hanging = q.listed([*P.LABEL_STOP, *P.DANGLING, "not", "also", "only", "very"])
    words = blanks(sub(sub(strip_end(x), P.LEAD_CUE), P.PRONOUN))
    opened = "list_position(list_transform(v, lambda y: len(regexp_extract_all(y, '\\(')) > len(regexp_extract_all(y, '\\)'))), true)"
    made = cap("array_to_string(u, ' ')")
    kept = f"t[1:coalesce(list_max(list_transform(t, lambda y, i: CASE WHEN list_contains({hanging}, lower(y)) OR (suffix(lower(y), 'ly') AND i > 1) THEN 0 ELSE i END)), 0)]"
    first = f"coalesce(list_position(list_transform(w, lambda y: list_contains({stop}, lower(y))), false), len(w) + 1)"
    first = f"CASE WHEN coalesce({first}, 0) = 0 THEN len(w) + 1 ELSE {first} END"
    inner = f"(SELECT {words} AS w)"
    inner = f"(SELECT w[{first}:][1:3] AS v FROM {inner})"
    inner = f"(SELECT CASE WHEN coalesce({opened}, 0) > 0 THEN v[1:{opened} - 1] ELSE v END AS t FROM {inner})"
    inner = f"(SELECT {kept} AS u FROM {inner})"
    return f"(SELECT CASE WHEN {made} <> '' THEN {made} ELSE {label(x, 3)} END FROM {inner})"


def figures(x: str) -> str:
    plain = sub(sub(x, P.ENUMERATOR), P.REFERENCE, "' '")
    return f"list_filter(list_transform(regexp_extract_all({plain}, {q.text(P.FIGURE)}), lambda e: {ends('e')}), lambda e: NOT regexp_matches(e, {q.text(P.YEAR)}))"


def figure_value(x: str) -> str:
    t = f"regexp_replace(lower({x}), '[,$₹€£]', '', 'g')"
    times = "CASE " + " ".join(f"WHEN contains({t}, '{w}') THEN {by!r}::DOUBLE" for w, by in P.MAGNITUDES) + " ELSE 1.0::DOUBLE END"
    return rf"(try_cast(regexp_extract({t}, '-?\d+(?:\.\d+)?') AS DOUBLE) * {times})"


def unit_of(x: str) -> str:
    word = rf"regexp_extract(lower({x}), '(trillion|billion|million|thousand|bn|mn|k)\b', 1)"
    return f"CASE WHEN regexp_matches({x}, '(?i)%|percent') THEN 'pct' WHEN regexp_matches({x}, '[$₹€£]') THEN 'cur' WHEN {word} <> '' THEN {word} ELSE 'plain' END"


# ---- queries


def add(name: str, run, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(stated(spark, sf_dir))
    ORACLE[name] = sql


_BLOCKS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda b: {sub(ends('b'), P.LIST_MARK)}), lambda b: b <> '')"
_RAW = "flatten(list_transform(" + _BLOCKS + ", lambda b: " + cut("b", r"""regexp_replace(b, '([.!?])\s+([A-Z0-9"“(])', '\1' || chr(1) || '\2', 'g')""") + "))"
_CLAUSES = cut("s", sub(sub("s", r"\s+and\s+([A-Z]\w*\s+(?:has|have|holds?|is|are)\b)", r"chr(1) || '\1'"), r",\s*(?:and\s+)?", "chr(1)"))
VISUAL_SENTENCES_SQL = f"""raw AS (SELECT id, unnest({_RAW}) AS s, generate_subscripts({_RAW}, 1) AS n FROM texts),
parted AS (SELECT id, n, s, {_CLAUSES} AS c FROM raw),
listed AS (SELECT id, n, CASE WHEN len(c) >= 3 AND len(list_filter(c, lambda p: NOT (regexp_matches(p, '\\d') AND regexp_matches(p, {q.text(P.VERBISH)})))) = 0
  THEN list_transform(c, lambda p: {cap(strip_end('p'))} || '.') ELSE [s] END AS c FROM parted),
spread AS (SELECT id, n, unnest(c) AS sent, generate_subscripts(c, 1) AS m FROM listed),
kept AS (SELECT id, n, m, sent FROM spread WHERE {squeezed('sent')} <> '' QUALIFY row_number() OVER (PARTITION BY id, {squeezed('sent')} ORDER BY n, m) = 1),
sents AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY n, m))::INT AS pos, sent FROM kept)"""

QUERIES["visual_sentences"] = lambda spark, sf_dir: P.sentence_rows(with_documents(spark, sf_dir), "id")
ORACLE["visual_sentences"] = f"WITH texts AS {WITH_DOCUMENTS_SQL}, {VISUAL_SENTENCES_SQL} SELECT id, pos, sent FROM sents"

_SHORT = cut("t", r"""regexp_replace(t, '([.!?])["''”’)\]]?\s+([A-Z0-9“"''(])', '\1' || chr(1) || '\2', 'g')""")
add(
    "short_sentences",
    lambda t: t.select("id", F.posexplode(P.short_sentences(F.col("text"))).alias("pos", "sent")),
    rf"""WITH t AS (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM {STATED_SQL}),
p AS (SELECT id, list_filter(list_transform({_SHORT}, lambda e: regexp_replace(e, '^[ .;:]+|[ .;:]+$', '', 'g')), lambda e: len({q.tokens('e')}) >= 3) AS p FROM t)
SELECT id::BIGINT AS id, (generate_subscripts(p, 1) - 1)::INT AS pos, unnest(list_transform(p, lambda e: CASE WHEN regexp_matches(e, '[.!?]$') THEN e ELSE e || '.' END)) AS sent FROM p""",
)
add(
    "whole_sentences",
    lambda t: t.select("id", F.posexplode(P.whole_sentences(F.col("text"))).alias("pos", "sent")),
    rf"""WITH t AS (SELECT id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1) || ' ', 'g'), chr(1)) AS p FROM {STATED_SQL}),
w AS (SELECT id, p, list_transform(p, lambda e: regexp_extract(regexp_replace(e, '[.!?]$', ''), '([A-Za-z0-9.]+)$', 1)) AS k FROM t),
c AS (SELECT id, array_to_string(list_transform(p, lambda e, i: e || CASE WHEN i < len(p) AND NOT (regexp_matches(ltrim(p[i + 1]), '^\p{{Ll}}') OR regexp_matches(k[i], '\d$') OR regexp_matches(k[i], '^[A-Z]$')
  OR list_contains({q.listed(P.ABBREVIATIONS)}, lower(replace(k[i], '.', '')))) THEN chr(2) ELSE '' END), '') AS x FROM w),
s AS (SELECT id, list_filter(list_transform(string_split(x, chr(2)), lambda e: regexp_replace(e, '^[ .;:]+|[ .;:]+$', '', 'g')), lambda e: e <> '') AS s FROM c)
SELECT id::BIGINT AS id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sent FROM s""",
)

QUERIES["sentence_labels"] = lambda spark, sf_dir: P.sentence_labels(P.sentence_rows(with_documents(spark, sf_dir), "id"))
ORACLE["sentence_labels"] = f"WITH texts AS {WITH_DOCUMENTS_SQL}, {VISUAL_SENTENCES_SQL} SELECT id, pos, {label('sent', 6)} AS label, {label('sent', 5, True)} AS step, {heading('sent')} AS head FROM sents"

QUERIES["figures"] = lambda spark, sf_dir: (
    with_documents(spark, sf_dir)
    .select("id", F.posexplode(P.figures(F.col("text"))).alias("pos", "figure"))
    .select("id", "pos", "figure", P.figure_value(F.col("figure")).alias("value"), P.pretty_value(F.col("figure")).alias("pretty"), P.unit_of(F.col("figure")).alias("unit"))
)
ORACLE["figures"] = rf"""WITH f AS (SELECT id, {figures('text')} AS f FROM {WITH_DOCUMENTS_SQL}), u AS (SELECT id, unnest(f) AS figure, (generate_subscripts(f, 1) - 1)::INT AS pos FROM f)
SELECT id, pos, figure, {figure_value('figure')} AS value, {sub(ends('figure'), '(?i)' + chr(92) + 's*percent' + chr(92) + 'b', "'%'")} AS pretty, {unit_of('figure')} AS unit FROM u"""

QUERIES["short_numbers"] = lambda spark, sf_dir: spark.createDataFrame([(v,) for v in NUMBERS], "v double").union(table(spark, sf_dir, "orders").select("o_totalprice")).select("v", P.short_number(F.col("v")).alias("shown"))
ORACLE["short_numbers"] = f"""SELECT v, CASE WHEN v >= 1e9 THEN replace(printf('%.1fB', v / 1e9), '.0B', 'B') WHEN v >= 1e6 THEN replace(printf('%.1fM', v / 1e6), '.0M', 'M') WHEN v >= 1e4 THEN printf('%.0fK', v / 1e3)
 WHEN v = floor(v) THEN format('{{:,}}', v::BIGINT) ELSE printf('%g', v) END AS shown FROM (SELECT v FROM {values([(v,) for v in NUMBERS], 'v')} UNION ALL SELECT o_totalprice FROM orders)"""

_EQ = sub(sub("text", "<->|<=>", "'⇌'"), "->|=>", "'→'")
add(
    "pretty_equations",
    lambda t: t.select("id", P.pretty_equation(F.col("text")).alias("equation")),
    rf"""SELECT id::BIGINT AS id, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace({_EQ}, '\s+', ' ', 'g')), '[A-Za-z)]\d+|.'),
 lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z)]\d+$') THEN translate(p, '0123456789', '{P.SUBSCRIPTS}') ELSE p END), '') AS equation FROM {STATED_SQL}""",
)
_SEG = cut("text", sub(sub(strip_end("text"), r"\s+and\s+([A-Za-z][\w ]{0,30}?\s+\W?\d)", r"chr(1) || '\1'"), r",\s*(?:and\s+)?", "chr(1)"))
add(
    "listed_pairs",
    lambda t: t.select("id", F.posexplode(P.listed_pairs(F.col("text"))).alias("pos", "p")).select("id", "pos", "p.*"),
    rf"""WITH s AS (SELECT id, {_SEG} AS s FROM {STATED_SQL}), u AS (SELECT id, len(s) AS total, unnest(s) AS s, generate_subscripts(s, 1) AS n FROM s),
w AS (SELECT *, {figures('s')} AS f, regexp_extract_all(regexp_replace(s, '(?s)' || {q.text(P.FIGURE)} || '.*$', ''), '[\w''’+#./&-]+') AS w FROM u),
a AS (SELECT *, w[1:coalesce(list_max(list_transform(w, lambda e, i: CASE WHEN list_contains({q.listed(P.TAIL_VERBS)}, lower(e)) THEN 0 ELSE i END)), 0)] AS v FROM w),
b AS (SELECT *, CASE WHEN coalesce(list_position(list_transform(v, lambda e: list_contains({q.listed(P.HEAD_FILLER)}, lower(e))), false), 0) = 0 THEN []::VARCHAR[] ELSE v[list_position(list_transform(v, lambda e: list_contains({q.listed(P.HEAD_FILLER)}, lower(e))), false):] END AS x FROM a),
c AS (SELECT *, array_to_string(x[greatest(len(x) - 3, 1):], ' ') AS l FROM b),
d AS (SELECT id, total, n, {cap('l')} AS label, try_cast(replace(regexp_extract(f[1], '\d[\d,]*(?:\.\d+)?'), ',', '') AS DOUBLE) AS value, {unit_of('f[1]')} AS unit, len(f) = 1 AND l <> '' AS ok FROM c),
g AS (SELECT id FROM d GROUP BY id HAVING bool_and(ok) AND any_value(total) >= 3 AND count(DISTINCT lower(label)) = any_value(total))
SELECT id::BIGINT AS id, (n - 1)::INT AS pos, label, value, unit FROM d WHERE id IN (SELECT id FROM g)""",
)
_Q = [f"regexp_extract(text, {q.text(P.QUANTITY)}, {k})" for k in (1, 2, 3)]
add("quantities", lambda t: t.select("id", P.quantity(F.col("text")).alias("quantity")), f"SELECT id::BIGINT AS id, trim({_Q[0]}) || {_Q[1]} || CASE WHEN {_Q[2]} IN ('', '%') THEN '' ELSE ' ' END || {_Q[2]} AS quantity FROM {STATED_SQL}")
_LED = sub(sub(sub(ends("text"), P.LEAD_MARKER), P.PRONOUN_LEAD), P.COPULA_LEAD)
add(
    "compressed_sentences",
    lambda t: t.select("id", P.compressed(F.col("text")).alias("bullet")),
    rf"""WITH a AS (SELECT id, regexp_replace(regexp_replace({_LED}, '\s+', ' ', 'g'), '^[ ,;:.]+|[ ,;:.]+$', '', 'g') AS s FROM {STATED_SQL}),
b AS (SELECT id, upper(left(s, 1)) || substr(s, 2) AS s FROM a), c AS (SELECT id, s, regexp_replace({sub('s', P.RELATIVE)}, '^[ ,;:]+|[ ,;:]+$', '', 'g') AS r FROM b),
d AS (SELECT id, CASE WHEN len({blanks('s')}) > 16 AND len({blanks('r')}) BETWEEN 8 AND 20 THEN r ELSE s END AS s FROM c),
e AS (SELECT id, s, array_to_string({blanks('s')}[1:19], ' ') AS h FROM d),
f AS (SELECT id, s, h, length(h) - length(regexp_extract(h, '^(?:.|\n)*([,;:]\s.*)$', 1)) AS place FROM e)
SELECT id::BIGINT AS id, CASE WHEN len({blanks('s')}) > 19 THEN regexp_replace(CASE WHEN regexp_matches(h, '[,;:]\s') AND place > length(h) * 0.5 THEN left(h, place) ELSE h END, '[ ,;:]+$', '') ELSE s END AS bullet FROM f""",
)
_TEX = "replace(text, '$', '')"
for _ in range(3):
    _TEX = sub(sub(sub(_TEX, r"\\(?:text|mathrm|mathbf|textbf|mathit|operatorname)\{([^{}]*)\}", r"'\1'"), r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"'(\1)/(\2)'"), r"\\sqrt\{([^{}]*)\}", r"'√(\1)'")
for _k, _v in P.LATEX.items():
    _TEX = f"replace({_TEX}, {q.text(_k)}, {q.text(_v)})"
for _k, _v in P.GREEK.items():
    _TEX = sub(_TEX, rf"\\{_k}\b", q.text(_v))


def _raised(x: str, mark: str, signs: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '(?s){mark}\{{?\d+\}}?|.'), lambda p: CASE WHEN regexp_matches(p, '^{mark}\{{?\d+\}}?$') THEN translate(regexp_replace(p, '[_^{{}}]', '', 'g'), '0123456789', '{signs}') ELSE p END), '')"


add(
    "plain_latex",
    lambda t: t.select("id", P.delatex(F.col("text")).alias("plain")),
    rf"""SELECT id::BIGINT AS id, CASE WHEN NOT contains(text, '\') AND NOT contains(text, '$') THEN text ELSE trim(regexp_replace(regexp_replace(regexp_replace({_raised(_raised(_TEX, '_', P.SUBSCRIPTS), chr(92) + '^', P.SUPERSCRIPTS)},
 '\\[A-Za-z]+', '', 'g'), '[{{}}]', '', 'g'), '\s{{2,}}', ' ', 'g')) END AS plain FROM {STATED_SQL}""",
)
_W = "regexp_extract_all(lower(text), '[a-z]+')"
_TRIPLE = "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
QUERIES["readable_texts"] = lambda spark, sf_dir: with_documents(spark, sf_dir).select("id", P.readable(F.col("text")).alias("readable"))
ORACLE["readable_texts"] = rf"""WITH a AS (SELECT id, text, {_W} AS w FROM {WITH_DOCUMENTS_SQL}), b AS (SELECT id, text, w, list_filter(w, lambda e: length(e) >= 3) AS l FROM a)
SELECT id, len(l) >= 3 AND len(list_filter(l, lambda e: regexp_matches(e, '[aeiouy]') AND NOT regexp_matches(e, '{_TRIPLE}'))) >= 0.7 * len(l)
  AND len(regexp_extract_all(text, '[^\w\s.,;:()''\-%/]'))::DOUBLE / greatest(length(text), 1) <= 0.08 AND len(list_filter(w, lambda e: length(e) <= 2))::DOUBLE / greatest(len(w), 1) <= 0.45 AS readable FROM b"""
add("without_ocr", lambda t: t.select("id", P.without_ocr(F.col("text")).alias("plain")), rf"SELECT id::BIGINT AS id, {ends(sub(sub('text', P.OCR_BLOCK), chr(92) + 'n{3,}', 'chr(10) || chr(10)'))} AS plain FROM {STATED_SQL}")
add(
    "citations",
    lambda t: t.select("id", P.is_citation(F.col("text")).alias("is_citation")),
    rf"""SELECT id::BIGINT AS id, (regexp_matches(text, '^\s*\[\d{{1,3}}\]\s+\S') AND regexp_matches(text, '\b(?:1[89]\d{{2}}|20\d{{2}})\b'))
 OR (regexp_matches(text, {q.text(P.CITATION)}) AND regexp_matches(text, '(?i)\b(?:1[89]\d{{2}}|20\d{{2}})\b|\bed(?:ition)?\b')) AS is_citation FROM {STATED_SQL}""",
)
_VERB = r"\b(?:is|are|was|were|has|have|can|will|uses?|means?|gives?|makes?|helps?|depends?|refers?|shows?|takes?|works?|needs?|allows?|produces?)\b"
QUERIES["clean_sentences"] = lambda spark, sf_dir: P.sentence_rows(with_documents(spark, sf_dir), "id").where(P.is_clean_sentence(F.col("sent")))
ORACLE["clean_sentences"] = rf"""WITH texts AS {WITH_DOCUMENTS_SQL}, {VISUAL_SENTENCES_SQL}
SELECT id, pos, sent FROM sents WHERE len({blanks('sent')}) BETWEEN 9 AND 32 AND regexp_matches(sent, '^[A-Z“"(]') AND regexp_matches(sent, '[a-z][.!?]$')
 AND NOT regexp_matches(sent, '[⇒→←<>|{{}}=_]|--|\s/\s|\b(?:wf|pos|lemma|lexsn)\b') AND len(regexp_extract_all(sent, '\p{{L}}')) >= 0.75 * length(replace(sent, ' ', '')) AND regexp_matches(sent, {q.text(_VERB)})"""


def _spans() -> str:
    ctes, before = [f"base AS (SELECT id::BIGINT AS id, text FROM {STATED_SQL})"], None
    for k, (name, words) in enumerate(P.CUES):
        pattern = q.text(rf"(?i)\b({words})\b")
        ctes.append(f"m{k} AS (SELECT id, unnest(regexp_extract_all(text, {pattern})) AS t, unnest(regexp_split_to_array(text, {pattern})[1:len(regexp_extract_all(text, {pattern}))]) AS g, generate_subscripts(regexp_extract_all(text, {pattern}), 1) AS n FROM base)")
        ctes.append(f"p{k} AS (SELECT id, (sum(length(g) + length(t)) OVER (PARTITION BY id ORDER BY n) - length(t))::INT AS start, length(t)::INT AS size FROM m{k})")
        apart = f" AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.id = p.id AND b.start <= p.start AND p.start < b.stop)" if before else ""
        mine = f"SELECT id, start, start + size AS stop, '{name}' AS relation FROM p{k} p WHERE size >= 3{apart}"
        ctes.append(f"a{k} AS ({mine}" + (f" UNION ALL SELECT * FROM {before})" if before else ")"))
        before = f"a{k}"
    return "WITH " + ",\n".join(ctes) + f" SELECT id, start, stop, relation FROM {before}"


add("cue_spans", lambda t: t.select("id", F.explode(P.cue_spans(F.col("text"))).alias("s")).select("id", "s.*"), _spans())


def _pair(a: Column, b: Column, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated pairs, and the headings of each document's slides that follow each other."""
    after = F.lead("title").over(Window.partitionBy("doc_id").orderBy("slide_no"))
    titles = slides(table(spark, sf_dir, "documents")).select(F.col("title").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return spark.createDataFrame(list(PAIRS), "a string, b string").union(titles).select("a", "b", P.title_key(a).alias("key"), P.same_heading(a, b).alias("same"))


def _key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\b(?:cont(?:inued|d)?|part|contd)\b', ' ', 'g'), '\s+', ' ', 'g'))"


QUERIES["same_headings"] = lambda spark, sf_dir: _pair(F.col("a"), F.col("b"), spark, sf_dir)
ORACLE["same_headings"] = f"""WITH {q.SLIDES}, pairs AS (SELECT a, b FROM {values(PAIRS, 'a, b')} UNION ALL SELECT * FROM (SELECT title AS a, lead(title) OVER (PARTITION BY doc_id ORDER BY slide_no) AS b FROM slides) WHERE b IS NOT NULL),
k AS (SELECT a, b, {_key('a')} AS ka, {_key('b')} AS kb FROM pairs), w AS (SELECT *, list_distinct({blanks('ka')}) AS wa, list_distinct({blanks('kb')}) AS wb FROM k)
SELECT a, b, ka AS key, ka <> '' AND kb <> '' AND (ka = kb OR ((contains(ka, kb) OR contains(kb, ka)) AND least(len(wa), len(wb)) >= 0.75 * greatest(len(wa), len(wb)))
 OR (greatest(len(wa), len(wb)) >= 3 AND len(list_intersect(wa, wb)) >= 0.8 * greatest(len(wa), len(wb)))) AS same FROM w"""

_OK = lambda x: f"(prefix({x}, '{{') AND json_valid({x}))"
QUERIES["json_objects"] = lambda spark, sf_dir: spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "id long, raw string").union(table(spark, sf_dir, "events").select(-1 - F.col("event_id"), F.concat(F.lit("Event: "), F.coalesce("props", F.lit(""))))).select("id", P.json_object(F.col("raw")).alias("object"))
ORACLE["json_objects"] = rf"""WITH r AS (SELECT id::BIGINT AS id, {ends('raw')} AS a, {ends(sub('raw', '(?i)```(?:json)?' + chr(92) + 's*'))} AS b, regexp_extract(raw, '(?s)\{{.*\}}') AS c FROM (SELECT id, raw FROM {values([(i, r) for i, r in enumerate(RAW)], 'id, raw')} UNION ALL SELECT -1 - event_id, 'Event: ' || coalesce(props, '') FROM events))
SELECT id, CASE WHEN {_OK('a')} THEN a WHEN {_OK('b')} THEN b WHEN {_OK('c')} THEN c END AS object FROM r"""
