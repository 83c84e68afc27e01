"""Queries of ``operators.utterances``: stated utterances and all turns of users; a registry of stated presentations and all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import utterances as U
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import blanks, values
from deckloom.sources.tables import table

QUERIES, ORACLE = {}, {}

UTTERANCES = (
    "stop", "hold on", "Carry on", "say that again", "never mind", "next slide", "previous one", "go to the first slide", "show the last slide", "go to slide number three", "what is on slide 12",
    "open the photosynthesis section", "stay here", "read it to me", "explain this slide", "what does this diagram show", "create a presentation about volcanoes", "open the web deck of cell biology",
    "let's present", "close the deck", "start over the presentation", "resume where we left off", "download the pdf of deck 2", "get rid of the deck", "Hey assistant, open the ppt on thermodynamics pls",
    "ABC-PRES-0012", "open number four", "open the second one", "open the second one on the slide", "do you have a ready-made deck on algebra", "check if there is a pre-built lesson", "is there a deck about maps",
    "list all my decks", "where is osmosis explained", "look up entropy", "look up entropy in my decks", "which decks are about law", "summarise deck one", "walk me through the presentation", "quiz me on tides",
    "next question", "why was that wrong", "the answer is 42", "teach me calculus", "exam prep for physics", "give me an easier", "too easy", "compare cats and dogs", "mitosis vs meiosis", "how do tides differ",
    "practical example please", "example of irony", "explain gravity in simple terms", "break it down", "why is the sky blue", "then what", "define entropy", "tell me about lava", "make this more visual",
    "animate this", "make it interactive", "what can you do", "translate to french", "good morning", "is it far?", "some deck", "blah blah", "", "give me 7 questions on rivers", "opn no. 3", "show presentation 3",
)
ENTRIES = (
    (1, "The Water Cycle", "", ""), (2, "Phishing attack patterns", "", ""), (3, "Sorting algorithms", "computing", ""), (4, "Deadlock and paging basics", "", ""), (5, "Romans in Gaul", "history", "antiquity"),
    (6, "Neural model training", "", ""), (7, "", "", ""),
)
SEARCHES = ((1, "red ring"), (2, ""), (3, "gadget blue BIG"), (4, "zzz"), (5, "water"), (6, "romans gaul"), (7, "ring"))
REFERENCES = (
    (1, "the water cycle presentation", None), (2, "", 3), (3, "", None), (4, "abc-pres-0004", None), (5, "ABC-PRES-0999", None), (6, "that one", 5), (7, "deck 2", None), (8, "open number six", None),
    (9, "presentation 77777", None), (10, "the last presentation", None), (11, "the second deck", None), (12, "red widget", None), (13, "sorting algorithms", None), (14, "romans of old", None),
    (15, "phishing and whales in the sea", None), (16, "zzz yyy", None), (17, "3", None), (18, "show it on the slide", 2),
)


def _utterances(spark, sf_dir):
    stated = spark.createDataFrame([(k, u) for k, u in enumerate(UTTERANCES)], "id long, text string")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return stated.union(turns)


def _entries(spark, sf_dir):
    stated = spark.createDataFrame(list(ENTRIES), "number long, title string, subject string, topic string")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 101).alias("number"), F.col("p_name").alias("title"), F.lower("p_type").alias("subject"), F.col("p_brand").alias("topic"))
    return U.derived(stated.union(parts)).withColumns({"pres_id": F.concat(F.lit("ABC-PRES-"), F.lpad(F.col("number").cast("string"), 4, "0")), "ready": F.col("number") % 3 == 0})


QUERIES["utterance_intents"] = lambda spark, sf_dir: U.understood(_utterances(spark, sf_dir))
QUERIES["presentation_registry"] = lambda spark, sf_dir: _entries(spark, sf_dir).select("number", "title", "subject", "topic", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", "|").alias("aliases"))
QUERIES["found_presentations"] = lambda spark, sf_dir: U.found_presentations(_entries(spark, sf_dir), spark.createDataFrame(list(SEARCHES), "query_id long, query string"))
QUERIES["found_in_gallery"] = lambda spark, sf_dir: U.found_in_gallery(_entries(spark, sf_dir), spark.createDataFrame(list(SEARCHES), "query_id long, query string"))
QUERIES["resolved_references"] = lambda spark, sf_dir: U.resolved(spark.createDataFrame(list(REFERENCES), "ref_id long, reference string, current long"), _entries(spark, sf_dir))


def _normal(x: str) -> str:
    t = f"trim(lower({x}))"
    for pattern, by in U.SPELLINGS:
        t = f"regexp_replace({t}, {q.text(pattern)}, {q.text(by.replace('$', chr(92)))}, 'g')"
    return rf"regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), '^[ ?!.]+|[ ?!.]+$', '', 'g')"


def _number(x: str) -> str:
    words = " ".join(rf"WHEN regexp_matches({x}, '\b{w}\b') THEN {k + 1}" for k, w in enumerate(U.NUMBER_WORDS))
    return rf"coalesce(try_cast(regexp_extract({x}, '\b(\d{{1,3}})\b', 1) AS INT), CASE {words} END)"


def _hit(k: int, r: U.Rule) -> str:
    unless = f" AND NOT regexp_matches(t, {q.text('(' + r.pattern + ')' + r.unless)})" if r.unless else ""
    return f"CASE WHEN regexp_matches(t, {q.text(r.pattern)}){unless} THEN {{'less': {-r.confidence!r}::DOUBLE, 'k': {k}, 'rule': '{r.name}', 'intent': '{r.intent}'}} END"


def _other(less: float, rule: str, intent: str) -> str:
    return f"{{'less': {less!r}::DOUBLE, 'k': {len(U.RULES)}, 'rule': '{rule}', 'intent': '{intent}'}}"


_BETWEEN, _VERSUS = r"(?:compare|difference between|between)\s+(.+?)\s+(?:and|vs\.?|versus|with)\s+(.+)$", r"(.+?)\s+(?:vs\.?|versus)\s+(.+)$"


def _compared(k: int) -> str:
    picked = f"CASE WHEN regexp_matches(t, {q.text(_BETWEEN)}) THEN regexp_extract(t, {q.text(_BETWEEN)}, {k}) ELSE regexp_extract(t, {q.text(_VERSUS)}, {k}) END"
    return f"CASE WHEN rule = 'edu.compare' THEN nullif(regexp_replace({picked}, '^[ ?]+|[ ?]+$', '', 'g'), '') END"


_AFTER = f"regexp_extract(t, {q.text(U.REFERENCE_VERB)}, 1)"
_REF = f"trim(regexp_replace(regexp_replace(CASE WHEN {_AFTER} <> '' THEN {_AFTER} ELSE t END, {q.text(U.REFERENCE_LEAD)}, ''), {q.text(U.REFERENCE_KIND)}, ''))"
ORACLE["utterance_intents"] = rf"""WITH u AS (SELECT id::BIGINT AS id, text FROM {values(list(enumerate(UTTERANCES)), 'id, text')} UNION ALL SELECT -1 - conv_id * 1000 - turn, coalesce(text, '') FROM conversations WHERE role = 'user'),
n AS (SELECT id, text, {_normal('text')} AS t FROM u),
b AS (SELECT id, t, CASE WHEN t = '' THEN {_other(0.0, '', 'UNKNOWN')} ELSE coalesce(list_sort(list_filter([{', '.join(_hit(k, r) for k, r in enumerate(U.RULES))}], lambda x: x IS NOT NULL))[1],
  CASE WHEN contains(text, '?') OR regexp_matches(t, {q.text(U.QUESTION)}) THEN {_other(-0.45, 'fallback.question', 'EXPLAIN_CONCEPT')} WHEN regexp_matches(t, 'presentation|deck') THEN {_other(-0.4, 'fallback.presentation', 'OPEN_PRESENTATION')} ELSE {_other(-0.2, 'none', 'UNKNOWN')} END) END AS b FROM n),
r AS (SELECT id, t, b.rule AS rule, b.intent AS intent, -b.less + 0.0::DOUBLE AS confidence FROM b)
SELECT id, t AS normal, rule, intent, confidence, CASE WHEN rule IN ('slide.goto', 'slide.goto2', 'pres.open_num', 'quiz.start') THEN {_number('t')} END AS number,
 CASE WHEN rule IN ('pres.webdeck', 'pres.start', 'pres.download', 'pres.delete', 'pres.open', 'pres.summarise', 'pres.explain', 'fallback.presentation') THEN CASE WHEN {_REF} <> '' THEN {_REF} ELSE t END
  WHEN rule = 'pres.open_id' THEN upper(regexp_extract(t, '[a-z]+-pres-\d{{3,}}')) WHEN rule = 'pres.open_num' THEN ({_number('t')})::VARCHAR END AS reference,
 {_compared(1)} AS concept, {_compared(2)} AS concept_b FROM r"""


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({q.listed(U.REGISTRY_STOP)}, w))"


_HINTS = " ".join(f"WHEN regexp_matches(blob, {q.text('|'.join(h))}) THEN {q.text(n)}" for n, h in U.SUBJECT_HINTS.items())
_REGISTRY = f"""e0 AS (SELECT number::BIGINT AS number, title, subject, topic FROM {values(ENTRIES, 'number, title, subject, topic')} UNION ALL SELECT p_partkey + 101, p_name, lower(p_type), p_brand FROM part),
e1 AS (SELECT *, lower(concat_ws(' ', title, subject, topic)) AS blob FROM e0),
e2 AS (SELECT number, title, CASE WHEN coalesce(subject, '') <> '' THEN subject ELSE CASE {_HINTS} ELSE '' END END AS subject, CASE WHEN coalesce(topic, '') <> '' THEN topic ELSE trim(title) END AS topic FROM e1),
e3 AS (SELECT *, {_tokens('title')} AS w, trim(lower(title)) AS low FROM e2),
entries AS (SELECT number, title, subject, topic, list_sort(list_distinct(list_concat(w, {_tokens('subject')})))[1:12] AS tags,
  list_filter(CASE WHEN low <> '' THEN [low, low || ' presentation', low || ' deck'] ELSE []::VARCHAR[] END || CASE WHEN subject <> '' THEN [subject || ' presentation', subject || ' deck'] ELSE []::VARCHAR[] END ||
    CASE WHEN len(w) > 0 THEN [w[1] || ' presentation', array_to_string(w[1:3], ' ')] ELSE []::VARCHAR[] END, lambda x: true) AS raw, 'ABC-PRES-' || lpad(number::VARCHAR, greatest(4, length(number::VARCHAR))::INT, '0') AS pres_id, number % 3 = 0 AS ready FROM e3),
reg AS (SELECT * EXCLUDE (raw), list_filter(raw, lambda x, i: list_position(raw, x) = i) AS aliases FROM entries)"""
ORACLE["presentation_registry"] = f"WITH {_REGISTRY} SELECT number, title, subject, topic, array_to_string(tags, ',') AS tags, array_to_string(aliases, '|') AS aliases FROM reg"
_HAY = "concat_ws(' ', lower(title), lower(subject), lower(topic), array_to_string(tags, ' '), array_to_string(aliases, ' '))"
ORACLE["found_presentations"] = f"""WITH {_REGISTRY}, a AS (SELECT query_id, trim(lower(query)) AS q, list_filter({blanks('trim(lower(query))')}, lambda w: length(w) > 1) AS w FROM {values(SEARCHES, 'query_id, query')}),
p AS (SELECT query_id::BIGINT AS query_id, number, q = '' AS every, CASE WHEN q = '' THEN 0 ELSE len(list_filter(w, lambda x: contains({_HAY}, x))) END AS hits FROM reg, a)
SELECT query_id, number, hits::INT AS hits, (row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, number))::INT AS rank FROM p WHERE every OR hits > 0"""
ORACLE["found_in_gallery"] = f"""WITH {_REGISTRY}, a AS (SELECT query_id, lower(trim(query)) AS q FROM {values(SEARCHES, 'query_id, query')} WHERE trim(query) <> ''),
p AS (SELECT query_id::BIGINT AS query_id, number, len(list_filter({blanks('q')}, lambda w: length(w) > 1 AND contains(concat_ws(' ', lower(title), lower(subject), array_to_string(tags, ' ')), w))) + CASE WHEN contains(lower(title), q) THEN 3 ELSE 0 END + CASE WHEN ready THEN 2 ELSE 0 END AS score
 FROM reg, a WHERE contains(lower(title), q) OR contains(lower(subject), q) OR len(list_filter(tags, lambda t: contains(t, q))) > 0)
SELECT query_id, number, score::INT AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, number))::INT AS rank FROM p QUALIFY rank <= 6"""
_ORD = "CASE o " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in U.ORDINALS.items()) + " ELSE try_cast(o AS INT) END"
_WORD = "regexp_extract(low, '\\b(one|two|three|four|five|six|seven|eight|nine|ten)\\b', 1)"
ORACLE["resolved_references"] = rf"""WITH {_REGISTRY}, f AS (SELECT ref_id::BIGINT AS ref_id, trim(reference) AS ref, current, lower(trim(reference)) AS low FROM {values(REFERENCES, 'ref_id, reference, current')}),
g AS (SELECT *, regexp_extract(low, '\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last|latest|newest|\d+)(?:\s+one)?\b', 1) AS o, upper(regexp_extract(ref, '(?i)^([a-z]+-pres-\d{{4,}})$', 1)) AS ident,
  trim(regexp_replace(low, {q.text(U.REFERENCE_FILLER)}, ' ', 'g')) AS phrase FROM f),
h AS (SELECT *, coalesce(try_cast(regexp_extract(low, '\b(?:presentation|deck|slide\s*deck|ppt|number|no\.?|#)\s*(\d{{1,3}})\b', 1) AS INT), try_cast(regexp_extract(low, '^\s*(\d{{1,3}})\s*$', 1) AS INT),
   CASE WHEN regexp_matches(low, '\b(presentation|deck|number|open|show|launch|start|go to|goto)\b') THEN list_position({q.listed(U.NUMBER_WORDS)}, nullif({_WORD}, '')) END) AS wanted,
  CASE WHEN regexp_matches(low, '\b(presentation|deck|one)\b') THEN {_ORD} END AS place, {_tokens("CASE WHEN phrase <> '' THEN phrase ELSE low END")} AS words,
  regexp_matches(low, '\b(earlier|before|previous|last one|that one|it)\b') AND NOT regexp_matches(low, '\bslide\b') AS context FROM g),
own AS (SELECT number, {_HAY} AS hay, list_distinct(list_concat(list_concat({_tokens("concat_ws(' ', title, subject, topic)")}, tags), {_tokens("array_to_string(aliases, ' ')")})) AS own FROM reg),
s AS (SELECT ref_id, number, CASE WHEN phrase <> '' AND contains(hay, phrase) THEN 1.0::DOUBLE WHEN len(words) = 0 OR len(own) = 0 THEN 0.0 ELSE len(list_intersect(words, own))::DOUBLE / len(list_distinct(words)) END AS score FROM h, own),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, number) AS rank FROM s WHERE score >= 0.34),
b AS (SELECT ref_id, max(number) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, count(*) FILTER (score >= 0.5) AS strong FROM k GROUP BY ref_id),
spots AS (SELECT number, row_number() OVER (ORDER BY number) AS spot, count(*) OVER () AS n FROM reg),
j AS (SELECT h.*, b.top, b.s1, b.s2, b.strong, (SELECT number FROM reg WHERE pres_id = h.ident) AS idn, (SELECT number FROM reg WHERE reg.number = h.wanted) AS fn, (SELECT number FROM spots WHERE spot = CASE WHEN h.place = -1 THEN n ELSE h.place END) AS pn FROM h LEFT JOIN b USING (ref_id)),
c AS (SELECT ref_id, CASE WHEN ref = '' AND current IS NOT NULL THEN ('resolved', current, 0.7, 'current') WHEN ref = '' THEN ('not_found', NULL, 0.0, 'no reference')
  WHEN ident <> '' THEN CASE WHEN idn IS NOT NULL THEN ('resolved', idn, 1.0, 'id') ELSE ('not_found', NULL, 0.0, 'id') END WHEN context AND current IS NOT NULL THEN ('resolved', current, 0.75, 'context')
  WHEN wanted IS NOT NULL THEN CASE WHEN fn IS NOT NULL THEN ('resolved', fn, 0.95, 'number') ELSE ('not_found', NULL, 0.0, 'number') END WHEN pn IS NOT NULL THEN ('resolved', pn, 0.8, 'position')
  WHEN strong = 1 THEN ('resolved', top, round_even(least(0.95::DOUBLE, 0.6::DOUBLE + s1 * 0.35::DOUBLE), 6), 'title') WHEN strong >= 2 AND s1 - s2 >= 0.34 THEN ('resolved', top, 0.8, 'best title') WHEN strong >= 2 THEN ('ambiguous', NULL, 0.4, 'several titles')
  WHEN s1 IS NOT NULL THEN ('resolved', top, 0.55, 'weak title') ELSE ('not_found', NULL, 0.0, 'nothing matches') END AS c FROM j)
SELECT ref_id, c[1] AS status, c[2]::BIGINT AS number, c[3]::DOUBLE AS confidence, c[4] AS reason FROM c"""
