"""Queries over documents as decks of slides, and their SQL."""

from __future__ import annotations

from deckloom.functions import score as S
from deckloom.operators import retrieval, scoring, sentences
from deckloom.plans import sqltext as q
from deckloom.sources.tables import passages, slides, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _slides(spark, sf_dir):
    return slides(table(spark, sf_dir, "documents"))


def _passages(spark, sf_dir):
    return passages(table(spark, sf_dir, "documents"))


_POINTS = """
p AS (SELECT doc_id, slide_no, len(bullets) AS b, len(tok) AS n, coalesce(list_sum(list_transform(tok, lambda x: length(x))), 0) AS chars, len(ttok) AS t FROM
  (SELECT *, {tok} AS tok, {ttok} AS ttok FROM slides)),
scored AS (SELECT doc_id, slide_no, round_even(least(100.0,
  round_even(CASE WHEN n >= 20 AND n <= 130 THEN 20.0 WHEN n < 20 THEN greatest(2.0, 20.0::DOUBLE * (n::DOUBLE / 20)) WHEN n <= 220 THEN greatest(8.0, 20.0::DOUBLE * (1.0 - (n::DOUBLE - 130.0) / 130)) ELSE 8.0 END, 1)
  + round_even(CASE WHEN b BETWEEN 2 AND 6 THEN 20.0 WHEN b = 7 THEN 17.0 WHEN b = 1 THEN 12.0 ELSE greatest(6.0, 20.0::DOUBLE - (b::DOUBLE - 6.0) * 3.0) END, 1)
  + round_even(CASE WHEN t BETWEEN 3 AND 10 THEN 15.0 WHEN t < 3 THEN greatest(2.0, 15.0::DOUBLE * (t::DOUBLE / 3)) ELSE greatest(5.0, 15.0::DOUBLE * (1.0 - (t::DOUBLE - 10.0) / 6.0)) END, 1)
  + round_even(CASE WHEN n = 0 THEN 0.0 WHEN chars::DOUBLE / greatest(n, 1) < 7.6 THEN 15.0 WHEN chars::DOUBLE / greatest(n, 1) < 10.0 THEN greatest(4.0, 15.0::DOUBLE * (1.0 - (chars::DOUBLE / greatest(n, 1) - 7.6) / 2.4)) ELSE 4.0 END, 1)), 0)::DOUBLE AS score FROM p)
""".format(tok=q.tokens("array_to_string(bullets, ' ')"), ttok=q.tokens("title"))

_CONCEPTS = q.content("title || ' ' || array_to_string(bullets, ' ')")


@query("slide_score", f"WITH {q.SLIDES}, {_POINTS} SELECT * FROM scored")
def slide_score(spark, sf_dir):
    return scoring.slide_scores(_slides(spark, sf_dir))


@query("deck_score", f"WITH {q.SLIDES}, {_POINTS} SELECT doc_id, count(*) AS n_slides, round_even(sum(score) / count(*), 0)::DOUBLE AS overall_score FROM scored GROUP BY doc_id")
def deck_score(spark, sf_dir):
    return scoring.deck_scores(_slides(spark, sf_dir))


@query("word_stats", f"""SELECT doc_id, len({q.words("coalesce(text, '')")})::BIGINT AS n_words, len(list_distinct({q.content("coalesce(text, '')")}))::BIGINT AS n_concepts,
  len({q.sentences("replace(coalesce(text, ''), chr(10), ' ')")})::BIGINT AS n_sentences FROM documents""")
def word_stats(spark, sf_dir):
    return scoring.word_stats(table(spark, sf_dir, "documents"))


@query("concept_weights", f"""WITH c AS (SELECT unnest(list_distinct({q.content("coalesce(text, '')")})) AS concept FROM documents)
SELECT concept, count(*) AS n_docs, round_even({q.idf('concept')}, 2) AS weight FROM c GROUP BY concept""")
def concept_weights(spark, sf_dir):
    return scoring.concept_weights(table(spark, sf_dir, "documents"))


@query("concept_novelty", f"""WITH {q.SLIDES}, c AS (SELECT doc_id, slide_no, unnest(list_distinct({_CONCEPTS})) AS concept FROM slides)
SELECT doc_id, slide_no, concept, slide_no = min(slide_no) OVER (PARTITION BY doc_id, concept) AS is_new FROM c""")
def concept_novelty(spark, sf_dir):
    return scoring.novelty(_slides(spark, sf_dir))


_FITNESS = f"""
c0 AS (SELECT doc_id, slide_no, unnest(list_distinct({_CONCEPTS})) AS concept FROM slides),
c1 AS (SELECT *, slide_no = min(slide_no) OVER (PARTITION BY doc_id, concept) AS is_new FROM c0),
fresh AS (SELECT doc_id, slide_no, count(*) AS n_new, round_even(sum({q.idf('concept')}), 6) AS information FROM c1 WHERE is_new GROUP BY doc_id, slide_no),
s1 AS (SELECT *, array_to_string(bullets, ' ') AS bt, list_distinct({_CONCEPTS}) AS concepts, list_distinct({q.content('title')}) AS head,
  list_transform(bullets, lambda b: list_distinct({q.content('b')})) AS sets FROM slides),
s2 AS (SELECT *, flatten(sets) AS every, list_distinct(flatten(sets)) AS dist FROM s1),
cnt AS (SELECT doc_id, slide_no, list(w) AS twice FROM (SELECT doc_id, slide_no, w FROM (SELECT doc_id, slide_no, unnest(every) AS w FROM s2) GROUP BY doc_id, slide_no, w HAVING count(*) > 1) GROUP BY doc_id, slide_no),
s3 AS (SELECT s2.*, coalesce(cnt.twice, []) AS twice FROM s2 LEFT JOIN cnt USING (doc_id, slide_no)),
s4 AS (SELECT *, CASE WHEN len(bullets) = 0 THEN 0.0 ELSE list_sum(list_transform(sets, lambda z: greatest({q.jaccard('z', 'head')},
   CASE WHEN len(dist) = 0 THEN 0.0 ELSE len(list_intersect(z, twice))::DOUBLE / len(dist) END))) / len(bullets) END AS redundancy,
  len(regexp_extract_all(bt, {q.text(S.RELATIONAL)}))::DOUBLE / greatest(len(bullets), 1) AS rel,
  {q.sentences('bt')} AS bsents FROM s3),
s5 AS (SELECT s4.*, coalesce(n_new, 0) AS n_new, coalesce(information, 0.0) AS u FROM s4 LEFT JOIN fresh USING (doc_id, slide_no)),
s6 AS (SELECT doc_id, slide_no, n_new,
  CASE WHEN len(bullets) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, u / (u + 6.0) * (1.0 - redundancy))) END::DOUBLE AS e,
  1.0 / (1.0 + exp(-(1.10::DOUBLE * least(1.0, greatest(0.0, len(concepts)::DOUBLE * (1.0 + rel) / 9.0)) + 1.35::DOUBLE * least(1.0, len({q.words('bt')})::DOUBLE / 16.0) - 2.30::DOUBLE))) AS l,
  (CASE WHEN trim(title) <> '' AND NOT regexp_matches(trim(title), '(?i)^slide\\s*\\d+$') THEN 0.5 ELSE 0.0 END
   + CASE WHEN len(bullets) > 0 AND len(concepts) > 0 THEN coalesce(list_sum(list_transform(bsents, lambda z: CASE WHEN len({q.content('z')}) = 0 OR {q.jaccard(q.content('z'), 'concepts')} >= 0.08 THEN 1.0 ELSE 0.0 END)), 0.0)::DOUBLE / greatest(len(bsents), 1) ELSE 1.0 END
   + 1.0 + 0.5)::DOUBLE / 4.0 AS c FROM s5),
fit AS (SELECT *, pow(greatest(e, 1e-6), 0.40) * pow(greatest(1.0 - l, 1e-6), 0.42) * pow(greatest(c, 1e-6), 0.18) AS fit FROM s6)"""


@query("fitness_slides", f"WITH {q.SLIDES}, {_FITNESS} SELECT doc_id, slide_no, n_new, round_even(e, 4) AS efficiency, round_even(l, 4) AS load, round_even(c, 4) AS coherence, round_even(fit, 4) AS fitness FROM fit")
def fitness_slides(spark, sf_dir):
    return scoring.fitness_slides(_slides(spark, sf_dir))


_FLOW = f"""
g0 AS (SELECT doc_id, slide_no, list_distinct({_CONCEPTS}) AS cs FROM slides),
g1 AS (SELECT doc_id, slide_no, cs, lag(cs) OVER (PARTITION BY doc_id ORDER BY slide_no) AS ps FROM g0),
g2 AS (SELECT doc_id, slide_no, CASE WHEN ps IS NOT NULL THEN {q.jaccard('ps', 'cs')} END::DOUBLE AS overlap FROM g1),
flows AS (SELECT doc_id, slide_no, overlap, CASE WHEN overlap < 0.18::DOUBLE THEN 0.6::DOUBLE + 0.4::DOUBLE * (overlap / 0.18::DOUBLE) WHEN overlap <= 0.55::DOUBLE THEN 1.0
  WHEN overlap IS NOT NULL THEN greatest(0.4::DOUBLE, 1.0::DOUBLE - (overlap - 0.55::DOUBLE) / (1.0::DOUBLE - 0.55::DOUBLE)) END::DOUBLE AS flow FROM g2)"""


@query("slide_flow", f"WITH {q.SLIDES}, {_FLOW} SELECT doc_id, slide_no, round_even(overlap, 6) AS overlap, round_even(flow, 6) AS flow FROM flows")
def slide_flow(spark, sf_dir):
    from pyspark.sql import functions as F

    return scoring.flow(_slides(spark, sf_dir)).select("doc_id", "slide_no", F.bround("overlap", 6).alias("overlap"), F.bround("flow", 6).alias("flow"))


@query("deck_fitness", f"""WITH {q.SLIDES}, {_FITNESS}, {_FLOW},
a AS (SELECT doc_id, exp(avg(ln(greatest(round_even(fit, 4), 1e-6)))) AS gm FROM fit GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(avg(flow), 1.0) AS fl FROM flows GROUP BY doc_id)
SELECT doc_id, round_even(gm, 3) AS geometric_mean, round_even(fl, 4) AS flow, round_even(gm * fl, 3) AS deck_fitness FROM a JOIN b USING (doc_id)""")
def deck_fitness(spark, sf_dir):
    return scoring.fitness_decks(_slides(spark, sf_dir))


_PLAIN = "replace(coalesce(text, ''), chr(10), ' ')"
_GRADE = f"""g AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[A-Za-z'']+') AS ws, len({q.sentences(_PLAIN)})::DOUBLE AS sn FROM documents),
h AS (SELECT doc_id, len(ws)::DOUBLE AS n, sn, coalesce(list_sum(list_transform(ws, lambda w: {q.syllables('w')})), 0)::DOUBLE AS syl FROM g),
graded AS (SELECT doc_id, CASE WHEN n = 0 OR sn = 0 THEN 0.0 ELSE round_even(0.39::DOUBLE * n / greatest(sn, 1.0) + 11.8::DOUBLE * syl / greatest(n, 1.0) - 15.59::DOUBLE, 1) + 0.0 END::DOUBLE AS grade FROM h)"""


@query("reading_grade", f"WITH {_GRADE} SELECT doc_id, grade, CASE WHEN grade <= 14 THEN 'pass' ELSE 'info' END AS status FROM graded")
def reading_grade(spark, sf_dir):
    return scoring.readability(table(spark, sf_dir, "documents"))


@query("deck_audit", f"""WITH {q.SLIDES}, w AS (SELECT doc_id, len({q.tokens("array_to_string(bullets, ' ')")}) AS n, len(bullets) AS b FROM slides),
c AS (SELECT doc_id, sum(CASE WHEN n > 150 THEN 1 ELSE 0 END)::BIGINT AS heavy, sum(CASE WHEN b = 0 THEN 1 ELSE 0 END)::BIGINT AS quiet FROM w GROUP BY doc_id)
SELECT doc_id, 'words per slide' AS check_name, CASE WHEN heavy = 0 THEN 'pass' ELSE 'warn' END AS status, heavy AS n_slides FROM c
UNION ALL SELECT doc_id, 'slides with points', CASE WHEN quiet = 0 THEN 'pass' ELSE 'info' END, quiet FROM c""")
def deck_audit(spark, sf_dir):
    return scoring.audit(_slides(spark, sf_dir))


@query("keyword_topk", f"""WITH a AS (SELECT item_id, unnest(list_distinct({q.tokens('lower(text)')})) AS word FROM benchmark),
h AS (SELECT doc_id, unnest(list_distinct({q.tokens("lower(coalesce(text, ''))")})) AS word FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS overlap FROM a JOIN h USING (word) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, overlap, (row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id))::BIGINT AS rank FROM s QUALIFY rank <= 3""")
def keyword_topk(spark, sf_dir):
    return retrieval.overlap_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("bm25_topk", f"""WITH {q.PASSAGES},
bag AS (SELECT doc_id, slide_no, sent_no, title, {q.retrieval("title || ' ' || sent")} AS bag FROM passages),
size AS (SELECT count(*)::DOUBLE AS n, sum(len(bag))::DOUBLE / count(*) AS av FROM bag),
asked AS (SELECT item_id, unnest(list_distinct({q.retrieval('text')})) AS term FROM benchmark),
tf AS (SELECT doc_id, slide_no, sent_no, term, count(*)::DOUBLE AS tf, any_value(ln)::DOUBLE AS ln FROM (SELECT doc_id, slide_no, sent_no, greatest(len(bag), 1) AS ln, unnest(bag) AS term FROM bag) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
parts AS (SELECT doc_id, slide_no, sent_no, term, round_even(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25 + 0.75 * tf.ln / av)), 9) AS part FROM tf JOIN df USING (term), size),
scored AS (SELECT item_id, doc_id, slide_no, sent_no, sum(part) AS raw FROM parts JOIN asked USING (term) GROUP BY ALL),
titled AS (SELECT DISTINCT item_id, doc_id, slide_no, sent_no FROM (SELECT doc_id, slide_no, sent_no, unnest(list_distinct({q.retrieval('title')})) AS term FROM passages) JOIN asked USING (term)),
x AS (SELECT s.item_id, s.doc_id, s.slide_no, s.sent_no, round_even(raw * CASE WHEN t.item_id IS NOT NULL THEN 1.25 ELSE 1.0 END::DOUBLE, 6) AS exact FROM scored s LEFT JOIN titled t USING (item_id, doc_id, slide_no, sent_no))
SELECT item_id, doc_id, slide_no, sent_no, round_even(exact, 2) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, doc_id, slide_no, sent_no))::BIGINT AS rank FROM x WHERE exact > 0 QUALIFY rank <= 6""")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25_topk(table(spark, sf_dir, "benchmark"), _passages(spark, sf_dir))


SEARCH = "the erering tion"
_TERMS = [w for w in dict.fromkeys(SEARCH.split()) if len(w) > 2]


@query("content_search", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
s AS (SELECT doc_id, ({' + '.join(f"(length(low) - length(replace(low, {q.text(w)}, ''))) / {len(w)}" for w in _TERMS)})::BIGINT AS hits,
  list_filter(string_split(t, chr(10)), lambda x: {' OR '.join(f"contains(lower(x), {q.text(w)})" for w in _TERMS)})[1] AS line FROM d)
SELECT doc_id, hits, substr(trim(line), 1, 80) AS snippet FROM s WHERE hits > 0""")
def content_search(spark, sf_dir):
    return retrieval.content_search(table(spark, sf_dir, "documents"), SEARCH)


def _re(pattern: str) -> str:
    return q.text(pattern)


_FORMULA = dict(sentences.VERBATIM)["formula"].replace(r"|\bequals\b(?!\s+the\s+number)", "")
_VERBATIM = " ".join(
    f"WHEN regexp_matches(sent, {_re(p)}) THEN '{n}'" if n != "formula" else rf"WHEN regexp_matches(sent, {_re(_FORMULA)}) OR regexp_matches(regexp_replace(sent, '\bequals\s+the\s+number', '', 'g'), '\bequals\b') THEN 'formula'"
    for n, p in sentences.VERBATIM
)
_TREATED = rf"""
r AS (SELECT doc_id, slide_no, sent_no, sent, {q.normalised('sent')} AS norm, list_distinct({q.tokens(q.normalised('sent'))}) AS ws FROM passages),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY slide_no, sent_no) AS pos, row_number() OVER (PARTITION BY doc_id, norm ORDER BY slide_no, sent_no) > 1 AS same FROM r),
near AS (SELECT DISTINCT b.doc_id, b.pos FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.pos < b.pos AND len(a.ws) >= 4 AND len(b.ws) >= 4
  AND (len(list_intersect(a.ws, b.ws)) IN (len(a.ws), len(b.ws)) OR len(list_intersect(a.ws, b.ws))::DOUBLE / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.72)),
treated AS (SELECT n.doc_id, slide_no, sent_no, CASE {_VERBATIM} END AS reason,
  CASE WHEN CASE {_VERBATIM} END IS NOT NULL THEN 'VERBATIM' WHEN same OR near.pos IS NOT NULL THEN 'MERGE' WHEN regexp_matches(sent, {_re(sentences.REASONING)}) THEN 'KEEP_REASONING' ELSE 'TIGHTEN' END AS treatment
  FROM n LEFT JOIN near ON n.doc_id = near.doc_id AND n.pos = near.pos)"""


@query("sentence_treatment", f"WITH {q.PASSAGES}, {_TREATED} SELECT doc_id, slide_no, sent_no, treatment, reason FROM treated")
def sentence_treatment(spark, sf_dir):
    return sentences.treatments(_passages(spark, sf_dir))


@query("treatment_counts", f"WITH {q.PASSAGES}, {_TREATED} SELECT doc_id, treatment, count(*) AS n FROM treated GROUP BY doc_id, treatment")
def treatment_counts(spark, sf_dir):
    return sentences.treatment_counts(_passages(spark, sf_dir))


def _first_cue(cues: str) -> str:
    """Whether the first match of the cues begins within 14 characters: what stands before it is at most that long."""
    return rf"(regexp_matches(head, '(?i)\b({cues})\b') AND length(regexp_extract(head, '(?is)^(.*?)\b({cues})\b', 1)) <= 14)"


_RELATION = " ".join([
    *(f"WHEN {_first_cue(c)} THEN '{n}'" for n, c in sentences.CUES),
    rf"WHEN regexp_matches(head, '(?i)^({sentences.ELABORATION})\b') THEN 'elaboration'",
    *(rf"WHEN regexp_matches(sent, '(?i)\b({c})\b') THEN '{n}'" for n, c in sentences.STRONG),
])


@query("discourse_relation", f"WITH {q.PASSAGES}, h AS (SELECT *, substr(trim(sent), 1, 48) AS head FROM passages) SELECT doc_id, slide_no, sent_no, CASE WHEN sent_no = 1 THEN 'none' {_RELATION} ELSE 'none' END AS relation FROM h")
def discourse_relation(spark, sf_dir):
    return sentences.relations(_passages(spark, sf_dir))


@query("sentence_salience", f"""WITH {q.PASSAGES},
r AS (SELECT doc_id, slide_no, sent_no, {q.content('sent')} AS ws, len({q.tokens('sent')}) AS n FROM passages),
e AS (SELECT doc_id, slide_no, sent_no, unnest(ws) AS w FROM r),
c AS (SELECT doc_id, w, count(*)::DOUBLE AS c FROM e GROUP BY doc_id, w),
x AS (SELECT doc_id, w, c / max(c) OVER (PARTITION BY doc_id) AS weight FROM c),
s AS (SELECT doc_id, slide_no, sent_no, sum(weight) AS total, count(*) AS k FROM e JOIN x USING (doc_id, w) GROUP BY ALL),
p AS (SELECT doc_id, slide_no, sent_no, n, row_number() OVER (PARTITION BY doc_id ORDER BY slide_no, sent_no) AS pos, count(*) OVER (PARTITION BY doc_id) AS every FROM r)
SELECT doc_id, slide_no, sent_no, round_even(coalesce(total / sqrt(k), 0.0) * CASE WHEN pos <= 2 THEN 1.25 ELSE 1.0 END::DOUBLE * CASE WHEN pos = every AND every > 3 THEN 1.1 ELSE 1.0 END::DOUBLE
  * CASE WHEN n > 34 THEN 0.85 ELSE 1.0 END::DOUBLE * CASE WHEN n < 6 THEN 0.8 ELSE 1.0 END::DOUBLE, 4) AS salience FROM p LEFT JOIN s USING (doc_id, slide_no, sent_no)""")
def sentence_salience(spark, sf_dir):
    return sentences.salience(_passages(spark, sf_dir))
