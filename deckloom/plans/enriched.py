"""Queries of ``operators.keyterms`` over stated decks and all documents, of ``operators.anchors`` over pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.functions import phrases as P
from deckloom.operators import anchors as A
from deckloom.operators import decks as D
from deckloom.operators import keyterms as K
from deckloom.operators import markdown as M
from deckloom.plans import sqltext as q
from deckloom.plans.decked import ORACLE as DECKED
from deckloom.plans.marked import _SECTIONS, _texts
from deckloom.plans.phrased import blanks, ends
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

_TERM_DECK = "\n".join(
    ["A parser builds trees. The parser reads tokens.", "Every token feeds the parser. A tree is made here [TABLE DATA] token."]
    + [f"Slide {k} uses a token for the parser in its own way. A token is read by the parser and has a use that it shows to all." for k in range(3, 16)]
    + ["Token use. It ends.", "Glossary of trees. A token has words."]
)
STATED = ((-1, _TERM_DECK), (-2, "Only one slide. It has a parser."), (-3, ""))
_STATED_SQL = " UNION ALL ".join(f"SELECT {i} AS doc_id, {q.text(t)} AS text".replace("\n", "' || chr(10) || '") for i, t in STATED)
_DECKS = q.SLIDES.replace("FROM documents)", f"FROM (SELECT doc_id, text FROM documents UNION ALL {_STATED_SQL}))")
FIXED = (("parser", "what builds trees from the tokens that it reads", 1), ("token", "a piece of text that has a kind", 2), ("tree", "nodes and their children in an order", 2), ("kind of token", "what says how to read it", 1))


def decks(spark, sf_dir):
    """(deck, slide_no, title, bullets, text) of the stated decks and all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(list(STATED), "doc_id long, text string"))
    return slides(docs).select(F.col("doc_id").alias("deck"), "slide_no", "title", "bullets", F.col("body").alias("text"))


def terms(spark, sf_dir):
    """(deck, term, definition, slide_no): stated terms, and each document's most frequent long words, defined where they are first met."""
    own = slides(table(spark, sf_dir, "documents"))
    words = D.quiz_words(own).select("doc_id", "word", "n", "rank")
    first = own.select("doc_id", "slide_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"[a-z][a-z\-']+"), F.lit(0)))).alias("word")).groupBy("doc_id", "word").agg(F.min("slide_no").alias("slide_no"))
    made = words.join(first, ["doc_id", "word"]).select(F.col("doc_id").alias("deck"), F.col("word").alias("term"), F.concat(F.lit("met "), F.col("n").cast("string"), F.lit(" times, at rank "), F.col("rank").cast("string")).alias("definition"), "slide_no")
    return made.union(spark.createDataFrame([(-1, *t) for t in FIXED], "deck long, term string, definition string, slide_no long"))


_WORDS_SQL = DECKED["quiz_words"].replace(f"WITH {q.SLIDES},", "").strip()
_W_CTES, _W_SELECT = _WORDS_SQL.rsplit("\nSELECT", 1)
_FIXED_SQL = " UNION ALL ".join(f"SELECT -1, {q.text(t)}, {q.text(d)}, {n}" for t, d, n in FIXED)
TERMS_SQL = rf"""{_DECKS}, {_W_CTES}, qw AS (SELECT{_W_SELECT}), fs AS (SELECT doc_id, unnest(list_distinct({q.words('body')})) AS word, slide_no FROM slides), fm AS (SELECT doc_id, word, min(slide_no) AS slide_no FROM fs GROUP BY 1, 2),
terms AS (SELECT qw.doc_id AS deck, qw.word AS term, 'met ' || n || ' times, at rank ' || rank AS definition, fm.slide_no FROM qw JOIN fm ON fm.doc_id = qw.doc_id AND fm.word = qw.word WHERE qw.doc_id >= 0 UNION ALL {_FIXED_SQL})"""

QUERIES["key_terms"] = lambda spark, sf_dir: K.key_terms(decks(spark, sf_dir), terms(spark, sf_dir))
ORACLE["key_terms"] = rf"""WITH {TERMS_SQL}, hits AS (SELECT deck, s.slide_no, term, definition, t.slide_no AS src, body FROM slides s JOIN terms t ON t.deck = s.doc_id WHERE contains(lower(body), term) AND contains(' ' || regexp_replace(lower(body), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || regexp_replace(term, '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ') AND regexp_matches(lower(body), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(term) || '($|[^\p{{L}}\p{{N}}_])')),
n AS (SELECT doc_id AS deck, count(*) AS n FROM slides GROUP BY 1), f AS (SELECT deck, term, count(*) AS k FROM hits GROUP BY 1, 2),
h AS (SELECT hits.deck, slide_no, list({{'t': hits.term, 'd': definition, 'c': k > 0.3 * n AND n >= 10}} ORDER BY length(hits.term) DESC, hits.term DESC, definition DESC) AS h FROM hits JOIN n ON n.deck = hits.deck JOIN f ON f.deck = hits.deck AND f.term = hits.term WHERE src <> slide_no AND NOT contains(body, '{K.TABLE_MARK}') GROUP BY 1, 2),
d AS (SELECT deck, list({{'i': slide_no, 'h': h}} ORDER BY slide_no) AS ss FROM h GROUP BY 1),
r AS (SELECT deck, list_reduce(ss, lambda a, x: list_transform([list_filter(x.h, lambda t: len(list_filter(a.last, lambda l: l.t = t.t AND (t.c OR x.i - l.i < {K.REGAP}))) = 0)[1:{K.PER_SLIDE}]],
 lambda g: {{'out': list_concat(a.out, list_transform(g, lambda t, k: {{'i': x.i, 'k': k, 't': t.t, 'd': t.d}})), 'last': list_concat(list_filter(a.last, lambda l: NOT list_contains(list_transform(g, lambda t: t.t), l.t)), list_transform(g, lambda t: {{'t': t.t, 'i': x.i}}))}})[1],
 {{'out': []::STRUCT(i BIGINT, k BIGINT, t VARCHAR, d VARCHAR)[], 'last': []::STRUCT(t VARCHAR, i BIGINT)[]}}).out AS o FROM d), u AS (SELECT deck, unnest(o) AS o FROM r)
SELECT deck, o.i AS slide_no, o.k::INT AS rank, CASE WHEN length(o.t) < 4 THEN o.t ELSE upper(left(o.t, 1)) || substr(o.t, 2) END AS term, o.d AS definition FROM u"""

_RANKED = rf"""{TERMS_SQL}, rt AS (SELECT t.deck, term, definition, sum((length(lower(body)) - length(replace(lower(body), term, ''))) // length(term))::BIGINT AS times FROM terms t JOIN slides s ON s.doc_id = t.deck GROUP BY 1, 2, 3)"""
QUERIES["glossary_pages"] = lambda spark, sf_dir: K.glossary_pages(decks(spark, sf_dir), terms(spark, sf_dir)).withColumn("lines", F.array_join("lines", "|"))
ORACLE["glossary_pages"] = rf"""WITH {_RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY times DESC, term DESC, definition DESC) - 1 AS i FROM rt WHERE len({blanks('definition')}) >= 3 AND deck NOT IN (SELECT doc_id FROM slides WHERE regexp_matches(title, {q.text(K.GLOSSARY_TITLE)}))),
gb AS (SELECT *, count(*) OVER (PARTITION BY deck) AS n FROM a WHERE i < 12), gc AS (SELECT deck, (i // 6 + 1)::INT AS page, ceil(max(n) / 6.0)::INT AS pages, string_agg(CASE WHEN length(term) < 30 THEN upper(left(term, 1)) || substr(term, 2) ELSE left(term, 30) END || ': ' || definition, '|' ORDER BY i) AS lines FROM gb WHERE n >= 4 GROUP BY 1, 2)
SELECT deck, page, CASE WHEN pages = 1 THEN 'Glossary' ELSE 'Glossary (' || page || '/' || pages || ')' END AS title, lines FROM gc"""
QUERIES["matching_pairs"] = lambda spark, sf_dir: K.matching_pairs(decks(spark, sf_dir), terms(spark, sf_dir))
ORACLE["matching_pairs"] = rf"""WITH {_RANKED}, a AS (SELECT *, (row_number() OVER (PARTITION BY deck ORDER BY times DESC, term DESC, definition DESC))::INT AS rank FROM rt WHERE (len({blanks('term')}) = 3 OR length(term) <= 28) AND len({blanks('definition')}) BETWEEN 4 AND 18),
b AS (SELECT *, count(*) OVER (PARTITION BY deck) AS n FROM a WHERE rank <= 5) SELECT deck, rank, upper(left(term, 1)) || substr(term, 2) AS term, definition FROM b WHERE n >= 4"""
_FIRST = f"coalesce(list_filter(list_transform(bullets, lambda b: {ends('b')}), lambda b: b <> '' AND NOT prefix(b, '###'))[1], '')"
_CUT = f"array_to_string({blanks('l')}[1:{K.LEAD_WORDS}], ' ')"
_WHOLE = f"regexp_extract({_CUT}, '^.*[.;:]')"
QUERIES["summary_lines"] = lambda spark, sf_dir: K.summary_lines(decks(spark, sf_dir))
ORACLE["summary_lines"] = rf"""WITH {_DECKS}, a AS (SELECT doc_id AS deck, slide_no, title AS whole, trim(regexp_replace(title, '\s*\(\d+/\d+\)$', '')) AS title, regexp_replace({_FIRST}, {q.text(K.OPENING)}, '') AS l, count(*) OVER (PARTITION BY doc_id) AS slides FROM slides),
b AS (SELECT deck, slide_no, title, CASE WHEN len({blanks('l')}) <= {K.LEAD_WORDS} THEN l WHEN len({blanks(_WHOLE)}) >= 6 THEN {_WHOLE} ELSE regexp_replace({_CUT}, '[,;: ]+$', '') || '…' END AS l FROM a WHERE slides >= 3 QUALIFY row_number() OVER (PARTITION BY deck, whole ORDER BY slide_no) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY slide_no) - 1 AS i, count(*) OVER (PARTITION BY deck) AS n FROM b WHERE l <> '' AND title <> ''),
d AS (SELECT deck, i AS k, title, l FROM c WHERE n BETWEEN 3 AND 7 UNION ALL SELECT deck, k, title, l FROM c JOIN (SELECT unnest(range(0, 7)) AS k) ON i = k * n // 7 WHERE n > 7)
SELECT deck, (k + 1)::INT AS place, left(title, 38) || ': ' || l AS line FROM d"""

_VERB = r"\b(?:is|are|was|were|has|have|can|will|uses?|means?|gives?|makes?|helps?|depends?|refers?|shows?|takes?|works?|needs?|allows?|produces?)\b"
_CLEAN = rf"""len({blanks('x')}) BETWEEN 9 AND 32 AND regexp_matches(x, '^[A-Z“"(]') AND regexp_matches(x, '[a-z][.!?]$') AND NOT regexp_matches(x, '[⇒→←<>|{{}}=_]|--|\s/\s|\b(?:wf|pos|lemma|lexsn)\b') AND len(regexp_extract_all(x, '\p{{L}}')) >= 0.75 * length(replace(x, ' ', '')) AND regexp_matches(x, {q.text(_VERB)})"""
_SIG = lambda x: f"left(regexp_replace(lower({x}), '[^a-z]', '', 'g'), 70)"
QUERIES["context_sentences"] = lambda spark, sf_dir: K.context_sentences(decks(spark, sf_dir))
ORACLE["context_sentences"] = rf"""WITH {_DECKS}, a AS (SELECT doc_id AS deck, slide_no, array_to_string(bullets, ' ') AS o, list_filter(list_transform(regexp_extract_all(regexp_replace(title, {q.text(K.CONTINUED)}, ''), '[A-Za-z][A-Za-z\-]{{3,}}'), lambda w: lower(w)), lambda w: NOT list_contains({q.listed(K.TITLE_STOP)}, w)) AS keys FROM slides),
p0 AS (SELECT deck, slide_no, string_split(regexp_replace(regexp_replace(o, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS xs FROM a), p1 AS (SELECT deck, slide_no AS source, {ends('unnest(xs)')} AS x, generate_subscripts(xs, 1) AS pos FROM p0), p AS (SELECT deck, source, pos, x, {_SIG('x')} AS mark FROM p1 WHERE {_CLEAN}),
c AS (SELECT a.deck, slide_no, keys, p.x, source, pos, mark, len(list_filter(keys, lambda k: regexp_matches(lower(p.x), '\b' || k))) AS hits FROM a JOIN p ON p.deck = a.deck AND source <> slide_no WHERE len({blanks('o')}) < {K.THIN} AND len(keys) > 0 AND NOT contains({_SIG('o')}, left(mark, 40))),
d AS (SELECT deck, slide_no, list({{'x': x, 's': source, 'm': mark}} ORDER BY abs(source - slide_no), source, pos) AS cs FROM c WHERE hits >= CASE WHEN len(keys) >= 3 THEN 2 ELSE 1 END AND (length(keys[1]) >= 5 OR hits >= 2) GROUP BY 1, 2),
e AS (SELECT deck, list({{'i': slide_no, 'cs': cs}} ORDER BY slide_no) AS ss FROM d GROUP BY 1),
r AS (SELECT deck, list_reduce(ss, lambda g, y: list_transform([list_filter(y.cs, lambda z: NOT list_contains(g.used, z.m))], lambda f: CASE WHEN len(f) = 0 THEN g ELSE {{'out': list_append(g.out, {{'i': y.i, 'x': f[1].x, 's': f[1].s}}), 'used': list_append(g.used, f[1].m)}} END)[1], {{'out': []::STRUCT(i BIGINT, x VARCHAR, s BIGINT)[], 'used': []::VARCHAR[]}}).out AS o FROM e), u AS (SELECT deck, unnest(o) AS o FROM r)
SELECT deck, o.i AS slide_no, o.x AS sentence, o.s AS source FROM u"""


def page_assets(spark, sf_dir):
    """(doc, asset, title, text, place): each paragraph of a page, every third under the page's title; each link by its text alone."""
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    plain = lambda x: P.ends(F.regexp_replace(x, r"(?s)<[^>]*>", ""))
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p>(.*?)(?:</p>|</article>)"), F.lit(1)), lambda x, i: F.struct(i.cast("long").alias("asset"), F.when(i % 3 == 0, title).otherwise("").alias("title"), plain(x).alias("text"), i.cast("long").alias("place")))
    links = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a [^>]*>(.*?)</a>"), F.lit(1)), lambda x, i: F.struct((1000 + i).cast("long").alias("asset"), plain(x).alias("title"), F.lit("").alias("text"), i.cast("long").alias("place")))
    return table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc"), F.explode(F.concat(paragraphs, links)).alias("a")).select("doc", "a.*")


def page_parts(spark, sf_dir):
    return M.sections_of(_texts(spark, sf_dir)).where("doc < 0")


_TAGLESS = lambda x: ends(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')")
_STOPS = q.listed(A.ASSET_STOP)
_SIGN = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 3 AND NOT list_contains({_STOPS}, w)))"
ANCHORED_SQL = rf"""{_SECTIONS}, ps AS (SELECT *, lower(trim(title)) AS name, {_SIGN("title || ' ' || text")} AS words FROM sections WHERE doc < 0), pn AS (SELECT doc, count(*) AS n FROM ps GROUP BY 1),
h AS (SELECT -1 - page_id AS doc, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) AS t, regexp_extract_all(coalesce(html, ''), '(?is)<p>(.*?)(?:</p>|</article>)', 1) AS p, regexp_extract_all(coalesce(html, ''), '(?is)<a [^>]*>(.*?)</a>', 1) AS l FROM pages),
pa AS (SELECT doc, t, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM h), la AS (SELECT doc, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM h),
assets AS (SELECT doc, i AS asset, CASE WHEN i % 3 = 0 THEN t ELSE '' END AS title, {_TAGLESS('x')} AS text, i AS place FROM pa UNION ALL SELECT doc, 1000 + i, {_TAGLESS('x')}, '', i FROM la),
r AS (SELECT a.doc, asset, place, n, {_SIGN('a.text')} AS words, (SELECT min(section) FROM ps WHERE ps.doc = a.doc AND name <> '' AND name = lower(trim(a.title))) AS by_title FROM assets a JOIN pn ON pn.doc = a.doc),
w AS (SELECT r.doc, asset, section, len(list_intersect(r.words, ps.words))::DOUBLE / least(len(r.words), len(ps.words)) AS share FROM r JOIN ps ON ps.doc = r.doc WHERE by_title IS NULL AND len(r.words) > 0 AND len(ps.words) > 0),
bw AS (SELECT doc, asset, section AS by_words FROM w WHERE share >= {A.LEAST_SHARE} QUALIFY row_number() OVER (PARTITION BY doc, asset ORDER BY share DESC, section) = 1),
anchored AS (SELECT r.doc, r.asset, coalesce(by_title, by_words, CASE WHEN place < n THEN place + 1 ELSE 1 END)::INT AS section, CASE WHEN by_title IS NOT NULL THEN 'title' WHEN by_words IS NOT NULL THEN 'words' ELSE 'place' END AS stage FROM r LEFT JOIN bw ON bw.doc = r.doc AND bw.asset = r.asset)"""
QUERIES["anchored_assets"] = lambda spark, sf_dir: A.anchored_assets(page_parts(spark, sf_dir), page_assets(spark, sf_dir))
ORACLE["anchored_assets"] = f"WITH {ANCHORED_SQL} SELECT doc, asset, section, stage FROM anchored"
QUERIES["assets_of_sections"] = lambda spark, sf_dir: A.assets_of_sections(page_parts(spark, sf_dir), page_assets(spark, sf_dir)).withColumn("images", F.array_join(F.transform("images", lambda x: x.cast("string")), ","))
ORACLE["assets_of_sections"] = f"WITH {ANCHORED_SQL}, held AS (SELECT doc, section, min(asset) AS image, string_agg(asset, ',' ORDER BY asset) AS images FROM anchored GROUP BY 1, 2) SELECT ps.doc, ps.section, image, coalesce(images, '') AS images FROM ps LEFT JOIN held ON held.doc = ps.doc AND held.section = ps.section"
