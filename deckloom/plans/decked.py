"""Queries of the deck passes and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import decks as D
from deckloom.plans import sqltext as q
from deckloom.plans.extracts import _DEF
from deckloom.plans.phrased import values
from deckloom.sources.tables import passages, slides, table

QUERIES, ORACLE = {}, {}


def add(name: str, run, sql: str, make=slides) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(make(table(spark, sf_dir, "documents")))
    ORACLE[name] = sql


add("distinct_passages", D.distinct_passages, f"""WITH {q.PASSAGES}, k AS (SELECT *, substr(regexp_replace(lower(sent), '[^a-z0-9_]+', '', 'g'), 1, 80) AS k FROM passages WHERE len({q.tokens('sent')}) >= 4)
SELECT doc_id, slide_no, sent_no, sent FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, slide_no, k ORDER BY sent_no) = 1""", passages)
add("buildups", D.buildups, f"""WITH {q.SLIDES}, a AS (SELECT doc_id, slide_no, lower(trim(title)) AS t, list_distinct({q.tokens('lower(body)')}) AS w FROM slides),
b AS (SELECT *, lead(t) OVER o AS t2, lead(w) OVER o AS w2 FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY slide_no))
SELECT doc_id, slide_no, coalesce(t <> '' AND t = t2 AND len(list_intersect(w, w2))::DOUBLE / greatest(len(w), 1) >= 0.9 AND len(w2) > len(w), false) AS is_buildup FROM b""")
add("agenda", D.agenda, rf"""WITH {q.SLIDES}, a AS (SELECT doc_id, slide_no, trim(regexp_replace(title, '(?i)\s*\((?:\d+/\d+|continued)\)\s*$', '')) AS title FROM slides),
b AS (SELECT * FROM a WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY slide_no) = 1),
c AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY slide_no) AS pos, count(*) OVER (PARTITION BY doc_id) AS total FROM b) SELECT doc_id, pos, title FROM c WHERE total >= 4 AND pos <= 8""")
add("flashcards", D.flashcards, f"""WITH {q.SLIDES}, {_DEF}, g AS (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY slide_no, term) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY slide_no, term) AS card_no, term AS front, definition AS back FROM g QUALIFY card_no <= 60""")
_FIVE = q.content("body").replace("length(q) > 2", "length(q) > 4")
add("quiz_words", D.quiz_words, f"""WITH {q.SLIDES}, w AS (SELECT doc_id, unnest({_FIVE}) AS word FROM slides), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 10""")
add("repeated_slides", D.repeated_slides, f"""WITH {q.SLIDES}, k AS (SELECT doc_id, slide_no, list_distinct(list_filter(list_transform(bullets, lambda b: substr(regexp_replace(lower(b), '[^a-z0-9]', '', 'g'), 1, 60)), lambda x: length(x) >= 6)) AS k FROM slides),
r AS (SELECT doc_id, slide_no, len(k) AS n, unnest(k) AS key FROM k),
m AS (SELECT a.doc_id, a.slide_no, b.slide_no AS of_slide, a.n, count(*) AS c FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.key = b.key AND b.slide_no < a.slide_no GROUP BY ALL)
SELECT doc_id, slide_no, min(of_slide) AS of_slide FROM m WHERE c >= 0.7 * n GROUP BY doc_id, slide_no""")


def _judged(spark, sf_dir):
    long = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")) >= 20
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(long, 1).otherwise(0).alias("given"))
    return D.confusion(table(spark, sf_dir, "labels").join(d, "doc_id").withColumnRenamed("quality", "wanted"), "wanted", "given")


QUERIES["quality_confusion"] = _judged
ORACLE["quality_confusion"] = f"""WITH j AS (SELECT quality AS wanted, CASE WHEN len({q.tokens("coalesce(text, '')")}) >= 20 THEN 1 ELSE 0 END AS given FROM labels JOIN documents USING (doc_id))
SELECT wanted, given, count(*) AS n, round_even(count(*)::DOUBLE / any_value(t), 4) AS share FROM j JOIN (SELECT wanted, count(*) AS t FROM j GROUP BY wanted) USING (wanted) GROUP BY wanted, given"""

VALUES = ((1, "98765 43210", "ABC-PRES-0001-S03"), (2, "+1 (415) 555-2671", "abc"), (3, "12", "XY-PRES-12-S7"))


def _identifiers(spark, sf_dir):
    """The stated identifiers, and some made of each customer's nation, key and segment."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    phone = F.concat((nation + 10).cast("string"), F.lit(" "), F.lpad(key, 8, "0"))
    slide = F.concat(F.upper(F.left("c_mktsegment", F.lit(3))), F.lit("-PRES-"), key, F.lit("-S"), nation.cast("string"))
    rows = spark.createDataFrame(list(VALUES), "id long, phone string, slide string").union(table(spark, sf_dir, "customer").select(-1 - F.col("c_custkey"), phone, slide))
    deck, number = D.slide_id(F.col("slide"))
    return rows.select("id", D.phone(F.col("phone")).alias("phone"), deck.alias("deck"), number.alias("slide_no"), F.left(F.sha1("slide"), F.lit(16)).alias("fingerprint"))


QUERIES["identifiers"] = _identifiers
ORACLE["identifiers"] = rf"""WITH v AS (SELECT id::BIGINT AS id, phone, slide FROM {values(VALUES, 'id, phone, slide')} UNION ALL SELECT -1 - c_custkey, (c_nationkey + 10) || ' ' || lpad(c_custkey::VARCHAR, 8, '0'), upper(left(c_mktsegment, 3)) || '-PRES-' || c_custkey || '-S' || c_nationkey FROM customer),
d AS (SELECT *, regexp_replace(phone, '[^\d+]', '', 'g') AS digits FROM v), f AS (SELECT *, CASE WHEN prefix(digits, '+') THEN digits WHEN length(digits) = 10 THEN '+91' || digits ELSE '+' || digits END AS whole FROM d)
SELECT id, CASE WHEN regexp_matches(whole, '^\+[1-9]\d{{7,14}}$') THEN whole END AS phone, nullif(regexp_extract(slide, '^([A-Z]+-PRES-\d+)-S\d+$', 1), '') AS deck, try_cast(regexp_extract(slide, '^[A-Z]+-PRES-\d+-S(\d+)$', 1) AS BIGINT) AS slide_no, left(sha1(slide), 16) AS fingerprint FROM f"""
