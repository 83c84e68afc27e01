"""Queries over records, windows and statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import records as R
from deckloom.operators import statistics as T
from deckloom.operators import windows as W
from deckloom.plans import sqltext as q
from deckloom.sources.tables import slides, table

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


def _jobs(spark, sf_dir):
    """Orders as jobs: id, user_id, status, error, source_type, created_at."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("queued")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.col("o_orderpriority").alias("source_type"), F.col("o_orderdate").alias("created_at"))


_JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'queued' END AS status,
  NULL::VARCHAR AS error, o_orderpriority AS source_type, o_orderdate AS created_at FROM orders)"""


@query("user_profiles", "SELECT c_custkey, c_name, n_name AS organization FROM customer JOIN nation ON c_nationkey = n_nationkey")
def user_profiles(spark, sf_dir):
    joined = R.with_profiles(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey")
    return joined.select("c_custkey", "c_name", F.col("n_name").alias("organization"))


@query("catalog_with_decks", """WITH ready AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS deck_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, c_mktsegment, deck_id, deck_id IS NOT NULL AS ready FROM customer LEFT JOIN ready USING (c_custkey)""")
def catalog_with_decks(spark, sf_dir):
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("deck_id"))
    return R.with_decks(table(spark, sf_dir, "customer"), ready, "c_custkey").select("c_custkey", "c_mktsegment", "deck_id", F.col("deck_id").isNotNull().alias("ready"))


@query("ready_entries", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ready_entries(spark, sf_dir):
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(ready, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("entries_to_build", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def entries_to_build(spark, sf_dir):
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(ready, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("live_and_saved_jobs", f"WITH {_JOBS}, live AS (SELECT * FROM jobs WHERE id % 3 = 0 AND status = 'running') SELECT id, user_id, status, 'live' AS origin FROM live UNION ALL SELECT id, user_id, status, 'saved' FROM jobs WHERE id NOT IN (SELECT id FROM live)")
def live_and_saved_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("id", "user_id", "status")
    live = jobs.where("id % 3 = 0 AND status = 'running'").withColumn("origin", F.lit("live"))
    return R.live_and_saved(live, jobs.withColumn("origin", F.lit("saved")), "id")


@query("newest_jobs", f"WITH {_JOBS} SELECT user_id, id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM jobs QUALIFY rank <= 5")
def newest_jobs(spark, sf_dir):
    return R.newest(_jobs(spark, sf_dir).select("user_id", "id", "created_at"), ["user_id"], "created_at", "id", 5)


@query("recovered_jobs", f"WITH {_JOBS} SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted' ELSE error END AS error FROM jobs")
def recovered_jobs(spark, sf_dir):
    return R.recovered(_jobs(spark, sf_dir), "interrupted").select("id", "status", "error")


@query("kept_jobs", f"WITH {_JOBS} SELECT id, status, created_at FROM jobs WHERE created_at >= TIMESTAMP '1998-08-02' - INTERVAL 30 DAY")
def kept_jobs(spark, sf_dir):
    return _jobs(spark, sf_dir).where(F.col("created_at") >= F.lit("1998-07-03").cast("timestamp")).select("id", "status", "created_at")


@query("live_store", f"""WITH {_JOBS}, f AS (SELECT * FROM jobs WHERE NOT (status IN ('done', 'failed', 'awaiting_review') AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 6 HOUR)),
n AS (SELECT id FROM f ORDER BY created_at DESC, id LIMIT 200) SELECT id, status FROM f WHERE status = 'running' OR id IN (SELECT id FROM n)""")
def live_store(spark, sf_dir):
    return R.live_store(_jobs(spark, sf_dir), "1998-01-01").select("id", "status")


@query("job_upsert", f"""WITH {_JOBS}, s AS (SELECT * FROM jobs WHERE id % 4 <> 0), n AS (SELECT id, user_id + 1 AS user_id, 'done' AS status, CASE WHEN id % 2 = 0 THEN '' ELSE 'pdf' END AS source_type FROM jobs WHERE id % 3 = 0)
SELECT coalesce(n.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.user_id ELSE n.user_id END AS user_id, CASE WHEN n.id IS NOT NULL THEN n.status ELSE s.status END AS status,
  CASE WHEN n.id IS NULL OR (s.id IS NOT NULL AND n.source_type = '') THEN s.source_type ELSE n.source_type END AS source_type FROM s FULL JOIN n ON s.id = n.id""")
def job_upsert(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("id", "user_id", "status", "source_type")
    new = jobs.where("id % 3 = 0").select("id", (F.col("user_id") + 1).alias("user_id"), F.lit("done").alias("status"), F.when(F.col("id") % 2 == 0, "").otherwise("pdf").alias("source_type"))
    return R.upsert(jobs.where("id % 4 <> 0"), new, "id", ["user_id"], ["source_type"])


@query("latest_versions", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS n_versions FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1")
def latest_versions(spark, sf_dir):
    return R.latest_versions(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber")


@query("restored_versions", """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), t AS (SELECT l_orderkey, max(l_linenumber) AS top FROM v GROUP BY 1)
SELECT * FROM v UNION ALL SELECT v.l_orderkey, (top + 1)::INT, v.l_quantity FROM v JOIN t USING (l_orderkey) WHERE l_linenumber = 1""")
def restored_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.restored(rows, "l_orderkey", "l_linenumber", 1)


@query("registry", "SELECT o_custkey AS user_id, o_orderkey AS deck_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS display_number, 'PRES-' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::VARCHAR, 4, '0') AS pres_id FROM orders")
def registry(spark, sf_dir):
    decks = _jobs(spark, sf_dir).select("user_id", F.col("id").alias("deck_id"), "created_at")
    return R.numbered(decks).drop("created_at")


@query("event_log", r"SELECT event_id, user_id, substr(regexp_replace(event_type, '[^A-Za-z0-9_.:\-]', '', 'g'), 1, 60) AS name, substr(props, 1, 2000) AS props FROM events")
def event_log(spark, sf_dir):
    return R.event_rows(table(spark, sf_dir, "events"))


@query("code_requests", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
r AS (SELECT event_id, user_id, round_even((us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 1e6::DOUBLE, 3) AS since_last,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS in_hour FROM e)
SELECT *, coalesce(since_last < 30, false) OR in_hour >= 5 AS refused FROM r""")
def code_requests(spark, sf_dir):
    return R.code_requests(table(spark, sf_dir, "events"))


@query("deck_dashboard", """WITH d AS (SELECT o_custkey AS user_id, o_orderkey AS deck_id, o_totalprice AS score, 1::BIGINT AS n_slides, o_orderdate AS created_at FROM orders)
SELECT user_id, count(*) AS n_decks, sum(n_slides)::BIGINT AS n_slides, round_even(sum(round(score * 100)::BIGINT)::DOUBLE / count(score), 0) / 100.0::DOUBLE AS mean_score, max_by(deck_id, (score, deck_id)) AS best_deck, min_by(deck_id, (score, deck_id)) AS weakest_deck,
  round_even(max_by(score, (created_at, deck_id)) - min_by(score, (created_at, deck_id)), 2) AS trend FROM d GROUP BY user_id""")
def deck_dashboard(spark, sf_dir):
    decks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("deck_id"), F.col("o_totalprice").alias("score"), F.lit(1).cast("long").alias("n_slides"), F.col("o_orderdate").alias("created_at"))
    return R.dashboard(decks)


@query("subject_counts", "SELECT c_mktsegment AS subject, count(*) AS n, min_by(c_name, c_custkey) AS first_entry FROM customer GROUP BY c_mktsegment")
def subject_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min_by("c_name", "c_custkey").alias("first_entry"))


@query("gallery_page", "SELECT c_custkey, c_name, c_acctbal > 0 AS ready FROM customer ORDER BY ready DESC, c_name LIMIT 40 OFFSET 20")
def gallery_page(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("ready")).orderBy(F.desc("ready"), "c_name").offset(20).limit(40)


@query("run_numbers", f"""WITH {q.SLIDES}, a AS (SELECT doc_id, slide_no, title, lower(trim(title)) AS k0 FROM slides),
b AS (SELECT *, coalesce((k0 <> lag(k0) OVER (PARTITION BY doc_id ORDER BY slide_no))::INT, 1) AS fresh FROM a), c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY slide_no) AS run FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY slide_no) AS k, count(*) OVER (PARTITION BY doc_id, run) AS n FROM c)
SELECT doc_id, slide_no, k, n, CASE WHEN n > 1 THEN title || ' (' || k || '/' || n || ')' ELSE title END AS label FROM d""")
def run_numbers(spark, sf_dir):
    return W.run_numbers(_slides(spark, sf_dir))


@query("carried_titles", f"WITH {q.SLIDES} SELECT doc_id, slide_no, coalesce(last_value(CASE WHEN length(title) >= 12 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY slide_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), title) AS title FROM slides")
def carried_titles(spark, sf_dir):
    return W.carried_titles(_slides(spark, sf_dir))


@query("even_pages", f"""WITH {q.SLIDES}, r AS (SELECT doc_id, slide_no, len(bullets) AS n, unnest(range(len(bullets))) AS i FROM slides),
p AS (SELECT *, ceil(n / 4.0)::BIGINT AS p FROM r), x AS (SELECT *, n // p AS b, n % p AS x FROM p)
SELECT doc_id, slide_no, i AS bullet_no, CASE WHEN i < x * (b + 1) THEN i // (b + 1) ELSE x + (i - x * (b + 1)) // b END + 1 AS page, p AS n_pages FROM x""")
def even_pages(spark, sf_dir):
    return W.even_pages(_slides(spark, sf_dir))


@query("word_windows", f"""WITH w AS (SELECT doc_id, {q.tokens("coalesce(text, '')")} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS i FROM w)
SELECT doc_id, i // 150 AS chunk_no, len(w[i + 1:i + 150]) AS n_words, md5(array_to_string(w[i + 1:i + 150], ' ')) AS chunk_md5 FROM s""")
def word_windows(spark, sf_dir):
    return W.word_windows(table(spark, sf_dir, "documents"))


@query("transitions", f"""WITH {q.SLIDES}, a AS (SELECT doc_id, slide_no, lower(trim(title)) AS stem, list_distinct(list_filter(regexp_extract_all(lower(body), '[a-z0-9]+'), lambda w: length(w) > 3)) AS ws FROM slides),
b AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY slide_no) AS pw, lag(stem) OVER (PARTITION BY doc_id ORDER BY slide_no) AS ps FROM a), c AS (SELECT *, {q.jaccard('pw', 'ws')} AS o FROM b)
SELECT doc_id, slide_no, CASE WHEN pw IS NOT NULL THEN round_even(o, 6) END AS overlap, CASE WHEN pw IS NULL THEN 'fade' WHEN stem = ps THEN 'none' WHEN o >= 0.45 THEN 'fade' WHEN o >= 0.15 THEN 'slide' ELSE 'convex' END AS transition FROM c""")
def transitions(spark, sf_dir):
    return W.transitions(_slides(spark, sf_dir))


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: lower(trim(x))), lambda x: x <> '')"


@query("repeated_lines", f"WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS line FROM l WHERE len(l) >= 8) SELECT doc_id, line, count(*) AS n FROM u WHERE length(line) >= 8 GROUP BY doc_id, line HAVING count(*) >= 3")
def repeated_lines(spark, sf_dir):
    return W.repeated_lines(table(spark, sf_dir, "documents"))


@query("furniture_lines", f"WITH u AS (SELECT unnest(list_distinct({_LINES})) AS line FROM documents), t AS (SELECT count(*) AS total FROM documents) SELECT line, count(*) AS n_docs FROM u, t GROUP BY line, total HAVING count(*) >= 3 AND count(*) >= 0.002 * total")
def furniture_lines(spark, sf_dir):
    return W.furniture(table(spark, sf_dir, "documents"))


def _junk(t: str) -> str:
    ws = rf"list_filter(list_transform(regexp_split_to_array({t}, '\s+'), lambda w: lower(regexp_replace(w, '^[:;,.]+|[:;,.]+$', '', 'g'))), lambda w: w <> '')"
    letters = rf"len(regexp_extract_all({t}, '\p{{L}}'))"
    return rf"({t} = '' OR (regexp_matches({t}, '[=+\-/*:]$') AND contains({t}, '=')) OR {letters} < greatest(3.0, length({t}) * 0.4) OR (len({ws}) >= 2 AND len(list_distinct({ws})) = 1) OR len({ws}) > 12)"


_HEADINGS = rf"""hs AS (SELECT doc_id, slide_no, body, trim(title) AS t, regexp_replace(trim(title), '(?i)\s*\((?:\d+/\d+|continued)\)\s*$', '') AS t2 FROM slides),
headed AS (SELECT doc_id, slide_no, {_junk('t')} AS junk, regexp_matches(t2, '{W.GENERIC_TITLE}') OR len({q.tokens('t2')}) < 5 OR NOT regexp_matches(t2, '{W.TITLE_VERB}') AS weak, len({q.tokens('body')}) < 60 AS thin FROM hs)"""


@query("headings", f"WITH {q.SLIDES}, {_HEADINGS} SELECT * FROM headed")
def headings(spark, sf_dir):
    return W.headings(_slides(spark, sf_dir))


@query("escalations", f"WITH {q.SLIDES}, {_HEADINGS} SELECT doc_id, CASE WHEN weak OR thin THEN 'model' ELSE 'offline' END AS route, count(*) AS n FROM headed GROUP BY 1, 2")
def escalations(spark, sf_dir):
    return W.escalations(_slides(spark, sf_dir))


@query("value_summary", """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2), t AS (SELECT l_returnflag, max(c) AS c FROM c GROUP BY 1),
m AS (SELECT l_returnflag, string_agg(l_quantity::VARCHAR, ',' ORDER BY l_quantity) AS modes FROM c JOIN t USING (l_returnflag, c) GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round_even(avg(l_quantity), 4) AS mean, round_even(median(l_quantity), 4) AS median, round_even((max(l_quantity) - min(l_quantity))::DOUBLE, 4) AS value_range,
  round_even(stddev_pop(l_quantity), 4) AS deviation, any_value(modes) AS modes FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag""")
def value_summary(spark, sf_dir):
    return T.summary(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")


@query("rank_correlation", """WITH r AS (SELECT c_mktsegment, c_acctbal, o_totalprice, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, o_orderkey) AS ra, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice, o_orderkey) AS rb FROM r)
SELECT c_mktsegment, round_even(CASE WHEN count(*) > 1 THEN 1.0 - 6.0 * sum(pow((ra - rb)::DOUBLE, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1.0)) ELSE 0.0 END::DOUBLE, 6) AS spearman,
  round_even(sqrt(avg(pow(c_acctbal - o_totalprice, 2))), 4) AS rmse FROM k GROUP BY c_mktsegment""")
def rank_correlation(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey).select("c_mktsegment", "c_acctbal", "o_totalprice", "o_orderkey")
    return T.spearman(rows, "c_mktsegment", "c_acctbal", "o_totalprice", "o_orderkey")


@query("bigram_model", rf"""WITH {q.PASSAGES}, w AS (SELECT list_concat(['<s>'], list_concat({q.words('sent')}, ['</s>'])) AS w FROM passages),
p AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b), f AS (SELECT a, sum(n)::BIGINT AS n_a FROM c GROUP BY a), v AS (SELECT count(DISTINCT b) AS v FROM c)
SELECT a, b, n, n_a, round_even((n + 1)::DOUBLE / (n_a + v), 9) AS p FROM c JOIN f USING (a), v""")
def bigram_model(spark, sf_dir):
    from deckloom.functions.text import words
    from deckloom.sources.tables import passages

    return T.bigrams(passages(table(spark, sf_dir, "documents")).select(words(F.col("sent")).alias("words")))


@query("naive_bayes", f"""WITH d AS (SELECT doc_id, quality AS label, {q.words("coalesce(text, '')")} AS ws FROM documents JOIN labels USING (doc_id)),
train AS (SELECT * FROM d WHERE doc_id % 5 <> 0), test AS (SELECT * FROM d WHERE doc_id % 5 = 0),
docs AS (SELECT label, count(*)::DOUBLE AS docs FROM train GROUP BY label), cnt AS (SELECT label, w, count(*)::DOUBLE AS c FROM (SELECT label, unnest(ws) AS w FROM train) GROUP BY label, w),
cls AS (SELECT label, ln(docs / (SELECT sum(docs) FROM docs)) AS prior, (SELECT sum(c) FROM cnt WHERE cnt.label = docs.label) + (SELECT count(DISTINCT w) FROM cnt)::DOUBLE AS room FROM docs),
asked AS (SELECT doc_id, w, count(*)::DOUBLE AS k FROM (SELECT doc_id, unnest(ws) AS w FROM test) WHERE w IN (SELECT w FROM cnt) GROUP BY doc_id, w),
s AS (SELECT a.doc_id, cls.label, any_value(prior) AS prior, sum(k) AS k, any_value(room) AS room, sum(round_even(k * ln(coalesce(c, 0) + 1.0), 9)) AS gain FROM asked a CROSS JOIN cls LEFT JOIN cnt ON cnt.w = a.w AND cnt.label = cls.label GROUP BY a.doc_id, cls.label),
r AS (SELECT doc_id AS id, label, round_even(prior - k * ln(room) + gain, 4) AS score FROM s)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1""")
def naive_bayes(spark, sf_dir):
    from deckloom.functions.text import words

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), words(F.coalesce("text", F.lit(""))).alias("words"))
    return T.naive_bayes(rows.where("id % 5 <> 0").select("label", "words"), rows.where("id % 5 = 0").select("id", "words"))


STATES = ["quiet", "busy"]
START = {"quiet": 0.6, "busy": 0.4}
MOVE = {("quiet", "quiet"): 0.7, ("quiet", "busy"): 0.3, ("busy", "quiet"): 0.4, ("busy", "busy"): 0.6}
EMIT = {("quiet", "view"): 0.5, ("quiet", "click"): 0.2, ("quiet", "error"): 0.1, ("quiet", "signup"): 0.1, ("quiet", "purchase"): 0.1, ("busy", "view"): 0.1, ("busy", "click"): 0.4, ("busy", "error"): 0.2, ("busy", "signup"): 0.1, ("busy", "purchase"): 0.2}


@query("viterbi_paths")
def viterbi_paths(spark, sf_dir):
    """States behind all of each user's events of the five known kinds."""
    kinds = [o for s, o in EMIT if s == "quiet"]
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin(kinds))
    rows = events.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("observations"))
    return T.viterbi(rows, STATES, START, MOVE, EMIT)


@query("load_segments")
def load_segments(spark, sf_dir):
    return T.segments(_slides(spark, sf_dir))
