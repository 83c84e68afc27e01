"""Queries of ``operators.desk`` over the driver's tables in the part of catalogues, decks and shares, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import desk as D
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import strip_end, values
from deckloom.functions.text import sentences
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}
NOW = "1996-06-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("subject"), F.col("p_type").alias("category"), F.split("p_name", " ").alias("tags"), F.when(F.col("p_size") > 25, "outline").otherwise("draft").alias("status"))


_ENTRIES = "entries AS (SELECT p_partkey AS id, p_name AS title, p_brand AS subject, p_type AS category, string_split(p_name, ' ') AS tags, CASE WHEN p_size > 25 THEN 'outline' ELSE 'draft' END AS status FROM part)"


@query("listed_entries", f"WITH {_ENTRIES} SELECT id, title FROM entries WHERE category = 'ECONOMY' AND status = 'outline' AND (contains(lower(title), 'r') OR contains(lower(subject), 'r') OR len(list_filter(tags, lambda t: contains(t, 'r'))) > 0)")
def listed_entries(spark, sf_dir):
    return D.listed_entries(_entries(spark, sf_dir), category="ECONOMY", query=" R", ready_only=True).select("id", "title")


def _palettes(spark, sf_dir):
    names = F.array(*map(F.lit, ("Nature", "Warm", "Tech", "Corporate", "Vivid", "Soft")))
    return table(spark, sf_dir, "part").select(F.format_string("p%07d", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("category"), F.when(F.col("p_size") % 2 == 0, "light").otherwise("dark").alias("mode"), F.array(F.lower("p_type"), F.lower("p_brand")).alias("tags"))


_PALETTES = "palettes AS (SELECT format('p{:07d}', p_partkey) AS id, p_name AS name, ['Nature', 'Warm', 'Tech', 'Corporate', 'Vivid', 'Soft'][p_partkey % 6 + 1] AS category, CASE WHEN p_size % 2 = 0 THEN 'light' ELSE 'dark' END AS mode, [lower(p_type), lower(p_brand)] AS tags FROM part)"
TOPICS = ("Marine biology", "History of art", "Data networks", "Tax law", "School sport", "Interior design", "Misc", "", "machine tools")


@query("palette_page", f"""WITH {_PALETTES} SELECT id, name FROM palettes WHERE mode = 'light' AND (contains(lower(name), 'r') OR len(list_filter(tags, lambda t: contains(t, 'r'))) > 0)
 AND (contains(lower(name), 'eco') OR len(list_filter(tags, lambda t: contains(t, 'eco'))) > 0) ORDER BY id LIMIT 20 OFFSET 3""")
def palette_page(spark, sf_dir):
    return D.found_palettes(_palettes(spark, sf_dir), "r ECO", mode="light", limit=20, offset=3).select("id", "name")


_CATS = " ".join(rf"WHEN regexp_matches(lower(topic), '\b(?:{'|'.join(w.split())})') THEN '{n}'" for w, n in D.TOPIC_CATEGORY)


@query("picked_palettes", f"""WITH {_PALETTES}, t AS (SELECT topic, CASE {_CATS} ELSE '' END AS category, coalesce(list_sum(list_transform(list_filter(string_split(topic, ''), lambda c: c <> ''), lambda c, i: ascii(c)::BIGINT * i)), 0)::BIGINT AS k FROM {values([(t,) for t in TOPICS], 'topic')}),
pool AS (SELECT category, id FROM palettes WHERE mode = 'light' UNION ALL SELECT '', id FROM palettes WHERE mode = 'light'), n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM pool)
SELECT topic, t.category, id AS palette FROM t JOIN n ON n.category = t.category AND place = k % n""")
def picked_palettes(spark, sf_dir):
    return D.picked_palettes(spark.createDataFrame([(t,) for t in TOPICS], "topic string"), _palettes(spark, sf_dir))


def _shares(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("o_orderdate").cast("timestamp") + F.expr(f"INTERVAL {D.SHARE_DAYS} DAYS"))
    return table(spark, sf_dir, "orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("token"), (F.col("o_custkey") % 50).alias("deck_id"), (F.col("o_custkey") % 7).alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), end.alias("expires_at"), (F.col("o_orderstatus") == "F").alias("revoked"), (F.col("o_orderkey") % 10).alias("views")
    )


_SHARES = f"""shares AS (SELECT md5(o_orderkey::VARCHAR) AS token, o_custkey % 50 AS deck_id, o_custkey % 7 AS user_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL {D.SHARE_DAYS} DAYS END AS expires_at, o_orderstatus = 'F' AS revoked, o_orderkey % 10 AS views FROM orders)"""
_LIVE = f"NOT revoked AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}')"


@query("live_shares", f"WITH {_SHARES} SELECT token, deck_id FROM shares WHERE {_LIVE}")
def live_shares(spark, sf_dir):
    return D.live_shares(_shares(spark, sf_dir), NOW).select("token", "deck_id")


@query("share_views", f"WITH {_SHARES}, v AS (SELECT md5(l_orderkey::VARCHAR) AS token, count(*) AS n FROM lineitem GROUP BY 1) SELECT token, views + coalesce(n, 0) AS views FROM shares LEFT JOIN v USING (token) WHERE {_LIVE}")
def share_views(spark, sf_dir):
    return D.with_views(_shares(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("token")), NOW)


@query("shares_of_decks", f"WITH {_SHARES} SELECT user_id, deck_id, token, revoked, (row_number() OVER (PARTITION BY user_id, deck_id ORDER BY created_at DESC, token))::INT AS rank FROM shares QUALIFY rank <= 5")
def shares_of_decks(spark, sf_dir):
    return D.shares_of_deck(_shares(spark, sf_dir), 5).select("user_id", "deck_id", "token", "revoked", "rank")


@query("session_users", f"""WITH s AS (SELECT sha256('t' || o_orderkey) AS token_hash, o_custkey AS user_id FROM orders WHERE o_orderdate + INTERVAL 2000 DAYS > TIMESTAMP '{NOW}'), r AS (SELECT event_id AS request_id, 't' || user_id AS token FROM events)
SELECT request_id, user_id FROM r LEFT JOIN s ON token_hash = sha256(coalesce(token, ''))""")
def session_users(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").select(F.sha2(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")), 256).alias("token_hash"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 2000 DAYS")).alias("expires_at"))
    return D.session_users(table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token")), sessions, NOW)


@query("error_rows", "SELECT event_id AS id, substr(CASE WHEN event_type = 'error' THEN 'client' ELSE event_type END, 1, 30) AS source, substr(props, 1, 1000) AS message, substr(props || props, 1, 4000) AS stack, substr(event_type, 1, 200) AS path FROM events")
def error_rows(spark, sf_dir):
    return D.error_rows(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("source"), F.col("props").alias("message"), F.concat("props", "props").alias("stack"), F.col("event_type").alias("path")))


@query("saved_edits", """WITH v AS (SELECT l_orderkey AS deck_id, l_linenumber AS version, l_returnflag AS body FROM lineitem), t AS (SELECT deck_id, max(version) AS top FROM v GROUP BY 1),
e AS (SELECT o_orderkey AS deck_id, o_custkey AS edit_no, o_orderpriority AS body FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -1, 'again' FROM orders WHERE o_orderkey % 6 = 0)
SELECT deck_id, version, body FROM v UNION ALL SELECT deck_id, (coalesce(top, 0) + row_number() OVER (PARTITION BY deck_id ORDER BY edit_no))::INT, body FROM e LEFT JOIN t USING (deck_id)""")
def saved_edits(spark, sf_dir):
    versions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("version"), F.col("l_returnflag").alias("body"))
    orders = table(spark, sf_dir, "orders")
    edits = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("deck_id"), F.col("o_custkey").alias("edit_no"), F.col("o_orderpriority").alias("body"))
    return D.saved_edits(versions, edits.union(orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit(-1).cast("long"), F.lit("again"))))


@query("kept_copies", "SELECT o_custkey AS store, o_orderkey AS copy_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))::INT AS rank FROM orders QUALIFY rank <= 14")
def kept_copies(spark, sf_dir):
    copies = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("copy_id"), F.col("o_orderdate").cast("timestamp").alias("made_at"))
    return D.kept_copies(copies).select("store", "copy_id", "rank")


QUIZZES = ((1, "Two and two?", ["3", "4"], "B", ""), (2, "Capital?", ["A", "B", "C", "D", "E"], "A", "apply"), (3, "Open", [], "", None), (4, "Yes?", ["yes"], "A", None))


@query("quiz_rows", """SELECT id::BIGINT AS id, question, coalesce(o[1], '') AS A, coalesce(o[2], '') AS B, coalesce(o[3], '') AS C, coalesce(o[4], '') AS D, correct, coalesce(nullif(difficulty, ''), 'recall') AS difficulty FROM (SELECT * FROM (VALUES (1, 'Two and two?', ['3', '4'], 'B', ''),
 (2, 'Capital?', ['A', 'B', 'C', 'D', 'E'], 'A', 'apply'), (3, 'Open', []::VARCHAR[], '', NULL), (4, 'Yes?', ['yes'], 'A', NULL)) AS v(id, question, o, correct, difficulty) UNION ALL SELECT -1 - (conv_id * 1000 + turn), role, """ + q.sentences("coalesce(text, '')") + """, 'A', NULL FROM conversations) WHERE len(o) > 0""")
def quiz_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("id"), "role", sentences(F.coalesce("text", F.lit(""))), F.lit("A"), F.lit(None).cast("string"))
    return D.quiz_rows(spark.createDataFrame(list(QUIZZES), "id long, question string, options array<string>, correct string, difficulty string").union(turns))


def _deck_slides(spark, sf_dir):
    return slides(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("deck"), "slide_no", "title", "bullets", F.col("body").alias("text"))


_DECK = f"{q.SLIDES}, s AS (SELECT doc_id AS deck, slide_no, title, bullets, body AS text FROM slides)"
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("cheat_sheets", rf"""WITH {_DECK}, t AS (SELECT deck, slide_no, bullets, trim(regexp_replace(title, '\s*\(\d+/\d+\)$', '')) AS t, list_transform(regexp_extract_all(array_to_string(bullets, ' '), {q.text(D.CHIPS)}), lambda c: trim(c)) AS c FROM s),
b AS (SELECT deck, slide_no, '<section><h2>' || {_ESC('t')} || '</h2><ul>' || array_to_string(list_transform(bullets[1:3], lambda b: '<li>' || {_ESC(f"substr({strip_end('b')}, 1, 170)")} || '</li>'), '') || '</ul>' ||
 array_to_string(list_transform(list_filter(c, lambda x, i: list_position(c, x) = i)[1:4], lambda x: '<span>' || {_ESC('x')} || '</span>'), '') || '</section>' AS block FROM t WHERE t <> '')
SELECT deck, md5(string_agg(block, '' ORDER BY slide_no)) AS sheet FROM b GROUP BY deck""")
def cheat_sheets(spark, sf_dir):
    return D.cheat_sheets(_deck_slides(spark, sf_dir)).select("deck", F.md5("html").alias("sheet"))


@query("deck_payloads", f"WITH {_DECK} SELECT deck, count(*) AS n, sum(slide_no)::BIGINT AS places, string_agg(md5(title || '|' || array_to_string(bullets, '|')), '' ORDER BY slide_no) AS bodies FROM s GROUP BY deck")
def deck_payloads(spark, sf_dir):
    kind = "array<struct<slide_no:long,title:string,bullets:array<string>>>"
    back = D.deck_payloads(_deck_slides(spark, sf_dir)).select("deck", F.from_json("payload", kind).alias("p"))
    add = F.aggregate(F.transform("p", lambda s: s["slide_no"]), F.lit(0).cast("long"), lambda a, x: a + x)
    bodies = F.array_join(F.transform("p", lambda s: F.md5(F.concat(s["title"], F.lit("|"), F.array_join(s["bullets"], "|")))), "")
    return back.select("deck", F.size("p").cast("long").alias("n"), add.alias("places"), bodies.alias("bodies"))


TITLES = ((1, "cell_biology-week_2.pptx", "# Other"), (2, "Untitled 3.pdf", "intro\n## Heading here\ntext"), (3, "document.docx", "no heading"), (4, "Typed Input", "### The lead\n# Two"), (5, "a--b__c", ""))
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(name, '\.[A-Za-z0-9]{1,5}$', ''), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("deck_titles", rf"""WITH t AS (SELECT id, {_PLAIN} AS plain, trim(regexp_extract(markdown, '(?m)^#{{1,6}}[ \t]+(\S.*)$', 1)) AS h FROM (SELECT id::BIGINT AS id, name, markdown FROM {values(TITLES, 'id, name, markdown')} UNION ALL SELECT -1 - doc_id, coalesce(source, 'document') || '_' || doc_id || '.pdf', coalesce(text, '') FROM documents))
SELECT id::BIGINT AS id, CASE WHEN regexp_matches(plain, '(?i)^(?:typed input|untitled|document|file|upload|presentation|slides?)?\s*\d*$') AND h <> '' THEN h ELSE plain END AS title FROM t""")
def deck_titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(-1 - F.col("doc_id"), F.concat(F.coalesce("source", F.lit("document")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")), F.coalesce("text", F.lit("")))
    return spark.createDataFrame(list(TITLES), "id long, name string, markdown string").union(docs).select("id", D.deck_title(F.col("name"), F.col("markdown")).alias("title"))


@query("recent_activity", f"""SELECT o_custkey AS user_id, coalesce(sum(CASE WHEN o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS THEN o_orderkey % 20 END), 0)::BIGINT AS recent_slides, sum(o_orderkey % 20)::BIGINT AS n_slides, sum(o_orderkey % 3)::BIGINT AS n_quizzes,
 round_even(avg(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100)::DOUBLE END), 4) AS mean_score FROM orders GROUP BY 1""")
def recent_activity(spark, sf_dir):
    decks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderkey") % 20).alias("n_slides"), (F.col("o_orderkey") % 3).alias("n_quizzes"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 100).cast("double")).alias("score"))
    return D.recent_activity(decks, NOW)


PROVIDERS = (("alpha", 1), ("beta", 2), ("gamma", 3), ("delta", 4))
PREFERRED = (("chat", "gamma", 1), ("chat", "alpha", 2), ("image", "delta", 1))


@query("provider_order", f"""WITH p AS {values(PROVIDERS, 'provider, ord')}, f AS {values(PREFERRED, 'task, provider, place')}, t AS (SELECT unnest(['chat', 'image', 'other']) AS task UNION SELECT event_type FROM events)
SELECT t.task, p.provider, (row_number() OVER (PARTITION BY t.task ORDER BY coalesce(f.place, 99), ord))::INT AS rank FROM t CROSS JOIN p LEFT JOIN f ON f.task = t.task AND f.provider = p.provider""")
def provider_order(spark, sf_dir):
    return D.provider_order(spark.createDataFrame(list(PROVIDERS), "provider string, ord int"), spark.createDataFrame([("chat",), ("image",), ("other",)], "task string").union(table(spark, sf_dir, "events").select("event_type")).distinct(), PREFERRED)


@query("evaluation", """WITH j AS (SELECT quality = 1 AS fit, doc_id % 10 <> 3 AS covered, toxic = 0 AS has_data, doc_id % 6 AS got FROM labels)
SELECT round_even(avg(fit::INT), 3) AS fit, round_even(avg(covered::INT), 3) AS covered, round_even(avg(has_data::INT), 3) AS data, round_even(avg((fit AND covered AND has_data)::INT), 3) AS strict, count(*) AS n, count(DISTINCT got) AS kinds FROM j""")
def evaluation(spark, sf_dir):
    return D.evaluation(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("fit"), (F.col("doc_id") % 10 != 3).alias("covered"), (F.col("toxic") == 0).alias("has_data"), (F.col("doc_id") % 6).alias("got")))


@query("read_once", "SELECT doc_id AS image_id, reverse(left(coalesce(text, ''), 5)) || length(coalesce(text, '')) AS made FROM documents")
def read_once(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return D.once_each(images, lambda c: F.concat(F.reverse(F.left(c.cast("string"), F.lit(5))), F.length(c.cast("string")).cast("string")))


TEMPLATES = (("OPEN", "open the {topic} deck", "topic"), ("OPEN", "show {topic}", "topic"), ("GOTO", "go to slide {n}", "n"), ("QUIZ", "quiz me on {topic}", "topic"))
SLOTS = tuple(("topic", w) for w in "algebra botany chemistry drama ecology".split()) + tuple(("n", str(k)) for k in range(1, 8))
GOLD = (("OPEN", "open the algebra deck"), ("HELP", "what can you do"))


@query("generated_questions", None)
def generated_questions(spark, sf_dir):
    slots = spark.createDataFrame(list(SLOTS), "slot string, value string").union(table(spark, sf_dir, "part").select(F.lit("topic"), F.lower("p_name")).distinct())
    return D.generated_questions(spark.createDataFrame(list(TEMPLATES), "intent string, template string, slot string"), slots, spark.createDataFrame(list(GOLD), "intent string, question string"))


_SQZ = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("first_takeaways", f"""WITH {_DECK}, t AS (SELECT deck, slide_no, coalesce(bullets[1], title) AS takeaway, bullets[2:] AS rest FROM s), n AS (SELECT *, {_SQZ('takeaway')} AS norm, {_SQZ("array_to_string(rest, ' ')")} AS body FROM t)
SELECT deck, slide_no, CASE WHEN norm <> '' AND row_number() OVER (PARTITION BY deck, norm ORDER BY slide_no) = 1 AND NOT contains(body, norm) THEN takeaway ELSE '' END AS takeaway FROM n""")
def first_takeaways(spark, sf_dir):
    rows = _deck_slides(spark, sf_dir).select("deck", "slide_no", F.coalesce(F.get("bullets", F.lit(0)), F.col("title")).alias("takeaway"), F.slice("bullets", 2, 1 << 20).alias("bullets"))
    return D.first_takeaways(rows)


@query("lost_facts", r"""WITH f AS (SELECT doc_id AS deck, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\d[\d.,]*\d'))) AS value FROM documents), t AS (SELECT doc_id AS deck, left(coalesce(text, ''), length(coalesce(text, '')) // 2) AS text FROM documents)
SELECT deck, 'figure' AS kind, value FROM f JOIN t USING (deck) WHERE NOT contains(regexp_replace(lower(text), '[\s,]+', '', 'g'), regexp_replace(lower(value), '[\s,]+', '', 'g'))""")
def lost_facts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("deck"), F.coalesce("text", F.lit("")).alias("text"))
    facts = docs.select("deck", F.lit("figure").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d[\d.,]*\d"), F.lit(0)))).alias("value"))
    return D.lost_facts(facts, docs.select("deck", F.left("text", F.expr("CAST(length(text) DIV 2 AS INT)")).alias("text")))


LABS = ((1, "<p>x</p><!-- lab: Sorting | sort, Bubble Sort -->"), (2, "<!-- other -->"), (3, "<!--lab: Waves|wave ,tide-->"), (4, "<!-- lab: Cells | cell -->"))
LAB_SLIDES = ((1, 1, "Bubble sort at work", "It swaps."), (1, 2, "Intro", "A sort is a sort."), (1, 3, "Tides", "The wave and the tide, wave by wave."), (1, 4, "None", "one cell only"), (2, 1, "Cells and waves", "cell cell"))
_LABS = rf"""labs AS (SELECT lab, regexp_extract(html, '(?s)<!--\s*lab:\s*([^|>]+?)\s*\|\s*(.*?)\s*-->', 1) AS title, list_filter(list_transform(string_split(lower(regexp_extract(html, '(?s)<!--\s*lab:\s*([^|>]+?)\s*\|\s*(.*?)\s*-->', 2)), ','), lambda t: trim(t)), lambda t: t <> '') AS topics
 FROM (SELECT lab::BIGINT AS lab, html FROM {values(LABS, 'lab, html')} UNION ALL SELECT 1000 + page_id, coalesce(html, '') || '<!-- lab: Page ' || page_id || ' | ' || regexp_extract(coalesce(url, ''), '([a-z]+)\.example', 1) || ' -->' FROM pages) WHERE regexp_matches(html, '(?s)<!--\s*lab:\s*([^|>]+?)\s*\|\s*(.*?)\s*-->'))"""


def _labs(spark, sf_dir):
    """The stated labs, and each page as one about its host's name."""
    mark = F.concat(F.coalesce("html", F.lit("")), F.lit("<!-- lab: Page "), F.col("page_id").cast("string"), F.lit(" | "), F.regexp_extract(F.coalesce("url", F.lit("")), r"([a-z]+)\.example", 1), F.lit(" -->"))
    return D.lab_records(spark.createDataFrame(list(LABS), "lab long, html string").union(table(spark, sf_dir, "pages").select(1000 + F.col("page_id"), mark)))


@query("lab_records", f"WITH {_LABS} SELECT lab::BIGINT AS lab, title, array_to_string(topics, ',') AS topics FROM labs")
def lab_records(spark, sf_dir):
    return _labs(spark, sf_dir).select("lab", "title", F.array_join("topics", ",").alias("topics"))


@query("labs_of_slides", f"""WITH {_LABS}, t AS (SELECT lab, unnest(topics) AS topic FROM labs), {q.SLIDES}, s AS (SELECT deck::BIGINT AS deck, slide_no::BIGINT AS slide_no, title, text FROM {values(LAB_SLIDES, 'deck, slide_no, title, text')} UNION ALL SELECT -1 - doc_id, slide_no, title, body FROM slides),
c AS (SELECT deck, slide_no, lab, CASE WHEN contains(lower(title), topic) THEN 2 WHEN (length(text) - length(replace(lower(text), topic, ''))) / length(topic)::DOUBLE >= 2 THEN 1 ELSE 0 END AS score FROM s, t)
SELECT deck::BIGINT AS deck, slide_no::BIGINT AS slide_no, lab::BIGINT AS lab, score FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY deck, slide_no ORDER BY score DESC, lab) = 1""")
def labs_of_slides(spark, sf_dir):
    decks = slides(table(spark, sf_dir, "documents")).select(-1 - F.col("doc_id"), "slide_no", "title", "body")
    return D.labs_of_slides(spark.createDataFrame(list(LAB_SLIDES), "deck long, slide_no long, title string, text string").union(decks), _labs(spark, sf_dir))


KEYWORDS = (
    ("book-open", "book read reading literature learn lesson textbook chapter study"), ("atom", "atom physics quantum particle molecule nuclear electron"), ("leaf", "plant leaf photosynthesis ecology environment nature"),
    ("cloud", "cloud weather rain storage network internet"), ("droplets", "water rain liquid ocean river"), ("zap", "electric power voltage current energy"), ("network", "network connection internet protocol node"),
)
ICON_TEXTS = ((1, "Rain water fills rivers and oceans; the river runs on"), (2, "Networks and protocols of the internet, networked nodes"), (3, "Reading books at school"), (4, "Electrons carry energy; electricity is powerful"), (5, "zz"))
_KEYWORD_ROWS = [(icon, k, w) for k, (icon, words) in enumerate(KEYWORDS) for w in words.split()]


@query("icons_for_texts", rf"""WITH t AS (SELECT id, unnest(list_transform(regexp_extract_all(lower(text), '[a-z][a-z\-]+'), lambda t: replace(t, '-', ''))) AS t FROM (SELECT id::BIGINT AS id, text FROM {values(ICON_TEXTS, 'id, text')} UNION ALL SELECT -1 - (conv_id * 1000 + turn), coalesce(text, '') FROM conversations)), k AS {values(_KEYWORD_ROWS, 'icon, ord, word')},
m AS (SELECT id, icon, ord, t, (count(*) // count(DISTINCT word)) AS times, max((t = word)::INT) AS same FROM t JOIN k ON length(t) >= 4 AND left(t, 2) = left(word, 2) AND (prefix(t, left(word, greatest(4, length(word) - 2)::INT)) OR prefix(word, left(t, greatest(4, length(t) - 2)::INT))) GROUP BY ALL),
s AS (SELECT id, icon, ord, sum(times * (5 + same)) AS score FROM m GROUP BY ALL) SELECT id::BIGINT AS id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, ord))::INT AS rank, icon, score::BIGINT AS score FROM s QUALIFY rank <= 4""")
def icons_for_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(-1 - (F.col("conv_id") * 1000 + F.col("turn")), F.coalesce("text", F.lit("")))
    return D.icons_for(spark.createDataFrame(list(ICON_TEXTS), "id long, text string").union(turns), spark.createDataFrame(_KEYWORD_ROWS, "icon string, ord int, word string"))


_LW = lambda x, n: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > {n}))"


@query("residual_notes", rf"""WITH {_DECK}, a AS (SELECT deck * 1000 + slide_no AS id, {_LW("title", 3)} AS shown, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda e: e <> '') AS ss FROM s),
u AS (SELECT id, shown, unnest(ss) AS sent, generate_subscripts(ss, 1) AS n FROM a), w AS (SELECT *, {_LW("sent", 3)} AS w FROM u)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY n))::INT AS pos, sent AS note FROM w WHERE len(w) > 0 AND len(list_intersect(w, shown)) < 0.6 * len(w) QUALIFY pos <= 4""")
def residual_notes(spark, sf_dir):
    return D.residual_notes(_deck_slides(spark, sf_dir).select((F.col("deck") * 1000 + F.col("slide_no")).alias("id"), "text", F.col("title").alias("data")))


@query("missing_items", f"""WITH {_DECK}, i AS (SELECT deck * 1000 + slide_no AS id, unnest(bullets) AS item, (generate_subscripts(bullets, 1) - 1)::INT AS pos, title || ' ' || coalesce(bullets[1], '') AS covered FROM s), w AS (SELECT *, {_LW("item", 2)} AS w, {_LW("covered", 2)} AS c FROM i)
SELECT id, pos, item FROM w WHERE len(w) > 0 AND len(list_intersect(w, c)) < greatest(1.0, len(w) * 0.6)""")
def missing_items(spark, sf_dir):
    rows = _deck_slides(spark, sf_dir).select((F.col("deck") * 1000 + F.col("slide_no")).alias("id"), F.posexplode("bullets").alias("pos", "item"), F.concat("title", F.lit(" "), F.coalesce(F.get("bullets", F.lit(0)), F.lit(""))).alias("covered"))
    return D.missing_items(rows)


@query("filtered_decks", "SELECT c_custkey AS deck_id, c_name AS title, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey))::INT AS place FROM customer WHERE contains(lower(c_name), '00001')")
def filtered_decks(spark, sf_dir):
    decks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deck_id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("n_slides"))
    return D.filtered_decks(decks, " 00001 ", "slides")
