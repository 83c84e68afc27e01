"""Records around decks: catalogues, palettes, shares, sessions, labs, exports, saved versions, evaluation and small joins."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import strip_end

# Words by which a topic falls into a palette's category, and names that say nothing.
TOPIC_CATEGORY = (
    ("biology health medical nature environment ecology agri chemistry geography", "Nature"),
    ("history literature art culture humanities philosophy language architecture", "Warm"),
    ("computer software data machine ai network programming algorithm cyber robot electronics physics", "Tech"),
    ("business finance management economics marketing accounting law policy report", "Corporate"),
    ("kids school primary creative festival event sport game", "Vivid"),
    ("psychology wellness design fashion lifestyle education", "Soft"),
)
CHIPS = r"\bO\([^)]+\)|[$₹€£]?\d[\d,.]*\s?(?:%|percent|million|billion|kJ|kg|km|m|s)\b"
SHARE_DAYS, KEEP_COPIES = 30, 14


def listed_entries(entries: DataFrame, subject: str = "", category: str = "", query: str = "", ready_only: bool = False) -> DataFrame:
    """Catalogue entries of a subject and category whose title, subject or a tag holds the query."""
    q, kept = query.strip().lower(), entries
    if subject:
        kept = kept.where(F.col("subject") == subject)
    if category:
        kept = kept.where(F.col("category") == category)
    if ready_only:
        kept = kept.where("status = 'outline'")
    if q:
        kept = kept.where(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("subject"), F.lit(q)) | F.exists("tags", lambda t: F.contains(t, F.lit(q))))
    return kept


def found_palettes(palettes: DataFrame, query: str = "", category: str = "", mode: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """Palettes of a category and mode with every word of the query in a tag or the name, in id order from ``offset``."""
    kept = palettes
    if category:
        kept = kept.where(F.lower("category") == category.lower())
    if mode:
        kept = kept.where(F.col("mode") == mode.lower())
    for word in query.lower().split():
        kept = kept.where(_has_word(word))
    kept = kept.orderBy("id")
    kept = kept.offset(offset) if offset else kept
    return kept.limit(limit) if limit else kept


def _has_word(word: str) -> Column:
    return F.contains(F.lower("name"), F.lit(word)) | F.exists("tags", lambda t: F.contains(t, F.lit(word)))


def topic_category(topic: Column) -> Column:
    found = F.lit("")
    for words, name in reversed(TOPIC_CATEGORY):
        found = F.when(F.lower(topic).rlike(r"\b(?:" + "|".join(words.split()) + ")"), name).otherwise(found)
    return found


def picked_palettes(topics: DataFrame, palettes: DataFrame, mode: str = "light") -> DataFrame:
    """(topic, category, palette): always the same palette for a topic, of its category if it has one: the sum of code points times places, modulo
    the pool's size, in id order. Pools are some hundred palettes: numbered by category, and once more all together."""
    pool = palettes.where(F.col("mode") == mode)
    pools = pool.select("category", "id").union(pool.select(F.lit("").alias("category"), "id"))
    numbered = pools.select("category", "id", (F.row_number().over(Window.partitionBy("category").orderBy("id")) - 1).alias("place"))
    sizes = pools.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    key = F.aggregate(F.transform(F.filter(F.split("topic", ""), lambda c: c != ""), lambda c, i: F.ascii(c).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    asked = topics.select("topic", topic_category(F.col("topic")).alias("category"), key.alias("k")).join(F.broadcast(sizes), "category")
    return asked.withColumn("place", F.col("k") % F.col("n")).join(numbered, ["category", "place"]).select("topic", "category", F.col("id").alias("palette"))


def live_shares(shares: DataFrame, now: str) -> DataFrame:
    """Shares that are not revoked and not over; without an end they live on."""
    return shares.where(~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp"))))


def with_views(shares: DataFrame, visits: DataFrame, now: str) -> DataFrame:
    """(token, views) of live shares: their views and those of ``visits`` (token). Visits are counted before they meet the shares."""
    counted = visits.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return live_shares(shares, now).join(counted, "token", "left").select("token", (F.col("views") + F.coalesce("n", F.lit(0))).alias("views"))


def shares_of_deck(shares: DataFrame, most: int = 1 << 30) -> DataFrame:
    """Each deck's shares, newest first by ``rank``."""
    rank = F.row_number().over(Window.partitionBy("user_id", "deck_id").orderBy(F.desc("created_at"), "token"))
    return shares.withColumn("rank", rank).where(F.col("rank") <= most)


def session_users(requests: DataFrame, sessions: DataFrame, now: str) -> DataFrame:
    """(request_id, user_id) of requests whose token's hash is a session that is not over; else a null user."""
    live = sessions.where(F.col("expires_at") > F.lit(now).cast("timestamp")).select("token_hash", "user_id")
    return requests.select("request_id", F.sha2(F.coalesce("token", F.lit("")), 256).alias("token_hash")).join(live, "token_hash", "left").select("request_id", "user_id")


def error_rows(errors: DataFrame) -> DataFrame:
    """Errors as they are logged: source, message, stack and path cut to 30, 1,000, 4,000 and 200 characters."""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("client"))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return errors.select("id", cut(source, 30).alias("source"), cut(F.col("message"), 1000).alias("message"), cut(F.col("stack"), 4000).alias("stack"), cut(F.col("path"), 200).alias("path"))


def saved_edits(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """Versions (deck_id, version, body) with each edited deck's new body appended under the next number: nothing is overwritten. A deck without
    versions begins at 1; edits of one deck follow each other by ``edit_no``."""
    top = versions.groupBy("deck_id").agg(F.max("version").alias("top"))
    place = F.row_number().over(Window.partitionBy("deck_id").orderBy("edit_no"))
    fresh = edits.withColumn("place", place).join(top, "deck_id", "left")
    return versions.unionByName(fresh.select("deck_id", (F.coalesce("top", F.lit(0)) + F.col("place")).cast("int").alias("version"), "body"))


def kept_copies(copies: DataFrame, keep: int = KEEP_COPIES) -> DataFrame:
    """Each store's newest ``keep`` backups."""
    rank = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("made_at"), F.desc("copy_id")))
    return copies.withColumn("rank", rank).where(F.col("rank") <= keep)


def quiz_rows(quizzes: DataFrame) -> DataFrame:
    """Questions as rows of an export: four options, missing ones empty, difficulty 'recall' where none is given."""
    options = F.slice(F.concat("options", F.array_repeat(F.lit(""), 4)), 1, 4)
    picks = [F.get(options, F.lit(k)).alias(name) for k, name in enumerate("ABCD")]
    return quizzes.where(F.size("options") > 0).select("id", "question", *picks, "correct", F.coalesce(F.nullif(F.col("difficulty"), F.lit("")), F.lit("recall")).alias("difficulty"))


def cheat_sheets(slides: DataFrame) -> DataFrame:
    """(deck, html): a sheet a deck: a section a slide in order, with three bullets and up to four figures."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.trim(F.regexp_replace("title", r"\s*\(\d+/\d+\)$", ""))
    chips = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.array_join("bullets", " "), F.lit(CHIPS), F.lit(0)), lambda c: F.trim(c))), 1, 4)
    items = F.array_join(F.transform(F.slice("bullets", 1, 3), lambda b: F.concat(F.lit("<li>"), escaped(F.substring(strip_end(b), 1, 170)), F.lit("</li>"))), "")
    marks = F.array_join(F.transform(chips, lambda c: F.concat(F.lit("<span>"), escaped(c), F.lit("</span>"))), "")
    rows = slides.where(title != "").select("deck", "slide_no", F.concat(F.lit("<section><h2>"), escaped(title), F.lit("</h2><ul>"), items, F.lit("</ul>"), marks, F.lit("</section>")).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("slide_no", "block"))), lambda s: s["block"])
    return rows.groupBy("deck").agg(F.array_join(blocks, "").alias("html"))


def deck_payloads(slides: DataFrame) -> DataFrame:
    """(deck, payload): a deck's slides as one JSON text."""
    body = F.array_sort(F.collect_list(F.struct("slide_no", "title", "bullets")))
    return slides.groupBy("deck").agg(F.to_json(body).alias("payload"))


def deck_title(name: Column, markdown: Column) -> Column:
    """From a file's name without suffix and marks, or from the first heading where the name says nothing."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\-]+", " "), r"\s+", " "))
    heading = F.trim(F.regexp_extract(markdown, r"(?m)^#{1,6}[ \t]+(\S.*)$", 1))
    vague = plain.rlike(r"(?i)^(?:typed input|untitled|document|file|upload|presentation|slides?)?\s*\d*$")
    return F.when(vague & (heading != ""), heading).otherwise(plain)


def recent_activity(decks: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Per user: slides of decks made in the last days, all slides and quizzes, and the mean of scores that exist."""
    recent = F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return decks.groupBy("user_id").agg(F.coalesce(F.sum(F.when(recent, F.col("n_slides"))), F.lit(0)).alias("recent_slides"), F.sum("n_slides").alias("n_slides"), F.sum("n_quizzes").alias("n_quizzes"), F.bround(F.avg("score"), 4).alias("mean_score"))


def provider_order(providers: DataFrame, tasks: DataFrame, preferences: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(task, provider, rank): providers by a task's preference, the others after them in their own order."""
    spark = providers.sparkSession
    wanted = spark.createDataFrame(list(preferences), "task string, provider string, place int")
    rows = tasks.join(F.broadcast(providers)).join(F.broadcast(wanted), ["task", "provider"], "left")
    order = Window.partitionBy("task").orderBy(F.coalesce("place", F.lit(99)), "ord")
    return rows.select("task", "provider", F.row_number().over(order).alias("rank"))


def evaluation(judged: DataFrame) -> DataFrame:
    """One row: shares of cases that fit, are covered, have data and are all three, how many there are and how many kinds they got."""
    share = lambda c: F.bround(F.avg(c.cast("int")), 3)
    fit, covered, data = F.col("fit"), F.col("covered"), F.col("has_data")
    return judged.agg(share(fit).alias("fit"), share(covered).alias("covered"), share(data).alias("data"), share(fit & covered & data).alias("strict"), F.count(F.lit(1)).alias("n"), F.count_distinct("got").alias("kinds"))


def once_each(images: DataFrame, read) -> DataFrame:
    """``images`` (image_id, content) with what ``read`` (content column to column) makes of each distinct content: worked out once a digest, then given
    back by it."""
    rows = images.select("image_id", F.sha2("content", 256).alias("digest"), "content")
    made = rows.groupBy("digest").agg(F.any_value("content").alias("content")).select("digest", read(F.col("content")).alias("made"))
    return rows.select("image_id", "digest").join(made, "digest").select("image_id", "made")


def generated_questions(templates: DataFrame, slots: DataFrame, gold: DataFrame, share: int = 3) -> DataFrame:
    """Templates with each slot value put in, one of ``share`` by a hash of both, and the gold rows; each question once."""
    crossed = templates.join(F.broadcast(slots), "slot").where(F.pmod(F.crc32(F.concat("template", F.lit("|"), "value").cast("binary")), F.lit(share)) == 0)
    made = crossed.select("intent", F.replace(F.col("template"), F.concat(F.lit("{"), F.col("slot"), F.lit("}")), F.col("value")).alias("question"), F.lit("generated").alias("origin"))
    every = made.unionByName(gold.select("intent", "question", F.lit("gold").alias("origin")))
    return every.groupBy("question").agg(F.max_by("intent", F.struct("origin", "intent")).alias("intent"), F.max("origin").alias("origin"))


def first_takeaways(slides: DataFrame) -> DataFrame:
    """(deck, slide_no, takeaway): only a deck's first of equal takeaways stays, and none that its slide's bullets hold."""
    norm = F.trim(F.regexp_replace(F.lower("takeaway"), "[^a-z0-9]+", " "))
    body = F.trim(F.regexp_replace(F.lower(F.array_join("bullets", " ")), "[^a-z0-9]+", " "))
    rows = slides.select("deck", "slide_no", "takeaway", norm.alias("norm"), body.alias("body"))
    first = F.row_number().over(Window.partitionBy("deck", "norm").orderBy("slide_no"))
    keep = (F.col("norm") != "") & (first == 1) & ~F.contains("body", F.col("norm"))
    return rows.select("deck", "slide_no", F.when(keep, F.col("takeaway")).otherwise("").alias("takeaway"))


def lost_facts(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Facts (deck, kind, value) that their deck's text (deck, text) doesn't hold, without regard to case, spaces and commas."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[\s,]+", "")
    return facts.join(texts, "deck").where(~F.contains(squeeze(F.col("text")), squeeze(F.col("value")))).select("deck", "kind", "value")


#: Topics of so many characters at most go to all tasks as one automaton.
TOPIC_CHARS = 4 << 20


def labs_of_slides(slides: DataFrame, labs: DataFrame) -> DataFrame:
    """(deck, slide_no, lab): the first lab with the highest score: 2 for a topic in the title, 1 for two or more mentions in the text.

    An automaton of all topics reads each slide once, if the topics are counted to fit in ``TOPIC_CHARS``; else a topic is met by its first three letters among those that a
    slide holds anywhere (topics of under three letters by their first). So slides and topics are never paired.
    """
    topics = labs.select("lab", F.explode("topics").alias("topic")).where("topic <> ''").groupBy("topic").agg(F.min("lab").alias("lab"))
    rows = slides.select("deck", "slide_no", F.lower("title").alias("title"), F.lower("text").alias("text"))
    size = topics.agg(F.coalesce(F.sum(F.length("topic")), F.lit(0))).first()[0]
    scored = _by_automaton(rows, topics) if size <= TOPIC_CHARS else _by_grams(rows, topics)
    best = scored.groupBy("deck", "slide_no").agg(F.max(F.struct("score", (-F.col("lab")).alias("back"))).alias("top"))
    return best.select("deck", "slide_no", (-F.col("top.back")).alias("lab"), F.col("top.score").alias("score"))


def _by_automaton(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """(deck, slide_no, lab, score) of the topics that each slide holds."""
    found = [(r["topic"], r["lab"]) for r in topics.collect()]  # at most ``TOPIC_CHARS`` characters
    shared = rows.sparkSession.sparkContext.broadcast(found)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("deck", "slide_no")}

    def run(batches):
        import ahocorasick

        known = ahocorasick.Automaton()
        for topic, lab in shared.value:
            known.add_word(topic, (topic, lab))
        if shared.value:
            known.make_automaton()
        for batch in batches:
            at, labs, scores = [], [], []
            for i, (title, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if shared.value else ()):
                for topic, lab in {v for _, v in known.iter(f"{title or ''}\n{text or ''}")}:
                    score = 2 if topic in (title or "") else 1 if (text or "").count(topic) >= 2 else 0
                    if score:
                        at.append(i)
                        labs.append(lab)
                        scores.append(score)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labs, pa.int64()), pa.array(scores, pa.int32())], names=["deck", "slide_no", "lab", "score"])

    return rows.mapInArrow(run, f"deck {kinds['deck']}, slide_no {kinds['slide_no']}, lab long, score int")


def _by_grams(rows: DataFrame, topics: DataFrame) -> DataFrame:
    topics = topics.withColumn("gram", F.when(F.length("topic") >= 3, F.substring("topic", 1, 3)).otherwise(F.substring("topic", 1, 1)))
    whole = F.concat("title", F.lit("\n"), "text")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.array(F.substring(whole, i, F.lit(1)), F.substring(whole, i, F.lit(3))))))
    met = rows.withColumn("gram", F.explode(grams)).join(topics, "gram")
    times = (F.length("text") - F.length(F.replace(F.col("text"), F.col("topic"), F.lit("")))) / F.length("topic")
    score = F.when(F.contains("title", F.col("topic")), 2).when(times >= 2, 1).otherwise(0)
    return met.withColumn("score", score).where("score > 0").select("deck", "slide_no", "lab", "score")


def lab_records(pages: DataFrame) -> DataFrame:
    """(lab, title, topics) of HTML texts with a comment ``<!-- lab: title | topic, topic -->``."""
    pattern = r"(?s)<!--\s*lab:\s*([^|>]+?)\s*\|\s*(.*?)\s*-->"
    topics = F.filter(F.transform(F.split(F.lower(F.regexp_extract("html", pattern, 2)), ","), lambda t: F.trim(t)), lambda t: t != "")
    return pages.where(F.col("html").rlike(pattern)).select("lab", F.regexp_extract("html", pattern, 1).alias("title"), topics.alias("topics"))


def icons_for(texts: DataFrame, keywords: DataFrame, most: int = 4) -> DataFrame:
    """(id, rank, icon): icons by how many tokens of a text share a beginning with one of their keywords, a fifth more where equal. Tokens meet keywords
    by their first two letters, so only a fraction is compared; keywords are some hundreds."""
    tokens = texts.select("id", F.posexplode(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda t: F.replace(t, F.lit("-"), F.lit("")))).alias("pos", "t"))
    counted = tokens.where(F.length("t") >= 4).groupBy("id", "t").agg(F.count(F.lit(1)).alias("times"))
    words = keywords.select("icon", "ord", "word", F.substring("word", 1, 2).alias("two"))
    met = counted.withColumn("two", F.substring("t", 1, 2)).join(F.broadcast(words), "two")
    head = lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2))
    met = met.where(F.startswith("t", head(F.col("word"))) | F.startswith("word", head(F.col("t"))))
    each = met.groupBy("id", "icon", "ord", "t", "times").agg(F.max((F.col("t") == F.col("word")).cast("int")).alias("same"))
    score = each.groupBy("id", "icon", "ord").agg(F.sum(F.col("times") * (5 + F.col("same"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ord"))
    return score.select("id", rank.alias("rank"), "icon", "score").where(F.col("rank") <= most)


def residual_notes(slides: DataFrame, most: int = 4, share: float = 0.6) -> DataFrame:
    """(id, pos, note): the first ``most`` sentences of a slide's text of whose longer words less than ``share`` are in its visual's data."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 3))
    rows = slides.select("id", words(F.col("data")).alias("shown"), F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: s != "")).alias("n", "sent"))
    rows = rows.withColumn("w", words(F.col("sent"))).where((F.size("w") > 0) & (F.size(F.array_intersect("w", "shown")) < share * F.size("w")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return rows.select("id", rank.alias("pos"), F.col("sent").alias("note")).where(F.col("pos") <= most)


def missing_items(items: DataFrame) -> DataFrame:
    """Items (id, pos, item, covered) of whose words of three letters or more fewer than 60 % (at least one) are in the covered text."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))
    rows = items.select("id", "pos", "item", words(F.col("item")).alias("w"), words(F.col("covered")).alias("c"))
    return rows.where((F.size("w") > 0) & (F.size(F.array_intersect("w", "c")) < F.greatest(F.lit(1.0), F.size("w") * 0.6))).select("id", "pos", "item")


def filtered_decks(decks: DataFrame, query: str, order: str) -> DataFrame:
    """Decks whose title holds the query, by 'title', 'slides' or 'newest'."""
    kept = decks.where(F.contains(F.lower("title"), F.lit(query.strip().lower())))
    by = {"title": [F.lower("title")], "slides": [F.desc("n_slides")], "newest": [F.desc("created_at")]}[order]
    return kept.select("deck_id", "title", F.row_number().over(Window.orderBy(*by, "deck_id")).alias("place"))  # one person's decks
