"""Queries of ``operators.shapes``: over small stated fixtures where the corpus has no such text, over pages and documents else."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import shapes as S
from deckloom.plans import sqltext as q
from deckloom.sources.tables import slides, table

QUERIES, ORACLE = {}, {}

TEXTS = (
    (1, "Plans compared", "Intro line\n| Plan | Price |\n| --- | --- |\n| Basic | 5 |\n| Team | 20 | extra |\nAfter"),
    (2, "Loose pipes", "| a | b |\nno table here\n| c | d |"),
    (3, "Energy sources", "Coal gives 40 percent. Gas gives 35 percent. Wind gives 25% of the total."),
    (4, "A short history", "In 1969 people landed on the moon. The web began in 1991 at a laboratory. In 2007 phones changed again."),
    (5, "Roles", "Planner: decides what is built first\nBuilder: makes the parts that were planned\nTester: tries to break what was built"),
    (6, "Cats and dogs", "Both are kept at home. Only cats climb trees. Only dogs fetch sticks."),
    (7, "The water cycle", "Water evaporates from the sea. Clouds form in cold air. Rain falls on land."),
    (8, "Why prices rise", "Demand grows in spring. This leads to shortages. As a result prices rise again."),
    (9, "How to make tea", "Boil fresh water. Warm the pot. Add the leaves. Pour and wait."),
    (10, "Birds", "Birds have feathers. Many can fly."),
)
BULLETS = (
    (1, "- **Bold** claim with `code`"),
    (2, "## Heading text"),
    (3, "3) third of all"),
    (4, "Step 2: mix *well* and stir"),
    (5, "a 3*4 product stays"),
    (6, "one __under__ two  spaces"),
    (7, "A sentence that is quite a bit longer than forty characters in all"),
)
PROBLEMS = (
    (1, "Solve 3x + 5 = 20"),
    (2, "Solve 2x - 4 = x + 6"),
    (3, "What is 15% of 240?"),
    (4, "Find the simple interest on $1,000 at 5% for 3 years."),
    (5, "Find the compound interest on $2000 at 10% for 2 years."),
    (6, "How far does a car go at 60 km/h in 2.5 hours?"),
    (7, "Name three rivers."),
    (8, "Solve -x + 1.5 = 4"),
)
COLOURS = (("#000000", "#ffffff"), ("#1a73e8", "#ffffff"), ("#777777", "#888888"))


def _values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q.text(v).replace("\n", "' || chr(10) || '") for v in r) + ")" for r in rows) + f") AS v({names}))"


def order_tables(spark, sf_dir):
    """(id, text): each customer's orders as a table of pipes, under negative ids."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda o: F.concat(F.lit("| "), o["o_orderkey"].cast("string"), F.lit(" | "), o["o_orderstatus"], F.lit(" |")))
    made = table(spark, sf_dir, "orders").groupBy((-1 - F.col("o_custkey")).alias("id")).agg(F.array_join(lines, "\n").alias("text"))
    return made.select("id", F.concat(F.lit("Orders\n| Order | Status |\n| --- | --- |\n"), "text").alias("text"))


ORDER_TABLES_SQL = "SELECT -1 - o_custkey AS id, 'Orders' || chr(10) || '| Order | Status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1"
QUERIES["table_cells"] = lambda spark, sf_dir: S.table_cells(spark.createDataFrame([(i, t) for i, _, t in TEXTS], "id long, text string").union(order_tables(spark, sf_dir)))
ORACLE["table_cells"] = r"""WITH t AS FIXTURE,
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
p AS (SELECT *, regexp_matches(trim(line), '^\|.*\|$') AS piped FROM l),
f AS (SELECT id, min(n) FILTER (piped) AS first_n, count(*) FILTER (piped) AS k FROM p GROUP BY id),
r AS (SELECT p.id, p.n, line FROM p JOIN f USING (id) WHERE piped AND k >= 3 AND n >= first_n AND NOT EXISTS (SELECT 1 FROM p b WHERE b.id = p.id AND NOT b.piped AND b.n > first_n AND b.n < p.n)),
c AS (SELECT id, n, list_transform(string_split(regexp_replace(trim(line), '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(x)) AS cells FROM r),
m AS (SELECT *, len(list_filter(cells, lambda x: x <> '' AND NOT regexp_matches(x, '^:?-{2,}:?$'))) = 0 AS marks FROM c),
g AS (SELECT id, max(len(cells)) FILTER (NOT marks) AS w FROM m GROUP BY id HAVING count(*) FILTER (marks) > 0 AND count(*) FILTER (NOT marks) >= 2),
o AS (SELECT m.id, row_number() OVER (PARTITION BY m.id ORDER BY n) - 1 AS row_no, cells, w FROM m JOIN g USING (id) WHERE NOT marks)
SELECT id::BIGINT AS id, row_no, j AS col_no, coalesce(cells[j + 1], '') AS cell FROM (SELECT *, unnest(range(w)) AS j FROM o)""".replace("FIXTURE", f"(SELECT id::BIGINT AS id, text FROM {_values([(i, t) for i, _, t in TEXTS], 'id, text')} UNION ALL {ORDER_TABLES_SQL})")

QUERIES["slide_families"] = lambda spark, sf_dir: S.families(spark.createDataFrame(list(TEXTS), "id long, title string, text string"))
# the shapes of the stated texts, worked out by hand
ORACLE["slide_families"] = """SELECT id::BIGINT AS id, family, variant, confidence::DOUBLE AS confidence, size::BIGINT AS size FROM (VALUES
(1, 'COMPARE_TABLE', 'table', 0.95, 2), (2, 'KEY_POINTS', 'grid', 0.55, 3), (3, 'CHART_PART_TO_WHOLE', 'pie', 0.9, 3), (4, 'TIMELINE', 'dated', 0.9, 3), (5, 'LIST_STRUCTURED', 'cards', 0.86, 3),
(6, 'SET_DIAGRAM', 'venn2', 0.84, 3), (7, 'PROCESS_CYCLIC', 'cycle', 0.8, 3), (8, 'CAUSE_EFFECT', 'loop', 0.76, 3), (9, 'PROCESS_LINEAR', 'flowchart', 0.7, 4), (10, 'KEY_POINTS', 'grid', 0.55, 2)) AS v(id, family, variant, confidence, size)"""

def _bullets(spark, sf_dir):
    """The stated bullets, and those of all documents under negative ids."""
    own = slides(table(spark, sf_dir, "documents")).select("doc_id", "slide_no", F.posexplode("bullets").alias("i", "text"))
    return spark.createDataFrame(list(BULLETS), "id long, text string").union(own.select(-1 - ((F.col("doc_id") * 10000 + F.col("slide_no")) * 1000 + F.col("i")), "text"))


QUERIES["clean_bullets"] = lambda spark, sf_dir: _bullets(spark, sf_dir).select("id", S.clean_bullet(F.col("text")).alias("clean"), S.truncated(S.clean_bullet(F.col("text")), 40).alias("short"))
_CLEAN = "text"
for _pattern, _by in ((r"^\s*#{1,6}\s*", ""), (r"(?i)^\s*(?:[-*+•]|\d+[.)]|step\s*\d+\s*[:.\-])\s*", ""), (r"(?s)\*\*(.+?)\*\*", r"\1"), (r"(?s)__(.+?)__", r"\1"), (r"`([^`]+)`", r"\1"), (r"\*\*|__", ""), (r"\\+(\s|$)", " "), (r"(^|[^\w*_])[*_]+", r"\1"), (r"[*_]+([^\w*_]|$)", r"\1"), (r"\s+", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, {q.text(_pattern)}, {q.text(_by)}, 'g')"
ORACLE["clean_bullets"] = rf"""WITH {q.SLIDES}, b AS (SELECT id::BIGINT AS id, text FROM {_values(BULLETS, 'id, text')} UNION ALL SELECT -1 - ((doc_id * 10000 + slide_no) * 1000 + i), text FROM (SELECT doc_id, slide_no, unnest(bullets) AS text, generate_subscripts(bullets, 1) - 1 AS i FROM slides)),
c AS (SELECT id, trim({_CLEAN}) AS clean FROM b), k AS (SELECT id, clean, left(clean, 40) AS cut FROM c), p AS (SELECT *, CASE WHEN contains(cut, ' ') THEN length(cut) - instr(reverse(cut), ' ') ELSE 0 END AS place FROM k)
SELECT id, clean, CASE WHEN length(clean) <= 40 THEN clean ELSE regexp_replace(CASE WHEN place > 24 THEN left(cut, place) ELSE cut END, '[ ,;:—–.]+$', '') || '…' END AS short FROM p"""

QUERIES["solved_problems"] = lambda spark, sf_dir: S.solved(spark.createDataFrame(list(PROBLEMS), "id long, text string"))
ORACLE["solved_problems"] = """SELECT id::BIGINT AS id, kind, answer::DOUBLE AS answer FROM (VALUES (1, 'linear', 5.0), (2, 'linear', 10.0), (3, 'percent', 36.0), (4, 'interest', 150.0), (5, 'interest', 420.0),
(6, 'speed', 150.0), (7, 'unknown', NULL), (8, 'linear', -2.5)) AS v(id, kind, answer)"""

def _colours(spark, sf_dir):
    """The stated pairs of colours, and one from the digests of each part's key and name."""
    of = lambda c: F.concat(F.lit("#"), F.substring(F.md5(F.col(c).cast("string")), 1, 6))
    return spark.createDataFrame(list(COLOURS), "a string, b string").union(table(spark, sf_dir, "part").select(of("p_partkey"), of("p_name")))


QUERIES["colour_contrast"] = lambda spark, sf_dir: _colours(spark, sf_dir).select("a", "b", F.bround(S.contrast(F.col("a"), F.col("b")), 2).alias("ratio"), (S.contrast(F.col("a"), F.col("b")) >= 4.5).alias("passes"))


def _lum(x: str) -> str:
    linear = lambda at: f"(SELECT CASE WHEN c <= 0.04045::DOUBLE THEN c / 12.92::DOUBLE ELSE pow((c + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END FROM (SELECT ('0x' || substr({x}, {at}, 2))::INT / 255.0::DOUBLE AS c))"
    return f"(0.2126::DOUBLE * {linear(2)} + 0.7152::DOUBLE * {linear(4)} + 0.0722::DOUBLE * {linear(6)})"


ORACLE["colour_contrast"] = f"""WITH p AS (SELECT a, b FROM {_values(COLOURS, 'a, b')} UNION ALL SELECT '#' || left(md5(p_partkey::VARCHAR), 6), '#' || left(md5(p_name), 6) FROM part), l AS (SELECT a, b, {_lum('a')} AS x, {_lum('b')} AS y FROM p),
r AS (SELECT a, b, (greatest(x, y) + 0.05::DOUBLE) / (least(x, y) + 0.05::DOUBLE) AS r FROM l) SELECT a, b, round_even(r, 2) AS ratio, r >= 4.5::DOUBLE AS passes FROM r"""

QUERIES["page_sections"] = lambda spark, sf_dir: S.page_sections(table(spark, sf_dir, "pages"))
ORACLE["page_sections"] = r"""WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>|<footer.*?</footer>', ' ', 'g') AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')) AS title, len(regexp_extract_all(h, '(?i)<p[ >]')) AS n_paragraphs, len(regexp_extract_all(h, '(?i)<li[ >]')) AS n_items,
  len(regexp_extract_all(h, '(?i)<a ')) AS n_links, length(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM h"""

QUERIES["slide_shapes"] = lambda spark, sf_dir: S.families(slides(table(spark, sf_dir, "documents")).select(F.concat_ws("-", "doc_id", "slide_no").alias("id"), "title", F.col("body").alias("text"))).groupBy("family", "variant").agg(F.count(F.lit(1)).alias("n"))
