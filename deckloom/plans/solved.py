"""Queries of ``operators.problems`` over stated problems, and their SQL: one closed form a kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import problems as S
from deckloom.plans import sqltext as q
from deckloom.plans.phrased import ends, values
from deckloom.functions.text import sentences
from deckloom.sources.tables import table

QUERIES, ORACLE = {}, {}

PROBLEMS = (
    (1, "Solve 3x + 5 = 20"), (2, "Solve 2x - 4 = x + 6"), (3, "What is 15% of 240?"), (4, "Find the simple interest on $1,000 at 5% for 3 years."), (5, "Find the compound interest on $2000 at 10% for 2 years."),
    (6, "A car goes 150 km in 2.5 hours. How fast is it?"), (7, "Name three rivers."), (8, "Solve -x + 1.5 = 4"), (9, "Solve x^2 - 5x + 6 = 0"), (10, "x^2 + 2x + 5 = 0"), (11, "Solve 2x^2 = 8"), (12, "x^2 - 4x + 4 = 0"),
    (13, "2x + 3y = 12 and x - y = 1"), (14, "x + y = 10\nx - y = 4"), (15, "Increase 80 by 15%"), (16, "A discount of 20% on a $250 coat"), (17, "The price of 300 will decrease by 10%"),
    (18, "A bag has 3 red and 5 blue balls. What is the probability of drawing a red one?"), (19, "P(A) = 0.3 and P(B|A) = 0.5 and P(B) = 0.25, find P(A|B)?"), (20, "Differentiate 3x^2 + 2x - 7"), (21, "Find the integral of 6x^2 + 4x"),
    (22, "A right-angled triangle has sides 3 and 4"), (23, "Area of a circle with radius 2"), (24, "Circumference of a circle of radius 5"), (25, "The area of a room of 4 by 6.5 m"), (26, "Integrate x dx"), (27, "derivative of 5"),
    (28, "What chance is there? 4 cats, 4 dogs and 2 dogs"), (29, "Read this. Solve 4x = 10. Then rest."), (30, "Runner: 100 m in 12.5 s, what speed"),
)
#: The stated problems, and all turns of conversations under negative ids.
_P = f"(SELECT id::BIGINT AS id, text FROM {values(PROBLEMS, 'id, text')} UNION ALL SELECT -1 - (conv_id * 1000 + turn), coalesce(text, '') FROM conversations)"
GRAMMAR = (("S", "NP", "VP"), ("NP", "DET", "N"), ("VP", "V", "NP"), ("VP", "V", "PP"), ("PP", "P", "NP"), ("NP", "NP", "PP"), ("DET", "the", None), ("DET", "a", None), ("N", "dog", None), ("N", "cat", None), ("N", "park", None), ("V", "sees", None), ("P", "in", None), ("NP", "birds", None), ("P", "of", None), ("P", "to", None), ("V", "is", None), ("N", "that", None), ("NP", "it", None))
PARSED = ((1, "the dog sees a cat"), (2, "the dog sees a cat in"), (3, "sees dog the"), (4, "birds sees a cat in"), (5, "a dog sees birds in the park"), (6, "unknown words"))


def problems(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("id"), F.coalesce("text", F.lit("")))
    return spark.createDataFrame(list(PROBLEMS), "id long, text string").union(turns)


QUERIES["explained_problems"] = lambda spark, sf_dir: S.explained(problems(spark, sf_dir))
QUERIES["problem_answers"] = lambda spark, sf_dir: problems(spark, sf_dir).select("id", F.explode(F.array(*[f(F.col("text")) for f in S.SOLVERS])).alias("s")).where("s IS NOT NULL").select("id", "s.kind", "s.answer")
QUERIES["problem_candidates"] = lambda spark, sf_dir: S.candidates(problems(spark, sf_dir))
def _sentences(spark, sf_dir):
    """The stated sentences, and all of conversations under negative ids; the parser takes those of up to seven words."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("i", "text"))
    return spark.createDataFrame(list(PARSED), "id long, text string").union(turns.select(-1 - ((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("i")), "text"))


QUERIES["parse_chart"] = lambda spark, sf_dir: S.parsed(_sentences(spark, sf_dir), spark.createDataFrame(list(GRAMMAR), "lhs string, one string, two string"))


def num(x: str) -> str:
    return f"CASE WHEN ({x}) = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE round_even({x}, 6)::DOUBLE::VARCHAR END"


def ex(p: str, k: int, x: str = "text") -> str:
    return f"regexp_extract({x}, {q.text(p)}, {k})"


def dbl(x: str) -> str:
    return f"try_cast(replace({x}, ',', '') AS DOUBLE)"


def has(p: str, x: str = "text") -> str:
    return f"regexp_matches({x}, {q.text(p)})"


def coef(side: str, p: int) -> str:
    """SQL of the sum of the coefficients of x to the power p."""
    terms = rf"regexp_extract_all(regexp_replace({side}, '\s+', '', 'g'), '[+-]?[^+-]+')"
    power = r"CASE WHEN regexp_matches(t, 'x\^') THEN regexp_extract(t, 'x\^(\d+)', 1)::INT WHEN contains(t, 'x') THEN 1 ELSE 0 END"
    c = r"regexp_extract(t, '^([+-]?\d*\.?\d*)', 1)"
    return f"coalesce(list_sum(list_transform({terms}, lambda t: CASE WHEN {power} = {p} THEN CASE {c} WHEN '' THEN 1.0 WHEN '+' THEN 1.0 WHEN '-' THEN -1.0 ELSE {c}::DOUBLE END ELSE 0.0 END)), 0.0)::DOUBLE"


def poly(cs: list[str]) -> str:
    """SQL of the text of a polynomial of the given coefficients, lowest power first."""
    terms = []
    for p in range(len(cs) - 1, -1, -1):
        body = "" if p == 0 else "x" if p == 1 else f"x^{p}"
        size = f"CASE WHEN abs({cs[p]}) = 1 THEN '' ELSE {num(f'abs({cs[p]})')} END" if p else num(f"abs({cs[p]})")
        terms.append(f"CASE WHEN {cs[p]} <> 0 THEN CASE WHEN {cs[p]} < 0 THEN '- ' ELSE '+ ' END || {size} || '{body}' END")
    text = f"regexp_replace(regexp_replace(concat_ws(' ', {', '.join(terms)}), '^\\+ ', ''), '^- ', '-')"
    return f"CASE WHEN {text} = '' THEN '0' ELSE {text} END"


_EQ = f"(SELECT id, text, {ex(S.EQUATION, 1)} AS e FROM {_P})"
_SIDES = ", ".join(f"{coef('split_part(e, ' + chr(39) + '=' + chr(39) + ', 1)', p)} - {coef('split_part(e, ' + chr(39) + '=' + chr(39) + ', 2)', p)} AS c{p}" for p in range(5))
_XY = lambda e, letter: rf"coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace({e}, '\s+', '', 'g'), '([+-]?\d*\.?\d*){letter}', 1), lambda c: CASE c WHEN '' THEN 1.0 WHEN '+' THEN 1.0 WHEN '-' THEN -1.0 ELSE c::DOUBLE END)), 0.0)::DOUBLE"
_BODY = [f"{coef('b', p)} AS c{p}" for p in range(5)]
_THINGS = q.listed(S.NO_THINGS)
ORACLE["problem_answers"] = rf"""WITH p AS {_P},
eq AS (SELECT id, e, {_SIDES} FROM {_EQ} WHERE e <> ''),
qu AS (SELECT *, c1 * c1 - 4.0 * c2 * c0 AS d FROM eq WHERE c2 <> 0 AND c3 = 0 AND c4 = 0),
qr AS (SELECT id, d, least((-c1 - sqrt(greatest(d, 0))) / (2.0 * c2), (-c1 + sqrt(greatest(d, 0))) / (2.0 * c2)) AS a, greatest((-c1 - sqrt(greatest(d, 0))) / (2.0 * c2), (-c1 + sqrt(greatest(d, 0))) / (2.0 * c2)) AS b FROM qu),
sy AS (SELECT id, regexp_extract_all(text, {q.text(S.EQUATION_XY)}) AS f FROM p),
sz AS (SELECT id, f, {_XY('f[1]', 'x')} AS a1, {_XY('f[1]', 'y')} AS b1, {_XY('f[2]', 'x')} AS a2, {_XY('f[2]', 'y')} AS b2, try_cast(regexp_extract(f[1], '=\s*([-+]?[\d.]+)$', 1) AS DOUBLE) AS c1, try_cast(regexp_extract(f[2], '=\s*([-+]?[\d.]+)$', 1) AS DOUBLE) AS c2 FROM sy WHERE len(f) = 2 AND contains(array_to_string(f, ' '), 'y')),
pc AS (SELECT id, CASE WHEN {has(S.CHANGE_FIRST)} THEN {ex(S.CHANGE_FIRST, 1)} ELSE {ex(S.CHANGE_LAST, 2)} END AS verb, {dbl(f"CASE WHEN {has(S.CHANGE_FIRST)} THEN {ex(S.CHANGE_FIRST, 2)} ELSE {ex(S.CHANGE_LAST, 3)} END")} AS r,
  {dbl(f"CASE WHEN {has(S.CHANGE_FIRST)} THEN {ex(S.CHANGE_FIRST, 3)} ELSE {ex(S.CHANGE_LAST, 1)} END")} AS base FROM p WHERE {has(S.CHANGE_FIRST)} OR {has(S.CHANGE_LAST)}),
it AS (SELECT id, text, {dbl(ex(r'\$\s?(\d[\d,]*(?:\.\d+)?)', 1))} AS p, {dbl(ex(r'(\d+(?:\.\d+)?)\s*%', 1))} AS r, {dbl(ex(r'(?i)(\d+(?:\.\d+)?)\s*(?:year|yr|month)', 1))} / CASE WHEN {has(r'(?i)\d\s*month')} THEN 12.0 ELSE 1.0 END AS y FROM p WHERE {has('(?i)interest')}),
th AS (SELECT id, text, list_filter(list_transform(regexp_extract_all(text, '\d+\s+[A-Za-z]+'), lambda x: {{'n': regexp_extract(x, '^(\d+)', 1)::BIGINT, 'w': lower(regexp_extract(x, '([A-Za-z]+)$', 1))}}), lambda s: NOT list_contains({_THINGS}, s.w)) AS c FROM p WHERE {has(S.CHANCE)}),
tt AS (SELECT id, c, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains(list_transform(c, lambda s: s.w), w))[-1] AS t FROM th WHERE len(c) >= 2),
pr AS (SELECT id, list_sum(list_transform(c, lambda s: s.n))::BIGINT AS total, coalesce(list_sum(list_transform(list_filter(c, lambda s: s.w = t), lambda s: s.n)), 0)::BIGINT AS fav FROM tt WHERE t IS NOT NULL),
bk AS (SELECT id, unnest(regexp_extract_all(text, {q.text(S.GIVEN)}, 1)) AS a, unnest(regexp_extract_all(text, {q.text(S.GIVEN)}, 2)) AS g, unnest(regexp_extract_all(text, {q.text(S.GIVEN)}, 3))::DOUBLE AS v FROM p),
bn AS (SELECT id, trim(a) AS a, trim(regexp_replace(coalesce(g, ''), '^\|', '')) AS g, v FROM bk),
bay AS (SELECT l.id, l.a AS b, l.g AS a, l.v * pa.v / pb.v AS post FROM bn l JOIN bn pa ON pa.id = l.id AND pa.a = l.g AND pa.g = '' JOIN bn pb ON pb.id = l.id AND pb.a = l.a AND pb.g = ''
  WHERE l.g <> '' AND NOT EXISTS (SELECT 1 FROM bn n WHERE n.id = l.id AND n.a = l.g AND n.g = l.a)),
de AS (SELECT id, {', '.join(_BODY)} FROM (SELECT id, trim({ex(S.DERIVE, 1, 'trim(text)')}) AS b FROM p) WHERE b <> ''),
ig AS (SELECT id, {', '.join(_BODY)} FROM (SELECT id, trim({ex(S.INTEGRATE, 1, 'trim(text)')}) AS b FROM p) WHERE b <> ''),
ge AS (SELECT id, text, list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')::DOUBLE) AS s, {dbl(ex(S.RADIUS, 1))} AS r FROM p),
gf AS (SELECT id, CASE WHEN {has(S.TRIANGLE)} AND len(s) >= 2 THEN ['Pythagoras', 'c = ' || {num('round_even(sqrt(s[1] * s[1] + s[2] * s[2]), 4)')}]
  WHEN {has(S.CIRCLE)} AND r IS NOT NULL THEN CASE WHEN {has('(?i)circumference|perimeter')} THEN ['circumference', {num('round_even(2.0::DOUBLE * pi() * r, 4)')}] ELSE ['area of a circle', {num('round_even(pi() * r * r, 4)')}] END
  WHEN {has(S.RECTANGLE)} AND regexp_matches(text, '(?i)\barea\b') THEN ['area of a rectangle', {num(f"{dbl(ex(S.RECTANGLE, 1))} * {dbl(ex(S.RECTANGLE, 2))}")}] END AS g FROM ge),
sp AS (SELECT id, {dbl(ex(S.JOURNEY, 1))} / {dbl(ex(S.JOURNEY, 3))} AS v, {ex(S.JOURNEY, 2)} || '/' || regexp_replace({ex(S.JOURNEY, 4)}, 's+$', '') AS u FROM p WHERE {has(S.JOURNEY)} AND regexp_matches(text, '(?i)\b(speed|how fast|average speed)\b')),
pp AS (SELECT id, {dbl(ex(r'(?i)(\d+(?:\.\d+)?)\s*%\s*of\s*\$?(\d[\d,]*(?:\.\d+)?)', 1))} / 100.0::DOUBLE * {dbl(ex(r'(?i)(\d+(?:\.\d+)?)\s*%\s*of\s*\$?(\d[\d,]*(?:\.\d+)?)', 2))} AS v FROM p WHERE regexp_matches(text, '(?i)\b(what is|find|calculate|compute|how much)\b')),
o AS (SELECT id, 'linear equation' AS kind, 'x = ' || {num('-c0 / c1 + 0.0::DOUBLE')} AS answer FROM eq WHERE c1 <> 0 AND c2 = 0 AND c3 = 0 AND c4 = 0
UNION ALL SELECT id, 'quadratic equation', CASE WHEN d < 0 THEN 'No real solutions' WHEN d = 0 THEN 'x = ' || {num('a')} ELSE 'x = ' || {num('a')} || ' or x = ' || {num('b')} END FROM qr
UNION ALL SELECT id, 'pair of linear equations', 'x = ' || {num('(c1 * b2 - c2 * b1) / (a1 * b2 - a2 * b1) + 0.0::DOUBLE')} || ', y = ' || {num('(a1 * c2 - a2 * c1) / (a1 * b2 - a2 * b1) + 0.0::DOUBLE')} FROM sz WHERE a1 * b2 - a2 * b1 <> 0
UNION ALL SELECT id, 'percentage', {num('v')} FROM pp WHERE v IS NOT NULL
UNION ALL SELECT id, 'percentage change', {num("CASE WHEN regexp_matches(verb, '(?i)^(increase|raise|mark)') THEN base + r / 100.0::DOUBLE * base ELSE base - r / 100.0::DOUBLE * base END")} FROM pc
UNION ALL SELECT id, CASE WHEN {has('(?i)compound')} THEN 'compound interest' ELSE 'simple interest' END, round_even(CASE WHEN {has('(?i)compound')} THEN p * pow(1.0::DOUBLE + r / 100.0::DOUBLE, y) ELSE p * r / 100.0::DOUBLE * y END, 2)::DOUBLE::VARCHAR FROM it WHERE p * r * y IS NOT NULL
UNION ALL SELECT id, 'probability', (fav // gcd(fav, total)) || '/' || (total // gcd(fav, total)) FROM pr WHERE total > 0
UNION ALL SELECT id, 'Bayes'' rule', 'P(' || a || '|' || b || ') = ' || {num('round_even(post, 6)')} FROM bay WHERE (SELECT count(*) FROM bn WHERE bn.id = bay.id) >= 3
UNION ALL SELECT id, 'derivative', 'f''(x) = ' || {poly(['c1', '(2 * c2)', '(3 * c3)', '(4 * c4)'])} FROM de
UNION ALL SELECT id, 'integral', {poly(['0.0', 'c0', '(c1 / 2)', '(c2 / 3)', '(c3 / 4)', '(c4 / 5)'])} || ' + C' FROM ig
UNION ALL SELECT id, g[1], g[2] FROM gf WHERE g IS NOT NULL
UNION ALL SELECT id, 'speed', {num('round_even(v, 4)')} || ' ' || u FROM sp)
SELECT id::BIGINT AS id, kind, answer FROM o"""
_TRIM = r"regexp_replace(x, '^[ \-•\t]+|[ \-•\t]+$', '', 'g')"
ORACLE["problem_candidates"] = rf"""WITH l AS (SELECT id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}), lambda x: x <> '') AS l FROM {_P}),
c AS (SELECT id, list_concat(list_concat([{ends('text')}], list_filter(list_transform(l, lambda x, i: CASE WHEN contains(x, '=') AND contains(coalesce(l[i + 1], ''), '=') THEN x || ' ; ' || l[i + 1] END), lambda x: x IS NOT NULL)),
  list_concat(l, list_transform(flatten(list_transform(l, lambda x: string_split(regexp_replace(x, '([.?!])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda e: {ends('e')}))) AS c FROM l),
d AS (SELECT id, list_filter(c, lambda x, i: x <> '' AND list_position(c, x) = i) AS c FROM c)
SELECT id::BIGINT AS id, (generate_subscripts(c, 1) - 1)::INT AS pos, unnest(c) AS text FROM d"""
_LEVELS = " UNION ALL ".join(["SELECT * FROM c1", *[f"SELECT * FROM c{s}" for s in range(2, 8)]])
_STEPS = []
for _s in range(2, 8):
    _all = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, _s))
    _STEPS.append(f"c{_s} AS (SELECT DISTINCT l.id, l.start, r.stop, g.lhs AS symbol FROM ({_all}) l JOIN ({_all}) r ON l.id = r.id AND r.start = l.stop + 1 AND r.stop - l.start = {_s - 1} JOIN g ON g.one = l.symbol AND g.two = r.symbol)")
ORACLE["parse_chart"] = rf"""WITH g AS {values(GRAMMAR, 'lhs, one, two')}, t AS (SELECT id::BIGINT AS id, text FROM {values(PARSED, 'id, text')} UNION ALL SELECT -1 - ((conv_id * 1000 + turn) * 1000 + i), text FROM (SELECT conv_id, turn, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS i FROM (SELECT conv_id, turn, {q.sentences("coalesce(text, '')")} AS s FROM conversations))),
ws AS (SELECT id, regexp_split_to_array(lower(text), '\s+') AS s FROM t), w AS (SELECT id, unnest(s) AS word, (generate_subscripts(s, 1) - 1)::INT AS i FROM ws WHERE len(s) <= 7),
c1 AS (SELECT DISTINCT id, i AS start, i AS stop, lhs AS symbol FROM w JOIN g ON g.one = w.word AND g.two IS NULL), {', '.join(_STEPS)} {_LEVELS}"""
