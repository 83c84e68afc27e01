"""Worked problems: each solver is a column that gives its kind, its answer and its steps, or null; a table of solvers is tried in order.

Everything is closed forms over numbers that patterns find: polynomials in x up to the fourth power, pairs of linear equations, percentages,
probabilities, Bayes' rule, the power rule, a few figures, speeds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.phrases import ends, let

POWERS = 5
# Words beside a number that are no things to draw, and the patterns of the problems.
NO_THINGS = "times percent out in of years year".split()
CHANGE_FIRST = r"(?i)(increase|decrease|raise|reduce|discount|mark(?:ed)? up)\w*\D{0,25}?(\d+(?:\.\d+)?)\s*%.*?\$?(\d[\d,]*(?:\.\d+)?)"
CHANGE_LAST = r"(?i)\$?(\d[\d,]*(?:\.\d+)?)\D{0,25}?(increase|decrease|discount)\w*.*?(\d+(?:\.\d+)?)\s*%"
CHANCE = r"(?i)\bprobabilit\w*|\bchance\b|\blikely\b"
GIVEN = r"P\(\s*([^)|]+?)\s*(\|\s*[^)]+?)?\s*\)\s*=\s*(\d*\.?\d+)"
DERIVE = r"(?i)(?:differentiate|derivative of|d/dx|find the derivative of)\s*[:\s]*\(?\s*([-+\d.x^\s]+?)\)?\s*(?:with respect to x)?\s*[?.]?$"
INTEGRATE = r"(?i)(?:integrate|integral of|∫)\s*[:\s]*\(?\s*([-+\d.x^\s]+?)\)?\s*(?:dx)?\s*[?.]?$"
TRIANGLE = r"(?i)hypotenuse|right[- ]angled? triangle|pythagoras"
CIRCLE, RADIUS = r"(?i)circle", r"(?i)radius\D{0,8}(\d+(?:\.\d+)?)"
RECTANGLE = r"(?i)(?:rectangle|room|field|garden).*?(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)"
JOURNEY = r"(?i)(\d+(?:\.\d+)?)\s*(km|miles?|m|metres|meters)\b.*?(\d+(?:\.\d+)?)\s*(hours?|hrs?|h|minutes?|min|seconds?|s)\b"
EQUATION = r"([-+\d.x^\s]*x[-+\d.x^\s]*=[-+\d.x^\s]*|[-+\d.\s]*=[-+\d.x^\s]*x[-+\d.x^\s]*)"
EQUATION_XY = r"[-+\d.xy\s]*[xy][-+\d.xy\s]*=\s*[-+]?[\d.]+"


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def named(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def shown(value: Column) -> Column:
    """Whole numbers without a point, others to six places."""
    return let(value, lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.bround(v, 6).cast("string")))


def coefficients(side: Column) -> Column:
    """Sums of the coefficients of x to the powers 0 to 4 of a text like ``3x^2 - x + 4``."""
    terms = F.regexp_extract_all(F.regexp_replace(side, r"\s+", ""), F.lit(r"[+-]?[^+-]+"), F.lit(0))

    def read(t: Column) -> Column:
        c = F.regexp_extract(t, r"^([+-]?\d*\.?\d*)", 1)
        power = F.when(t.rlike(r"x\^"), F.regexp_extract(t, r"x\^(\d+)", 1).cast("int")).when(F.contains(t, F.lit("x")), 1).otherwise(0)
        return named(power=power, factor=F.when(c.isin("", "+"), 1.0).when(c == "-", -1.0).otherwise(c.try_cast("double")))

    def sums(found: Column) -> Column:
        return F.array(*[F.aggregate(found, F.lit(0.0), _adds(p)) for p in range(POWERS)])

    return let(F.transform(terms, read), sums)


def _adds(power: int):
    return lambda a, t: a + F.when(t["power"] == power, t["factor"]).otherwise(0.0)


def polynomial(coefs: Column) -> Column:
    """The coefficients as a text, highest power first; 0 for none."""

    def term(v: Column, p: int) -> Column:
        body = "" if p == 0 else "x" if p == 1 else f"x^{p}"
        size = F.when((F.abs(v) == 1) & F.lit(p > 0), "").otherwise(shown(F.abs(v)))
        return F.when(v != 0, F.concat(F.when(v < 0, "- ").otherwise("+ "), size, F.lit(body)))

    text = let(coefs, lambda c: F.concat_ws(" ", *[term(F.get(c, F.lit(p)), p) for p in range(POWERS, -1, -1)]))
    return let(F.regexp_replace(F.regexp_replace(text, r"^\+ ", ""), "^- ", "-"), lambda t: F.when(t == "", "0").otherwise(t))


def solution(ok: Column, kind: Column | str, answer: Column, *steps: tuple[str, Column]) -> Column:
    """The struct of a solved problem where ``ok``, else null; steps are a title and a line each."""
    lines = F.array(*[F.struct(F.lit(t).alias("title"), line.alias("line")) for t, line in steps])
    return F.when(ok, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), answer.alias("answer"), F.filter(lines, lambda s: s["line"].isNotNull()).alias("steps")))


def _moved(text: Column, use) -> Column:
    """``use`` of the coefficients of an equation's left side less its right side, null without an equation."""
    equation = F.regexp_extract(text, EQUATION, 1)
    sides = (coefficients(F.split_part(equation, F.lit("="), F.lit(k))) for k in (1, 2))
    return F.when(equation != "", let(F.zip_with(*sides, lambda a, b: a - b), use))


def quadratic(text: Column) -> Column:
    def roots(c: Column) -> Column:
        b, a = F.get(c, F.lit(1)), F.get(c, F.lit(2))
        disc = b * b - 4.0 * a * F.get(c, F.lit(0))
        return let(named(a=a, b=b, disc=disc, root=F.sqrt(disc)), lambda s: named(disc=s["disc"], low=(-s["b"] - s["root"]) / (2.0 * s["a"]), high=(-s["b"] + s["root"]) / (2.0 * s["a"])))

    def solve(c: Column) -> Column:
        def write(s: Column) -> Column:
            one, two = shown(F.least(s["low"], s["high"])), shown(F.greatest(s["low"], s["high"]))
            answer = F.when(s["disc"] < 0, "No real solutions").when(s["disc"] == 0, F.concat(F.lit("x = "), one)).otherwise(F.concat(F.lit("x = "), one, F.lit(" or x = "), two))
            form = F.concat(polynomial(c), F.lit(" = 0"))
            return solution(F.lit(True), "quadratic equation", answer, ("Write it in standard form", form), ("Work out the discriminant", F.concat(F.lit("b^2 - 4ac = "), shown(s["disc"]))), ("Find the answers", answer))

        return F.when((F.get(c, F.lit(2)) != 0) & (F.get(c, F.lit(3)) == 0) & (F.get(c, F.lit(4)) == 0), let(roots(c), write))

    return _moved(text, solve)


def linear(text: Column) -> Column:
    def solve(c: Column) -> Column:
        def write(s: Column) -> Column:
            found = F.concat(F.lit("x = "), s["shown"])
            return solution(
                F.lit(True),
                "linear equation",
                found,
                ("Collect the unknown on one side", F.concat(s["number"], F.lit("x = "), shown(s["right"]))),
                ("Divide by its number", found),
                ("Check the answer", F.concat(s["number"], F.lit(" * "), s["shown"], F.lit(" = "), shown(s["a"] * s["x"]))),
            )

        a, right = F.get(c, F.lit(1)), -F.get(c, F.lit(0)) + 0.0
        ok = (a != 0) & F.forall(F.slice(c, 3, POWERS), lambda v: v == 0)
        return F.when(ok, let(named(a=a, right=right, x=right / a, number=shown(a), shown=shown(right / a)), write))

    return _moved(text, solve)


def system(text: Column) -> Column:
    def sum_of(t: Column, letter: str) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(t, r"\s+", ""), F.lit(rf"([+-]?\d*\.?\d*){letter}"), F.lit(1))
        return F.aggregate(F.transform(found, lambda c: F.when(c.isin("", "+"), 1.0).when(c == "-", -1.0).otherwise(c.try_cast("double"))), F.lit(0.0), lambda s, v: s + v)

    def read(e: Column) -> Column:
        return named(text=ends(e), a=sum_of(e, "x"), b=sum_of(e, "y"), c=F.regexp_extract(e, r"=\s*([-+]?[\d.]+)$", 1).try_cast("double"))

    def write(s: Column) -> Column:
        one, two = s["one"], s["two"]
        det, top = one["a"] * two["b"] - two["a"] * one["b"], one["c"] * two["b"] - two["c"] * one["b"]
        values = named(det=det, top=top, x=top / det + 0.0, y=(one["a"] * two["c"] - two["a"] * one["c"]) / det + 0.0)

        def lines(v: Column) -> Column:
            answer = F.concat(F.lit("x = "), shown(v["x"]), F.lit(", y = "), shown(v["y"]))
            labels, removed = F.concat(one["text"], F.lit(" ; "), two["text"]), F.concat(shown(v["det"]), F.lit("x = "), shown(v["top"]))
            return solution(v["det"] != 0, "pair of linear equations", answer, ("Label the equations", labels), ("Remove y", removed), ("Find both", answer))

        return let(values, lines)

    found = F.transform(F.regexp_extract_all(text, F.lit(EQUATION_XY), F.lit(0)), read)
    both = let(found, lambda f: F.when((F.size(f) == 2) & F.exists(f, lambda e: F.contains(e["text"], F.lit("y"))), named(one=F.get(f, F.lit(0)), two=F.get(f, F.lit(1)))))
    return let(both, lambda s: F.when(s.isNotNull(), write(s)))


def percent(text: Column) -> Column:
    plain = r"(?i)(\d+(?:\.\d+)?)\s*%\s*of\s*\$?(\d[\d,]*(?:\.\d+)?)"
    asks = text.rlike(r"(?i)\b(what is|find|calculate|compute|how much)\b") & text.rlike(plain)
    p, base = (number(F.regexp_extract(text, plain, k)) for k in (1, 2))

    def write(s: Column) -> Column:
        value, share = shown(s["p"] / 100.0 * s["base"]), shown(s["p"] / 100.0)
        return solution(F.lit(True), "percentage", value, ("Percent as a decimal", F.concat(shown(s["p"]), F.lit("% = "), share)), ("Multiply", F.concat(share, F.lit(" * "), shown(s["base"]))), ("Calculate", value))

    return F.when(asks, let(named(p=p, base=base), write))


def percent_change(text: Column) -> Column:
    first = text.rlike(CHANGE_FIRST)
    pick = lambda a, b: F.when(first, F.regexp_extract(text, CHANGE_FIRST, a)).otherwise(F.regexp_extract(text, CHANGE_LAST, b))
    up = pick(1, 2).rlike("(?i)^(increase|raise|mark)")

    def write(s: Column) -> Column:
        change = s["p"] / 100.0 * s["base"]
        result = shown(F.when(s["up"], s["base"] + change).otherwise(s["base"] - change))
        steps = (("Find the change", F.concat(shown(s["p"]), F.lit("% of "), shown(s["base"]), F.lit(" = "), shown(change))), ("Apply it", F.concat(shown(s["base"]), F.when(s["up"], " + ").otherwise(" - "), shown(change))), ("Calculate", result))
        return solution(F.lit(True), "percentage change", result, *steps)

    return F.when(first | text.rlike(CHANGE_LAST), let(named(up=up, p=number(pick(2, 3)), base=number(pick(3, 1))), write))


def interest(text: Column) -> Column:
    """Compound if it says so: the amount; else the simple interest."""
    principal = number(F.regexp_extract(text, r"\$\s?(\d[\d,]*(?:\.\d+)?)", 1))
    rate, span = number(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1)), number(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:year|yr|month)", 1))

    def write(s: Column) -> Column:
        result = F.when(s["compound"], s["p"] * F.pow(1.0 + s["r"] / 100.0, s["y"])).otherwise(s["p"] * s["r"] / 100.0 * s["y"])
        answer = F.bround(result, 2).cast("string")
        return solution(
            (s["p"] * s["r"] * s["y"]).isNotNull(),
            F.when(s["compound"], "compound interest").otherwise("simple interest"),
            answer,
            ("Write the formula", F.when(s["compound"], "A = P(1 + r)^t").otherwise("I = P r t")),
            ("Convert the rate", F.concat(shown(s["r"]), F.lit("% = "), shown(s["r"] / 100.0))),
            ("Calculate", answer),
        )

    years = F.when(text.rlike(r"(?i)\d\s*month"), span / 12.0).otherwise(span)
    return F.when(text.rlike("(?i)interest"), let(named(p=principal, r=rate, y=years, compound=text.rlike("(?i)compound")), write))


def probability(text: Column) -> Column:
    """Of drawing the thing that is named last among those counted."""
    things = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\s+[A-Za-z]+)"), F.lit(1)), lambda p: named(n=F.regexp_extract(p, r"^(\d+)", 1).cast("long"), w=F.lower(F.regexp_extract(p, r"([A-Za-z]+)$", 1))))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda a, s: a + s["n"])

    def pick(counted: Column) -> Column:
        target = F.get(F.reverse(F.filter(words, lambda w: F.exists(counted, lambda s: s["w"] == w))), F.lit(0))
        return let(target, lambda t: named(t=t, n=F.size(counted), all=total(counted), fav=total(F.filter(counted, lambda s: s["w"] == t))))

    def divisor(a: Column, b: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            return F.when(s["b"] == 0, s).otherwise(named(a=s["b"], b=s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])))

        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), named(a=a, b=b), step, lambda s: s["a"])

    def write(s: Column) -> Column:
        by = lambda g: F.concat((s["fav"] / g).cast("long").cast("string"), F.lit("/"), (s["all"] / g).cast("long").cast("string"))
        answer = let(divisor(s["all"], s["fav"]), by)
        return solution((s["n"] >= 2) & s["t"].isNotNull() & (s["all"] > 0), "probability", answer, ("Count everything", s["all"].cast("string")), ("Count what is wanted", F.concat(s["t"], F.lit(": "), s["fav"].cast("string"))), ("Divide and simplify", answer))

    return F.when(text.rlike(CHANCE), let(let(F.filter(things, lambda s: ~s["w"].isin(NO_THINGS)), pick), write))


def bayes(text: Column) -> Column:
    """P(a|b) where P(b|a), P(a) and P(b) are given and it is not."""
    groups_ = [F.regexp_extract_all(text, F.lit(GIVEN), F.lit(k)).alias(n) for k, n in ((1, "x"), (2, "y"), (3, "v"))]
    known = F.transform(F.arrays_zip(*groups_), lambda s: named(a=F.trim(s["x"]), given=F.trim(F.regexp_replace(F.coalesce(s["y"], F.lit("")), r"^\|", "")), v=s["v"].try_cast("double")))

    def of(keys: Column, a: Column, given: Column) -> Column:
        return F.get(F.filter(keys, lambda s: (s["a"] == a) & (s["given"] == given)), F.lit(0))["v"]

    def pick(keys: Column) -> Column:
        none = F.lit("")
        usable = F.filter(keys, lambda s: (s["given"] != "") & of(keys, s["given"], none).isNotNull() & of(keys, s["a"], none).isNotNull() & of(keys, s["given"], s["a"]).isNull())
        return F.when(F.size(keys) >= 3, let(F.get(usable, F.lit(0)), lambda u: F.when(u.isNotNull(), named(a=u["given"], b=u["a"], top=u["v"] * of(keys, u["given"], none), under=of(keys, u["a"], none)))))

    def write(s: Column) -> Column:
        name = F.concat(F.lit("P("), s["a"], F.lit("|"), s["b"], F.lit(")"))
        rule = F.concat(name, F.lit(" = P("), s["b"], F.lit("|"), s["a"], F.lit(") * P("), s["a"], F.lit(") / P("), s["b"], F.lit(")"))
        post = shown(F.bround(s["top"] / s["under"], 6))
        return solution(s.isNotNull(), "Bayes' rule", F.concat(name, F.lit(" = "), post), ("Write the rule", rule), ("Multiply the top", shown(F.bround(s["top"], 6))), ("Divide", post))

    return let(let(known, pick), write)


def _terms(text: Column, pattern: str, make, write) -> Column:
    body = F.trim(F.regexp_extract(F.trim(text), pattern, 1))
    return F.when(body != "", let(coefficients(body), lambda c: let(named(given=polynomial(c), made=polynomial(make(c))), write)))


def derivative(text: Column) -> Column:
    def write(s: Column) -> Column:
        found = F.concat(F.lit("f'(x) = "), s["made"])
        return solution(F.lit(True), "derivative", found, ("Write the function", F.concat(F.lit("f(x) = "), s["given"])), ("Bring each power down and lower it by one", s["made"]), ("Add the pieces", found))

    return _terms(text, DERIVE, lambda c: F.array(*[F.get(c, F.lit(p + 1)) * (p + 1.0) for p in range(POWERS - 1)], F.lit(0.0), F.lit(0.0)), write)


def integral(text: Column) -> Column:
    def write(s: Column) -> Column:
        found = F.concat(s["made"], F.lit(" + C"))
        return solution(F.lit(True), "integral", found, ("Write the integral", s["given"]), ("Raise each power by one and divide by it", s["made"]), ("Add the constant", found))

    return _terms(text, INTEGRATE, lambda c: F.array(F.lit(0.0), *[F.get(c, F.lit(p)) / (p + 1.0) for p in range(POWERS)]), write)


def geometry(text: Column) -> Column:
    def triangle(s: Column) -> Column:
        squares = F.get(s, F.lit(0)) * F.get(s, F.lit(0)) + F.get(s, F.lit(1)) * F.get(s, F.lit(1))
        longest = shown(F.bround(F.sqrt(squares), 4))
        return solution(F.size(s) >= 2, "Pythagoras", F.concat(F.lit("c = "), longest), ("Write the theorem", F.lit("a^2 + b^2 = c^2")), ("Square and add", shown(squares)), ("Take the square root", longest))

    def circle(r: Column) -> Column:
        value = shown(F.bround(F.when(round_, 2.0 * math.pi * r).otherwise(math.pi * r * r), 4))
        kind, formula = F.when(round_, "circumference").otherwise("area of a circle"), F.when(round_, "C = 2 pi r").otherwise("A = pi r^2")
        return solution(r.isNotNull(), kind, value, ("Write the formula", formula), ("Put the radius in", F.concat(F.lit("r = "), shown(r))), ("Multiply", value))

    def rectangle(s: Column) -> Column:
        value = shown(s["w"] * s["l"])
        return solution(F.lit(True), "area of a rectangle", value, ("Write the formula", F.lit("A = length * width")), ("Put the sides in", F.concat(shown(s["w"]), F.lit(" * "), shown(s["l"]))), ("Multiply", value))

    round_ = text.rlike("(?i)circumference|perimeter")
    sides = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), number)
    w, l = (number(F.regexp_extract(text, RECTANGLE, k)) for k in (1, 2))  # noqa: E741
    return F.coalesce(
        F.when(text.rlike(TRIANGLE), let(sides, triangle)),
        F.when(text.rlike(CIRCLE), let(number(F.regexp_extract(text, RADIUS, 1)), circle)),
        F.when(text.rlike(RECTANGLE) & text.rlike(r"(?i)\barea\b"), let(named(w=w, l=l), rectangle)),
    )


def speed(text: Column) -> Column:
    distance, span = (number(F.regexp_extract(text, JOURNEY, k)) for k in (1, 3))
    unit = F.concat(F.regexp_extract(text, JOURNEY, 2), F.lit("/"), F.regexp_replace(F.regexp_extract(text, JOURNEY, 4), "s+$", ""))

    def write(s: Column) -> Column:
        value = F.concat(shown(F.bround(s["d"] / s["t"], 4)), F.lit(" "), s["unit"])
        return solution(s["t"] > 0, "speed", value, ("Write the formula", F.lit("speed = distance / time")), ("Put the numbers in", F.concat(shown(s["d"]), F.lit(" / "), shown(s["t"]))), ("Divide", value))

    return F.when(text.rlike(JOURNEY) & text.rlike(r"(?i)\b(speed|how fast|average speed)\b"), let(named(d=distance, t=span, unit=unit), write))


#: Solvers in the order in which they are tried.
SOLVERS: tuple[Callable[[Column], Column], ...] = (bayes, system, quadratic, linear, interest, percent, percent_change, probability, derivative, integral, geometry, speed)


def candidates(problems: DataFrame) -> DataFrame:
    """(id, pos, text): the whole text, neighbouring lines that are both equations, the lines, the sentences; each once, in that order."""
    lines = F.filter(F.transform(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \-•\t]+|[ \-•\t]+$", "")), lambda x: x != "")
    rows = problems.select("id", "text", lines.alias("lines"))
    both = F.filter(
        F.transform("lines", lambda x, i: F.when(F.contains(x, F.lit("=")) & F.contains(F.coalesce(F.get("lines", i + 1), F.lit("")), F.lit("=")), F.concat(x, F.lit(" ; "), F.get("lines", i + 1)))),
        lambda x: x.isNotNull(),
    )
    sents = F.flatten(F.transform("lines", lambda x: F.split(x, r"(?<=[.?!])\s+(?=[A-Z0-9])")))
    every = F.filter(F.array_distinct(F.concat(F.array(ends(F.col("text"))), both, F.col("lines"), F.transform(sents, ends))), lambda x: (x != "") & (F.length(x) <= 4000))
    return rows.select("id", F.posexplode(every).alias("pos", "text"))


def explained(problems: DataFrame, solvers=SOLVERS) -> DataFrame:
    """(id, kind, answer, step_no, title, line): the steps of the first solver that knows the first candidate text that one knows. ``solvers`` may be
    any functions from a text column to ``solution``."""
    solved = candidates(problems).withColumn("s", F.coalesce(*[f(F.col("text")) for f in solvers])).where("s IS NOT NULL AND size(s.steps) >= 3")
    first = solved.groupBy("id").agg(F.min_by("s", "pos").alias("s"))
    steps = first.select("id", "s.kind", "s.answer", F.posexplode("s.steps").alias("step_no", "step"))
    return steps.select("id", "kind", "answer", (F.col("step_no") + 1).alias("step_no"), "step.title", "step.line")


def parsed(sentences: DataFrame, rules: DataFrame, most: int = 7) -> DataFrame:
    """(id, start, stop, symbol): what spans words ``start`` to ``stop`` of each sentence (id, text of at most ``most`` words) by rules (lhs, one, two) of a
    grammar in Chomsky normal form; ``two`` is null where ``one`` is a word. A chart filled by span length, within the sentence's row.

    A chart is bounded (28 spans of seven words); the grammar is one row of a few rules, sent to all.
    """
    grammar = rules.agg(F.collect_list(F.struct("lhs", "one", "two")).alias("g"))
    rows = sentences.select("id", F.split(F.lower("text"), r"\s+").alias("words")).where(F.size("words") <= most).join(F.broadcast(grammar))
    cell = "array<struct<start:int,stop:int,symbol:string>>"

    def of_word(w: Column, i: Column) -> Column:
        return F.transform(F.filter("g", lambda r: r["two"].isNull() & (F.lower(r["one"]) == w)), lambda r: F.struct(i.alias("start"), i.alias("stop"), r["lhs"].alias("symbol")))

    rows = rows.withColumn("chart", F.array_distinct(F.flatten(F.transform("words", of_word))).cast(cell))
    for size in range(2, most + 1):

        def joined(l: Column, size: int = size) -> Column:  # noqa: E741
            def by_right(r: Column) -> Column:
                fits = F.filter("g", lambda q: (q["one"] == l["symbol"]) & (q["two"] == r["symbol"]))
                return F.transform(fits, lambda q: F.struct(l["start"].alias("start"), r["stop"].alias("stop"), q["lhs"].alias("symbol")))

            return F.flatten(F.transform(F.filter("chart", lambda r: (r["start"] == l["stop"] + 1) & (r["stop"] - l["start"] == size - 1)), by_right))

        rows = rows.withColumn("chart", F.array_distinct(F.concat("chart", F.flatten(F.transform("chart", lambda l: joined(l))).cast(cell))))  # noqa: E741, B023
    return rows.select("id", F.explode_outer("chart").alias("c")).where("c IS NOT NULL").select("id", "c.*")
