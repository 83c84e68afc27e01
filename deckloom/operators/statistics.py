"""Statistics and small models: summaries, rank correlation, bigrams, Naive Bayes, best paths and segmentations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions import score as S


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, all modes in order, range and population standard deviation of each group."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(by).agg(F.max("c").alias("c"))
    modes = counts.join(top, [by, "c"]).groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(value)).cast("array<string>"), ",").alias("modes"))
    main = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg(value), 4).alias("mean"),
        F.bround(F.median(value), 4).alias("median"),
        F.bround((F.max(value) - F.min(value)).cast("double"), 4).alias("value_range"),
        F.bround(F.stddev_pop(value), 4).alias("deviation"),
    )
    return main.join(modes, by)


def spearman(rows: DataFrame, by: str, a: str, b: str, tie: str) -> DataFrame:
    """Rank correlation without tie correction, and the root of the mean squared difference."""
    ranked = rows.withColumns({"ra": F.row_number().over(Window.partitionBy(by).orderBy(a, tie)), "rb": F.row_number().over(Window.partitionBy(by).orderBy(b, tie))})
    n, d2 = F.count(F.lit(1)).cast("double"), F.sum(F.pow((F.col("ra") - F.col("rb")).cast("double"), F.lit(2)))
    return ranked.groupBy(by).agg(F.bround(F.when(n > 1, 1.0 - 6.0 * d2 / (n * (n * n - 1.0))).otherwise(0.0), 6).alias("spearman"), F.bround(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), F.lit(2)))), 4).alias("rmse"))


def bigrams(sentences: DataFrame) -> DataFrame:
    """Counts of neighbouring words (a, b) with sentence marks, and the add-one probability of b after a.

    ``sentences``: words (array). Pairs are counted with partial sums, so a pair that is everywhere costs a row a task.
    """
    rows = sentences.select(F.concat(F.array(F.lit("<s>")), "words", F.array(F.lit("</s>"))).alias("padded"))
    short = F.size("padded") - 1
    pairs = F.arrays_zip(F.slice("padded", F.lit(1), short).alias("a"), F.slice("padded", F.lit(2), short).alias("b"))
    # exploded as outer, so that no test of sizes makes the arrays once more
    counts = rows.select(F.explode_outer(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("a").agg(F.sum("n").alias("n_a"))
    vocab = counts.agg(F.count_distinct("b").alias("v"))
    joined = counts.join(first, "a").join(F.broadcast(vocab))  # one row
    return joined.select("a", "b", "n", "n_a", F.bround((F.col("n") + 1).cast("double") / (F.col("n_a") + F.col("v")), 9).alias("p"))


def naive_bayes(train: DataFrame, test: DataFrame) -> DataFrame:
    """``train`` (label, words), ``test`` (id, words): the class with the largest add-one log probability; the least label of equals."""
    docs = train.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("docs"))
    total = docs.agg(F.sum("docs").alias("total"))
    counts = train.select("label", F.explode_outer("words").alias("w")).where("w IS NOT NULL").groupBy("label", "w").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sizes = counts.groupBy("label").agg(F.sum("c").alias("size"))
    vocab = counts.agg(F.count_distinct("w").cast("double").alias("v"))
    # one row a class
    classes = docs.join(sizes, "label").join(F.broadcast(total)).join(F.broadcast(vocab)).select("label", F.log(F.col("docs") / F.col("total")).alias("prior"), (F.col("size") + F.col("v")).alias("room"))
    known = counts.select("w").distinct()
    asked = test.select("id", F.explode_outer("words").alias("w")).where("w IS NOT NULL").groupBy("id", "w").agg(F.count(F.lit(1)).cast("double").alias("k")).join(known, "w", "left_semi")
    # a word's log probability under every class: what the counts lack is the same for all unseen words of a class
    seen = asked.join(counts, "w").join(classes.select("label", "room"), "label").groupBy("id", "label").agg(F.sum(F.bround(F.col("k") * (F.log(F.col("c") + 1.0)), 9)).alias("gain"))
    words_each = asked.groupBy("id").agg(F.sum("k").alias("k"))
    base = words_each.join(F.broadcast(classes))  # the result has a row for each class and text: classes are few
    scored = base.join(seen, ["id", "label"], "left").select("id", "label", F.bround(F.col("prior") - F.col("k") * F.log("room") + F.coalesce("gain", F.lit(0.0)), 4).alias("score"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label"))
    return scored.withColumn("_r", best).where("_r = 1").select("id", "label", "score")


#: Chances are scaled up by this power of two, which is exact, before a long sequence would take them to zero.
SCALE_BITS = 512


def viterbi(sequences: DataFrame, states: list[str], start: dict[str, float], move: dict[tuple[str, str], float], emit: dict[tuple[str, str], float]) -> DataFrame:
    """The likeliest states of each whole sequence (id, observations array), the first of equals; a fold over the array, no UDF.

    ``p`` is the path's chance, zero where a double can't hold it; ``log_p`` holds it at any length (null if the chance is none).
    """

    def best(state, seen):
        cells, made = state["cells"], []
        for s in states:
            options = F.array(*[F.struct((F.get(cells, F.lit(i))["p"] * move.get((r, s), 0.0)).alias("p"), F.lit(-i).alias("o"), F.get(cells, F.lit(i))["path"].alias("path")) for i, r in enumerate(states)])
            top = F.array_max(options)
            chance = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for o in sorted({o for _, o in emit}) for x in (o, float(emit.get((s, o), 0.0)))]), seen), F.lit(0.0))
            made.append(F.struct((top["p"] * chance).alias("p"), F.concat(top["path"], F.array(F.lit(s))).alias("path")))
        return scaled(F.struct(F.array(*made).alias("cells"), state["shift"].alias("shift")))

    def scaled(state):
        top = F.array_max(F.transform(state["cells"], lambda c: c["p"]))
        up = F.transform(state["cells"], lambda c: F.struct((c["p"] * 2.0**SCALE_BITS).alias("p"), c["path"].alias("path")))
        return F.when((top > 0) & (top < 2.0**-SCALE_BITS), F.struct(up.alias("cells"), (state["shift"] + 1).alias("shift"))).otherwise(state)

    def chance0(s, seen):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for o in sorted({o for _, o in emit}) for x in (o, float(emit.get((s, o), 0.0)))]), seen), F.lit(0.0))

    first = F.get("observations", F.lit(0))
    cells = F.array(*[F.struct((F.lit(float(start[s])) * chance0(s, first)).alias("p"), F.array(F.lit(s)).alias("path")) for s in states])
    folded = F.aggregate(F.slice("observations", F.lit(2), F.greatest(F.size("observations") - 1, F.lit(0))), F.struct(cells.alias("cells"), F.lit(0).alias("shift")), best)
    done = sequences.where(F.size("observations") > 0).select("id", folded.alias("f"))
    ends = F.transform("f.cells", lambda c, i: F.struct(c["p"].alias("p"), (-i).alias("o"), c["path"].alias("path")))
    done = done.select("id", F.array_max(ends).alias("top"), (F.col("f.shift") * SCALE_BITS).cast("double").alias("bits"))
    p = F.col("top.p")
    return done.select("id", F.array_join("top.path", ">").alias("path"), (p * F.pow(F.lit(2.0), -F.col("bits"))).alias("p"), F.when(p > 0, F.log(p) - F.col("bits") * math.log(2.0)).alias("log_p"))


def group_costs(slides: DataFrame, cap: int, target: int, least: int = 1) -> DataFrame:
    """(doc_id, slide_no, i, j, cost) of putting the bullets after the i-th up to the j-th on one page, for at most ``cap`` bullets. Slides of under ``least`` bullets have a row without a span."""
    from deckloom.functions.text import content_words, idf_guess, words

    # what a span is made of is read once a bullet: words never reach from one bullet into the next
    counted = F.transform("bullets", lambda b: F.struct(F.size(words(b)).alias("n"), F.regexp_count(b, F.lit(S.RELATIONAL)).alias("r")))
    apart = ~F.exists(F.slice("bullets", F.lit(1), F.size("bullets") - 1), lambda b: ~b.rlike(r"[.!?]\z")) & ~F.exists("bullets", lambda b: F.contains(F.lower(b), F.lit("if")))
    rows = slides.where(F.size("bullets") > 0).select("doc_id", "slide_no", F.size("bullets").alias("m"), "bullets", F.transform("bullets", lambda b: F.array_distinct(content_words(b))).alias("sets"), counted.alias("counted"), apart.alias("apart"))
    part = lambda name, i, j: F.slice(name, i + 1, j - i)
    ends = F.flatten(F.transform(F.sequence(F.lit(1), F.col("m")), lambda j: F.transform(F.sequence(F.greatest(F.lit(0), j - cap), j - 1), lambda i: F.struct(i.alias("i"), j.alias("j")))))
    # exploded as outer, so that no test of sizes makes the spans once more
    spans = rows.select("*", F.explode_outer(F.when(F.col("m") >= least, ends)).alias("s")).select("doc_id", "slide_no", "m", "s.i", "s.j", *[part(c, F.col("s.i"), F.col("s.j")).alias(c) for c in ("bullets", "sets", "counted")], "apart")
    # relations that may reach over a bullet's end (no mark there, or an if) are counted in the joined text
    sums = lambda name: F.aggregate("counted", F.lit(0), lambda t, c: t + c[name])
    relations = F.when(F.col("apart"), sums("r")).otherwise(F.regexp_count(F.array_join("bullets", " "), F.lit(S.RELATIONAL)))
    spans = spans.withColumns({"concepts": F.array_distinct(F.flatten("sets")), "sorted": F.sort_array(F.flatten("sets")), "n": F.size("bullets"), "relations": relations, "n_words": sums("n")})
    spans = spans.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (x == F.get("sorted", i - 1)))))
    # a bullet beside the others: without a title only the words that another bullet has too
    shared = F.transform("sets", lambda s: F.when(F.size("concepts") == 0, 0.0).otherwise(F.size(F.array_intersect(s, F.col("twice"))).cast("double") / F.size("concepts")))
    redundancy = F.when(F.col("twice").isNotNull() & F.col("concepts").isNotNull(), F.when(F.size("twice") == 0, 0.0).otherwise(F.aggregate(shared, F.lit(0.0), lambda t, x: t + x) / F.col("n")))
    information = F.bround(F.aggregate(F.transform("concepts", idf_guess), F.lit(0.0), lambda a, x: a + x), 6)
    e = S.efficiency(information, redundancy, F.lit(False))
    load = S.load_of(F.size("concepts").cast("double"), F.col("relations"), F.col("n_words"), F.col("n"), F.lit(0), F.lit(0.0))
    over = F.greatest(F.lit(0), F.col("n") - target).cast("double")
    return spans.select("doc_id", "slide_no", "m", "i", "j", F.bround(load + S.EMPTY_COST * (1.0 - e) + S.OVER_COST * over * over, 9).alias("cost"))


def segments(slides: DataFrame, cap: int = 5) -> DataFrame:
    """Pages of each slide's bullets with the least total cost of load and pages, at most ``cap`` bullets a page; none is lost.

    The best cost of each prefix is found by a fold over the costs of spans, which are made per slide; of equal costs the earliest
    cut stands. A slide that fits on a page as it is stays one, so no costs are made for it.
    """
    target = max(1, min(cap, round(cap * 0.75)))
    costs = group_costs(slides, cap, target, cap + 1)
    listed = costs.groupBy("doc_id", "slide_no").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("j", "i", "cost"))).alias("spans"))
    # state: best[k] and cuts[k] for prefixes 0..k; spans come by end, then by start
    zero = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.array().cast("array<int>")).alias("cuts"))

    def step(state, s):
        value = F.get(state["best"], s["i"]) + s["cost"] + S.SLIDE_COST
        path = F.concat(F.get(state["cuts"], s["i"]), F.array(s["j"]))
        fresh = F.size(state["best"]) == s["j"]
        better = F.coalesce(value < F.get(state["best"], s["j"]), F.lit(False))
        grown = F.struct(F.concat(state["best"], F.array(value)).alias("best"), F.concat(state["cuts"], F.array(path)).alias("cuts"))
        changed = F.struct(F.concat(F.slice(state["best"], F.lit(1), s["j"]), F.array(value)).alias("best"), F.concat(F.slice(state["cuts"], F.lit(1), s["j"]), F.array(path)).alias("cuts"))
        return F.when(fresh, grown).when(better, changed).otherwise(state)

    folded = listed.select("doc_id", "slide_no", "m", F.aggregate("spans", zero, step).alias("f"))
    cuts = F.when(F.col("m") <= cap, F.array("m")).otherwise(F.get(F.col("f.cuts"), F.col("m")))
    return folded.select("doc_id", "slide_no", F.col("m").alias("n_bullets"), F.array_join(cuts, ",").alias("page_ends"), F.size(cuts).alias("n_pages"))
