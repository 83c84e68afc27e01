"""Pages as tables of spans (doc, page, x0, y0, x1, y1, size, text): furniture, body size, columns, reading order, clusters of indents, lines outside tables,
chapters and slide-like documents. All by windows and groups within a page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.phrases import blanks

TOP, BOTTOM, WIDE, TOLERANCE = 0.12, 0.86, 0.62, 9.0


def band_furniture(spans: DataFrame, height: float, least: int = 3, share: float = 0.3) -> DataFrame:
    """(doc, band, norm): texts in the top or bottom band of at least ``least`` and ``share`` of a document's pages."""
    band = F.when(F.col("y1") < height * TOP, "top").when(F.col("y0") > height * BOTTOM, "bottom")
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    pages = spans.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"))
    seen = spans.select("doc", "page", band.alias("band"), norm.alias("norm")).where("band IS NOT NULL AND norm <> ''").groupBy("doc", "band", "norm").agg(F.count_distinct("page").alias("on"))
    return seen.join(pages, "doc").where((F.col("on") >= least) & (F.col("on") >= F.floor(share * F.col("n_pages")))).select("doc", "band", "norm", "on")


def body_sizes(spans: DataFrame) -> DataFrame:
    """(doc, modal, middle): the size that most characters have, the larger of equals, and the median size of the spans."""
    by_size = spans.groupBy("doc", F.bround("size", 0).alias("s")).agg(F.sum(F.length("text")).alias("chars"))
    modal = by_size.groupBy("doc").agg(F.max_by("s", F.struct("chars", "s")).alias("modal"))
    return modal.join(spans.groupBy("doc").agg(F.percentile("size", 0.5).alias("middle")), "doc")


def decorations(images: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """(doc, digest): images on at least ``least`` and ``share`` of a document's pages."""
    pages = images.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"))
    on = images.groupBy("doc", "digest").agg(F.count_distinct("page").alias("on"))
    return on.join(pages, "doc").where((F.col("on") >= least) & (F.col("on") >= share * F.col("n_pages"))).select("doc", "digest")


def _column_kind(width: float) -> Column:
    return F.when(F.col("x1") - F.col("x0") > width * WIDE, "wide").when(F.col("x1") < width / 2 * 1.06, "left").when(F.col("x0") > width / 2 * 0.94, "right")


def page_columns(spans: DataFrame, width: float) -> DataFrame:
    """(doc, page, columns): two if both sides have two blocks, four in all, and at most half as many span the page."""
    kind = _column_kind(width)
    counts = spans.groupBy("doc", "page").agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in ("left", "right", "wide")])
    sided = F.col("left") + F.col("right")
    two = (sided >= 4) & (F.col("left") >= 2) & (F.col("right") >= 2) & (F.col("wide") <= sided * 0.5)
    return counts.select("doc", "page", F.when(two, 2).otherwise(1).alias("columns"))


def reading_order(spans: DataFrame, width: float) -> DataFrame:
    """Spans with ``place`` on their page: column by column on pages of two, else top to bottom. Columns are counted by windows over the page."""
    page = Window.partitionBy("doc", "page")
    rows = spans.withColumn("kind", _column_kind(width))
    n = {k: F.count(F.when(F.col("kind") == k, 1)).over(page) for k in ("left", "right", "wide")}
    sided = n["left"] + n["right"]
    two = (sided >= 4) & (n["left"] >= 2) & (n["right"] >= 2) & (n["wide"] <= sided * 0.5)
    rows = rows.withColumn("two", two)
    column = F.when(~F.col("two") | (F.coalesce("kind", F.lit("")) == "wide"), 0).when(F.col("x1") < width / 2 * 1.06, 1).otherwise(2)
    rows = rows.withColumn("column", column)
    return rows.withColumn("place", F.row_number().over(page.orderBy("column", F.bround("y0", 1), "x0", "text"))).drop("kind", "two")


def indent_levels(spans: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, page, x0, level): each indent of a page with the nearest of its anchors, numbered from the left, three at most. An anchor is an indent over
    ``tolerance`` right of the anchor before: a fold over the page's sorted indents."""
    indents = spans.groupBy("doc", "page").agg(F.array_sort(F.collect_set("x0")).alias("xs"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.concat(acc, F.array(x)))
    rows = indents.withColumn("anchors", F.aggregate("xs", F.array().cast("array<double>"), step))
    spread = rows.select("doc", "page", "anchors", F.explode("xs").alias("x0"))
    gaps = F.transform("anchors", lambda a: F.abs(a - F.col("x0")))
    return spread.select("doc", "page", "x0", F.least(F.lit(3), F.array_position(gaps, F.array_min(gaps)).cast("int") - 1).alias("level"))


def outside_tables(spans: DataFrame, tables: DataFrame, margin: float = 2.0) -> DataFrame:
    """Spans whose middle is in no table box (doc, page, bx0, by0, bx1, by1) of their page. A page has few boxes."""
    x, y = (F.col("s.x0") + F.col("s.x1")) / 2, (F.col("s.y0") + F.col("s.y1")) / 2
    inside = x.between(F.col("t.bx0") - margin, F.col("t.bx1") + margin) & y.between(F.col("t.by0") - margin, F.col("t.by1") + margin)
    return spans.alias("s").join(tables.alias("t"), (F.col("s.doc") == F.col("t.doc")) & (F.col("s.page") == F.col("t.page")) & inside, "left_anti")


def chapters(pages: DataFrame, pattern: str = r"(?i)^(?:chapter|unit|module)\s+\d+") -> DataFrame:
    """(doc, chapter, title, first_page, n_pages): pages under the last heading that names a chapter; pages before the first form the front matter."""
    order = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("title").rlike(pattern)
    rows = pages.withColumns({"chapter": F.sum(opens.cast("int")).over(order), "head": F.last(F.when(opens, F.col("title")), ignorenulls=True).over(order)})
    return rows.groupBy("doc", "chapter").agg(F.coalesce(F.max("head"), F.lit("Front matter")).alias("title"), F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n_pages"))


def is_slide_style(pages: DataFrame) -> DataFrame:
    """(doc, slide_style): documents of twelve pages or more of which 70 % of up to fifteen evenly spaced ones have up to 140 words."""
    whole = Window.partitionBy("doc")
    rows = pages.select("doc", (F.row_number().over(whole.orderBy("page")) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("n"), F.size(blanks(F.col("text"))).alias("words"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 15)).cast("int")
    sampled = rows.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 15))
    return sampled.groupBy("doc").agg(((F.max("n") >= 12) & (F.count(F.when(F.col("words") <= 140, 1)) >= 0.7 * F.count(F.lit(1)))).alias("slide_style"))
