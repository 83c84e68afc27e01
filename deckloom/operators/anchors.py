"""Pictures and other assets to the sections they belong to: by title, then by shared words, then by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that say nothing of a section.
ASSET_STOP = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "was", "were", "be", "by", "as", "at", "from", "that", "this", "it",
    "its", "into", "than", "then", "but", "not", "can", "will", "step",
)
LEAST_SHARE = 0.25


def significant(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(list(ASSET_STOP))))


def anchored_assets(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc, asset, section, stage): the section (doc, section from 1, title, text) of each asset (doc, asset, title, text, place).

    'title': the first section of that title, case and rims aside. 'words': of the others those whose text shares at least a quarter of the smaller set of significant words with a section, the largest share and
    then the first. 'place': the section at the asset's place from 0 if there is one, else the first. Each stage sees only what the one before left; words meet through an index of the sections' words within
    a document, so a section that shares none is never looked at. Assets of documents without sections have no rows.
    """
    named = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    places = sections.select("doc", "section", named(F.col("title")).alias("name"), significant(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("words"))
    sizes = places.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    rows = assets.join(sizes, "doc").select("doc", "asset", "place", "n", named(F.col("title")).alias("name"), significant(F.coalesce("text", F.lit(""))).alias("words"))
    titles = places.where("name <> ''").groupBy("doc", "name").agg(F.min("section").alias("by_title"))
    rows = rows.join(titles, ["doc", "name"], "left")
    left = rows.where("by_title IS NULL").select("doc", "asset", F.size("words").alias("n_own"), F.explode("words").alias("word"))
    index = places.select("doc", "section", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    shared = left.join(index, ["doc", "word"]).groupBy("doc", "asset", "section").agg((F.count(F.lit(1)) / F.least(F.first("n_own"), F.first("n_words"))).alias("share"))
    best = shared.where(F.col("share") >= LEAST_SHARE).groupBy("doc", "asset").agg((-F.max(F.struct("share", (-F.col("section")).alias("back")))["back"]).alias("by_words"))
    rows = rows.join(best, ["doc", "asset"], "left")
    by_place = F.when(F.col("place").between(0, F.col("n") - 1), F.col("place") + 1).otherwise(1)
    stage = F.when(F.col("by_title").isNotNull(), "title").when(F.col("by_words").isNotNull(), "words").otherwise("place")
    return rows.select("doc", "asset", F.coalesce("by_title", "by_words", by_place).cast("int").alias("section"), stage.alias("stage"))


def assets_of_sections(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc, section, image, images): each section with its first asset and all of them in order; sections without any have null and an empty array."""
    anchored = anchored_assets(sections, assets)
    held = anchored.groupBy("doc", "section").agg(F.array_sort(F.collect_list("asset")).alias("images"))
    rows = sections.select("doc", "section").join(held, ["doc", "section"], "left")
    images = F.coalesce("images", F.array().cast(held.schema["images"].dataType.simpleString()))
    return rows.select("doc", "section", F.get("images", F.lit(0)).alias("image"), images.alias("images"))


def place_of(order: Column) -> Column:
    """Places from 0 within a document."""
    return F.row_number().over(Window.partitionBy("doc").orderBy(order)) - 1
