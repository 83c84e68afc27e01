"""Tables and the document model: a document is a deck, each of its lines with text is a slide.

A slide's first sentence is its title and the others are its bullets, so everything that needs neighbours or an order is
partitioned by document: no partition grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.functions.text import sentences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(docs: DataFrame) -> DataFrame:
    """(doc_id, slide_no, body, sents, title, bullets): ``slide_no`` counts lines with text from 1."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # exploded with nulls, which are left out then: a plain explode makes the optimiser test sizes first, which makes all arrays twice
    rows = docs.select("doc_id", F.posexplode_outer(lines).alias("pos", "body")).where("pos IS NOT NULL")
    rows = rows.select("doc_id", (F.col("pos") + 1).alias("slide_no"), "body", sentences(F.col("body")).alias("sents"))
    return rows.select("*", F.col("sents")[0].alias("title"), F.slice("sents", F.lit(2), F.greatest(F.size("sents") - 1, F.lit(0))).alias("bullets"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, slide_no, sent_no, title, sent): one row a sentence."""
    return slides(docs).select("doc_id", "slide_no", "title", F.posexplode_outer("sents").alias("pos", "sent")).where("pos IS NOT NULL").select("doc_id", "slide_no", (F.col("pos") + 1).alias("sent_no"), "title", "sent")


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file or array element; malformed records are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ratings with ``||``-joined bullets; the score is scaled to 0..1 by the file's least and largest."""
    rows = spark.read.option("header", True).schema("title string, bullets string, takeaway string, layout_type string, score double").csv(path)
    span = rows.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = rows.join(F.broadcast(span))
    return scaled.select("title", F.split("bullets", r"\|\|").alias("bullets"), "takeaway", "layout_type", F.expr("coalesce(try_divide(score - low, high - low), 0.5)").alias("score"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of whole text or markdown files; binary files are decoded with a fallback."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.select("path", F.regexp_replace(decode_text(F.col("content")), "\r\n?", "\n").alias("markdown"))


# What code page 1252 has where Latin-1 has control characters; five of these bytes stand for nothing there.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def decode_text(content):
    """UTF-8 (its mark removed) or UTF-16 by byte order mark, else code page 1252, or Latin-1 if a byte stands for nothing in it."""
    utf16 = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, "iso-8859-1")
    western = F.when(latin.rlike(r"[\x81\x8D\x8F\x90\x9D]"), latin).otherwise(F.translate(latin, _CP1252_BYTES, CP1252))
    return F.when(utf16, F.decode(content, "UTF-16")).otherwise(F.coalesce(F.regexp_replace(utf8, "^﻿", ""), western))
