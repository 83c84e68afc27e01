"""A corpus pipeline of five stages over ``documents``: language, lines, near duplicates, mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and rereads it as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm import jaccard, langid, linededup, mixing, pieces
from deckloom.llm.common import freed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. Learned from the rows that are not held out; no prediction uses the labels."""
    known = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accepted_documents(docs.select(*COLUMNS), known)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that came before; a document none of whose lines is left goes. ``n_chars`` follows the text."""
    done = linededup.dedup_lines(docs)
    return done.where((F.col("n_kept") > 0) | (F.col("n_lines") == 0)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by the sources' target weights: a row for each time that a document is taken."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row."""
    return pieces.encode_texts(docs).select("doc_id", "token_ids", "n_tokens", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: Compression sizes, edit distance and token ids are beyond SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; tables that only a finished stage needed are removed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with freed(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
