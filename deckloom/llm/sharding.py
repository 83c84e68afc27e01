"""Operator 9: contiguous shards of near-equal byte size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import col, free_names, staged, text_or_empty
from deckloom.llm.prefix import running_totals

#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def balanced_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into ``n_shards`` contiguous runs of ``id_col`` whose byte sizes are near equal.

    The rows' sizes (UTF-8 bytes of the text, plus 16) are summed over the whole table in the order of the id; the row
    whose middle byte lies in the k-th of ``n_shards`` equal stretches goes to shard k, so a shard's size is within one
    row of the mean. Native: DataFrame functions only; only id, size and checksum are shuffled.

    Returns id, ``size``, ``text_crc32``, ``shard``, ``slot`` (0, 1, ... within the shard).

    Null ids come first; null texts count as empty; repeated rows and equal ids are separate rows that lie side by
    side; one row far above the mean leaves shards beside it small or empty; an empty table gives no rows; other
    columns are not looked at.
    """
    return _dealt(_narrow(docs, id_col, text_col), n_shards).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _narrow(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(_id, size, text_crc32, ``keep``) of each row."""
    text = text_or_empty(col(text_col))
    return docs.select(col(id_col).alias("_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *map(col, keep))


def _dealt(narrow: DataFrame, n_shards: int) -> DataFrame:
    """``narrow`` with shard and slot."""
    order = [F.col("_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    totals = running_totals(narrow, order, "size")
    dealt = totals.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * _before + size) * {n_shards}) div (2 * _total)")).cast("int"))
    starts = dealt.groupBy(F.col("shard").alias("_of")).agg(F.min("_index").alias("_start"))
    # at most n_shards rows
    return dealt.join(F.broadcast(starts), F.col("shard") == F.col("_of")).withColumn("slot", F.col("_index") - F.col("_start"))


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Write the documents as Parquet under ``path/shard=K``; rows of one shard stay in the order of their slots.

    Rows are numbered in a staged table, and the numbers, not keys that many rows may share, bring each row its shard: no task has more than its part of rows, and a
    lost task finds the same numbers again. Texts are staged and then shuffled to their shard. Null, empty and very long texts, repeated rows and null ids are rows like others; an empty table writes no
    shard. A column of ``docs`` named as ``shard_col`` would clash with the folders' and raises.
    """
    if shard_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {shard_col}: name another one for the folders")
    row, of_row, slot = free_names([*docs.columns, shard_col], "row", "of_row", "slot")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = _dealt(_narrow(numbered, id_col, text_col, row), n_shards).select(col(row).alias(of_row), F.col("shard").alias(shard_col), F.col("slot").alias(slot))
    joined = numbered.join(placed, F.col(row) == F.col(of_row)).select(*map(col, docs.columns), col(shard_col), slot)
    dealt = joined.repartitionByRange(n_shards, col(shard_col), slot).sortWithinPartitions(col(shard_col), slot)
    dealt.drop(slot).write.partitionBy(shard_col).parquet(path)
