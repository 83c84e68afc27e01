"""Global running totals without a single-task window.

Rows are dealt by range of their order, each part is summed on its own, and the parts' totals (one row a part) give
each part its offset. Only the columns named travel; texts never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.common import shuffle_partitions, staged


#: Rows that a part holds at most, about; small tables keep the session's number of shuffle partitions.
ROWS_A_PART = 1 << 22


def running_totals(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Append ``_before`` (sum of ``value`` over all earlier rows), ``_index`` (rows before) and ``_total``.

    ``order``: sort columns. Rows that tie in all of them are split by their place in the input, so a key that holds
    most rows still spreads over tasks; such rows are interchangeable. An empty input gives an empty result.
    """
    spark = df.sparkSession
    salted = staged(df.withColumn("_salt", F.monotonically_increasing_id()))
    n_parts = max(shuffle_partitions(spark), -(-salted.count() // ROWS_A_PART))
    placed = staged(salted.repartitionByRange(n_parts, *order, F.col("_salt")).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(everything), F.lit(0)).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order, F.col("_salt"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    # one row a part: some tens of bytes for each ROWS_A_PART rows
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_before", F.coalesce(F.sum(value).over(so_far), F.lit(0)) + F.col("_sum0"))
        .withColumn("_index", F.row_number().over(inside) - 1 + F.col("_n0"))
        .drop("_part", "_salt", "_sum0", "_n0")
    )
