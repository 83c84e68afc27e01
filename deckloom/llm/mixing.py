"""Operator 1: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.common import WORD, broadcast_if_small, col, free_names, staged, text_or_empty
from deckloom.llm.prefix import running_totals

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words, and no source (so no document) more than CAP times.
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: A row of the table of sources (name, totals, bounds) with a name of usual length stays below so many bytes.
SOURCE_ROW_BYTES = 256


def symbol_quality(text: Column) -> Column:
    """A quality weight in [0.1, 1] from the text alone: it falls with the share of ``#*$%&|<>`` among all characters."""
    text = text_or_empty(text)
    share = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")
    return 0.1 + 0.9 * (1.0 - F.least(F.lit(1.0), 20.0 * share))


def sampling_key(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """Efraimidis-Spirakis: ``-ln(u) / weight`` with u in (0, 1) from a digest of the id, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size): append rank, weight, target, epochs, remainder and ``_start``.

    Targets share ``share`` of all words by weight; one that would pass ``cap`` times its source stops there and the
    excess is shared again by weight. With sources sorted by cap / weight, the level at which the others settle is the
    largest of the levels that the running sums give, so no loop is needed. One row a source, however many documents: the
    windows over all sources run in one task, so what grows there is the number of sources, not the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    ranked = ranked.withColumn("_start", F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * share
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level)
    ranked = ranked.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("weight")))
    words = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("try_divide(floor(target + 0.5), source_size)")).otherwise(0.0)
    ranked = ranked.withColumn("epochs", F.floor(epochs))
    return ranked.withColumn("remainder", words - F.col("epochs") * F.col("source_size")).drop("_cap", "_level")


def sampled(docs: DataFrame, quality: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """All rows in their sampling order with ``_into`` (words of the source before the row), and the sources' targets."""
    narrow = docs.select(
        col(id_col).alias("doc_id"),
        col(source_col).alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        sampling_key(col(id_col), quality, seed).alias("_key"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    placed = staged(running_totals(narrow, order, "size"))
    targets = staged(source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"))))
    rows = placed.alias("p").join(broadcast_if_small(targets, SOURCE_ROW_BYTES).alias("t"), F.expr("p.source <=> t.source")).select("p.*", *[F.col(f"t.{c}") for c in ("source_size", "weight", "target", "epochs", "remainder", "_start")])
    return rows.withColumn("_into", F.col("_before") - F.col("_start")), targets


def mix_sources(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Complete epochs come first (every document of the source, that many times); the rest of a source's target is
    filled in the order of exponential keys scaled by quality, as far as the running word count reaches. The document at
    the bound gives its first words only, so a source's words equal its rounded target.

    Returns doc_id, source, size, source_size, weight, target, epochs, taken. Null source is a source of its own, last
    in order. Null and empty texts have size 0 and nothing taken; rows that repeat an id share its key and follow each
    other; a source without words has target 0. An empty table gives no rows. Other columns are ignored.
    """
    quality = symbol_quality(col(text_col)) if quality is None else quality
    rows, _ = sampled(docs, quality, id_col, text_col, source_col, seed)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("remainder") - F.col("_into")))
    return rows.select(
        F.col("doc_id").alias(id_col), "source", "size", "source_size", "weight", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix as whole documents: a row for each time a document is taken, with the input's columns.

    The document at a source's bound is taken if at least half of it fits. The running totals give one bounding key a
    source, and documents are chosen by comparing with it: texts are neither joined by id nor shuffled while the table
    of sources is below the broadcast bound. Repeated rows tie at the bound and go together; null and empty texts have no words and go with the
    epochs and as long as the bound isn't passed. Ids of any type, columns of any name; an empty table gives no rows.
    """
    quality = symbol_quality(col(text_col)) if quality is None else quality
    rows, targets = sampled(docs, quality, id_col, text_col, source_col, seed)
    # a null id sorts first in a struct, as it does in the sampling order
    mark = F.struct(F.col("_key").alias("k"), F.col("doc_id").alias("i"), F.col("size").alias("s"))
    last = rows.where(2 * F.col("_into") + F.col("size") <= 2 * F.col("remainder")).groupBy("source").agg(F.max(mark).alias("last"))
    of_source, epochs, bound, own, copy = free_names(docs.columns, "source", "epochs", "last", "own", "copy")
    bounds = targets.alias("t").join(last.alias("l"), F.expr("t.source <=> l.source"), "left").select(F.col("t.source").alias(of_source), F.col("t.epochs").alias(epochs), F.col("l.last").alias(bound))
    bounds = broadcast_if_small(staged(bounds), SOURCE_ROW_BYTES)
    key = F.struct(sampling_key(col(id_col), quality, seed).alias("k"), col(id_col).alias("i"), F.regexp_count(text_or_empty(col(text_col)), F.lit(WORD)).cast("long").alias("s"))
    joined = docs.withColumn(own, key).join(bounds, col(source_col).eqNullSafe(F.col(of_source)))
    copies = F.col(epochs) + F.when(F.col(own) <= F.col(bound), 1).otherwise(0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*map(col, docs.columns))
