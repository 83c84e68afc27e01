"""Which of many strings each text holds: one reading of a text by an automaton, or by shared letters where the strings are too many for one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings of so many characters in all go to all tasks as one automaton.
SENT_CHARS = 4 << 20


def held(rows: DataFrame, key: str, text: str, strings: DataFrame, string: str) -> DataFrame:
    """(``key``, held): each of the distinct ``strings`` (not empty) that the text of a row holds anywhere, once a row.

    The strings are counted first: up to ``SENT_CHARS`` characters an automaton of them reads each text once; beyond, a string is met by its first three letters among those of the text (shorter ones
    by their first), in an equi-join. Texts and strings are never paired. Null texts hold nothing.
    """
    wanted = strings.where(F.col(string) != "").select(F.col(string).alias("held")).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("held")), F.lit(0))).first()[0]
    texts = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    if size > SENT_CHARS:
        gram = F.when(F.length("held") >= 3, F.substring("held", 1, 3)).otherwise(F.substring("held", 1, 1))
        grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.array(F.substring("text", i, F.lit(1)), F.substring("text", i, F.lit(3))))))
        met = texts.where("text <> ''").withColumn("gram", F.explode(grams)).join(wanted.withColumn("gram", gram), "gram")
        return met.where(F.contains("text", F.col("held"))).select(key, "held").distinct()
    shared = rows.sparkSession.sparkContext.broadcast([r["held"] for r in wanted.collect()])  # at most ``SENT_CHARS`` characters
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for s in shared.value:
            known.add_word(s, s)
        if shared.value:
            known.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist() if shared.value else ()):
                for s in {v for _, v in known.iter(t)}:
                    at.append(i)
                    found.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "held"])

    return texts.mapInArrow(run, f"{key} {kind}, held string")
