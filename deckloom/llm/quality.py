"""Operator 10: quality rules joined by weak supervision."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import col, free_names, mapped, staged
from deckloom.llm.text import Words, give_back, groups, mixed

#: Base rules: fewer words, or more than so many percent of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: A document is kept if its posterior probability of good quality is at least this.
MIN_POSTERIOR = 0.5
EM_STEPS = 100

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_chars", "n_short_lines", "n_distinct_words")

_CONT = np.zeros(256, dtype=bool)
_CONT[0x80:0xC0] = True
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter (category L)."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def is_letter(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether a letter begins there."""
    after = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    a, b, c, d = (after[k : k + len(data)] for k in range(4))
    tail = lambda x: x & 0x3F
    point = np.select([a < 0x80, a < 0xC0, a < 0xE0, a < 0xF0], [a, 0, (a & 0x1F) << 6 | tail(b), (a & 0x0F) << 12 | tail(b) << 6 | tail(c)], (a & 0x07) << 18 | tail(b) << 12 | tail(c) << 6 | tail(d))
    return _letters()[np.minimum(point, sys.maxunicode)]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text: words that lie in a window of ``WINDOW`` words which the text has twice or more."""
    found, at = words.windows(hashes, WINDOW)
    keyed = mixed(found ^ mixed(words.row[at].astype(np.uint64) + np.uint64(1)))  # equal only within one text
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(keyed), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.row[inside], minlength=len(words.per_row))


def _distinct(words: Words, hashes: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, words.row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])
    return np.bincount(words.row[order][new], minlength=len(words.per_row))


def _line_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Per text: lines with a word, those equal to an earlier one, and those of under 30 bytes."""
    every, dups, short = [], [], []
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        every.append(len(lines))
        dups.append(len(lines) - len(set(lines)))
        short.append(sum(len(x) < 30 for x in lines))
    return every, dups, short


def features(column: pa.Array) -> list[np.ndarray]:
    """``FIELDS`` of each text. Nulls are empty."""
    parts: list[list] = [[] for _ in FIELDS]
    for _, _, data, offsets in groups(column):
        words = Words(data, offsets)
        hashes = words.hashes(lower=False)
        chars = np.concatenate(([0], np.cumsum(~_CONT[data], dtype=np.int64)))
        word_chars = np.bincount(words.row, weights=chars[words.stop] - chars[words.start], minlength=len(words.per_row)).astype(np.int64)
        lines, dups, short = _line_counts(data, offsets)
        values = (words.per_row, word_chars, _per_row(_IS_SYMBOL[data], offsets), dups, _repeated(words, hashes), lines, _per_row(is_letter(data), offsets), chars[offsets[1:]] - chars[offsets[:-1]], short, _distinct(words, hashes))
        for part, v in zip(parts, values, strict=True):
            part.append(np.asarray(v, dtype=np.int64))
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``FIELDS``) of every document, in one pass over the texts."""
    if id_col in FIELDS:
        raise ValueError(f"{id_col} is the name of a result")
    (own,) = free_names(FIELDS, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, features(batch.column(1)))], names=[own, *FIELDS])
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    # bytes, not strings: an unpaired surrogate in a text can't stop the pass
    shaped = docs.select(col(id_col).alias(own), col(text_col).cast("binary").alias("text"))
    return mapped(shaped, run, f"{own} {kind}, " + ", ".join(f"{f} long" for f in FIELDS)).withColumnRenamed(own, id_col)


#: Each rule votes 1 (good), -1 (poor) or 0 (abstains), over all documents with a word.
def rule_votes() -> dict[str, Column]:
    words, chars = F.col("n_words"), F.greatest(F.col("n_chars"), F.lit(1))
    mean = F.col("word_chars") / F.greatest(words, F.lit(1))

    def vote(good: Column, poor: Column) -> Column:
        return F.when(poor, -1).when(good, 1).otherwise(0)

    return {
        "symbols": vote(100 * F.col("n_symbols") <= words, 10 * F.col("n_symbols") > words),
        "word_length": vote(mean.between(3.0, 8.0), (mean < 2.0) | (mean > 15.0)),
        "letters": vote(100 * F.col("n_letters") >= 76 * chars, 100 * F.col("n_letters") < 72 * chars),
        "dup_lines": vote((F.col("n_lines") >= 2) & (F.col("n_dup_lines") == 0), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": vote((words >= 50) & (F.col("n_repeat_words") == 0), 10 * F.col("n_repeat_words") > 3 * words),
        "short_lines": vote((F.col("n_lines") >= 3) & (10 * F.col("n_short_lines") <= 3 * F.col("n_lines")), (F.col("n_lines") >= 3) & (10 * F.col("n_short_lines") > 9 * F.col("n_lines"))),
        "variety": vote((words >= 50) & (10 * F.col("n_distinct_words") >= 3 * words), (words >= 50) & (10 * F.col("n_distinct_words") < 1 * words)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[float, np.ndarray]:
    """Expectation-maximisation for rules that err independently given the class.

    ``patterns`` (patterns x rules: 1, -1, 0) with their ``counts``. Returns the share of good documents and, for each
    class (poor, good) and rule, the probabilities of the votes -1 and 1 among the votes that it casts: abstaining says nothing about the
    class, so short documents, on which many rules abstain, aren't taken for poor ones. Starts from the majority of votes, which
    also fixes which class is the good one; sums are over all documents, so the fit does not depend on their order.
    """
    counts = counts.astype(float)
    total = max(counts.sum(), 1.0)
    score = patterns.sum(axis=1) / np.maximum(1, np.abs(patterns).sum(axis=1))
    good = np.clip(0.5 + 0.49 * score, 0.01, 0.99)
    share, table = 0.5, np.full((2, patterns.shape[1], 2), 0.5)
    for _ in range(steps):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = float(np.clip(weight[1].sum() / total, 0.01, 0.99))
        cast = np.stack([weight @ (patterns == v) + 1.0 for v in (-1, 1)], axis=2)
        table = cast / cast.sum(axis=2, keepdims=True)
        # a rule may be useless but not perverse: a poor vote is no likelier for a good document than for a poor one
        table[0, :, 0] = np.maximum(table[0, :, 0], table[1, :, 0])
        table[0, :, 1] = 1.0 - table[0, :, 0]
        new = posterior(patterns, share, table)
        if np.abs(new - good).max(initial=0.0) < 1e-9:
            break
        good = new
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of the good class for each pattern."""
    logs = np.log(table)
    each = [((patterns == -1) * logs[c, :, 0] + (patterns == 1) * logs[c, :, 1]).sum(axis=1) for c in (0, 1)]
    return 1.0 / (1.0 + np.exp(np.clip(each[0] + np.log(1 - share) - each[1] - np.log(share), -700, 700)))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Features, votes, base verdict, posterior and verdict of every document.

    The rules' votes make at most 3 ** rules patterns; those are counted over all documents, the accuracies are fitted on
    the counts by expectation-maximisation, and each pattern's posterior goes back to its documents.

    Null and empty texts have no words: they fail the base rules, have posterior null and take no part in the fit. Repeated
    rows count each. Documents with base words but no vote at all get the prior. An empty table gives no rows.
    """
    found = staged(document_features(docs, id_col, text_col))
    votes = rule_votes()
    code = sum(((v + 1) * 3**k for k, v in enumerate(votes.values())), F.lit(0))
    own_code, known_code = free_names(found.columns, "code", "known")
    coded = found.withColumn(own_code, F.when(F.col("n_words") > 0, code))
    # at most 3 ** rules rows reach the driver
    counted = coded.groupBy(F.col(own_code).alias("code")).agg(F.count(F.lit(1)).alias("n")).where("code IS NOT NULL").orderBy("code").collect()
    patterns = np.array([[r["code"] // 3**k % 3 - 1 for k in range(len(votes))] for r in counted], dtype=np.int64).reshape(-1, len(votes))
    share, table = fit(patterns, np.array([r["n"] for r in counted], dtype=np.int64))
    rows = [(int(r["code"]), float(p)) for r, p in zip(counted, posterior(patterns, share, table), strict=True)]
    known = docs.sparkSession.createDataFrame(rows, f"{known_code} int, posterior double")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # a row a pattern of votes
    joined = coded.join(F.broadcast(known), F.col(own_code) == F.col(known_code), "left")
    return joined.select(
        col(id_col),
        *FIELDS,
        *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()],
        base_failed.alias("base_failed"),
        "posterior",
        (~base_failed & F.coalesce(F.col("posterior") >= min_posterior, F.lit(False))).alias("kept"),
    )
