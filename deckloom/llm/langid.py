"""Operator 6: language by compression with a dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import col, free_names, hash_bits, mapped, typed
from deckloom.llm.text import give_back

#: Bounds of what is learned: documents a language, bytes of a piece from each, bytes of a dictionary.
SAMPLE_DOCS, PIECE_CHARS, DICT_BYTES = 600, 220, 131072
LEVEL = 5
#: Compressed with each text, so that short ones make a compressed block too and their sizes can differ.
PAD = b" " * 64
#: Texts are compressed in equal blocks of at most so many bytes, each with the whole dictionary: it counts alike at any length.
BLOCK_BYTES = 1 << 14
#: A prediction is rejected if the best size is within this share of the second best.
MIN_MARGIN = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of ``labelled``: about ``sample_docs`` pieces a language.

    Languages are counted over all rows; rows are then chosen by a hash of their piece, so reruns agree, copies count
    once and no language's rows gather anywhere. The order of the result is by falling count: ties go to the first.
    """
    known = labelled.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(col(lang_col)).count().collect()}
    if not counts:
        return {}
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, 2.0 * sample_docs / n)) for lang, n in counts.items()], "_lang string, _share double")
    at = hash_bits(col(text_col), seed=6)
    room = F.greatest(F.length(col(text_col)) - PIECE_CHARS + 1, F.lit(1))
    rows = known.select(col(lang_col).alias("_l"), at.alias("_at"), col(text_col).alias("_text"), room.alias("_room"))
    chosen = rows.join(F.broadcast(shares), F.col("_l") == F.col("_lang")).where(F.pmod("_at", F.lit(1 << 30)) < F.col("_share") * float(1 << 30))
    pieces = chosen.select("_lang", F.lower(F.expr(f"substring(_text, cast(1 + pmod(shiftright(_at, 31), _room) as int), {PIECE_CHARS})")).alias("piece"), "_at").groupBy("_lang", "piece").agg(F.min("_at").alias("_at"))
    found: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    limit = 3 * sample_docs * len(counts)  # about twice what is expected
    for row in pieces.orderBy("_at", "_lang", "piece").limit(limit).collect():
        if len(found[row["_lang"]]) < sample_docs:
            found[row["_lang"]].append(row["piece"].encode("utf-8", "replace"))
    return {lang: b" ".join(p)[:DICT_BYTES] for lang, p in found.items() if p}


def packers(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in dictionaries.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False)))
    return made


def classify(text: bytes, made: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """The language whose dictionary makes the text's blocks smallest in sum, and the saving against the second in [0, 1]."""
    raw = text.decode("utf-8", "replace").lower().encode("utf-8", "replace") + PAD
    size = -(-len(raw) // -(-len(raw) // BLOCK_BYTES))
    blocks = [raw[at : at + size] for at in range(0, len(raw), size)]
    sizes = [sum(len(packer.compress(block)) for block in blocks) for _, packer in made]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = [s for k, s in enumerate(sizes) if k != best]
    return made[best][0], (min(others) - sizes[best]) / min(others) if others else 1.0


def _predicted(docs: DataFrame, dictionaries: dict[str, bytes], cols: list[str], text_col: str, pred: str, score: str) -> DataFrame:
    """``cols``, and the predicted language and its score under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = packers(shared.value)
        for batch in batches:
            *rest, letters, texts = batch.columns
            found = []
            for text, ok in zip(texts, letters, strict=True):
                found.append(classify(text.as_buffer().to_pybytes(), made) if ok.as_py() and made else (UNKNOWN, 0.0))
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*cols, pred, score])
            give_back()

    has_letter = F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False))
    letter, raw = free_names(cols, "letter", "raw")
    shaped = docs.select(*map(col, cols), has_letter.alias(letter), col(text_col).cast("binary").alias(raw))
    return mapped(shaped, run, ", ".join([*typed(docs, cols), f"{pred} string", f"{score} double"]))


def _rejected(pred: str, score: str, min_margin: float) -> Column:
    return (F.col(pred) == UNKNOWN) | (F.col(score) < min_margin)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, ``keep``, lang_pred, score, rejected) for every row, from its whole text.

    ``und`` with score 0, rejected, for null texts and those without a letter, and for all if no language was learned. Texts of
    any length, repeated rows and empty tables need no care; equal texts get equal results. Nothing but the text enters a prediction.
    """
    cols = [id_col, *[c for c in keep if c != id_col]]
    pred, score = free_names(cols, "lang_pred", "score")
    out = _predicted(docs, dictionaries, cols, text_col, pred, score)
    return out.select(*map(col, cols), F.col(pred).alias("lang_pred"), F.col(score).alias("score"), _rejected(pred, score, min_margin).alias("rejected"))


def accepted_documents(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected. The text goes through Python once and unchanged.

    Null texts and texts without a letter go; repeated rows stay as often as given; columns may have any name and type; an empty table
    gives no rows.
    """
    pred, score = free_names(docs.columns, "lang_pred", "score")
    return _predicted(docs, dictionaries, docs.columns, text_col, pred, score).where(~_rejected(pred, score, min_margin)).select(*map(col, docs.columns))
