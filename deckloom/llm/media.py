"""Operator 7: interleaved documents with media columns.

HTML becomes an ordered sequence of text and media references; payloads live in a table of their own, once for each
digest, and references meet them by digest. Payloads are stored as 8-bit gray images (binary PGM) of ``WIDTH`` samples a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import BROADCAST_BYTES, col, free_names, mapped, split_hot, staged, text_or_empty, typed

WIDTH = 576
PAD = 255
#: Tags whose content is no text of the document.
HIDDEN = frozenset(("script", "style", "template", "noscript", "head"))
#: Tags that end a run of text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))

#: Parts of one digest beyond which it counts as hot; bytes of a row of ``media`` (features, not payloads); tasks that share a hot digest.
HOT_PARTS, MEDIA_ROW_BYTES = 256, 512

PART = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
PART_SQL = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


class _Parts(HTMLParser):
    """Collects parts in document order; a figure's caption goes to the figure's media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[int] = []
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"pos": len(self.parts), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.flush()
                self.parts.append({"pos": len(self.parts), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or None})
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(len(self.parts))
        if tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            media = [p for p in self.parts[self.figures[-1] :] if p["kind"] == "media"] if self.figures else []
            for part in media:
                part["caption"] = caption or part["caption"]
            if caption and not media:
                self.text.append(caption)
        if tag in BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_parts(html: str | None) -> list[dict]:
    """Ordered parts of one document. Null or empty html has none; unclosed tags end with the text."""
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    if parser.caption:
        parser.text += parser.caption
    parser.flush()
    return parser.parts


def interleaved(docs: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``parts``: the array of (pos, kind, text, ref, caption) of each row's html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([parse_parts(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.list_(PART))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], parts], names=[*keep, "parts"])

    (html,) = free_names(list(keep), "html")
    return mapped(docs.select(*map(col, keep), col(html_col).alias(html)), run, ", ".join([*typed(docs, list(keep)), f"parts {PART_SQL}"]))


def resolve(parts: DataFrame, media: DataFrame, id_col: str, media_cols: tuple[str, ...] = ("media",)) -> DataFrame:
    """One row a part, in place: id, pos, kind, text, caption, digest and the columns of ``media`` (keyed by digest).

    A reference whose payload is missing keeps its row with nulls, so positions and captions stay aligned. ``media`` has one
    row a digest. Digests of more than ``HOT_PARTS`` parts are counted first, with partial sums: the rows of ``media`` of the most
    frequent, as many as fit at any number of parts, are broadcast, so no task gets all parts that share a payload; the rest meet in an equi-join.
    """
    rows = parts.select(col(id_col), F.explode_outer("parts").alias("p")).select(col(id_col), "p.*")
    digest = F.regexp_extract(F.coalesce("ref", F.lit("")), r"^media:([0-9a-f]{64})$", 1)
    rows = staged(rows.withColumn("digest", F.when(digest != "", digest)).drop("ref"))
    own = media.select(F.col("digest").alias("_digest"), *media_cols)
    counts = staged(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PARTS).select(F.col("digest").alias("_hot"), "n"))
    hot = split_hot(counts, "n", BROADCAST_BYTES // MEDIA_ROW_BYTES)[0].drop("n")
    few = F.broadcast(staged(own.join(F.broadcast(hot), F.col("_digest") == F.col("_hot")).drop("_hot")))
    is_hot = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    shared = is_hot.where("_hot IS NOT NULL").drop("_hot").join(few, F.col("digest") == F.col("_digest"), "left")
    rest = is_hot.where("_hot IS NULL").drop("_hot").join(own, F.col("digest") == F.col("_digest"), "left")
    return shared.unionByName(rest).drop("_digest")


def padded(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of ``WIDTH``."""
    return payload + bytes([PAD]) * (-len(payload) % WIDTH if payload else WIDTH)


def to_image(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def from_image(image: bytes | memoryview) -> memoryview:
    """The samples of a binary PGM; ValueError if its head and size don't fit."""
    view = memoryview(image).cast("B")
    head = bytes(view[:64]).split(b"\n", 3)
    if len(head) < 4 or head[0] != b"P5" or head[2] != b"255":
        raise ValueError("not an 8-bit binary PGM")
    width, height = map(int, head[1].split())
    start = len(head[0]) + len(head[1]) + len(head[2]) + 3
    if len(view) - start != width * height:
        raise ValueError(f"{len(view) - start} samples, not {width} x {height}")
    return view[start:]


def image_features(samples: memoryview) -> str:
    """A 16-bin histogram of the samples in parts per thousand, their mean and the rows."""
    values = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(values >> 4, minlength=16)
    bins = ",".join(str(int(c) * 1000 // len(values)) for c in counts)
    return f"rows={len(values) // WIDTH};mean={int(values.sum(dtype=np.int64)) * 100 // len(values)};hist={bins}"


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Write the texts' payloads as images; returns the stored table (digest, n_bytes, media).

    A digest is stored once for each task that meets it; ``media_table`` leaves one. Payloads are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for value in batch.column(0):
                raw = value.as_buffer().to_pybytes()
                digest = hashlib.sha256(raw).digest()
                if digest in seen:
                    continue
                if len(seen) >= 1 << 17:  # what is forgotten is only stored once more
                    seen.clear()
                seen.add(digest)
                rows.append((digest.hex(), len(raw), to_image(padded(raw))))
                size += len(raw)
                if size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        digests, sizes, images = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digests), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["digest", "n_bytes", "media"])

    return staged(mapped(docs.select(text_or_empty(col(text_col)).cast("binary").alias("payload")), run, "digest string, n_bytes long, media binary"))


def media_table(stored: DataFrame) -> DataFrame:
    """One row a digest of a stored table."""
    return stored.dropDuplicates(["digest"])


def media_features(stored: DataFrame) -> DataFrame:
    """Reads the stored bytes back: digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; one row a digest.

    A payload that does not give its digest raises.
    """
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n_bytes, image in zip(*batch.columns, strict=True):
                stored_form = memoryview(image.as_buffer()).cast("B")
                samples = from_image(stored_form)
                if hashlib.sha256(samples[: n_bytes.as_py()]).hexdigest() != digest.as_py():
                    raise ValueError(f"stored payload {digest.as_py()} does not have its digest")
                rows.append((digest.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored_form), hashlib.sha256(stored_form).hexdigest(), image_features(samples)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = mapped(stored, run, schema)
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def figure_html(digest: Column, caption: Column) -> Column:
    """The html of a document whose payload is one figure."""
    return F.concat(F.lit('<article><figure><img src="media:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as media, referred to from html, parsed, resolved by digest and read back.

    Features are computed where the stored payloads are read, so the digest join moves a short row a digest, not payloads.
    Returns id, pos, caption and the columns of ``media_features``. Null texts are empty payloads (one row of 255s); equal texts
    share one stored payload and all values; repeated rows and null ids come back as often as given; an empty table gives no rows.
    """
    stored = store_media(docs, text_col)
    text = text_or_empty(text_col)
    digest = F.sha2(text.cast("binary"), 256)
    page = docs.select(col(id_col), figure_html(digest, F.concat(F.octet_length(text), F.lit(" bytes"))).alias("html"))
    parts = interleaved(page, "html", (id_col,))
    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return resolve(parts, media_features(stored), id_col, columns).select(col(id_col), "pos", "caption", *columns)
