"""Operator 5: WARC archives in Zstandard, written and read back.

An archive (``.warc.zst``) is a skippable frame with the dictionary, then one frame for each record. Archives are kept as
rows (archive, data) of a Parquet table in the shared folder, since executors have no other writer to any store;
``read_archives`` takes those rows or files found by ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import BROADCAST_BYTES, col, mapped, split_hot, staged, text_or_empty

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Archives close at so many bytes of records; one record may pass it.
ARCHIVE_BYTES = 4 << 20
#: The dictionary is trained on the archive's first records, up to these bounds (a tuning aid: results don't depend on it).
DICT_SAMPLES, DICT_SAMPLE_BYTES, DICT_BYTES = 200, 8192, 16384
LEVEL = 3

#: Bytes of a row of the table of repeated digests.
GROUP_ROW_BYTES = 96

DICT_FRAME_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
URN = "urn:page:"
DATE = "2020-01-01T00:00:00Z"


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, refers_to, is_revisit).

    Digests are counted after partial aggregation, and only those seen more than once meet the pages again. The most frequent of
    them, of which no more than fit can exist by the number of pages they need, are broadcast, so a payload that a third of all pages share is in no
    single task; where that leaves none, payloads aren't shuffled. The others meet their pages in an equi-join. Pages with the group's smallest id
    are all responses if that id repeats; a null id counts as the largest.
    """
    payload = text_or_empty(col(payload_col))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("digest"))
    large = F.octet_length("payload") >= MIN_REVISIT_BYTES
    groups = staged(rows.where(large).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select(F.col("digest").alias("_digest"), "first", "n"))
    same = large & (F.col("digest") == F.col("_digest"))
    hot, rest = split_hot(groups, "n", BROADCAST_BYTES // GROUP_ROW_BYTES)
    if rest is None:
        joined = rows.join(F.broadcast(hot), same, "left")
    else:
        met = rows.join(F.broadcast(hot), same, "left")
        others = met.where("_digest IS NULL").drop("_digest", "first", "n")
        joined = met.where("_digest IS NOT NULL").unionByName(others.join(rest, same, "left"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"), again.alias("is_revisit"))


def id_text(page_id: object) -> str:
    """An id as the end of a record's name: '' for null, numbers as they are, texts percent-encoded behind ``s:``."""
    return "" if page_id is None else "s:" + quote(page_id, safe="") if isinstance(page_id, str) else str(page_id)


def record(page_id: object, url: str | None, payload: bytes, digest: bytes, refers_to: object, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of its response (with the payload's length) and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{id_text(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest.hex()}"),
    ]
    if is_revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{URN}{id_text(refers_to)}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The dictionary's skippable frame, then one frame a record."""
    samples = [r[:DICT_SAMPLE_BYTES] for r in records[:DICT_SAMPLES]]
    dictionary = b""
    if len(samples) >= 16 and sum(map(len, samples)) >= 4 * DICT_BYTES:
        try:
            dictionary = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # samples too alike or too few for a dictionary: the archive goes without
            dictionary = b""
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_FRAME_MAGIC, len(dictionary)), dictionary, *map(packer.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and its blocks' headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(data):
            raise ValueError(f"frame at byte {at} is cut off")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError(f"frame at byte {at} has a reserved block")
        pos += 3 + (1 if kind == 1 else size)
        if head & 1:
            pos += 4 * checksum
            if pos > len(data):
                raise ValueError(f"frame at byte {at} is cut off")
            return pos


def split_records(data: bytes | memoryview) -> Iterator[bytes]:
    """The archive's records, one decoded frame each."""
    view = memoryview(data).cast("B")
    pos, own = 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view, 0)[0] == DICT_FRAME_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("the dictionary's frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        own = zstandard.ZstdCompressionDict(raw) if raw else None
        pos = 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=own)
    while pos < len(view):
        magic = struct.unpack_from("<I", view, pos)[0] if len(view) - pos >= 8 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            pos += 8 + struct.unpack_from("<I", view, pos + 4)[0]
            continue
        end = frame_end(view, pos)
        yield unpacker.decompressobj().decompress(view[pos:end])
        pos = end


def parse_record(raw: bytes) -> dict:
    """Fields of a record; ValueError if a header, a length or a digest does not hold."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content-length {size} does not fit a block of {len(rest) - 4}")
    out = {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    block = rest[:size]
    if "http" in fields.get("content-type", "") and out["record_type"] in ("response", "revisit"):
        http, mark, body = block.partition(b"\r\n\r\n")
        if not mark or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        lengths = [int(line.split(b":", 1)[1]) for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
        out["payload_bytes"] = lengths[0] if lengths else len(body)
        if out["record_type"] == "response" and len(body) != out["payload_bytes"]:
            raise ValueError(f"payload has {len(body)} bytes, its head says {out['payload_bytes']}")
    else:
        body, out["payload_bytes"] = block, size
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:").lower() or None
    if out["record_type"] == "response" and digest is not None and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("the payload does not have its digest")
    return out | {"payload": None if out["record_type"] == "revisit" else body, "payload_digest": digest}


def write_archives(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """One record for each row, in archives of about ``ARCHIVE_BYTES``; returns the stored table (archive, data)."""
    rows = revisits(pages, id_col, payload_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            data = archive(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()[:16]]), pa.array([data], pa.binary())], names=["archive", "data"])

        for batch in batches:
            ids, urls, payloads, digests, refers, again = batch.columns
            for k in range(batch.num_rows):
                held.append(record(ids[k].as_py(), urls[k].as_py(), payloads[k].as_buffer().to_pybytes(), digests[k].as_py(), refers[k].as_py(), again[k].as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    size = 0
        if held:
            yield close()

    shaped = rows.select("page_id", "url", F.col("payload").cast("binary"), "digest", "refers_to", "is_revisit")
    return staged(mapped(shaped, pack, "archive string, data binary"), codec="uncompressed")


def read_archives(archives: DataFrame, data_col: str = "data", payloads: bool = False) -> DataFrame:
    """All records of the archives: record_id, record_type, url, payload_bytes, payload_digest, refers_to, error
    (and payload).

    A frame or record that does not hold gives a row with ``error`` and ends its archive if the frame's bounds are lost.
    """
    names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "error"] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads
    schema = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, error string" + ", payload binary" * payloads

    def rows_of(data: memoryview) -> Iterator[dict]:
        found = split_records(data)
        while True:
            try:
                raw = next(found)
            except StopIteration:
                return
            except (ValueError, zstandard.ZstdError) as e:
                yield {"error": str(e)}
                return
            try:
                yield parse_record(raw)
            except ValueError as e:
                yield {"error": str(e)}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held = []
                for row in rows_of(memoryview(data.as_buffer()) if data.is_valid else memoryview(b"")):
                    held.append(row)
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return mapped(archives.select(data_col), unpack, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write all pages and read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. A null page_id comes back null; ids may be numbers or texts. Repeated rows are separate records. A record that
    fails its checks raises. An empty table gives no rows; other columns are ignored.
    """
    back = read_archives(write_archives(pages, id_col, payload_col))
    kind = pages.schema[id_col].dataType

    def number(c: Column) -> Column:
        text = F.when(F.length(c) > len(URN), F.substring(c, F.lit(len(URN) + 1), F.length(c)))
        return F.url_decode(F.replace(F.substring(text, F.lit(3), F.length(text)), F.lit("+"), F.lit("%2B"))) if kind.simpleString() == "string" else text.cast(kind)

    return back.select(
        number(F.col("record_id")).alias("page_id"),
        "url",
        "payload_bytes",
        "payload_digest",
        F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_type")).alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )
