"""Word and PowerPoint files as rows of blocks, and such files from rows. A file is a zip of XML parts; only its parts are read, by the standard library, one element at a time.

``read_office`` takes files from any store that Spark reads (``binaryFile``); ``OfficeDataSource`` (``spark.read.format("office")``) plans a partition a file of a folder that executors share.
A file that can't be read is one row of block 'error'.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A part that unpacks to more is an error: a small zip can hold a very large part.
MAX_PART_BYTES = 256 << 20
#: Pictures of fewer pixels a side are no content; notes of as few characters neither.
MIN_PIXELS, MIN_NOTES = 100, 6
BLOCK_SQL = "unit int, place int, block string, level int, text string, cells array<string>, digest string"
SCHEMA = f"path string, kind string, {BLOCK_SQL}"
_BLOCK = [("unit", pa.int32()), ("place", pa.int32()), ("block", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string())), ("digest", pa.string())]
MIME = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"}

# Names of the formats' XML spaces and relation types.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
DGM = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
NOTES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
SLIDE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slide"

Block = tuple  # (unit, place, block, level, text, cells, digest)


class Package:
    """The parts of a file."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def open(self, name: str):
        if self.zip.getinfo(name).file_size > MAX_PART_BYTES:
            raise ValueError(f"{name} unpacks to over {MAX_PART_BYTES} bytes")
        return self.zip.open(name)

    def tree(self, name: str) -> ElementTree.Element:
        with self.open(name) as part:
            return ElementTree.parse(part).getroot()

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Of a part: (type, target part) by id; targets outside the file are left out."""
        folder, _, last = name.rpartition("/")
        rels = f"{folder}/_rels/{last}.rels".lstrip("/")
        if rels not in self.names:
            return {}
        found = {}
        for r in self.tree(rels):
            if r.get("TargetMode") != "External":
                target = r.get("Target", "")
                parts = [] if target.startswith("/") else folder.split("/") if folder else []
                for step in target.lstrip("/").split("/"):
                    parts = parts[:-1] if step == ".." else parts if step == "." else [*parts, step]
                found[r.get("Id", "")] = (r.get("Type", ""), "/".join(parts))
        return found


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _paragraph(p: ElementTree.Element) -> str:
    """A Word paragraph's text: runs, tabs and breaks."""
    return "".join(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" and e.get(f"{W}val") is None else "\n" if e.tag in (f"{W}br", f"{W}cr") else "" for e in p.iter())


def docx_blocks(content: bytes) -> Iterator[Block]:
    """Blocks of a Word file in order: heading (level 0: title), paragraph, item (level: indent), row (its table's number as level), equation. A short bold line is a heading of level 1."""
    package = Package(content)
    names: dict[str, str] = {}
    if "word/styles.xml" in package.names:
        for style in package.tree("word/styles.xml").iter(f"{W}style"):
            name = style.find(f"{W}name")
            names[style.get(f"{W}styleId", "")] = name.get(f"{W}val", "") if name is not None else ""
    place = tables = depth = 0
    with package.open("word/document.xml") as part:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                depth += e.tag == f"{W}tbl"
                path.append(e)
                continue
            path.pop()
            depth -= e.tag == f"{W}tbl"
            if depth or e.tag not in (f"{W}p", f"{W}tbl"):
                continue
            if e.tag == f"{W}tbl":
                rows = [[_squeezed(" ".join(_paragraph(p) for p in c.iter(f"{W}p"))).replace("|", "/") for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]
                rows = [r for r in rows if any(r)]
                if len(rows) >= 2:
                    for cells in rows:
                        yield 0, place, "row", tables, None, cells, None
                        place += 1
                    tables += 1
            else:
                block = _word_block(e, names)
                if block:
                    yield 0, place, *block, None, None
                    place += 1
                for maths in e.iter(f"{M}oMath"):
                    if text := "".join(t.text or "" for t in maths.iter(f"{M}t")).strip():
                        yield 0, place, "equation", 0, text, None, None
                        place += 1
            e.clear()
            if path:
                path[-1].remove(e)  # what was read is let go


def _word_block(p: ElementTree.Element, names: dict[str, str]) -> tuple[str, int, str] | None:
    text = _squeezed(_paragraph(p))
    if not text:
        return None
    style = p.find(f"{W}pPr/{W}pStyle")
    name = names.get(style.get(f"{W}val", ""), style.get(f"{W}val", "")) if style is not None else ""
    if m := re.match(r"(heading|title)\s*(\d?)", name, re.IGNORECASE):
        return "heading", 0 if m[1].lower() == "title" else int(m[2] or 1), text
    number = p.find(f"{W}pPr/{W}numPr")
    if number is not None or name.lower().startswith("list"):
        indent = number.find(f"{W}ilvl") if number is not None else None
        return "item", int(indent.get(f"{W}val", "0")) if indent is not None else 0, text
    runs = [r for r in p.iter(f"{W}r") if "".join(t.text or "" for t in r.iter(f"{W}t")).strip()]
    bold = lambda r: (b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val", "1") not in ("0", "false")
    if len(text) <= 80 and not text.endswith(".") and runs and all(map(bold, runs)):
        return "heading", 1, text
    return "paragraph", 0, text


def picture_size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF or JPEG, (0, 0) of others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return 0, 0


def _runs(p: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{A}t" else "\n" if e.tag == f"{A}br" else "" for e in p.iter()).strip()


def _shapes(tree: ElementTree.Element) -> list[ElementTree.Element]:
    """Shapes from top to bottom, then left to right, those of a group where the group stands."""

    def corner(e: ElementTree.Element) -> tuple[int, int]:
        off = next((o for o in e.iter(f"{A}off")), None)
        if off is None:
            off = next((o for o in e.iter(f"{P}off")), None)
        return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)

    kinds = {f"{P}sp", f"{P}pic", f"{P}graphicFrame", f"{P}grpSp"}
    found = sorted((e for e in tree if e.tag in kinds), key=corner)
    return [x for e in found for x in (_shapes(e) if e.tag == f"{P}grpSp" else [e])]


def _shape_blocks(shape: ElementTree.Element, package: Package, relations: dict, table: int) -> Iterator[tuple]:
    """(block, level, text, cells, digest) of a shape."""
    for row in shape.iter(f"{A}tr"):
        yield "row", table, None, [_squeezed(" ".join(map(_runs, c.iter(f"{A}p")))) for c in row.findall(f"{A}tc")], None
    if shape.find(f".//{A}tbl") is not None:
        return
    target = lambda e, key: relations.get(e.get(key, "") if e is not None else "", ("", ""))[1]
    if (media := target(shape.find(f".//{A}blip"), f"{R}embed")) in package.names and shape.tag == f"{P}pic":
        with package.open(media) as part:
            data = part.read()
        width, height = picture_size(data)
        if width >= MIN_PIXELS and height >= MIN_PIXELS:
            named = shape.find(f"{P}nvPicPr/{P}cNvPr")
            yield "picture", width, (named.get("descr") or "") if named is not None else "", [str(width), str(height)], hashlib.sha256(data).hexdigest()
    if (chart := target(shape.find(f".//{C}chart"), f"{R}id")) in package.names:
        tree = package.tree(chart)
        title = _squeezed(" ".join(t.text or "" for t in (tree.iter(f"{A}t") if tree.find(f".//{C}title") is not None else ())))
        for series in tree.iter(f"{C}ser"):
            value = lambda at: [v.text or "" for v in series.findall(f"{C}{at}//{C}v")]  # noqa: E731, B023
            yield "chart", 0, title or "Chart", [*value("tx")[:1], *(f"{c}={v}" for c, v in zip(value("cat"), value("val"), strict=False))], None
    if (diagram := target(shape.find(f".//{DGM}relIds"), f"{R}dm")) in package.names:
        for point in package.tree(diagram).iter(f"{DGM}pt"):
            if text := _squeezed(" ".join(t.text or "" for t in point.iter(f"{A}t"))):
                yield "diagram", 0, text, None, None
    for maths in shape.iter(f"{M}oMath"):
        if text := "".join(t.text or "" for t in maths.iter(f"{M}t")).strip():
            yield "equation", 0, text, None, None
    holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    is_title = holder is not None and holder.get("type") in ("title", "ctrTitle")
    for p in shape.findall(f"{P}txBody/{A}p"):
        if text := _runs(p):
            level = p.find(f"{A}pPr")
            yield "heading" if is_title else "item", int(level.get("lvl", 0)) if level is not None else 0, text, None, None


def pptx_blocks(content: bytes) -> Iterator[Block]:
    """Blocks of a PowerPoint file, slide by slide (unit, from 1) and in reading order: heading (``Slide n`` where there is no title), item, row, picture (its digest; width as level), chart
    (a series, as name and category=value), diagram, equation, notes."""
    package = Package(content)
    relations = package.relations("ppt/presentation.xml")
    order = [relations[i][1] for s in package.tree("ppt/presentation.xml").iter(f"{P}sldId") if (i := s.get(f"{R}id", "")) in relations]
    for unit, name in enumerate(order, 1):
        own, tree = package.relations(name), package.tree(name).find(f"{P}cSld/{P}spTree")
        rows, table = [], 0
        for shape in _shapes(tree) if tree is not None else ():
            found = list(_shape_blocks(shape, package, own, table))
            table += any(b[0] == "row" for b in found)
            rows += found
        heads = [b for b in rows if b[0] == "heading"]
        rows = [heads[0] if heads else ("heading", 0, f"Slide {unit}", None, None), *(b for b in rows if not heads or b is not heads[0])]
        for kind, target in own.values():
            if kind == NOTES and target in package.names:
                bodies = [s for s in package.tree(target).iter(f"{P}sp") if (h := s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and h.get("type") == "body"]
                text = "\n".join(t for s in bodies for p in s.iter(f"{A}p") if (t := _runs(p)))
                if len(text) >= MIN_NOTES:
                    rows.append(("notes", 0, text, None, None))
        yield from ((unit, place, *b) for place, b in enumerate(rows))


def file_blocks(kind: str | None, content: bytes | None) -> Iterator[Block]:
    """The blocks of one file, or one row 'error' that says what is wrong with it."""
    try:
        if kind not in ("docx", "pptx"):
            raise ValueError(f"no reader of {kind}")
        if not content or content[:2] != b"PK":
            raise ValueError(f"not a {kind}: it doesn't begin as a zip")
        yield from list((docx_blocks if kind == "docx" else pptx_blocks)(content))
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, struct.error, NotImplementedError, RuntimeError, EOFError, OSError) as error:
        yield 0, 0, "error", 0, f"{type(error).__name__}: {error}", None, None


def looks_like(content: Column, kind: Column) -> Column:
    """Whether a file begins as its name says: zips for docx and pptx, ``%PDF`` within white space for pdf; others may hold anything."""
    head = F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^\s+", "")
    return F.when(kind == "pdf", F.startswith(head, F.lit("%PDF"))).when(kind.isin("docx", "pptx"), F.startswith(head, F.lit("PK"))).otherwise(True)


def parsed_files(files: DataFrame, keep: str = "path") -> DataFrame:
    """(``keep``, kind, blocks) of files (``keep``, kind, content): one row a block, some thousands of rows a batch."""
    sql = files.schema[keep].dataType.simpleString()
    names = [keep, "kind", *(n for n, _ in _BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content = batch.column(2)[i]
                blocks = list(file_blocks(batch.column(1)[i].as_py(), content.as_buffer().to_pybytes() if content.is_valid else None))
                for at in range(0, len(blocks), 4096):
                    part = list(zip(*blocks[at : at + 4096], strict=True))
                    own = batch.slice(i, 1).take(pa.array([0] * len(part[0]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(c, t) for c, (_, t) in zip(part, _BLOCK, strict=True))], names=names)

    return files.select(keep, "kind", "content").mapInArrow(run, f"`{keep}` {sql}, kind string, {BLOCK_SQL}")


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all Word and PowerPoint files of a path that Spark reads, found recursively; files without a byte, which Spark passes over, have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,pptx}").load(path)
    return parsed_files(files.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind"), "content"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _OfficeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.path.removeprefix("file://"))
        found = [top] if top.is_file() else sorted(p for p in top.rglob("*") if p.suffix.lower() in (".docx", ".pptx"))
        return [_File(str(p)) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not hasattr(partition, "path"):  # what Spark asks for where there is no partition
            return
        kind = partition.path.rpartition(".")[2].lower()
        with open(partition.path, "rb") as f:
            content = f.read()
        for block in file_blocks(kind, content):
            yield partition.path, kind, *block


class OfficeDataSource(DataSource):
    """``spark.read.format("office").load(folder)`` after ``spark.dataSource.register(OfficeDataSource)``: a partition a file."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _OfficeReader(self.options["path"])


def blocks_to_markdown(blocks: DataFrame, keep: str = "path") -> DataFrame:
    """(``keep``, markdown) of parsed files: the highest heading level that the author used is a section (``##``), items keep up to two indents, tables are pipes, notes quotes. Slides are
    sections, but for their titles' number nothing is added. Files in error have no row."""
    order = Window.partitionBy(keep).orderBy("unit", "place")
    rows = blocks.where("block <> 'error'").select("*", F.min(F.when(F.col("block") == "heading", F.col("level"))).over(Window.partitionBy(keep)).alias("top"), F.lag("block").over(order).alias("before"), F.lag("level").over(order).alias("level_before"))
    piped = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    first = ~F.coalesce((F.col("before") == "row") & (F.col("level_before") == F.col("level")), F.lit(False))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.size("cells")))
    text = (
        F.when(F.col("block") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("level") - F.col("top") + 2)), F.lit(" "), "text"))
        .when(F.col("block") == "item", F.concat(F.repeat(F.lit("  "), F.least("level", F.lit(2))), F.lit("- "), "text"))
        .when(F.col("block") == "row", F.when(first, F.concat(F.lit("\n"), piped, rule)).otherwise(piped))
        .when(F.col("block") == "notes", F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> "))))
        .when(F.col("block") == "picture", F.concat(F.lit("!["), "text", F.lit("](media:"), "digest", F.lit(")")))
        .when(F.col("block") == "chart", F.concat("text", F.lit(": "), F.array_join("cells", ", ")))
        .otherwise(F.col("text"))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("unit", "place", text.alias("t")))), lambda x: x["t"])
    return rows.groupBy(keep).agg(F.array_join(lines, "\n").alias("markdown"))


# ---- writing


_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _xml(text: str | None) -> str:
    return escape(_ODD.sub("", text or "")).replace("\r", "&#13;")


def _zipped(parts: dict[str, str]) -> bytes:
    """The parts as a zip whose bytes depend on them alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text.encode("utf-8", "replace"), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _package(kind: str, main: str, others: dict[str, str]) -> dict[str, str]:
    types = f'<Override PartName="/{main}" ContentType="{MIME[kind]}"/>'
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{OFFICE}" Target="{main}"/></Relationships>',
        **others,
    }


def docx_file(blocks: list[dict]) -> bytes:
    """A Word file of blocks (block, level, text, cells): headings, paragraphs, items and table rows; other blocks are paragraphs."""
    out, table = [], None
    for b in [*blocks, None]:
        mark = b["level"] if b and b["block"] == "row" else None
        if table is not None and mark != table:
            out.append("</w:tbl>")
        if mark is not None:
            if mark != table:
                out.append("<w:tbl>")
            out.append("<w:tr>" + "".join(f'<w:tc><w:p><w:r><w:t xml:space="preserve">{_xml(c)}</w:t></w:r></w:p></w:tc>' for c in b["cells"] or [""]) + "</w:tr>")
        elif b:
            style = ("Title" if not b["level"] else f"Heading{b['level']}") if b["block"] == "heading" else "ListParagraph" if b["block"] == "item" else ""
            how = f'<w:pPr><w:pStyle w:val="{style}"/>' + (f'<w:numPr><w:ilvl w:val="{b["level"]}"/><w:numId w:val="1"/></w:numPr>' if b["block"] == "item" else "") + "</w:pPr>" if style else ""
            out.append(f'<w:p>{how}<w:r><w:t xml:space="preserve">{_xml(b["text"])}</w:t></w:r></w:p>')
        table = mark
    space = W.strip("{}")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in [("Title", "Title"), ("ListParagraph", "List Paragraph"), *((f"Heading{k}", f"heading {k}") for k in range(1, 10))])
    document = f'{_HEAD}<w:document xmlns:w="{space}"><w:body>{"".join(out)}</w:body></w:document>'
    return _zipped(_package("docx", "word/document.xml", {"word/document.xml": document, "word/styles.xml": f'{_HEAD}<w:styles xmlns:w="{space}">{styles}</w:styles>'}))


def pptx_file(slides: list[dict]) -> bytes:
    """A PowerPoint file of slides (title, bullets): a title and a body shape each, without master and theme."""
    parts, rels, ids = {}, [], []
    spaces = f'xmlns:p="{P.strip("{}")}" xmlns:a="{A.strip("{}")}" xmlns:r="{R.strip("{}")}"'
    line = lambda t: f"<a:p><a:r><a:t>{_xml(t)}</a:t></a:r></a:p>"
    for k, s in enumerate(slides, 1):
        shape = lambda i, kind, y, lines: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/><a:ext cx="9144000" cy="1000000"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>'
        body = shape(2, "title", 0, line(s["title"])) + (shape(3, "body", 1_200_000, "".join(map(line, s["bullets"]))) if s["bullets"] else "")
        parts[f"ppt/slides/slide{k}.xml"] = f'{_HEAD}<p:sld {spaces}><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{body}</p:spTree></p:cSld></p:sld>'
        rels.append(f'<Relationship Id="rId{k}" Type="{SLIDE}" Target="slides/slide{k}.xml"/>')
        ids.append(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>')
    main = {"ppt/presentation.xml": f'{_HEAD}<p:presentation {spaces}><p:sldIdLst>{"".join(ids)}</p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>'}
    return _zipped(_package("pptx", "ppt/presentation.xml", main | parts))


def office_files(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(``key``, kind, content) of rows (``key``, parts): 'docx' from parts (block, level, text, cells), 'pptx' from parts (title, bullets), in the array's order."""
    sql = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(docx_file if kind == "docx" else pptx_file)(parts.as_py() or []) for parts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * len(made)), pa.array(made, pa.binary())], names=[key, "kind", "content"])

    return rows.select(key, "parts").mapInArrow(run, f"`{key}` {sql}, kind string, content binary")
