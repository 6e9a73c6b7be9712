"""Physical formats: captured files to rows.

Delimited and fixed-width text goes through Spark's readers, so large files split. Formats whose records can't be told apart in the
middle of a file (quoted line breaks, carets with embedded breaks, archives, XML) are read one file a task, with caps on what a
file may inflate to.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZIP_BUDGET = 512 << 20
NESTING = 256


def _closed(spark: SparkSession, path: str) -> None:
    """Raises for a file whose quotes don't pair up. Files are read by lines, so large ones are counted in parts."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_count("value", F.lit('"')).alias("n"))
    open_ = lines.groupBy("file").agg(F.sum("n").alias("n")).where("n % 2 = 1").limit(1).collect()
    if open_:
        raise ValueError(f"unterminated quote in {open_[0]['file']}")


def csv_records(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """RFC 4180 with embedded line breaks, all cells text, missing cells empty, blank lines left out. Raises on a quote that isn't
    closed."""
    _closed(spark, path)
    rows = spark.read.csv(path, header=header, multiLine=True, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE")
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns)).where(" or ".join(f"`{c}` <> ''" for c in rows.columns))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """csv_records() whose first record names the columns."""
    return csv_records(spark, path, header=True)


def separated(spark: SparkSession, path: str, sep: str, names: list[str] | None = None, quote: str = "") -> DataFrame:
    """Text separated by a tab, pipe or the like; the first line is the header unless names are given."""
    reader = spark.read.options(sep=sep, quote=quote, mode="PERMISSIVE")
    if names is None:
        return reader.csv(path, header=True)
    return reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def positional(spark: SparkSession, path: str, sep: str, fields: dict[str, int], least: int) -> DataFrame:
    """Named positions of headerless wide lines. Lines with fewer than `least` cells are skipped; all short raises."""
    cells = spark.read.text(path).select(F.split("value", re.escape(sep), -1).alias("cells"))
    counted = cells.agg(F.count("*").alias("n"), F.count_if(F.size("cells") >= least).alias("kept")).first()
    if counted["n"] and not counted["kept"]:
        raise ValueError(f"no line of {path} has {least} cells")
    return cells.where(F.size("cells") >= least).select(*(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for n, i in fields.items()))


def fixed_width(lines: DataFrame, layouts: dict[str, list[tuple[str, int, int]]], tag: tuple[int, int]) -> dict[str, DataFrame]:
    """A table for each record type. layouts: type -> (name, start from 1, width); tag: where the type stands. A line of another
    type or length raises."""
    kind = F.substring("value", *tag)
    sizes = {k: max(s + w - 1 for _, s, w in fields) for k, fields in layouts.items()}
    right = F.lit(False)
    for k, n in sizes.items():
        right = right | ((kind == k) & (F.length("value") == n))
    bad = lines.where(~right).limit(1).collect()
    if bad:
        raise ValueError(f"unknown type or length: {bad[0]['value'][:60]!r}")
    return {k: lines.where(kind == k).select(*(F.trim(F.substring("value", s, w)).alias(n) for n, s, w in fields)) for k, fields in layouts.items()}


def caret_records(spark: SparkSession, path: str) -> DataFrame:
    """file, row, code, value of caret-separated text whose rows may hold line breaks: long form, filled cells only.

    The header has unique codes of eight characters, and each row as many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines = data.decode("windows-1252").replace("\r\n", "\n").split("\n")
                header = lines[0].split("^")
                if len(set(header)) != len(header) or not all(re.fullmatch(r"[A-Z0-9]{8}", c) for c in header):
                    raise ValueError(f"header of {file}")
                rows, held = [], ""
                for line in lines[1:]:
                    held = f"{held}\n{line}" if held else line
                    cells = held.split("^")
                    if len(cells) == len(header):
                        rows.append(cells)
                        held = ""
                    elif len(cells) > len(header):
                        raise ValueError(f"row {len(rows) + 1} of {file} is too wide")
                if held.strip():
                    raise ValueError(f"last row of {file} is too narrow")
                out = [(file, i, c, v) for i, cells in enumerate(rows, 1) for c, v in zip(header, cells, strict=True) if v != ""]
                yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.string())], names=["file", "row", "code", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row long, code string, value string")


def inflate(data: bytes, most: int, raw: bool = True) -> bytes:
    """Deflated data, or an error beyond `most` bytes."""
    machine = zlib.decompressobj(-15 if raw else 15)
    out = machine.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError(f"inflates to more than {most} bytes")
    return out + machine.flush()


def zip_entries(data: bytes, budget: int = ZIP_BUDGET) -> Iterator[tuple[str, bytes]]:
    """Stored and deflated entries, in order; encrypted ones, other methods, wrong sizes and too much data raise, and so do archives
    of several disks or with a directory in 64-bit form."""
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or data[end + 4 : end + 8] != b"\0\0\0\0":
        raise ValueError("no archive, or one of several disks")
    if data[end + 10 : end + 20].find(b"\xff\xff\xff\xff") >= 0 or data[max(0, end - 20) : end - 16] == b"PK\x06\x07":
        raise ValueError("directory in 64-bit form")
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{info.filename}: encrypted, or packed in another way")
            if info.is_dir():
                continue
            if info.file_size > budget:
                raise ValueError("archive is over its budget")
            with archive.open(info) as f:
                body = f.read(budget + 1)
            budget -= len(body)
            if budget < 0 or len(body) != info.file_size:
                raise ValueError(f"{info.filename}: size")
            yield info.filename, body


def per_file(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that parse(file, bytes) yields as tuples for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(parse(file, data))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], schema).schema
    names, arrow = kind.names, to_arrow_schema(kind)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kind)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    return per_file(spark, path, lambda file, data: ((file, n, body) for n, body in zip_entries(data)), "archive string, name string, content binary")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def xlsx_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of the filled cells of a workbook, sheets in its order; formulas give their cached values."""
    parts = dict(zip_entries(data))
    shared = [("".join(t.text or "" for t in si.iter(f"{_SHEET}t"))) for si in ElementTree.fromstring(parts["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in parts else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(parts["xl/_rels/workbook.xml.rels"])}
    for sheet in ElementTree.fromstring(parts["xl/workbook.xml"]).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        for cell in ElementTree.fromstring(parts[target if target.startswith("xl/") else f"xl/{target}"]).iter(f"{_SHEET}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = 0
            for c in letters:
                column = column * 26 + ord(c) - 64
            value = cell.findtext(f"{_SHEET}v")
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            if value not in (None, ""):
                yield sheet.get("name"), int(row), column, value


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return per_file(spark, path, lambda file, data: ((file, *c) for c in xlsx_cells(data)), "file string, sheet string, row int, column int, value string")


def xml_items(data: bytes, roots: tuple[str, ...], item: str) -> Iterator[dict[str, list[tuple[dict, str]]]]:
    """For each item its children: local name -> (attributes, text). The root must be one of roots; entities aren't expanded."""
    if b"<!DOCTYPE" in data[:4096] and b"<!ENTITY" in data:
        raise ValueError("declares entities")
    local = lambda tag: tag.rpartition("}")[2].lower()
    stack: list[str] = []
    for event, node in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
        if event == "start":
            stack.append(local(node.tag))
            if len(stack) == 1 and stack[0] not in roots:
                raise ValueError(f"root is {stack[0]}")
            if len(stack) > NESTING:
                raise ValueError("nested too deeply")
        else:
            stack.pop()
            if local(node.tag) == item:
                out: dict[str, list[tuple[dict, str]]] = {}
                for child in node:
                    out.setdefault(local(child.tag), []).append((dict(child.attrib), "".join(child.itertext()).strip()))
                yield out
                node.clear()


_FEED = "file string, pos int, id string, title string, link string, published_text string, summary string, source string, form_type string"


def _feed(file: str, data: bytes) -> Iterator[tuple]:
    text = lambda x, *names: next((v for n in names for _, v in x.get(n, ()) if v), None)
    pos = -1
    for pos, x in enumerate(xml_items(data, ("rss", "rdf"), "item") if b"<item" in data else xml_items(data, ("feed",), "entry")):
        links = x.get("link", [])
        link = next((a.get("href") for a, _ in links if a.get("rel", "alternate") == "alternate" and a.get("href")), None) or next((v for _, v in links if v), None)
        form = text(x, "filing-type") or next((a.get("term") for a, _ in x.get("category", ()) if a.get("term")), None)
        title = text(x, "title")
        if title and link and re.match(r"https?://[^/@\s]+(/|$|\?)", link):
            yield file, pos, text(x, "guid", "id") or link, title, link, text(x, "pubdate", "published", "date", "updated"), text(x, "description", "summary", "content"), text(x, "source"), form


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of captured RSS and Atom feeds with a title and a safe link."""
    return per_file(spark, path, _feed, _FEED)


def html_rows(pages: DataFrame, html: str, key: str) -> DataFrame:
    """key, row, cell, text of the cells of all table rows of a page."""
    from tidemill.functions.text import clean_text

    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select(key, "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("cell", "td"))
    return cells.select(key, "row", "cell", clean_text(F.col("td")).alias("text"))


def sectioned_lines(lines: DataFrame, order: str, value: str) -> DataFrame:
    """Lines of a list with `[section]` heads and `#` labels: order, section, label, url; https only, each once."""
    w = Window.orderBy(order)  # a list of some hundred lines
    line = F.trim(F.regexp_replace(value, "#.*$", ""))
    head = F.nullif(F.regexp_extract(value, r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    rows = lines.select(order, F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("section"), F.nullif(F.trim(F.regexp_extract(value, "#(.*)$", 1)), F.lit("")).alias("label"), line.alias("url"))
    urls = rows.where(F.col("url").startswith("https://"))
    return urls.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(order))).where("__n = 1").drop("__n")


def spaced_columns(lines: DataFrame, value: str, names: list[str], comment: str = "#") -> DataFrame:
    """Columns set apart by spaces; comments and lines of another number of cells are skipped."""
    cells = lines.where(~F.col(value).startswith(comment)).select(F.split(F.trim(value), r"\s+").alias("c"))
    return cells.where(F.size("c") == len(names)).select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))


def caption_segments(xml: Column) -> Column:
    """array<struct<start, duration, text>> in seconds of timed text, either in seconds or in milliseconds."""
    from tidemill.functions.text import clean_text

    number = lambda x, p: F.regexp_extract(x, p, 1).try_cast("double")
    a = F.regexp_extract_all(xml, F.lit(r"(?s)<text[^>]*>.*?</text>"), F.lit(0))
    b = F.regexp_extract_all(xml, F.lit(r"(?s)<p [^>]*>.*?</p>"), F.lit(0))
    one = lambda n, d, scale: lambda x: F.struct((number(x, rf'\b{n}="([\d.]+)"') / scale).alias("start"), (number(x, rf'\b{d}="([\d.]+)"') / scale).alias("duration"), clean_text(x).alias("text"))
    return F.when(F.size(a) > 0, F.transform(a, one("start", "dur", 1))).otherwise(F.transform(b, one("t", "d", 1000)))


def decoded(content: Column, encoding: str = "UTF-8", lossy: bool = False) -> Column:
    """Bytes as text. UTF-8 raises on what isn't, or, lossy, puts the replacement character there; windows-1252 takes every byte."""
    if encoding.lower() == "windows-1252":
        return F.decode(content, "ISO-8859-1") if lossy else _windows_1252(content)
    return F.make_valid_utf8(content.cast("string")) if lossy else F.validate_utf8(content.cast("string"))


def _windows_1252(content: Column) -> Column:
    """As Latin-1, but for the 32 places from 0x80 on, of which 27 have characters of their own."""
    own = {chr(b): bytes([b]).decode("windows-1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(own), "".join(own.values()))
