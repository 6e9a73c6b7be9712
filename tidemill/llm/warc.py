"""Derived WARC records: from response records, linked metadata and plain-text conversion records, in SQL functions.

Each response gives two records. The metadata record (application/warc-fields) has the page's title, the source's HTTP headers,
length and payload digest, and the digest of the derived text. The conversion record has the text. Both refer to the response
by its record id, URI and date. Digests are sha256 in hexadecimal, as labelled digests. Record ids are UUIDs made from the
digest of what identifies a record, so the same input gives the same ids, however often a task runs.

Text: scripts, styles, comments and the like are dropped, block-level tags become line breaks, other tags go, the
usual entities are decoded, and runs of spaces and of empty lines become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"

# Fixed values, the same in the SQL below: what is dropped, what breaks lines, and entities in the order they are decoded.
DROPPED = [rf"(?is)<{tag}[ \t\r\n>].*?</{tag}[ \t\r\n]*>" for tag in ("script", "style", "noscript", "template")] + [r"(?s)<!--.*?-->"]
BREAKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|tr|table|article|aside|section|nav|header|footer|main|title|blockquote|pre)(?:[ \t\r\n/][^>]*)?>"
TAGS = r"<[/!?a-zA-Z][^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
TITLE = r"(?is)<title[^>]*>(.*?)</title"


def plain_text(html: Column) -> Column:
    """The text of an HTML page; empty for a null one."""
    out = F.coalesce(html, F.lit(""))
    for p in DROPPED:
        out = F.regexp_replace(out, p, " ")
    out = F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, "[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " ?\n[ \n]*", "\n"), "^\n|\n$", ""))


def page_title(html: Column) -> Column:
    out = F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)
    out = F.regexp_replace(out, TAGS, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \t\r\n\f]+", " "))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """<urn:uuid:...> from the md5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records: page_id, record_id, target_uri, date, http_headers, payload."""
    html, url = F.coalesce(pages["html"], F.lit("")), F.coalesce(pages["url"], F.lit(""))
    head = CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", ""))
    return pages.select(pages["page_id"].cast("long").alias("page_id"), record_id(F.lit("response"), F.coalesce(pages["page_id"].cast("string"), F.lit("")), url, digest(html)).alias("record_id"), pages["url"].alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit(head), F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)).alias("http_headers"), html.alias("payload"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks in the value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def derive(source: DataFrame) -> DataFrame:
    """page_id, kind, record_id, refers_to, target_uri, source_digest, block_digest, content_length, header, block: two records,
    'metadata' and 'conversion', for each response.

    header is the whole WARC header, to be followed by block and two line breaks. A null payload counts as empty, its text too; a
    null URI leaves the URI lines out. Repeated rows give repeated records with equal ids. Columns that aren't named in
    responses() aren't read. An empty table gives none. No row meets another: there is no shuffle.
    """
    one = source.select("page_id", "record_id", "target_uri", "date", "http_headers", digest(F.coalesce("payload", F.lit(""))).alias("source_digest"), F.octet_length(F.coalesce("payload", F.lit(""))).alias("source_length"), page_title(F.col("payload")).alias("title"), plain_text(F.col("payload")).alias("text"))
    one = one.withColumn("text_digest", digest(F.col("text")))
    fields = F.concat(_field("title", F.col("title")), _field("source-http-headers", F.rtrim(F.regexp_replace("http_headers", "[\r\n]+", " "))), _field("source-length", F.col("source_length").cast("string")), _field("source-payload-digest", F.col("source_digest")), _field("text-digest", F.col("text_digest")))
    made = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block"), digest(fields).alias("block_digest")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block"), F.col("text_digest").alias("block_digest")),
    )
    rows = one.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest", F.inline(made))
    rows = rows.withColumn("record_id", record_id(F.col("kind"), F.col("refers_to"), F.col("block_digest"))).withColumn("content_length", F.octet_length("block").cast("long"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("kind")),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Refers-To-Target-URI", F.col("target_uri")),
        _field("WARC-Refers-To-Date", F.col("date")),
        _field("WARC-Source-Payload-Digest", F.col("source_digest")),
        _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")),
        _field("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF),
    )
    return rows.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", header.alias("header"), "block")


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write one .warc file for each task to a folder that all executors share; name and records of each file."""
    import uuid

    from tidemill.llm.tokens import open_store

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc", 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for b in batches:
                for header, block in zip(b.column("header").to_pylist(), b.column("block").to_pylist(), strict=True):
                    out.write(header.encode() + block.encode() + b"\r\n\r\n")
                    n += 1
        yield pa.record_batch([[name], [n]], names=["name", "records"])

    return records.select("header", "block").mapInArrow(write, "name string, records long")


def _sql() -> str:
    """The same records in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''").replace("\r", "'||chr(13)||'").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'").replace("\f", "'||chr(12)||'") + "'"
    swap = lambda x, p, to: f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"

    def decoded(x: str) -> str:
        for name, char in ENTITIES:
            x = f"replace({x}, {q(name)}, {q(char)})"
        return x

    text = "coalesce(html, '')"
    for p in DROPPED:
        text = swap(text, p, " ")
    text = swap(decoded(swap(swap(text, BREAKS, "\n"), TAGS, "")), "[ \t\r\f]+", " ")
    text = f"trim({swap(swap(text, ' ?' + chr(10) + '[ ' + chr(10) + ']*', chr(10)), '^' + chr(10) + '|' + chr(10) + '$', '')}, ' ')"
    title = f"trim({swap(decoded(swap(f'regexp_extract(coalesce(html, {q("")}), {q(TITLE)}, 1)', TAGS, '')), '[ \t\r\n\f]+', ' ')}, ' ')"
    uuid = lambda x: f"'<urn:uuid:'||substr({x},1,8)||'-'||substr({x},9,4)||'-'||substr({x},13,4)||'-'||substr({x},17,4)||'-'||substr({x},21,12)||'>'"
    line = lambda name, x: f"coalesce('{name}: '||{swap(x, '[' + chr(13) + chr(10) + ']+', ' ')}||chr(13)||chr(10), '')"
    head = "'HTTP/1.1 200 OK Content-Type: text/html; charset=utf-8 Content-Length: '||strlen(coalesce(html,''))"
    fields = "||".join((line("title", "title"), line("source-http-headers", "http"), line("source-length", "source_length"), line("source-payload-digest", "source_digest"), line("text-digest", "text_digest")))
    header = "||".join(["'WARC/1.1'||chr(13)||chr(10)", *(line(n, c) for n, c in (("WARC-Type", "kind"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length::varchar"))), "chr(13)||chr(10)"])
    return f"""
with one as (
  select page_id, url as target_uri, '2024-01-01T00:00:00Z' as date, 'sha256:'||sha256(coalesce(html,'')) as source_digest,
    strlen(coalesce(html,''))::varchar as source_length, {head} as http, {title} as title, {text} as text from pages),
two as (select *, md5('response|'||coalesce(page_id::varchar,'')||'|'||coalesce(target_uri,'')||'|'||source_digest) as h, 'sha256:'||sha256(text) as text_digest from one),
three as (select *, {uuid("h")} as refers_to from two),
four as (
  select page_id, refers_to, target_uri, date, source_digest, 'metadata' as kind, 'application/warc-fields' as content_type, {fields} as block from three
  union all
  select page_id, refers_to, target_uri, date, source_digest, 'conversion', 'text/plain; charset=utf-8', text from three),
five as (select *, 'sha256:'||sha256(block) as block_digest, strlen(block)::bigint as content_length from four),
six as (select *, md5(kind||'|'||refers_to||'|'||block_digest) as k from five),
seven as (select *, {uuid("k")} as record_id from six)
select page_id, kind, record_id, refers_to, target_uri, source_digest, block_digest, content_length, {header} as header, block from seven
"""


ORACLE_SQL = _sql()
