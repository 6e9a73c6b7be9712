import base64
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.sources import documents, formats, json_records


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", '﻿id,name\r\n1,"a ""q"", b\nc"\r\n\r\n2\r\n')
    got = formats.csv_table(spark, path).collect()
    assert [tuple(r) for r in got] == [("1", 'a "q", b\nc'), ("2", "")]
    with pytest.raises(ValueError, match="unterminated"):
        formats.csv_table(spark, put(tmp_path, "b.csv", 'id\n"open\n'))
    assert [tuple(r) for r in formats.csv_records(spark, put(tmp_path, "c.csv", 'a,"b\nc"\n\nd\n')).collect()] == [("a", "b\nc"), ("d", "")]


def test_positional(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "x\ty\t\tz\nshort\n")
    assert [tuple(r) for r in formats.positional(spark, path, "\t", {"a": 0, "c": 2, "d": 3}, 4).collect()] == [("x", None, "z")]
    with pytest.raises(ValueError, match="no line"):
        formats.positional(spark, put(tmp_path, "b.tsv", "x\n"), "\t", {"a": 0}, 4)


def test_fixed_width(spark):
    lines = spark.createDataFrame([("A01xx",), ("B7",)], "value string")
    got = formats.fixed_width(lines, {"A": [("n", 2, 2), ("t", 4, 2)], "B": [("k", 2, 1)]}, (1, 1))
    assert [tuple(r) for r in got["A"].collect()] == [("01", "xx")] and got["B"].first()["k"] == "7"
    with pytest.raises(ValueError, match="unknown"):
        formats.fixed_width(lines, {"A": [("n", 2, 2), ("t", 4, 2)]}, (1, 1))


def test_caret(spark, tmp_path):
    path = put(tmp_path, "a.txt", "RSSD9001^TEXT0001^RSSD9017\n1^two\nlines^x\n2^^y\n")
    got = sorted(tuple(r)[1:] for r in formats.caret_records(spark, path).collect())
    assert got == [(1, "RSSD9001", "1"), (1, "RSSD9017", "x"), (1, "TEXT0001", "two\nlines"), (2, "RSSD9001", "2"), (2, "RSSD9017", "y")]


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_zip_and_inflate(spark, tmp_path):
    path = put(tmp_path, "a.zip", archive(**{"x.txt": "hello", "d/y.txt": "z" * 100}))
    assert sorted((r["name"], bytes(r["content"])) for r in formats.read_zip(spark, path).collect()) == [("d/y.txt", b"z" * 100), ("x.txt", b"hello")]
    with pytest.raises(ValueError, match="budget"):
        list(formats.zip_entries(archive(a="z" * 1000), budget=100))
    with pytest.raises(ValueError, match="more than"):
        formats.inflate(zlib.compress(b"z" * 10_000), 100, raw=False)


def test_xlsx(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = archive(
        **{
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>',
            "xl/worksheets/s.xml": f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="AB2"><f>1+1</f><v>2</v></c><c r="C3"/></row></sheetData></worksheet>',
        }
    )
    got = formats.read_xlsx(spark, put(tmp_path, "a.xlsx", book)).collect()
    assert [tuple(r)[1:] for r in got] == [("S", 1, 1, "bc"), ("S", 2, 28, "2")]


def test_feeds(spark, tmp_path):
    rss = '<rss><channel><item><title><![CDATA[A & B]]></title><link>https://x.example/1</link><guid>g1</guid><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>no link</title></item><item><title>t</title><link>javascript:x</link></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>F</title><link rel="self" href="https://x.example/s"/><link rel="alternate" href="https://x.example/a"/><updated>2024-01-02T00:00:00Z</updated><category term="10-K"/></entry></feed>'
    put(tmp_path, "a.xml", rss), put(tmp_path, "b.xml", atom)
    got = {r["title"]: r for r in formats.read_feed(spark, str(tmp_path)).collect()}
    assert set(got) == {"A & B", "F"}
    assert got["A & B"]["id"] == "g1" and got["F"]["link"] == "https://x.example/a" and got["F"]["form_type"] == "10-K"
    with pytest.raises(ValueError, match="root"):
        list(formats.xml_items(b"<html><item/></html>", ("rss",), "item"))


def test_html_rows_and_lists(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td>x &amp; y</td><td><b>z</b></td></tr></table>")], "id int, h string")
    assert sorted(tuple(r)[1:] for r in formats.html_rows(pages, "h", "id").collect()) == [(0, 0, "A"), (1, 0, "x & y"), (1, 1, "z")]
    lines = spark.createDataFrame(list(enumerate(["# top", "[one]", "https://a.example # first", "http://b.example", "[two]", "https://c.example", "https://a.example"])), "n int, l string")
    assert [tuple(r) for r in formats.sectioned_lines(lines, "n", "l").orderBy("n").collect()] == [(2, "one", "first", "https://a.example"), (5, "two", None, "https://c.example")]
    assert [tuple(r) for r in formats.spaced_columns(spark.createDataFrame([("# c",), (" DJF  1950 -1.5",), ("x",)], "v string"), "v", ["season", "year", "anomaly"]).collect()] == [("DJF", "1950", "-1.5")]


def test_captions(spark):
    df = spark.createDataFrame([('<text start="1.5" dur="2">a &amp;amp; b</text>',), ('<p t="1500" d="2000">c</p>',)], "x string")
    got = [r["s"] for r in df.select(formats.caption_segments(F.col("x")).alias("s")).collect()]
    assert [tuple(s[0]) for s in got] == [(1.5, 2.0, "a & b"), (1.5, 2.0, "c")]


def test_json_connectors(spark, tmp_path):
    (tmp_path / "hn").mkdir()
    put(tmp_path / "hn", "a.json", json.dumps({"hits": [{"title": "T", "url": "https://x", "objectID": "1"}, {"title": 5, "objectID": "2"}, {"title": "U", "objectID": "3"}]}))
    got = json_records.connect(spark, "hacker-news", str(tmp_path / "hn")).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["id"], r["provider"]) for r in got] == [("T", "https://x", "1", "hacker-news"), ("U", "https://news.ycombinator.com/item?id=3", "3", "hacker-news")]
    (tmp_path / "kev").mkdir()
    put(tmp_path / "kev", "a.json", json.dumps({"vulnerabilities": [{"cveID": "x"}]}))
    with pytest.raises(Exception, match="cisa-kev: no valid record"):
        json_records.connect(spark, "cisa-kev", str(tmp_path / "kev")).collect()
    (tmp_path / "bad").mkdir()
    put(tmp_path / "bad", "a.json", "<html>")
    with pytest.raises(Exception, match="hacker-news: no JSON"):
        json_records.connect(spark, "hacker-news", str(tmp_path / "bad")).collect()
    (tmp_path / "wb").mkdir()
    put(tmp_path / "wb", "a.json", json.dumps({"documents": {"D1": {"id": "1", "display_title": "A", "url": "u"}, "facets": {}}}))
    assert [r["title"] for r in json_records.connect(spark, "world-bank", str(tmp_path / "wb")).collect()] == ["A"]
    (tmp_path / "gd").mkdir()
    feature = {"properties": {"eventid": 7, "eventtype": "FL", "alertlevel": "Red"}, "geometry": {"coordinates": [1, 2.5]}}
    put(tmp_path / "gd", "a.json", json.dumps({"features": [feature, feature]}))
    got = json_records.connect(spark, "gdacs", str(tmp_path / "gd")).collect()
    assert [(r["id"], r["longitude"], r["latitude"]) for r in got] == [(7, 1.0, 2.5)]


def test_abstract(spark):
    df = spark.createDataFrame([('{"b": [1, 3], "a": [0], "c": [2]}',)], "x string")
    assert df.select(json_records.abstract_from_index(F.parse_json("x")).alias("a")).first()["a"] == "a b c b"


def test_documents(spark, tmp_path):
    epub = archive(**{"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></spine></package>', "o/a.xhtml": "<html><head><title>One</title></head><body><p>first</p></body></html>", "o/b.xhtml": "<p>second &eacute;</p>"})
    put(tmp_path, "a.epub", epub)
    put(tmp_path, "b.html", "<html><title>T</title><script>x</script><p>hi<br>there</html>")
    put(tmp_path, "c.txt", "plain")
    content = zlib.compress(b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET")
    put(tmp_path, "d.pdf", b"%PDF-1.4\n1 0 obj\n<</Length 9/Filter/FlateDecode>>\nstream\n" + content + b"\nendstream\nendobj")
    put(tmp_path, "e.pdf", b"%PDF-1.4\n/Encrypt 1 0 R")
    put(tmp_path, "f.cbz", archive(**{"p10.png": "", "p2.png": ""}))
    got = {}
    for r in documents.read_documents(spark, str(tmp_path)).collect():
        got.setdefault(r["file"][-6:], []).append((r["section"], r["title"], r["text"], r["error"]))
    assert sorted(got["a.epub"]) == [(0, "One", "first", None), (1, "", "second é", None)]
    assert got["b.html"] == [(0, "T", "hi\nthere", None)] and got["/c.txt"] == [(0, None, "plain", None)]
    assert got["/d.pdf"] == [(0, None, "Hello (PDF)\nworld", None)]
    assert got["/e.pdf"][0][3] == "encrypted" and got["/f.cbz"][0][3] == "images only"
    assert documents.comic_pages((tmp_path / "f.cbz").read_bytes()) == ["p2.png", "p10.png"]


def test_palmdoc():
    assert documents.palmdoc(b"abc\x80\x1bd\xe8\x02\xff\xfe") == b"abc" + b"abcabc" + b"d" + b" h" + b"\xff\xfe"


def pdf(*streams):
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n<<%s>>\nstream\n%s\nendstream\nendobj" % (i, head, body) for i, (head, body) in enumerate(streams, 1))


def test_pdf_filters():
    show = lambda t: b"BT (" + t + b") Tj ET"
    run = lambda x: bytes([len(x) - 1]) + x + b"\x80"
    a85 = lambda x: base64.a85encode(x) + b"~>"
    image = (b"/Subtype/Image/Filter/DCTDecode", b"\xff\xd8")
    data = pdf((b"/Length 9", show(b"plain")), (b"/Filter/ASCIIHexDecode", show(b"hex").hex().encode() + b">"), (b"/Filter [/ASCII85Decode /FlateDecode]", a85(zlib.compress(show(b"chain")))), (b"/Filter/RunLengthDecode", run(show(b"runs"))), image)
    assert documents.pdf_text(data).split("\n") == ["plain", "hex", "chain", "runs"]
    for head, body in ((b"/Filter/LZWDecode", b"x"), (b"/Filter/FlateDecode", b"not deflated"), (b"/Filter/FlateDecode", zlib.compress(show(b"cut short"))[:-8]), (b"/Filter 9 0 R", b"x")):
        with pytest.raises(ValueError, match="can't be decoded"):
            documents.pdf_text(pdf((b"/Length 9", show(b"plain")), (head, body)))
