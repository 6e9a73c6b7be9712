import hashlib

import duckdb

from tidemill.llm import queries, warc

SCHEMA = "page_id long, url string, html string, kind string, block string, text string"


def pages(spark, *pairs):
    return spark.createDataFrame([(i, u, h, "k", "b", "t") for i, u, h in pairs], SCHEMA)


def test_records(spark):
    html = '<html><head><title>A &amp; B\n</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One&nbsp;<b>two</b><br>three &lt;4&gt;</p></body></html>'
    got = {r["kind"]: r for r in warc.derive(warc.responses(pages(spark, (7, "http://x.example/a", html)))).collect()}
    text, fields = got["conversion"], got["metadata"]
    assert text["block"] == "A & B\nOne two\nthree <4>"
    assert text["refers_to"] == fields["refers_to"] != text["record_id"] != fields["record_id"]
    assert text["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    lines = text["header"].split("\r\n")
    assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""]
    head = dict(x.split(": ", 1) for x in lines[1:] if x)
    assert head["WARC-Type"] == "conversion" and head["WARC-Refers-To"] == text["refers_to"] and head["WARC-Target-URI"] == head["WARC-Refers-To-Target-URI"] == "http://x.example/a"
    assert int(head["Content-Length"]) == len(text["block"].encode()) == text["content_length"]
    block = dict(x.split(": ", 1) for x in fields["block"].split("\r\n") if x)
    assert block["title"] == "A & B" and block["source-payload-digest"] == text["source_digest"] and block["text-digest"] == text["block_digest"]
    assert "HTTP/1.1 200 OK" in block["source-http-headers"]


def test_messy(spark):
    df = pages(spark, (1, None, "<p>x"), (2, "http://a\r\nb", None), (None, None, None), (3, "u", ""), (3, "u", ""), (4, "v", "<p>" + "long " * 200_000))
    got = warc.derive(warc.responses(df)).collect()
    assert len(got) == 12
    assert all("WARC-Target-URI" not in r["header"] for r in got if r["page_id"] == 1)
    assert all("WARC-Target-URI: http://a b\r\n" in r["header"] for r in got if r["page_id"] == 2)
    assert len({r["record_id"] for r in got if r["page_id"] == 3}) == 2
    assert [len(r["block"]) for r in got if r["page_id"] == 4 and r["kind"] == "conversion"] == [999_999]
    assert warc.derive(warc.responses(pages(spark))).count() == 0


def test_files(spark, tmp_path):
    records = warc.derive(warc.responses(pages(spark, (1, "http://x.example", "<p>a</p>"), (2, "http://y.example", "<p>é</p>"))))
    files = warc.write_warc(records.coalesce(1), f"file://{tmp_path}/w").collect()
    data = b"".join((tmp_path / "w" / f["name"]).read_bytes() for f in files)
    at, seen = 0, 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if x)
        block = data[end : end + int(head["Content-Length"])]
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        at, seen = end + len(block) + 4, seen + 1
    assert seen == 4


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    got = queries.op10_warc(spark, d)
    want = con.sql(warc.ORACLE_SQL).fetchall()
    names = [c[0] for c in con.sql(warc.ORACLE_SQL).description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want)
