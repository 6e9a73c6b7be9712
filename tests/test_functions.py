import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import classify, dates, ids, match, severity, text, url


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, text.clean_text, '<![CDATA[<b a="x > y">Hi</b>  there]]>', "&amp;lt;i&amp;gt;x", "a&amp;amp;b", None) == ["Hi there", "x", "a&b", None]
    assert values(spark, text.decode_entities, "&amp;lt;", "&#65;&#x42;&copy;", "&#xD800;", None) == ["&lt;", "AB&copy;", "&#xD800;", None]
    assert values(spark, text.byte_size, "1,024 kB", "1.5 MiB", "7", "2 bytes", "-1 kB") == [1048576, 1572864, None, 2, None]
    assert values(spark, text.fold_marks, "Éàñ ﬁ", None) == ["Ean fi", None]
    assert values(spark, text.surname, "Austen, Jane", "Jane Austen", "") == ["austen", "austen", ""]
    assert values(spark, text.ipv4_number, "1.2.3.4", "1.2.3", "1.2.3.256", "a.b.c.d") == [16909060, None, None, None]
    assert values(spark, lambda x: text.signed_integer(x.cast("double")), "1234.5", "-2.5", "0") == ["+1,235", "-2", "+0"]


def test_url(spark):
    assert values(spark, url.normalize_url, "https://a.b/c?utm_source=x&k=1#f", "https://a.b/?utm_term=1", "not a url#x", "https://a.b/c?k=1&guccounter=2&z") == ["https://a.b/c?k=1", "https://a.b/", "not a url#x", "https://a.b/c?k=1&z"]
    assert values(spark, url.safe_http_url, "http://a.b", "ftp://a", "https://u:p@a.b/", "https://a.b/\n", "https:///x") == ["http://a.b", None, None, None, None]
    assert values(spark, url.redact_url, "https://u:p@a.b/?x=1&api_key=2&my_token=3&keyboard=4", "junk") == ["https://a.b/?x=1&api_key=<redacted>&my_token=<redacted>&keyboard=4", "<invalid-url>"]


def test_ids(spark):
    assert values(spark, ids.normalize_isbn, "0-306-40615-2", "978-0-306-40615-7", "0306406153", "080442957X", "x") == ["0306406152", "9780306406157", None, "080442957X", None]
    assert values(spark, ids.isbn10_to_13, "0306406152", "9780306406157") == ["9780306406157", None]
    assert values(spark, ids.normalize_doi, "https://dx.doi.org/10.1000/ABC", "doi: 10.1234/x", "10.12/x") == ["10.1000/abc", "10.1234/x", None]
    assert values(spark, ids.extract_isbns, "see 0306406152 and 978-0-306-40615-7, 0306406152; 1234567890") == [["0306406152", "9780306406157"]]


@pytest.mark.parametrize(
    ("given", "kind", "want"),
    [
        ("2024-02-29T10:20:30.1239+02:00", "iso_8601", "2024-02-29 08:20:30.123"),
        ("2024-06-30T23:59:60Z", "iso_8601", "2024-07-01 00:00:00"),
        ("2024-02-30", "date_only", None),
        ("2024-02-28", "date_only", "2024-02-28 00:00:00"),
        ("Tue, 02 Jan 24 03:04 EST", "rfc_822", "2024-01-02 08:04:00"),
        ("2 Jan 1999 03:04:05 -0130", "rfc_822", "1999-01-02 04:34:05"),
        ("20240102T030405Z", "gdelt", "2024-01-02 03:04:05"),
        ("/Date(1704164645000-0500)/", "dotnet", "2024-01-02 03:04:05"),
        ("/Date(-5)/", "dotnet", None),
        ("Jan-02-24 03:04PM", "finviz", "2024-01-02 20:04:00"),
        ("Mar-10-24 02:30AM", "finviz", None),
        ("Nov-03-24 01:30AM", "finviz", "2024-11-03 05:30:00"),
        ("Jan-02-24 13:04PM", "finviz", None),
        ("soon", None, None),
    ],
)
def test_dates(spark, given, kind, want):
    row = spark.createDataFrame([(given,)], "x string").select(dates.published_format(F.col("x")).alias("k"), dates.published_at(F.col("x")).cast("string").alias("v")).first()
    assert (row["k"], row["v"]) == (kind, want)


def test_date_only(spark):
    assert values(spark, dates.date_only, "2024-01-02T23:00:00-05:00", "20240102T030405Z") == [datetime.date(2024, 1, 3), None]


def test_match(spark):
    assert values(spark, lambda x: match.mentions(x, query="'Big' deal", company="Acme  Corp", ticker="RGA"), "a deal, big one", "bigger deal", "ACME corp", "$RGA up", "rga", "XRGA") == [True, False, True, True, False, False]
    assert values(spark, lambda x: match.mentions_ticker(x, "t"), "T rises", "$T", "NYSE: T", "NYSE: TX") == [False, True, True, False]
    assert values(spark, lambda x: match.mentions(x), "anything") == [False]
    assert values(spark, lambda x: match.research_match(x, "Rate-cut é"), "the RATE, cut été", "rate") == [True, False]


def test_classify(spark):
    none = F.lit(None).cast("string")
    kind = lambda x: classify.event_kind(classify.item_text(x), none, none)
    tags = lambda x: F.array_join(classify.event_tags(classify.item_text(x), none, none), ",")
    cases = ("Q3 results and a dividend", "prices senior notes", "nothing", "S&P downgrade by court")
    assert values(spark, kind, *cases) == ["earnings", "capital-markets", None, "rating"]
    assert values(spark, tags, *cases) == ["dividend,earnings", "capital-markets,debt", "", "legal,rating"]
    filing = lambda x: F.array_join(classify.event_tags(classify.item_text(x), F.lit("10-K A"), none), ",")
    assert values(spark, filing, "x") == ["10-k-a,filing"]


def test_severity(spark):
    assert values(spark, lambda x: severity.meets(x, "minor"), "unknown", "Minor", "extreme", "odd", None) == [False, True, True, False, False]


def test_isbns_are_worked_out_once(spark):
    df = spark.createDataFrame([("978-0-306-40615-7",), ("0-306-40615-2",), ("080442957x",), ("9790000000001",), ("97 8030640615 8",), ("١234567890",), ("",), (None,)], "t string")
    out = df.select(ids.isbn_identity(F.col("t")).alias("one"), ids.isbn10_to_13(F.col("t")).alias("thirteen"))
    assert [(r["one"]["isbn13"], r["one"]["isbn10"], r["thirteen"]) for r in out.collect()] == [
        ("9780306406157", "0306406152", None), ("9780306406157", "0306406152", "9780306406157"), ("9780804429573", "080442957X", "9780804429573"), ("9790000000001", None, None), *[(None, None, None)] * 4
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    found = df.select(ids.extract_isbns(F.concat("t", F.lit(" or 0-306-40615-2 0306406152"))).alias("x"))
    assert [r["x"] for r in found.collect()][0] == ["9780306406157", "0306406152"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
