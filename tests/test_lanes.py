import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import lanes

ITEM = "provider string, id string, title string, summary string, source string, url string, canonical_url string, published_at timestamp, kind string, form_type string, tags array<string>, related_tickers array<string>"


def item(provider, id_, title, url, day=None, **more):
    at = datetime.datetime(2024, 1, day) if day else None
    return (provider, id_, title, more.get("summary"), "src", url, None, at, more.get("kind"), None, more.get("tags"), None)


def test_feed(spark):
    rows = [
        item("a", "1", "Acme upgrade", "https://x.example/1?utm_source=z", 2),
        item("b", "2", "Acme upgrade again", "https://x.example/1", 3, summary="more"),
        item("a", "3", "Acme dividend", "https://x.example/3", 5, tags=["own"]),
        item("a", "4", "Other", "https://x.example/4", 6),
        item("a", "5", "ACME undated", "https://x.example/5"),
    ]
    items = spark.createDataFrame(rows, ITEM)
    got = lanes.feed(items, lanes.Subject(company=" acme "), limit=10).collect()
    assert [r["id"] for r in got] == ["3", "2", "5"]
    assert got[1]["providers"] == ["a", "b"] and got[0]["all_tags"] == ["dividend", "own"] and got[1]["event_kind"] == "rating"
    inside = lanes.feed(items, lanes.Subject(company="acme"), since=datetime.datetime(2024, 1, 3), until=datetime.datetime(2024, 1, 5))
    assert sorted(r["id"] for r in inside.collect()) == ["2", "3"]
    assert lanes.feed(items, lanes.Subject(company="acme"), limit=0).count() == 0
    assert lanes.watchlist(items, [lanes.Subject(company="acme"), lanes.Subject(query="other")]).count() == 4
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError, match="limit"):
            lanes.feed(items, lanes.Subject(query="x"), limit=bad)
    with pytest.raises(ValueError, match="since"):
        lanes.in_window(items, "published_at", datetime.datetime(2024, 2, 1), datetime.datetime(2024, 1, 1))


def test_status(spark):
    items = spark.createDataFrame([("a",), ("a",)], "provider string")
    providers = spark.createDataFrame([("a", True, None), ("b", True, None), ("c", True, "http"), ("d", True, "config"), ("e", False, None)], "provider string, supported boolean, error_code string")
    got = lanes.provider_status(items, providers)
    assert {r["provider"]: r["status"] for r in got.collect()} == {"a": "ok", "b": "empty", "c": "error", "d": "disabled", "e": "unsupported"}
    assert lanes.is_partial(got).first()["partial"] and not lanes.is_partial(got.where("provider in ('a', 'b')")).first()["partial"]


def test_release(spark):
    r = lanes.Release("p", "d", datetime.date(2024, 1, 2), spark.range(1), 5)
    assert r.newer_than(None, None) and r.newer_than(datetime.date(2025, 1, 1), 4) and not r.newer_than(datetime.date(2020, 1, 1), 5)
    assert r.newer_than(datetime.date(2024, 1, 1), None) and not r.newer_than(datetime.date(2024, 1, 2), None)
    assert r.stamped().columns == ["id", "provider", "dataset", "as_of", "sequence"]


def test_snapshot(spark):
    schema = "id string, severity string, country string, observed_at timestamp, latitude double, longitude double"
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [("a", "minor", "us", day(1), 1.0, 2.0), ("b", "extreme", "FR", None, None, None), ("c", "extreme", "US", day(2), 0.0, 0.0), ("d", "odd", None, day(3), None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r["id"] for r in lanes.snapshot(lanes.checked_snapshot(df)).collect()] == ["c", "b", "a", "d"]
    assert [r["id"] for r in lanes.snapshot(df, floor="minor", countries=["us"], limit=1).collect()] == ["c"]
    for bad in (("a", "x", None, None, 1.0, None), ("", "x", None, None, None, None), ("z", "x", None, None, 91.0, 0.0)):
        with pytest.raises(ValueError, match="snapshot"):
            lanes.checked_snapshot(spark.createDataFrame([*rows, bad], schema))


def test_works(spark):
    works = spark.createDataFrame([("k", 1, None, 2000, "pdf", None, None, "m", "preview", "p", "u"), ("k", 0, "T", None, None, "i", None, None, "open-access", "q", "v"), ("j", 2, "S", None, None, None, None, None, None, "p", "w")], "key string, seq int, title string, year int, format string, isbn13 string, doi string, md5 string, availability string, provider string, url string")
    got = lanes.merge_works(works).collect()
    assert [(r["key"], r["title"], r["year"], r["isbn13"], r["availability"], len(r["provenance"])) for r in got] == [("k", "T", 2000, "i", "open-access", 2), ("j", "S", None, None, None, 1)]


def test_resolve(spark):
    schema = "id string, title string, authors array<string>, year int, isbn13 string, doi string"
    records = spark.createDataFrame([("r1", "The Art of War", ["Sun Tzu"], 1910, None, None), ("r2", "Unknown Book", ["X Y"], 2000, "978", None)], schema)
    authority = spark.createDataFrame([("s1", "Art of War", ["Tzu"], 1910, None, None), ("s2", "Art of War", ["Other"], 1990, None, None), ("s3", "Something", [], None, "978", None)], schema)
    got = lanes.resolve(records, authority).collect()
    assert sorted((r["record_id"], r["source_id"], r["score"], r["rank"]) for r in got) == [("r1", "s1", 1.0, 1), ("r2", "s3", 1.0, 1)]


def test_quotes_and_centroids(spark):
    df = spark.createDataFrame([(40.0, 60.0), (0.0, 30.0), (None, None), (150.0, None)], "b double, a double")
    assert [r[0] for r in df.select(lanes.implied_probability(F.col("b"), F.col("a"), 100.0)).collect()] == [0.5, 0.3, None, 1.0]
    square = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)],)], "r array<struct<x double, y double>>")
    assert tuple(square.select(lanes.ring_centroid(F.col("r")).alias("c")).first()["c"]) == (4.0, 1.0, 1.0)
