import zlib

from tests.llm.conftest import SCHEMA, rows
from tidemill.llm import queries, sharding


def jump(key, n):
    """Lamping and Veach's loop."""
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_matches_the_loop(spark):
    keys = [0, 1, -1, 5, 2**63 - 1, -(2**63), 123456789012345, *range(1000, 1400)]
    got = sharding.shard_documents(spark.createDataFrame(rows(*((k, "t") for k in keys)), SCHEMA), shards=40).collect()
    assert len(got) == len(keys)
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 40), jump(r["doc_id"], 41))
        assert r["grown_shard"] in (r["shard"], 40)


def test_messy(messy):
    got = sharding.shard_documents(messy, shards=3, buckets=2).collect()
    assert len(got) == messy.count()
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    null = [r for r in got if r["doc_id"] == 3][0]
    assert (null["size"], null["text_crc32"], null["law"]) == (16, 0, "key")
    accents = [r for r in got if r["doc_id"] == 9][0]
    assert (accents["size"], accents["text_crc32"]) == (16 + len("Été ça, naïve.".encode()), zlib.crc32("Été ça, naïve.".encode()))


def test_empty(empty):
    assert sharding.shard_documents(empty).count() == 0


def test_query(spark):
    got = queries.op1_sharding(spark, "/root/testdata/sf0.001").collect()
    assert all(r["shard"] == jump(r["doc_id"], 40) for r in got)


def test_slots_dont_depend_on_the_order_of_rows(spark):
    """Rows that share an id and a size but not a text keep their slots."""
    pairs = [(7, f"{k:04d}") for k in range(60)] + [(None, f"{k:04d}") for k in range(60)]
    runs = []
    for own in (pairs, pairs[::-1]):
        got = sharding.shard_documents(spark.createDataFrame(rows(*own), SCHEMA).repartition(7), shards=4, buckets=2).collect()
        runs.append({(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in got})
    assert runs[0] == runs[1] and len(runs[0]) == 120
