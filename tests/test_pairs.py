"""Pairs and identities where many rows have the same names."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import lanes, similarity
from tidemill.plans import queries

PART = "/root/testdata/sf0.001/part.parquet"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """part.parquet twenty times over with keys of its own, and a repeated key."""
    folder = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"copy (select * exclude k replace (p_partkey + k * 1000 as p_partkey) from '{PART}', range(20) r(k) union all select * from '{PART}' where p_partkey = 7) to '{folder}/part.parquet'")
    return str(folder)


def moved(df):
    """Rows that all shuffles of a finished plan wrote."""

    def walk(node):
        kind, metrics = node.getClass().getSimpleName(), node.metrics()
        n = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        below = node.children()
        return n + sum(map(walk, inner + [below.apply(i) for i in range(below.size())]))

    return walk(df._jdf.queryExecution().executedPlan())


def as_sql(spark, copies, name):
    """The query's rows, checked against its SQL, and the rows that it moved."""
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{copies}/part.parquet'")
    df = queries.QUERIES[name](spark, copies)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.sql(f"select {', '.join(df.columns)} from ({queries.ORACLES[name]})").fetchall())
    return got, moved(df)


def test_pairs_of_large_groups_arent_moved(spark, copies):
    got, rows = as_sql(spark, copies, "identifier_or_match")
    assert rows < len(got) / 4


def test_agreeing_pairs(spark):
    rng = random.Random(2)
    pick = lambda *of: rng.choice([None, *of])
    rows = [(i // 2 if i < 9 else i, pick("x", "y", "z"), pick(1.5, 2.5, float("nan"), 0.0, -0.0), pick(*range(9))) for i in range(120)]
    agree = lambda p, q: any(x is not None and (x == y or (x != x and y is not None and y != y)) for x, y in zip(p[1:], q[1:], strict=True))
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and agree(p, q))
    df = spark.createDataFrame([*rows, (None, "x", 1.5, 1)], "id long, s string, d double, n int")
    for size in (1, 4, 1000):
        assert sorted(map(tuple, similarity.agreeing_pairs(df, "id", ["s", "d", "n"], size).collect())) == want


WORKS = "id long, title string, authors array<string>, year int, isbn13 string"


def scores(records, authority, k, floor):
    """Each record with each work, by the definition."""
    rounded = lambda x: math.floor(x * 1000 + 0.5) / 1000
    least, best = max(0.05, (floor - 0.4) / 0.6), {}
    for i, title, names, year, isbn in records:
        for j, other, more, when, code in authority:
            x, y = set((title or "").split()), set((other or "").split())
            dice = rounded(2.0 * len(x & y) / (len(x) + len(y))) if x and y else 0.0
            author = 1.0 if set(names or ()) & set(more or ()) else 0.0
            near = 0.0 if year is None or when is None else {0: 1.0, 1: 0.6, 2: 0.3}.get(abs(year - when), 0.0)
            score = rounded(dice * 0.6 + author * 0.25 + near * 0.15) if dice >= least else 0.0
            best[i, j] = max(best.get((i, j), 0.0), 1.0 if isbn and isbn == code else score)
    out = []
    for i in {r[0] for r in records}:
        top = sorted((-v, j) for (r, j), v in best.items() if r == i and v >= floor)[:k]
        out += [(i, j, -v, n) for n, (v, j) in enumerate(top, 1)]
    return sorted(out)


@pytest.mark.parametrize("floor,k,longest", [(0.82, 3, 6), (0.6, 10, 6), (0.3, 2, 6), (0.7, 4, 11)])
def test_resolve_finds_the_best(spark, floor, k, longest):
    rng = random.Random(longest * k)
    words = "red blue old new hot cold ring bolt rod plate anvil gear".split()

    def work(i):
        title = rng.sample(words[: longest + 1], rng.randint(1, longest))
        return (i, rng.choice([" ".join(title)] * 9 + [None]), rng.choice([None, [], ["ann"], ["ann", "bob"], ["cy"]]), rng.choice([None, *range(2000, 2005)]), rng.choice([None] * 9 + ["x", "y"]))

    records, authority = [work(i) for i in range(40)], [work(i // 2 if i < 20 else i) for i in range(150)]
    got = lanes.resolve(spark.createDataFrame(records, WORKS), spark.createDataFrame(authority, WORKS), k, floor).collect()
    assert sorted(map(tuple, got)) == scores(records, authority, k, floor)


def test_resolve_with_one_title(spark):
    """All works have the same title; the pairs grow with the records."""
    n = 1500
    rows = spark.createDataFrame([(i, "Same Short Title", ["Jane Austen"], 1813, None) for i in range(n)], WORKS)
    found = lanes.resolve(rows, rows, 3)
    assert sorted(map(tuple, found.collect())) == [(i, j, 1.0, j + 1) for i in range(n) for j in range(3)]
    assert moved(found) < n * n / 10


def test_similar_titles_as_sql(spark, copies):
    as_sql(spark, copies, "title_dice_similarity")


def test_pairs_of_similar_titles_arent_moved(spark):
    """As with large tables, joins aren't broadcasts."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    df = spark.range(60).select(F.col("id").alias("b"), F.split(F.concat(F.lit("red blue old new n"), "id"), " ").alias("t"))
    many = spark.range(6000).select(F.col("id").alias("a"), F.split(F.concat(F.lit("red blue old new n"), F.col("id") % 60), " ").alias("t"))
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found = similarity.candidates(many, df, "a", "b", "t", 0.8)
        got = found.collect()
    finally:
        for k in own:
            spark.conf.unset(k)
    assert len({(r["a"], r["b"]) for r in got}) == len(got) == 60 * 6000
    assert moved(found) < len(got) / 4


def test_candidates_in_blocks(spark):
    rng = random.Random(8)
    titles = [" ".join(rng.sample("red blue old new hot".split(), rng.randint(1, 3))) for _ in range(80)]
    sets = [set(t.split()) for t in titles]
    dice = lambda x, y: math.floor(2.0 * len(x & y) / (len(x) + len(y)) * 1000 + 0.5) / 1000
    want = sorted((i, j, dice(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets[:60]) if dice(x, y) >= 0.6)
    df = spark.createDataFrame(list(enumerate(titles)), "a long, title string").select("a", similarity.title_tokens(F.col("title")).alias("t"))
    for size in (1, 3, 1000):
        got = similarity.candidates(df, df.where("a < 60").withColumnRenamed("a", "b"), "a", "b", "t", 0.6, size)
        assert sorted(map(tuple, got.collect())) == want
