import random

from pyspark.sql import functions as F

from tidemill.operators import merge, ranges, series, similarity


def fold(rows):
    """The ordered fold, row by row."""
    kept = None
    for seq, score, tagged in sorted(rows):
        if kept is None:
            kept = [seq, score, tagged]
        else:
            if score + tagged > kept[1] + kept[2]:
                kept[:2] = [seq, score]
            kept[2] = kept[2] or tagged
    return kept[0], kept[1] + kept[2]


def test_fold_winner(spark):
    rng = random.Random(3)
    rows = [(k, k * 1000 + i, rng.randint(0, 10), rng.random() < 0.3) for k in range(150) for i in range(rng.randint(1, 25))]
    rows += [(-1, 0, 5, False), (-1, 1, 4, True), (-1, 2, 5, True)]
    got = {r["k"]: (r["seq"], r["score"]) for r in merge.fold_winner(spark.createDataFrame(rows, "k int, seq long, score int, tagged boolean"), "k", "seq", "score", "tagged").collect()}
    assert got == {k: fold([r[1:] for r in rows if r[0] == k]) for k in got} and got[-1] == (0, 6)


def test_first_wins_and_first_non_null(spark):
    df = spark.createDataFrame([("a", 2, None, "x"), ("a", 1, None, "y"), ("a", 3, 7, None), ("b", 1, 5, None)], "k string, seq int, n int, t string")
    assert sorted((r["k"], r["seq"]) for r in merge.first_wins(df, ["k"], "seq").collect()) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, merge.first_non_null(df, ["k"], "seq", ["n", "t"]).collect())) == [("a", 7, "y"), ("b", 5, None)]


def test_changes_and_carry(spark):
    df = spark.createDataFrame([(i, float(v), c) for i, (v, c) in enumerate([(1, "x"), (2, None), (4, None), (8, "y"), (8, None)])], "t int, v double, c string")
    out = df.select("t", series.change(df, "t", "v", "pch").alias("pch"), series.change(df, "t", "v", "ch1", 2).alias("y"), series.carry_forward("c", ["t"], []).alias("c"), series.changed("v", ["t"], []).alias("new")).orderBy("t").collect()
    assert [r["pch"] for r in out] == [None, 100.0, 100.0, 100.0, 0.0]
    assert [r["y"] for r in out] == [None, None, 3.0, 6.0, 4.0]
    assert [r["c"] for r in out] == ["x", "x", "x", "y", "y"]
    assert [r["new"] for r in out] == [True, True, True, True, False]


def test_candidates_are_all_similar_pairs(spark):
    rng = random.Random(5)
    titles = [" ".join(rng.sample("alpha beta gamma delta eps zeta eta theta iota".split(), rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string").select("i", similarity.title_tokens(F.col("title")).alias("t"))
    got = {(r["a"], r["b"]) for r in similarity.candidates(df.withColumnRenamed("i", "a"), df.withColumnRenamed("i", "b"), "a", "b", "t", 0.75).collect()}
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y))
    sets = [set(t.split()) for t in titles]
    assert got == {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if round(dice(x, y), 3) >= 0.75}


def test_first_range(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, 99.0), (4, 10.0)], "__id int, p double")
    spans = spark.createDataFrame([(2, 0.0, 20.0), (1, 10.0, 30.0)], "o int, low double, high double")
    got = {r["__id"]: r["o"] for r in ranges.first_range(points, spans, "p", "low", "high", "o", 7.0).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: 1}
