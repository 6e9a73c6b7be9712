import numpy as np
import pytest

from tidemill.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, query_id string, rank int"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "q", 1) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], SCHEMA)


def brute(ids, x, every, k):
    x = x.astype(np.float32).astype(np.float64)
    out = {}
    for at, i in enumerate(ids):
        if i % every == 0:
            s = (x * x[at]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want, k):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / k for q in want])


def clustered(rng, n, d=32, spread=0.15):
    """Rows in small groups, as real embeddings have: neighbours are far nearer than others."""
    centres = rng.normal(size=(n // 25, d))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))


def coded(x, bits=256):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.learn_rotations(ann.on_sphere(x, 1.0), bits)
    return ann.bits_of(ann.on_sphere(x, 1.0), *model)


def test_radius_finds_every_code():
    rng = np.random.default_rng(0)
    for length in (64, 100, 256):
        bits = rng.integers(0, 2, (500, length), dtype=np.uint8)
        index = ann.MultiIndex(bits)
        near = bits[7].copy()
        near[[0, 5, length - 1]] ^= 1
        for r in (0, 2, 5, 8, 15, 24, length // 2, length):
            for q in (bits[3], near, rng.integers(0, 2, length, dtype=np.uint8)):
                assert (index.within(q, r) == np.flatnonzero((bits != q).sum(axis=1) <= r)).all()


def test_tables_and_scan_find_the_same():
    """All rows within the smallest radius that holds enough, whichever way they are found."""
    rng = np.random.default_rng(3)
    for x in (clustered(rng, 3000), rng.normal(size=(3000, 32))):
        bits = coded(x)
        index = ann.MultiIndex(bits)
        for q in range(0, 3000, 60):
            for enough in (1, 30, 5000):
                d = (bits != bits[q]).sum(axis=1)
                want = np.flatnonzero(d <= np.sort(d)[min(enough, 3000) - 1])
                assert (np.sort(index.nearest(bits[q], enough)) == want).all()
        assert not index.seen.any()


def test_tables_look_at_few_rows_where_there_is_structure():
    """Doubled rows: what a query looks at stays a small share and doesn't double."""
    shares = []
    for n in (8000, 16_000):
        bits = coded(clustered(np.random.default_rng(4), n))
        index = ann.MultiIndex(bits)
        for q in range(0, n, 80):
            index.nearest(bits[q], 8)
        assert index.found > 0.9 * index.asked
        shares.append(index.looked_at / index.asked / n)
    assert shares[0] < 0.1 and shares[1] < 0.75 * shares[0]


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 32))
    want = brute(np.arange(1500), x, 20, 10)
    got = as_lists(ann.search(table(spark, x), k=10, shard_rows=400, block=30))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want, 10) >= 0.9
    for v in got.values():
        assert [(-s, i) for i, s in v] == sorted((-s, i) for i, s in v)


def test_recall_with_skewed_norms(spark):
    """Norms over three orders of magnitude: the nearest by inner product are mostly the long ones."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 24)) * np.exp(1.2 * rng.normal(size=(2000, 1)))
    want = brute(np.arange(2000), x, 20, 20)
    got = as_lists(ann.search(table(spark, x)))
    assert recall(got, want, 20) >= 0.9


def test_exhaustive_is_exact_with_hot_vectors(spark):
    """A third of all rows share a vector; ties go to the smaller id."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(240, 8)), 1)
    x[:80] = x[0]
    ids = rng.permutation(240)
    want = brute(ids, x, 20, 20)
    got = as_lists(ann.search(table(spark, x, ids), k=20, least=10**6))
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert np.allclose([s for _, s in got[q]], [s for _, s in rows])


def test_lengths_and_shared_ids(spark):
    """Vectors of another length meet each other; rows that share an id but not a vector are rows of their own."""
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.5, 0.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [3.0, 2.0])]
    got = ann.search(spark.createDataFrame([(i, v, "q", 1) for i, v in rows], SCHEMA)).collect()
    found = sorted((r["query_id"], r["query_row"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert found == [(0, 0, 1, 1, 0.5), (20, 0, 1, 3, 2.0), (20, 0, 2, 20, 0.0), (20, 1, 1, 3, 3.0), (20, 1, 2, 20, 0.0)]


def test_messy(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "a", 1), (20, [0.5, 0.5], "a", 1), (1, None, "a", 1), (2, [], "a", 1), (40, [0.0, 0.0], "a", 1), (3, [nan, 1.0], None, None), (4, [1.0, None], "a", 1), (5, [1.0, 2.0, 3.0], "a", 1), (None, [1.0, 1.0], "a", 1), (6, [2.0, 1.0], "a", 1), (6, [2.0, 1.0], "a", 1), (7, [float("inf"), 1.0], "a", 1)]
    got = as_lists(ann.search(spark.createDataFrame(rows, SCHEMA)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [6, 20], 20: [6, 0]}
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.search(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    e = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    want = brute(np.array([i for i, _ in e]), np.array([v for _, v in e]), 20, 20)
    assert recall(as_lists(queries.op4_ann(spark, d)), want, 20) >= 0.9
