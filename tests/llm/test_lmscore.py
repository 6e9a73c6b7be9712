from collections import Counter

import numpy as np

from tests.llm.conftest import SCHEMA, rows
from tidemill.llm import lmscore, queries

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, good, words=10**6, weight=2.0):
    """(difference, tokens) of each text with plain dictionaries; as long as no slots are shared."""
    split = {i: ["".join(c for c in w if c.isalnum()) for w in (t or "").lower().split()] for i, t in docs}
    split = {i: [w for w in s if w] for i, s in split.items()}
    total = Counter(w for s in split.values() for w in s)
    vocab = {w for w, _ in sorted(total.items(), key=lambda x: -x[1])[:words]}
    models = []
    for own in ([*split], [i for i in split if i in good]):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for i in own:
            seq = [w if w in vocab else None for w in split[i]]
            uni.update(seq)
            bi.update(zip(["<s>", *seq], seq, strict=False))
            ctx["<s>"] += bool(seq)
        models.append((uni, ctx, bi))
    size = len(vocab) + 1

    def loss(model, seq):
        uni, ctx, bi = model
        n = sum(uni.values())
        out = []
        for v, w in zip(["<s>", *seq], seq, strict=False):
            c = ctx[v] if v == "<s>" else uni[v]
            out.append(-np.log((bi[v, w] + weight * (uni[w] + 1) / (n + size)) / (max(c, bi[v, w]) + weight)))
        return np.mean(out)

    out = {}
    for i, s in split.items():
        seq = [w if w in vocab else None for w in s]
        out[i] = (loss(models[1], seq) - loss(models[0], seq), len(seq)) if seq else (None, 0)
    return out


def test_against_dictionaries(spark):
    docs = [(k, " ".join(f"w{(k * j * j + j) % 23}" for j in range(3 + 5 * k))) for k in range(20)] + [(20, None), (21, ""), (22, "!!")]
    labels = spark.createDataFrame([(k, int(k < 7), 0) for k in range(20)] + [(3, 0, 0), (None, 1, 0)], LABELS)
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(spark.createDataFrame(rows(*docs), SCHEMA), labels, slots=1 << 24).collect()}
    want = brute(docs, set(range(7)))
    assert got.keys() == want.keys()
    for i, (d, n) in want.items():
        assert got[i]["n_tokens"] == n
        assert (got[i]["difference"] is None) if d is None else abs(got[i]["difference"] - d) < 1e-4


def test_target_scores_lower(spark):
    d = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op5_lmscore(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    mean = lambda q: np.mean([r["difference"] for r in got if quality.get(r["doc_id"]) == q])
    assert mean(1) < mean(0)


def test_messy(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], LABELS)
    got = lmscore.cross_entropy_difference(messy, labels, slots=1 << 12).collect()
    assert len(got) == messy.count()
    assert {r["doc_id"] for r in got if r["difference"] is None} == {3, 4, 5, None} and sum(r["n_tokens"] == 0 for r in got) == 4
    assert lmscore.cross_entropy_difference(empty, labels, slots=16).count() == 0
    assert lmscore.cross_entropy_difference(messy, labels.limit(0), slots=1 << 12).count() == messy.count()


def test_every_word_and_pair_counts_for_itself(spark):
    """More words and pairs than any fixed table once held (30,000 words, 2**20 slots), and chunks that share them."""
    rng = np.random.default_rng(7)
    docs = [(k, " ".join(f"w{x}" for x in np.concatenate([rng.integers(0, 60_000, 9_000), rng.integers(0, 50, 300)]))) for k in range(150)]
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(150)], LABELS)
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(spark.createDataFrame(rows(*docs), SCHEMA), labels, chunk_tokens=50_000).collect()}
    want = brute(docs, set(range(40)))
    assert got.keys() == want.keys()
    for i, (d, n) in want.items():
        assert got[i]["n_tokens"] == n and abs(got[i]["difference"] - d) < 1e-6
