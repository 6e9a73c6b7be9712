import itertools
from collections import Counter

import numpy as np

from tests.llm.conftest import SCHEMA, rows, words
from tidemill.llm import neardup, queries
from tidemill.llm._common import bag, bag_similarity, word_hashes, word_hashes_of


def brute(docs, threshold=0.8):
    """The class of each row, as the number of its first row, by comparing all pairs."""
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in docs]
    for a, b in itertools.combinations(range(len(docs)), 2):
        if docs[a][1] is not None and docs[b][1] is not None and (docs[a][1] == docs[b][1] or bag_similarity(bags[a], bags[b]) >= threshold):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(docs))]


def named_classes(docs):
    """class_id of each row, or None where no row of the class has an id of its own."""
    often = Counter(i for i, _ in docs)
    own = [i if i is not None and i >= 0 and often[i] == 1 else None for i, _ in docs]
    labels = brute(docs)
    best = {c: min((i for i, x in zip(own, labels, strict=True) if x == c and i is not None), default=None) for c in labels}
    return labels, [best[c] for c in labels]


def check(df):
    """Every row has its class; classes are told apart, named by the smallest id, and have one representative each."""
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = neardup.classes(df).collect()
    labels, names = named_classes(docs)
    plain = lambda x: -(10**6) if x is None else x
    assert sorted((plain(r["doc_id"]), plain(r["class_id"] if r["class_id"] < neardup.UNNAMED else None)) for r in got) == sorted((plain(i), plain(c)) for (i, _), c in zip(docs, names, strict=True))
    assert len({r["class_id"] for r in got}) == len(set(labels))
    assert sorted(Counter(r["class_id"] for r in got).values()) == sorted(Counter(labels).values())
    assert Counter(r["class_id"] for r in got if r["representative"]) == Counter({r["class_id"] for r in got})
    assert all(r["doc_id"] == r["class_id"] for r in got if r["representative"] and r["class_id"] < neardup.UNNAMED)


def test_messy(messy):
    check(messy)


def test_empty(empty):
    assert neardup.classes(empty).count() == 0
    assert neardup.deduplicated(empty).columns == empty.columns


def test_chains_and_crowds(spark):
    """Edits that add up to a chain, a crowd of near copies, and texts that share half: all as brute force says."""
    base = words(5, 150).split()
    pairs = []
    for k in range(12):
        pairs.append((k, " ".join([*words(99, 8 * k).split(), *base[8 * k :]])))
    rng = np.random.default_rng(0)
    for k in range(60):
        own = base.copy()
        for at in rng.integers(0, len(own), int(rng.integers(1, 7))):
            own[at] = f"edit{k}x{at}"
        pairs.append((100 + k, " ".join(own)))
    for k in range(20):
        pairs.append((200 + k, " ".join(base[:75]) + " " + words(300 + k, 75)))
    check(spark.createDataFrame(rows(*pairs), SCHEMA))


def test_repeated_ids_with_other_texts(spark):
    a, b, c = (words(k, 40) for k in (71, 72, 73))
    check(spark.createDataFrame(rows((1, a), (1, b), (1, None), (2, b), (3, a + " more"), (4, c), (4, c), (5, None), (5, None)), SCHEMA))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    test_chains_and_crowds(spark)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows_ = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i: c for (i, _), c in zip(rows_, named_classes(rows_)[1], strict=True)}
    assert {r["doc_id"]: r["class_id"] for r in queries.op3_neardup(spark, "/root/testdata/sf0.001").collect()} == want


def test_deduplicated(messy):
    """One row of each class: a text of a repeated id stays only if no row with an id of its own has it."""
    kept = neardup.deduplicated(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == [None]


def test_deduplicated_judges_rows(spark):
    """Clean texts of a repeated id stay, whatever happens to the id's other rows; of equal rows one stays."""
    a, b, c = (words(k, 40) for k in (81, 82, 83))
    df = spark.createDataFrame(rows((0, a), (1, a), (1, b), (2, c), (3, c + " more"), (None, b + " more"), (4, None), (4, None), (-5, "one two")), SCHEMA)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.deduplicated(df).collect())
    assert len(kept) == 6 and kept[:2] == [(-5, "one two"), (0, a)] and (2, c) in kept and kept.count((4, "")) == 2
    assert len({(0, b + " more"), (1, b)} & set(kept)) == 1


def test_hot_copies_and_a_stray(spark, monkeypatch):
    """A third of all rows share a text; a crowd of near copies shares a bucket with strangers. Blocks stay small."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = words(5, 60).split()
    crowd = [(1000 + k, " ".join([*base, f"own{k}"])) for k in range(60)]
    hot = [(2000 + k, "the same text in very many rows") for k in range(150)]
    half = [(3000 + k, " ".join([*base[: 30 + 3 * k], *words(400 + k, 30).split()])) for k in range(10)]
    check(spark.createDataFrame(rows(*crowd, *hot, *half), SCHEMA))


def test_signatures_are_unbiased():
    """Agreement of components estimates the weighted Jaccard similarity of multisets."""
    rng = np.random.default_rng(1)
    for n, over in ((3, 2), (40, 25), (300, 250)):
        gaps = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:over], pool[n : 2 * n - over]])
            x, y = (a, rng.integers(1, 12, n)), (b, rng.integers(1, 12, n))
            s = neardup.signatures([x, y], 192)
            gaps.append((s[0] == s[1]).mean() - bag_similarity(x, y))
        assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.06


def test_signature_does_not_depend_on_the_batch():
    bags = [bag(words(k, n)) for k, n in enumerate((1, 6, 50, 700, 0, 30))]
    together = neardup.signatures(bags, 96)
    for b, row in zip(bags, together, strict=True):
        assert (neardup.signatures([b], 96)[0] == row).all()
    assert not together[4].any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (95, 120), (7, 7)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 90 for i in (90, 95, 100, 120)}}


def test_word_hashes():
    assert (word_hashes("Ab, c--D  !") == word_hashes("ab cd")).all()
    assert [len(w) for w in word_hashes_of([None, "", "!!", "a b"])] == [0, 0, 0, 2]
    assert len(set(word_hashes(words(9, 5000)).tolist())) == len(set(words(9, 5000).split()))
