import numpy as np

from tests.llm.conftest import SCHEMA, rows, words
from tidemill.llm import decontamination, queries


def items(spark, *pairs):
    return spark.createDataFrame([(i, t, "x") for i, t in pairs], "item_id long, text string, doc_id string")


def leak(passage, at, seed, change=()):
    own = passage.split()
    for k in change:
        own[k] = f"other{k}"
    w = words(seed, 300).split()
    return " ".join(w[:at] + own + w[at:])


def test_substitutions_are_tolerated_and_clean_texts_are_not_hit(spark):
    passage, short = words(1000, 40), words(1001, 7)
    cases = [
        (1, leak(passage, 0, 1)),
        (2, leak(passage, 100, 2, change=(7, 16, 25, 34))),
        (3, leak(passage, 300, 3, change=(0, 12, 20, 28, 36))),
        (4, leak(" ".join(passage.split()[10:30]), 50, 4)),
        (5, leak(" ".join([*passage.split()[:20], "extra", *passage.split()[20:]]), 9, 5, change=(3, 33))),
        (6, leak(short, 9, 6)),
        (7, words(7, 300)),
        (8, leak(" ".join(passage.split()[:6]), 9, 8)),
        (9, leak(passage.upper().replace(" ", ", "), 9, 9)),
    ]
    got = decontamination.leaks(spark.createDataFrame(rows(*cases), SCHEMA), items(spark, (1, passage), (2, short), (3, None), (4, ""), (5, "a b"))).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (9, 1)]
    first = [r for r in got if r["doc_id"] == 1][0]
    assert (first["matched"], first["item_words"], first["first_word"]) == (40, 40, 0)


def test_chunks_give_the_same(spark):
    passages = [words(2000 + k, 30) for k in range(9)]
    docs = spark.createDataFrame(rows(*((k, leak(p, 20, k)) for k, p in enumerate(passages))), SCHEMA)
    bench = items(spark, *enumerate(passages))
    whole, parts = (sorted(map(tuple, decontamination.leaks(docs, bench, chunk_bytes=n).collect())) for n in (10**6, 300))
    assert whole == parts and len(whole) == 9


def test_messy_and_empty(spark, messy, empty):
    passage = messy.where("doc_id = 2").first()["text"]
    bench = items(spark, (1, passage), (1, passage), (None, "null id"))
    got = decontamination.leaks(messy, bench).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted([1, 1, 2, 0, 10, 11] * 2)
    kept = decontamination.decontaminated(messy, bench)
    assert kept.columns == messy.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, None}
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(messy, bench.limit(0)).count() == 0


def test_query_against_a_plain_search(spark):
    """At sf0.001 every leak is a whole passage: those that a search for the words finds."""
    d = "/root/testdata/sf0.001"
    norm = lambda t: " " + " ".join("".join(c for c in w if c.isalnum()) for w in (t or "").lower().split()) + " "
    docs = {r["doc_id"]: norm(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    bench = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, p in bench.items() if p in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, d).collect()}
    assert got >= want and len(got - want) <= 2


def test_best_segment():
    equal = np.array([0, 1, 1, 0, 1, 1, 0, 0, 0, 1], bool)
    assert decontamination.best_segment(equal) == (1, 6)


def test_every_good_segment_counts():
    """Two exact runs of 12 words with 11 replaced between them: 24 of 35 words are too few, but each run alone is a leak."""
    own = [f"a{k}" for k in range(35)]
    index = decontamination.build_index([(1, " ".join(own))])
    text = " ".join([*own[:12], *(f"x{k}" for k in range(11)), *own[23:]])
    assert list(decontamination.find([text], index, 0.7, 10, 0.7)) == [(0, (0, 24, 0))]
    rng = np.random.default_rng(1)
    for _ in range(300):
        equal = rng.random(30) < 0.6
        want = np.zeros(30, bool)
        for a in range(30):
            for b in range(a + 1, 31):
                if equal[a:b].sum() >= max(5, 0.7 * (b - a) - 1e-9):
                    want[a:b] |= equal[a:b]
        assert (decontamination.good_words(equal, 0.7, 5) == want).all()


def test_every_allowed_pattern_has_a_hit():
    """All patterns of 5 to 14 words with 0.7 equal; an item with every 4th word replaced; a short one with a word replaced."""
    for n in range(5, 15):
        for code in range(1 << n):
            bits = f"{code:0{n}b}"
            if bits.count("1") >= max(5, 0.7 * n):
                assert any(all(bits[a + i] == "1" for i, on in enumerate(m) if on == "1") for m in decontamination.MASKS for a in range(n - len(m) + 1)), bits
    rng = np.random.default_rng(2)
    for n, replaced in [(40, range(3, 40, 4)), (8, [3]), *((n, rng.choice(n, r, replace=False)) for n, r in ((15, 3), (16, 3), (18, 4), (20, 4)) for _ in range(50))]:
        own = [f"a{k}" for k in range(n)]
        index = decontamination.build_index([(1, " ".join(own))])
        text = " ".join(f"x{k}" if k in set(replaced) else w for k, w in enumerate(own))
        assert len(list(decontamination.find(["other words", text], index, 0.7, 10, 0.7))) == 1


def plain_overlap(own, words, identity, least, share):
    """Matched words of an item by looking at every segment of every diagonal."""
    covered, fewest = set(), min(5, len(own))
    for diagonal in range(-len(own) + 1, len(words)):
        low, high = max(0, -diagonal), min(len(own), len(words) - diagonal)
        equal = [own[i] == words[i + diagonal] for i in range(low, high)]
        for a in range(len(equal)):
            n = 0
            for b in range(a, len(equal)):
                n += equal[b]
                if n >= max(fewest, identity * (b + 1 - a) - 1e-9):
                    covered |= {low + i for i in range(a, b + 1) if equal[i]}
    return len(covered) if len(covered) >= min(least, int(np.ceil(share * len(own)))) and covered else 0


def test_substitutions_against_brute_force(spark):
    """Items of 1 to 25 words with words replaced, dropped and added, in texts of other words."""
    rng = np.random.default_rng(9)
    passages = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 13, 16, 20, 25))]
    docs = []
    for k in range(120):
        own = list(passages[k % len(passages)])
        for at in sorted(rng.choice(len(own), int(rng.integers(0, 1 + len(own) // 3)), replace=False)):
            own[at] = f"new{k}x{at}"
        if k % 5 == 0 and len(own) > 6:
            del own[len(own) // 2]
        if k % 7 == 0:
            own.insert(len(own) // 2, "more")
        other = [f"o{k}x{j}" for j in range(12)]
        docs.append((k, " ".join([*other[:6], *own, *other[6:]])))
    bench = items(spark, *((k, " ".join(p)) for k, p in enumerate(passages)))
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontamination.leaks(spark.createDataFrame(rows(*docs), SCHEMA), bench).collect()}
    want = {(i, k): n for i, t in docs for k, p in enumerate(passages) if (n := plain_overlap(p, t.split(), 0.7, 10, 0.7))}
    assert got == want and len(want) > 60
    kept = decontamination.decontaminated(spark.createDataFrame(rows(*docs), SCHEMA), bench, chunk_bytes=200)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_rows_are_judged_not_ids(spark):
    """Leaked rows without an id go; clean rows that share an id with a leaked one stay."""
    passage, clean = words(1000, 40), words(50, 60)
    docs = spark.createDataFrame(rows((None, leak(passage, 5, 1)), (None, clean), (1, leak(passage, 9, 2)), (1, clean), (1, None)), SCHEMA)
    kept = decontamination.decontaminated(docs, items(spark, (1, passage)))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(0, clean), (1, clean), (1, "")])


def test_a_common_window_in_a_repetitive_text(spark):
    """A window that all items share, many times in one text: hits are counted in parts."""
    passages = [f"which of the following {words(3000 + k, 20)}" for k in range(50)]
    text = " ".join(["which of the following"] * 400)
    index = decontamination.build_index(list(enumerate(passages)))
    found = decontamination.word_hashes_of([text, passages[3]])
    few, many = (decontamination.diagonals(found, index, 10, 0.7, at_once=n) for n in (500, 10**7))
    assert all((a == b).all() for a, b in zip(few, many, strict=True))
    assert {(t, i) for t, (i, *_) in decontamination.find([text, passages[3]], index, 0.7, 10, 0.7)} == {(1, 3)}
