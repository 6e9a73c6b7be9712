import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, rows
from tidemill.llm import langid, queries
from tidemill.llm._common import character_grams, gram_hashes, hash_strings


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op9_langid(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_word_first_then_shorter_grams():
    def made(**rows):
        names = sorted(rows)
        return names, np.array([rows[n] for n in names], np.float32)

    def sorted_table(hashes, rows):
        order = np.argsort(hashes)
        return langid.Table(hashes[order], rows[order])

    names, rows_ = made(known=[-1.0, -9.0])
    words = sorted_table(hash_strings(pa.array(names, pa.large_string())), rows_)
    grams = {o: langid.Table(np.zeros(0, np.uint64), np.zeros((0, 2), np.float32)) for o in langid.ORDERS}
    for order, known in ((5, {"<abcd": [-2.0, -1.0]}), (2, {"ab": [0.0, -5.0], "bz": [-2.0, -5.0]}), (1, {"q": [-1.0, -3.0]})):
        grams[order] = sorted_table(gram_hashes(list(known)), np.array(list(known.values()), np.float32))
    got = langid.Model(["x", "y"], words, grams).word_scores(pa.array(["known", "abcde", "zabz", "zqz", "zzz"]))
    p = langid.PENALTY
    assert np.allclose(got, [[-1.0, -9.0], [-2.0 + p, -1.0 + p], [-1.0 + 4 * p, -5.0 + 4 * p], [-1.0 + 5 * p, -3.0 + 5 * p], [0.0, 0.0]])


def test_tables_are_log_shares(spark):
    docs = spark.createDataFrame(rows((1, "aa aa bb"), lang="x") + rows((2, "bb cc"), lang="y") + rows((3, "zz"), lang=None), SCHEMA)
    model = langid.fit(docs, F.lit(True))
    assert model.languages == ["x", "y"] and len(model.words.keys) == 3
    aa = model.words.rows[model.words.find(hash_strings(pa.array(["aa"], pa.large_string())))[0]]
    assert np.allclose(aa, [np.log(2.5 / 4.5), np.log(0.5 / 3.5)])
    assert model.words.find(hash_strings(pa.array(["zz"], pa.large_string())))[0] == -1


def plain_words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def test_against_a_plain_loop(spark):
    """Tables, backoff, predictions and scores with plain dictionaries: every word and n-gram of the training texts counts."""
    rng = np.random.default_rng(6)
    stems = {"x": ["alpha", "beta", "gamma", "el", "do"], "y": ["alphe", "beto", "gimme", "le", "de"]}
    docs = [(k, " ".join(rng.choice(stems[lang], 3)) + f" q{'abcdefgh'[k % 8]}r", lang) for k in range(40) for lang in ["xy"[k % 2]]] + [(40, "zzz 12", None), (41, "gammel", "x"), (42, "", "x")]
    df = spark.createDataFrame([row for i, t, lang in docs for row in rows((i, t), lang=lang)], SCHEMA)
    train = [(t, lang) for i, t, lang in docs if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    languages = sorted({lang for _, lang in train})
    grams_of = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]

    def shares(parts):
        counts = {lang: Counter(p for t, x in train if x == lang for w in plain_words(t) for p in parts(w)) for lang in languages}
        keys = set().union(*counts.values())
        return {k: np.array([np.log((counts[x][k] + 0.5) / (sum(counts[x].values()) + 0.5 * len(keys))) for x in languages]) for k in keys}

    known = shares(lambda w: [w])
    by_order = {n: shares(lambda w, n=n: grams_of(w, n)) for n in langid.ORDERS}

    def word(w):
        if w in known:
            return known[w]
        for k, n in enumerate(langid.ORDERS):
            found = [by_order[n][g] for g in grams_of(w, n) if g in by_order[n]]
            if found:
                return np.mean(found, axis=0) + (k + 1) * langid.PENALTY
        return np.zeros(len(languages))

    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert got.keys() == {i for i, _, _ in docs}
    for i, text, _ in docs:
        w = plain_words(text)
        if not w:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        total = sum(word(x) for x in w) * min(20, len(w)) / len(w)
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[i]["lang_pred"] == languages[int(total.argmax())] and abs(got[i]["score"] - share.max()) < 1e-4


def test_grams_are_those_of_a_plain_loop():
    words = ["a", "été", "longer"]
    for n, (owner, hashes) in enumerate(character_grams(pa.array(words), 5), 1):
        plain = [(k, f"<{w}>"[i : i + n]) for k, w in enumerate(words) for i in range(len(w) + 3 - n)]
        assert owner.tolist() == [k for k, _ in plain] and (hashes == gram_hashes([g for _, g in plain])).all()


def test_messy(spark, messy, empty):
    got = langid.identify(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        text = {x["doc_id"]: x["text"] for x in messy.where("doc_id is not null").collect()}.get(r["doc_id"], "a")
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) or r["doc_id"] is None
        assert (r["lang_pred"] == "und") == (r["score"] == 0)
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    a = langid.identify(docs).orderBy("doc_id").collect()
    b = langid.identify(docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))).orderBy("doc_id").collect()
    assert a == b


def test_accepted(messy):
    kept = langid.accepted(messy, langid.fit(messy, F.lit(True)))
    assert kept.columns == messy.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 8, 9, 10, 11, None}
