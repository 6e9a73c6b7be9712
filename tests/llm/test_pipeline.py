
import corpus_pipeline
from tests.llm.test_decontamination import leak
from tests.llm.test_neardup import brute
from tests.llm.conftest import words



def test_stages_over_a_small_corpus(spark, tmp_path):
    """Each stage's decision against what it should be, and the rows of the whole."""
    insults = ("worthless", "pathetic", "disgusting", "moron")
    docs, labels = [], []
    for k in range(120):
        toxic = k % 4 == 0
        w = words(k, 80).split()
        docs.append((k, " ".join([*w[:40], *(insults if toxic else ()), *w[40:]]), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    passage = words(9000, 40)
    docs += [(500, words(1, 80), "en", "s", 1), (501, leak(passage, 5, 77), "en", "s", 1), (502, "12 34 !!", "en", "s", 1), (503, None, None, None, None), (504, words(1, 80) + " more", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, kept, at = dict(corpus_pipeline.STAGES), {}, source
    assert list(stages) == ["language", "toxicity", "near-duplicates", "decontamination", "packing"]
    for name, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, str(tmp_path))
        assert at.columns == source.columns
        kept[name] = {r["doc_id"] for r in at.collect()}
    every = {d[0] for d in docs}
    assert every - kept["language"] == {502, 503}
    gone = kept["language"] - kept["toxicity"]
    assert {k for k in gone} >= {k for k in range(0, 120, 4)} and len(gone) <= 33
    near = [(i, t) for i, t, *_ in docs if i in kept["toxicity"]]
    assert kept["near-duplicates"] == {near[c][0] for c in brute(near)}
    assert kept["near-duplicates"] - kept["decontamination"] == {501}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == kept["decontamination"]
    assert max(r["offset"] + r["length"] for r in rows) <= 2048


def test_messy_rows(spark, messy, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and columns with clashing names, through all stages."""
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(2, 30_000)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, str(tmp_path))
        assert at.schema.names == docs.schema.names
        known = {tuple(r) for r in docs.collect()}
        assert all(tuple(r) in known for r in at.collect())
    texts = [r["text"] for r in at.collect()]
    assert None not in texts and "" not in texts and len(set(texts)) == len(texts)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where("piece = 0").count() == len(texts)


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert all(callable(f) for f in names.values())
