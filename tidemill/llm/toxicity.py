"""Toxicity by subword bags: a linear softmax over averaged embeddings, both trained together in numpy.

A word has the features of the whole word, marked at both ends, and of its character n-grams of 3 to 6 letters, hashed into
`buckets` rows of an embedding table. A document is the sum of its features' vectors over their number plus `blank`, as if
that many features without weight stood beside it; a linear softmax reads the class from it. A misspelling that was never
seen still shares most n-grams with what was.

Training data are a bounded sample: at most `per_class[c]` labelled documents of class c, those with the smallest hash of
their id, and at most `most_bytes` of text, weighted so that classes count as in all labelled rows. Scoring covers every whole text: since the classifier is linear
in the average, each bucket has one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._common import character_grams, filter_by_text, give_back, hash_strings, mix64, parts_of, slices, split_words

CHARACTERS = r"\p{L}\p{N}"


def feature_hashes(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of the whole words, then of their n-grams of 3, 4, 5 and 6 characters."""
    yield np.arange(len(words)), mix64(hash_strings(words))
    yield from character_grams(words, 6)[2:]


def features_of(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all features of all words, sorted by word."""
    parts = list(feature_hashes(words))
    owner, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    return owner[order], (hashes[order] % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    """A document's log-odds of being toxic: (sum of weights over its features) / (their number + blank) + bias."""

    weights: np.ndarray
    bias: float
    blank: float


@dataclass
class Bags:
    """Documents as bags of words, words as bags of features: all that training needs of its texts, as arrays.

    words[starts[d]:starts[d + 1]] are the distinct words of document d, often says how often each occurs there, and
    features[bounds[w]:bounds[w + 1]] are the features of word w, numbered among those that occur; buckets has their buckets."""

    starts: np.ndarray
    words: np.ndarray
    often: np.ndarray
    bounds: np.ndarray
    features: np.ndarray
    buckets: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        """The number of features of each document."""
        per_word = np.diff(self.bounds)[self.words] * self.often
        return np.add.reduceat(np.append(per_word, 0), self.starts[:-1]) * (np.diff(self.starts) > 0)


def bags(texts: list[str | None] | pa.ChunkedArray, buckets: int, most: int = 500_000) -> Bags:
    """Texts are taken a few at a time, so the distinct words of all and the counts are what memory holds."""
    number: dict[str, int] = {}
    starts, words, often = [0], [], []
    column = (texts if isinstance(texts, pa.ChunkedArray) else pa.chunked_array([pa.array(texts, pa.large_string())])).combine_chunks()
    for part in parts_of(column, most):
        distinct, which, whose = split_words(column[part], CHARACTERS)
        own = np.array([number.setdefault(w, len(number)) for w in distinct.to_pylist()], np.int64)
        size = max(1, len(own))
        pairs, n = np.unique(whose * size + which, return_counts=True)
        words.append(own[pairs % size] if len(pairs) else np.zeros(0, np.int64))
        often.append(n)
        starts.extend((starts[-1] + np.searchsorted(pairs // size, np.arange(part.stop - part.start), side="right")).tolist())
    names = pa.array(list(number), pa.large_string())
    del number
    sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(names), 10_000):  # n-grams of all words at once would take a hundred times the words' bytes
        some = names[at : at + 10_000]
        owner, bucket = features_of(some, buckets)
        sizes.append(np.bincount(owner, minlength=len(some)))
        found.append(bucket.astype(np.int32))
    features = np.concatenate(found)
    occurring = np.flatnonzero(np.bincount(features, minlength=buckets))
    number_of = np.zeros(buckets, np.int32)
    number_of[occurring] = np.arange(len(occurring))
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)
    return Bags(np.array(starts), join(words), join(often), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), number_of[features], occurring)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def train(texts: list[str | None] | pa.ChunkedArray, toxic: np.ndarray, class_weights: dict[int, float], buckets: int = 1 << 18, size: int = 8, epochs: int = 10, rate: float = 0.3, gain: float = 30.0, blank: float = 100.0, batch: int = 64, seed: int = 7) -> Model:
    """Adagrad over the embedding table and the softmax layer at once; the same inputs give the same model.

    A step adds up the vectors of each distinct word of its documents once; its memory is that of the words' features."""
    made = bags(texts, buckets)
    full = np.flatnonzero(np.diff(made.starts))
    y = toxic[full].astype(int)
    if not len(y) or len(np.unique(y)) < 2:
        share = float(np.mean(toxic)) if len(toxic) else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), blank)
    scale = (gain / (made.sizes[full] + blank)).astype(np.float32)
    importance = np.array([class_weights[c] for c in y])
    importance /= importance.mean()
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (buckets, size)).astype(np.float32)[made.buckets]
    layer, bias = rng.normal(0, 0.5, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_layer, seen_bias = np.full(len(table), 1e-6, np.float32), 1e-6, 1e-6
    of_word = np.diff(made.bounds)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            docs = full[chosen]
            n = made.starts[docs + 1] - made.starts[docs]
            places = _ranges(made.starts[docs], n)
            owner = np.repeat(np.arange(len(docs)), n)
            words, which = np.unique(made.words[places], return_inverse=True)
            share = made.often[places] * scale[chosen][owner]  # what a word's sum of vectors counts in its document
            ids = made.features[_ranges(made.bounds[words], of_word[words])]
            begins = np.cumsum(of_word[words]) - of_word[words]
            sums = np.add.reduceat(table[ids], begins, axis=0)
            means = np.add.reduceat(sums[which] * share[:, None], np.cumsum(n) - n, axis=0)
            logits = means @ layer + bias
            slope = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope /= slope.sum(axis=1, keepdims=True)
            slope[np.arange(len(chosen)), y[chosen]] -= 1
            slope *= (importance[chosen] / len(chosen))[:, None]
            back = slope @ layer.T
            by_word = np.stack([np.bincount(which, back[owner, j] * share, len(words)) for j in range(size)], axis=1)
            rows = np.flatnonzero(np.bincount(ids, minlength=len(table)))
            change = np.stack([np.bincount(ids, np.repeat(by_word[:, j], of_word[words]), len(table))[rows] for j in range(size)], axis=1)
            seen[rows] += (change**2).mean(axis=1)
            table[rows] -= rate * change / np.sqrt(seen[rows])[:, None]
            change_layer, change_bias = means.T @ slope, slope.sum(axis=0)
            seen_layer += float((change_layer**2).mean())
            seen_bias += float((change_bias**2).mean())
            layer -= (rate / np.sqrt(seen_layer) * change_layer).astype(np.float32)
            bias -= (rate / np.sqrt(seen_bias) * change_bias).astype(np.float32)
    direction = layer[:, 1] - layer[:, 0]
    # Buckets that no text has keep the vectors they began with.
    weights = np.random.default_rng(seed).normal(0, 0.01, (buckets, size)).astype(np.float32) @ direction
    weights[made.buckets] = table @ direction
    return Model((weights * gain).astype(np.float32), float(bias[1] - bias[0]), blank)


def sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int], most_bytes: int) -> tuple[pa.ChunkedArray, np.ndarray, dict[int, float]]:
    """Texts, labels and class weights of the training sample. docs: doc_id, text, train; labels: doc_id, toxic.

    An id with several labels counts as toxic if any of them says so. The sample has at most sum(per_class) ids, and of those
    as many as have most_bytes of text together, in the order of a hash of their ids."""
    marked = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(in_training(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    chosen = None
    for c, most in enumerate(per_class):
        one = marked.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(most)
        chosen = one if chosen is None else chosen.unionByName(one)
    # At most sum(per_class) ids are broadcast, and as many rows reach the window and the driver.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")).where("text is not null")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("h", "doc_id"))
    got = rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "toxic", "text").toArrow().sort_by("doc_id")
    toxic = got.column("toxic").to_numpy().astype(int)
    return got.column("text"), toxic, {c: sizes.get(c, 0) / max(1, int((toxic == c).sum())) for c in (0, 1)}


def in_training(doc_id: Column, folds: int = 5) -> Column:
    """True but for ids whose crc32 as text is divisible by folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != 0


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The chance of being toxic of each whole text."""
    n = len(texts)
    words, which, whose = split_words(texts, CHARACTERS)
    total, count = np.zeros(n), np.zeros(n)
    if len(which):
        sums, sizes = np.zeros(len(words)), np.zeros(len(words))
        for owner, hashes in feature_hashes(words):
            sums += np.bincount(owner, model.weights[(hashes % np.uint64(len(model.weights))).astype(np.int64)], len(words))
            sizes += np.bincount(owner, minlength=len(words))
        total, count = np.bincount(whose, sums[which], n), np.bincount(whose, sizes[which], n)
    return 1 / (1 + np.exp(-np.clip(total / (count + model.blank) + model.bias, -500, 500)))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, score (0 to 1) and predicted (1 if score is 0.5 or more) of every row, from its whole text.

    A null text or one without words has the score of an empty one. Repeated rows each get a score; an empty table gives an
    empty result. Columns other than text and those in keep aren't read, whatever their names. The model has `buckets` numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            got = scores(shared.value, b.column("__text"))
            yield pa.RecordBatch.from_arrays([*(b.column(f"__k{i}") for i in range(len(keep))), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(docs["text"].alias("__text"), *(docs[c].alias(f"__k{i}") for i, c in enumerate(keep))).mapInArrow(run, out)


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2000, 1500), most_bytes: int = 32_000_000, **options) -> Model:
    """Fit on labelled documents outside the held-out fold. Without labels of both classes the score is constant.

    A null text, id or label teaches nothing; of rows that share an id the smallest text counts. Very long texts count as a whole
    or, beyond most_bytes, not at all. Empty tables give a constant score. Other columns aren't read."""
    texts, toxic, weights = sample(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), labels, per_class, most_bytes)
    model = train(texts, toxic, weights, **options)
    del texts
    give_back()
    return model


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null doc_id is not held out."""
    model = fit(docs, labels, **options)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), (~F.coalesce(in_training(docs["doc_id"]), F.lit(True))).alias("held_out"))
    return score(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns whatever their names, that score below 0.5, each judged by its whole text alone.

    A null text or one without words is judged as an empty one; ids, null or repeated, don't matter, and equal rows stay or go
    together. A score of exactly 0.5 goes. An empty table stays empty. Very long texts are read as a whole, one at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        return lambda texts: scores(shared.value, texts) < 0.5

    return filter_by_text(docs, judge)
