"""Language identification by word-first backoff.

A word that was seen in training scores, for each language, the log of its smoothed share of that language's words. A word
that wasn't seen backs off to its character n-grams of the longest order of which any was seen, then to shorter ones; each
order down costs a fixed penalty, the same for all languages. A document's language has the largest sum over its words.

The tables are fitted on a bounded sample of labelled documents: about `per_language` documents or `most_bytes` of text for
each language, whichever is less, picked by a hash of (doc_id, text). Counting runs in Spark, and the tables keep every word
and n-gram of the sample, so its bounds are those of what is gathered and broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._common import character_grams, cut, filter_by_text, give_back, gram_hashes, hash_strings, slices, split_words

LETTERS = r"\p{L}"
ORDERS = (5, 4, 3, 2, 1)
PENALTY = math.log(0.4)
UNDETERMINED = "und"


@dataclass
class Table:
    """Sorted hashes of keys, and for each a row of log shares, one for each language."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row number of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def table(hashes: np.ndarray, counts: np.ndarray, smooth: float = 0.5) -> Table:
    """log((count + smooth) / (total + smooth * keys)) of each key in each language; counts has a row for each key."""
    rows = np.log((counts + smooth) / (counts.sum(axis=0) + smooth * max(1, len(hashes))))
    order = np.argsort(hashes)
    return Table(hashes[order], rows[order].astype(np.float32))


@dataclass
class Model:
    """languages in order, the table of words, and one of character n-grams for each order."""

    languages: list[str]
    words: Table | None = None
    grams: dict[int, Table] | None = None

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """A row for each word: its own, else the mean over its n-grams of the longest order of which any is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.words.find(hash_strings(words))
        out[at >= 0] = self.words.rows[at[at >= 0]]
        open_ = np.flatnonzero(at < 0)
        if not len(open_):
            return out
        grams = character_grams(words.take(pa.array(open_)), max(ORDERS))
        todo = np.ones(len(open_), bool)
        for k, order in enumerate(ORDERS):
            owner, hashes = grams[order - 1]
            on = todo[owner]
            owner, row = owner[on], self.grams[order].find(hashes[on])
            owner, row = owner[row >= 0], row[row >= 0]
            found = np.bincount(owner, minlength=len(open_))
            done = found > 0
            for j in range(len(self.languages)):
                total = np.bincount(owner, self.grams[order].rows[row, j], len(open_))
                out[open_[done], j] = total[done] / found[done] + (k + 1) * PENALTY
            todo &= ~done
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its softmax share of the mean word scores, scaled to at most 20 words."""
        n = len(texts)
        words, which, owner = split_words(texts, LETTERS)
        if not self.languages or not len(which):
            return [UNDETERMINED] * n, np.zeros(n)
        scores = self.word_scores(words)
        count = np.bincount(owner, minlength=n)
        totals = np.stack([np.bincount(owner, scores[which, j], n) for j in range(len(self.languages))], axis=1)
        scaled = totals * (np.minimum(20, count) / np.maximum(1, count))[:, None]
        best = scaled.argmax(axis=1)
        share = 1.0 / np.exp(scaled - scaled.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if c else UNDETERMINED for b, c in zip(best, count, strict=True)], np.where(count > 0, share, 0.0)


def fit(docs: DataFrame, train: Column, per_language: int = 1000, most_bytes: int = 4_000_000) -> Model:
    """Fit on the rows where train holds, text has a letter and lang isn't null.

    Null texts and languages teach nothing; repeated rows count as often as they occur in the sample; an empty table gives a
    model without languages. The driver receives one row for each word and n-gram of each language's sample; languages are taken
    to be some hundreds at most."""
    rows = docs.select(docs["lang"].alias("lang"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"], docs["text"]).alias("h"), train.alias("train"))
    rows = rows.where("train and lang is not null and text is not null")
    # The sample: a threshold on the hash takes about per_language rows of each language, without a sort of all rows. Only sizes
    # of languages come to the driver.
    sizes = {r["lang"]: (r["n"], r["bytes"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not sizes:
        return Model([])
    rates = {k: min(1.0, per_language / n, most_bytes / max(1, size)) for k, (n, size) in sizes.items()}
    share = F.create_map(*[x for k, rate in rates.items() for x in (F.lit(k), F.lit(rate))])
    sample = rows.where(F.pmod(F.col("h"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each task's part of the sample; the sample bounds it."""
        found: Counter = Counter()
        for b in slices(batches, "text"):
            langs, (distinct, which, owner) = b.column("lang").dictionary_encode(), split_words(b.column("text"), LETTERS)
            pairs, n = np.unique(langs.indices.to_numpy()[owner].astype(np.int64) * max(1, len(distinct)) + which, return_counts=True)
            names, words_ = langs.dictionary.to_pylist(), distinct.to_pylist()
            for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
                found[names[p // len(words_)], words_[p % len(words_)]] += k
        if found:
            yield pa.record_batch([[k[0] for k in found], [k[1] for k in found], pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    counted = cut(sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    marked = F.concat(F.lit("<"), "word", F.lit(">"))

    def runs(order: int) -> Column:
        starts = F.when(F.length(marked) >= order, F.sequence(F.lit(1), F.length(marked) - order + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(order)))

    # Every n-gram's length is its order, so one table holds all orders.
    grams = counted.select("lang", "n", F.explode(F.flatten(F.array(*map(runs, ORDERS)))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    by_word = _gathered(counted.toArrow(), "word", languages)
    by_gram = _gathered(grams.toArrow(), "gram", languages)
    lengths = pc.utf8_length(by_gram[0]).to_numpy()
    tables = {}
    for o in ORDERS:
        keys = by_gram[0].filter(pa.array(lengths == o))
        tables[o] = table(gram_hashes(keys.to_pylist()), by_gram[1][lengths == o])
    model = Model(languages, table(hash_strings(by_word[0]), by_word[1]), tables)
    del by_word, by_gram
    give_back()
    return model


def _gathered(rows: pa.Table, key: str, languages: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys, and a row of counts for each, one for each language."""
    coded = rows.column(key).cast(pa.large_string()).combine_chunks().dictionary_encode()
    which = {x: j for j, x in enumerate(languages)}
    counts = np.zeros((len(coded.dictionary), len(languages)))
    counts[coded.indices.to_numpy(), np.array([which[x] for x in rows.column("lang").to_pylist()], np.int64)] = rows.column("n").to_numpy()
    return coded.dictionary, counts


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred and score of every row of docs, from its whole text.

    `und` with score 0 if the text is null, empty or has no letter, or if nothing was learned. Ties go to the language that
    comes first. The model is broadcast; the limits of fit() bound it. Repeated rows each get an answer; an empty table gives
    an empty result. Columns of docs other than text and those in keep aren't read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            lang, score = shared.value.predict(b.column("__text"))
            yield pa.RecordBatch.from_arrays([*(b.column(f"__k{i}") for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(docs["text"].alias("__text"), *(docs[c].alias(f"__k{i}") for i, c in enumerate(keep))).mapInArrow(run, out)


def identify(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, **limits) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fitted without the held-out fold of crc32(doc_id as text)."""
    fold = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(folds))
    held = F.coalesce(fold == held_out_fold, F.lit(False))
    model = fit(docs, ~held, **limits)
    out = predict(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), held.alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns whatever their names, with a language whose score is at least `least`; undetermined texts go.

    Each row is judged by its whole text alone: null, empty and letterless ones go, ids don't matter, and equal rows stay or go
    together. A score of exactly `least` stays. An empty table stays empty. Very long texts are read one at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        return lambda texts: shared.value.predict(texts)[1] >= max(least, 1e-9)  # undetermined ones score 0

    return filter_by_text(docs, judge)
