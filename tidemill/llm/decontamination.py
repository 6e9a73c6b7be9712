"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; only the words at its ones are hashed, so a word replaced at a zero doesn't
hide a match. Hashes of all windows of the benchmark are looked up with those of all windows of every document. Each hit
names an item and a diagonal (where the item would start in the document); along that diagonal words are compared one by one,
and every segment of which enough is equal is kept. Segments on one or several diagonals add up, so insertions and deletions
only split a match. Items of fewer words than a segment needs have a mask of their own length, all ones: they match as a whole.

The benchmark's words and window hashes are broadcast in chunks of a checked size: a benchmark beyond the limit is dealt into
several, each with a pass of its own over the documents. Nothing is shuffled but the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import cut, filter_by_text, mix64, slices, word_hashes, word_hashes_of

#: Any segment with 5 equal words or more that are 0.7 of it has a hit: without "111", "1101" and "1011", runs of two words stand
#: at least two others apart and single ones one apart, so 5 equal words need 8 at least, and more never reach 0.7.
MASKS = ("111", "1101", "1011")
#: The fewest equal words of a segment, and the masks of items that have fewer words.
SEGMENT = 5
WHOLE = ("1", "11", "111", "1111")
#: Bytes of benchmark text that are broadcast at once.
CHUNK_BYTES = 16_000_000
BITMAP = 1 << 22


def window_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash for each window of the mask's length."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(salt + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i, on in enumerate(mask):
            if on == "1":
                total = (total ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
                total ^= total >> np.uint64(32)
    return mix64(total)


@dataclass
class Index:
    """Words of items, how often each item occurs, and for each mask the sorted hashes of its windows with item and place of each."""

    ids: list[int]
    times: list[int]
    words: list[np.ndarray]
    masks: list[str]
    hashes: list[np.ndarray]
    items: list[np.ndarray]
    places: list[np.ndarray]
    bitmap: np.ndarray


def build_index(rows: list[tuple], masks: tuple[str, ...] = MASKS) -> Index:
    """rows: (item, text) or (item, text, how often). An item without words has no windows."""
    ids, times, words = [], [], []
    for item, text, *often in rows:
        w = word_hashes(text)
        if len(w):
            ids.append(item)
            times.append(often[0] if often else 1)
            words.append(w)
    bitmap = np.zeros(BITMAP, bool)
    hashes, items, places = [], [], []
    of_whole = tuple(m for m in WHOLE if any(len(w) == len(m) for w in words))
    for salt, mask in enumerate(masks + of_whole):
        own = [(k, w) for k, w in enumerate(words) if (len(w) >= SEGMENT if salt < len(masks) else len(w) == len(mask))]
        parts = [(k, window_hashes(w, mask, salt)) for k, w in own]
        h = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
        order = np.argsort(h, kind="stable")
        hashes.append(h[order])
        items.append(np.concatenate([np.zeros(0, np.int64), *(np.full(len(p[1]), p[0], np.int64) for p in parts)])[order])
        places.append(np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p[1])) for p in parts)])[order])
        bitmap[(h & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return Index(ids, times, words, [*masks, *of_whole], hashes, items, places, bitmap)


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """The bounds of the segment with the largest (equal words - other words)."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    lows = np.minimum.accumulate(sums)
    end = int((sums - lows).argmax())
    return int(sums[: end + 1].argmin()), end


def good_words(equal: np.ndarray, identity: float, least: int) -> np.ndarray:
    """Which equal words are in any segment with at least `least` equal words that are at least `identity` of it.

    With each start goes the furthest end that reaches the identity, which also has the most equal words."""
    matched = np.concatenate([[0], np.cumsum(equal)])
    sums = matched - identity * np.arange(len(matched))
    after = np.maximum.accumulate(sums[::-1])  # the largest sum from the k-th place from the end on
    ends = len(sums) - 1 - np.searchsorted(after, sums - 1e-9)
    starts = np.flatnonzero(matched[ends] - matched >= max(least, 1))
    inside = np.zeros(len(sums), np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends[starts], -1)
    return equal & (np.cumsum(inside)[:-1] > 0)


def overlaps(words: np.ndarray, hits: set[tuple[int, int]], index: Index, identity: float, least: int, share: float) -> Iterator[tuple]:
    """(item number, words of the item that match, first matching word of the document) of each overlap that is confirmed."""
    by_item: dict[int, list[int]] = {}
    for item, diagonal in hits:
        by_item.setdefault(item, []).append(diagonal)
    for item in sorted(by_item):
        own = index.words[item]
        covered, first = np.zeros(len(own), bool), None
        for diagonal in sorted(by_item[item]):
            low, high = max(0, -diagonal), min(len(own), len(words) - diagonal)
            equal = own[low:high] == words[low + diagonal : high + diagonal]
            good = good_words(equal, identity, min(SEGMENT, len(own)))
            if good.any():
                covered[low:high] |= good
                start = low + int(good.argmax()) + diagonal
                first = start if first is None else min(first, start)
        matched = int(covered.sum())
        if matched >= min(least, math.ceil(share * len(own))):
            yield item, matched, first


def diagonals(words: list[np.ndarray], index: Index, least: int, share: float, at_once: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and diagonal of each distinct hit, of those items only of which enough words are equal on all diagonals hit.

    Hits are made and counted a part at a time, so a window that many items and many places share takes no more memory."""
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    owner = np.repeat(np.arange(len(words)), sizes)
    lengths = np.array([len(w) for w in index.words], np.int64)
    own = np.concatenate([np.zeros(0, np.uint64), *index.words])
    own_begins = np.cumsum(lengths) - lengths
    span, shift = int(sizes.max(initial=0) + lengths.max(initial=0) + 1), int(lengths.max(initial=0))
    kept_keys, kept_equal = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, mask in enumerate(index.masks):
        h = window_hashes(flat, mask, k)
        at = np.flatnonzero(index.bitmap[(h & np.uint64(BITMAP - 1)).astype(np.int64)])
        at = at[owner[at] == owner[at + len(mask) - 1]]  # not those that run into the next text
        low, high = np.searchsorted(index.hashes[k], h[at]), np.searchsorted(index.hashes[k], h[at], side="right")
        for part in _parts(high - low, at_once):
            n = (high - low)[part]
            entry = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = np.repeat(at[part], n)
            diagonal = place - begins[owner[place]] - index.places[k][entry]
            keys = np.unique((owner[place] * len(lengths) + index.items[k][entry]) * span + diagonal + shift)
            pair, diagonal = keys // span, keys % span - shift
            text, item = pair // len(lengths), pair % len(lengths)
            low_, high_ = np.maximum(0, -diagonal), np.minimum(lengths[item], sizes[text] - diagonal)
            equal = np.zeros(len(keys), np.int64)
            for some in _parts(high_ - low_, at_once):
                m = (high_ - low_)[some]
                starts = np.cumsum(m) - m
                j = np.arange(m.sum()) - np.repeat(starts - low_[some], m)
                same = own[np.repeat(own_begins[item[some]], m) + j] == flat[np.repeat(begins[text[some]] + diagonal[some], m) + j]
                equal[some] = np.add.reduceat(same.astype(np.int64), starts)
            good = equal >= np.minimum(SEGMENT, lengths[item])
            kept_keys.append(keys[good])
            kept_equal.append(equal[good])
    keys, first = np.unique(np.concatenate(kept_keys), return_index=True)
    equal = np.concatenate(kept_equal)[first]
    pair, diagonal = keys // span, keys % span - shift
    text, item = (pair // len(lengths), pair % len(lengths)) if len(keys) else (pair, pair)
    _, place = np.unique(pair, return_inverse=True)
    needed = np.minimum(least, np.ceil(share * lengths[item]))
    enough = np.bincount(place, equal)[place] >= needed if len(pair) else np.zeros(0, bool)
    return text[enough], item[enough], diagonal[enough]


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of places of which the sizes add up to about `most`, one place at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield slice(at, to)
        at = to


def find(texts: list[str | None] | pa.Array, index: Index, identity: float, least: int, share: float) -> Iterator[tuple[int, tuple]]:
    """(number of the text, overlap) of every confirmed overlap; hashing and a first count run over all texts at once."""
    words = word_hashes_of(texts)
    hits: dict[int, set[tuple[int, int]]] = {}
    for text, item, diagonal in zip(*(x.tolist() for x in diagonals(words, index, least, share)), strict=True):
        hits.setdefault(text, set()).add((item, diagonal))
    for text in sorted(hits):
        for found in overlaps(words[text], hits[text], index, identity, least, share):
            yield text, found


SCHEMA = "doc_id long, item_id long, matched int, item_words int, first_word int"


def leaks(docs: DataFrame, benchmark: DataFrame, identity: float = 0.7, least: int = 10, share: float = 0.7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, matched (words of the item), item_words,
    first_word (where in the document the overlap starts).

    An overlap counts if `least` words of the item match, or `share` of its words where that's fewer, in segments of which
    at least `identity` is equal and which have 5 equal words. An item of fewer than 5 words matches where it occurs as a
    whole. Words are compared in lower case without punctuation. Null texts and those without a word match nothing. Very long
    texts and items are compared as a whole, a text at a time. Of several places with equal overlaps the first is named.
    Repeated rows on either side each give their rows. A document with a null doc_id gives rows with a null doc_id, an item
    likewise. Columns other than ids and texts aren't read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = None
    for index in _indexes(benchmark, chunk_bytes):
        one = _pass(rows, spark.sparkContext.broadcast(index), identity, least, share)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _indexes(benchmark: DataFrame, chunk_bytes: int) -> Iterator[Index]:
    """The benchmark, equal rows once, in chunks of about chunk_bytes of text, which pass through the driver one by one."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("text is not null")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("n"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, math.ceil(size / chunk_bytes))
    for c in range(chunks):
        chunk = items if chunks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        found = [(r["item_id"], r["text"], r["n"]) for r in chunk.toLocalIterator()]
        index = build_index(sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if index.ids:
            yield index


def _pass(rows: DataFrame, shared, identity: float, least: int, share: float) -> DataFrame:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches, "text", 250_000):
            ids, got = b.column("doc_id").to_pylist(), []
            for text, (item, matched, first) in find(b.column("text"), index, identity, least, share):
                got += [(ids[text], index.ids[item], matched, len(index.words[item]), first)] * index.times[item]
            if got:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, identity: float = 0.7, least: int = 10, share: float = 0.7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text overlaps no item, by the rule of leaks().

    Each row is judged by its own whole text, so null and repeated doc_ids don't matter, and equal rows stay or go together.
    Null texts and those without a word stay. Empty tables on either side are no error; very long texts are read as a whole."""
    chunks = 0
    for index in _indexes(benchmark, chunk_bytes):
        if chunks:  # another chunk of a large benchmark: a pass of its own
            docs = cut(docs)
        docs, chunks = _clean(docs, docs.sparkSession.sparkContext.broadcast(index), identity, least, share), chunks + 1
    return docs


def _clean(docs: DataFrame, shared, identity: float, least: int, share: float) -> DataFrame:
    def judge():
        def accepts(texts: pa.Array) -> np.ndarray:
            clean = np.ones(len(texts), bool)
            for text, _ in find(texts, shared.value, identity, least, share):
                clean[text] = False
            return clean

        return accepts

    return filter_by_text(docs, judge, 250_000)
