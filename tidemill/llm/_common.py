"""Shared plumbing: the shared folder, lineage cuts, and word hashing on whole texts."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.shared import cut, shared_dir

__all__ = ["cut", "shared_dir"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A narrow table, broadcast if it has at most `most` rows (a few dozen bytes each), else left to a shuffle join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def give_back() -> None:
    """Return freed memory to the system; Arrow's pool and the C heap would keep what one batch has used for the next."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column has about `most` bytes in each; memory is given back after each batch."""
    for b in batches:
        for part in parts_of(b.column(column), most):
            yield b.slice(part.start, part.stop - part.start)
        del b
        give_back()


def parts_of(texts: pa.Array, most: int) -> Iterator[slice]:
    """Ranges of rows with about `most` bytes of text in each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield slice(at, to)
        at = to


def filter_by_text(docs: DataFrame, judge: Callable[[], Callable[[pa.Array], np.ndarray]], most: int = 500_000) -> DataFrame:
    """The rows of docs, with all columns whatever their names, whose texts are accepted. judge() runs once for each task.

    Only texts go to Python, and one boolean for each comes back."""

    @F.arrow_udf("boolean")
    def accepted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        accepts = None
        for texts in columns:
            accepts = accepts or judge()
            got = [accepts(texts[part]) for part in parts_of(texts, most)]
            yield pa.array(np.concatenate(got) if got else [], pa.bool_())
            del texts
            give_back()

    return docs.where(accepted(docs["text"]))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_FACTOR = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the factor and of its inverse mod 2**64, remembered."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 18), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A uint64 for each string, 0 for an empty one: a polynomial in its bytes, from differences of running sums."""
    strings = strings.cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    out = np.zeros(len(strings), np.uint64)
    data = strings.buffers()[2]
    if not len(strings) or data is None:
        return out
    data, at = np.frombuffer(data, np.uint8), 0
    with np.errstate(over="ignore"):
        while at < len(strings):  # slices of about a megabyte
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20))) - 1)
            places = ends[at : to + 1] - ends[at]
            up, down = _powers(int(places[-1]) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data[ends[at] : ends[to]]] * up[: places[-1]])])
            size = (places[1:] - places[:-1]).astype(np.uint64)
            value = mix64((sums[places[1:]] - sums[places[:-1]]) * down[places[:-1]] + size) | np.uint64(1)
            out[at:to] = np.where(size > 0, value, np.uint64(0))
            at = to
    return out


def word_hashes_of(texts: list[str | None] | pa.Array) -> list[np.ndarray]:
    """For each whole text one uint64 for each of its words; none for a null text.

    A word is a run of characters between spaces, in lower case and without all but letters and digits, unless nothing is
    left of it. Each distinct run of the texts is hashed once; the work is done on arrays."""
    column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    lists = pc.utf8_split_whitespace(pc.fill_null(column, ""))
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_lower(coded.dictionary)
    mixed = pc.invert(pc.utf8_is_alnum(words)).to_numpy(zero_copy_only=False)
    hashes = hash_strings(words)
    if mixed.any():
        hashes[mixed] = hash_strings(pc.replace_substring_regex(words.filter(pa.array(mixed)), r"[^\p{L}\p{N}]+", ""))
    flat = hashes[coded.indices.to_numpy()]
    bounds = lists.offsets.to_numpy()
    kept = np.concatenate([[0], np.cumsum(flat != 0)])[bounds]
    flat = flat[flat != 0]
    return [flat[a:b] for a, b in zip(kept, kept[1:], strict=False)]


def split_words(texts: pa.Array, kept: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column, in lower case; for each word of each whole text which of them it is, and whose it is.

    kept: the classes of characters of which words are made, such as \\p{L}."""
    column = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(pc.replace_substring_regex(column, f"[^{kept}]+", " "))
    coded = lists.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if not real.all():  # a text that begins or ends with space has an empty run there
        on = real[which]
        which, owner = (np.cumsum(real) - 1)[which[on]], owner[on]
        return coded.dictionary.filter(pa.array(real)), which, owner
    return coded.dictionary, which, owner


def character_grams(words: pa.Array, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to most: all runs of n characters of '<word>', as the word's number and a hash."""
    part = lambda x: pa.scalar(x, pa.large_string())
    marked = pc.binary_join_element_wise(part("<"), words.cast(pa.large_string()), part(">"), part(""))
    codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), pc.utf8_length(marked).to_numpy())
    out, state = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, most + 1):
            size = max(0, len(codes) - n + 1)
            state = (state[:size] ^ codes[n - 1 :][:size]) * np.uint64(0x9FB21C651E98DF25)
            state ^= state >> np.uint64(29)
            inside = owner[:size] == owner[n - 1 :][:size]
            out.append((owner[:size][inside], mix64(state[inside] + np.uint64(n))))
    return out


def gram_hashes(grams: list[str]) -> np.ndarray:
    """The hashes that character_grams() gives these runs."""
    out = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for n in {len(g) for g in grams}:
            at = np.array([i for i, g in enumerate(grams) if len(g) == n])
            codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(at), n)
            state = np.zeros(len(at), np.uint64)
            for k in range(n):
                state = (state ^ codes[:, k]) * np.uint64(0x9FB21C651E98DF25)
                state ^= state >> np.uint64(29)
            out[at] = mix64(state + np.uint64(n))
    return out


def word_hashes(text: str | None) -> np.ndarray:
    return word_hashes_of([text])[0]


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """A uint64 for each run of n words; a text of 1 to n-1 words has one shingle, its whole."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
            total ^= total >> np.uint64(29)
    return mix64(total)


def bags_of(texts: list[str | None] | pa.Array, n: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes in order, and how often each occurs."""
    return [np.unique(shingles(w, n), return_counts=True) for w in word_hashes_of(texts)]


def bag(text: str | None, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return bags_of([text], n)[0]


def bag_similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags: the sum of minima over the sum of maxima; 0 if both are empty."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (total - low)
