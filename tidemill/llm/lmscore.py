"""Language-model scoring by cross-entropy difference (after Moore and Lewis, 2010).

Two bigram models, of a target domain and of the background, share one vocabulary and one smoothing, so their losses are
comparable. A document's score is the mean over its tokens of (target loss - background loss), in nats: the lower, the more
the document is like the target. A model's chance of a word after another is interpolated:
  P(w | v) = (c(v, w) + a * P(w)) / (c(v) + a),   P(w) = (c(w) + 1) / (N + V).

The vocabulary is every word of all documents and the unknown word; every word and every pair has a count of its own, so the
models grow with the input. Each task turns its documents into chunks of about two million tokens. A chunk asks once for each
distinct word and pair that it has, by a 64-bit hash, and says how often it has it; the requests are dealt by ranges of the
hash into buckets of bounded size, in which all chunks' counts are added up and sent back to the chunks. A chunk then has the
exact counts of all its words and pairs, and scores its documents. However common a word or pair is, it's asked for at most
once by a chunk, so no bucket grows with it, and nothing of the models is held in the driver or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import cut, mix64, slices, small_side, word_hashes_of

START = np.uint64(0x5851F42D4C957F2D)
WEIGHT = 2.0
#: Tokens and documents of a chunk, and bytes of text for each bucket of requests.
CHUNK_TOKENS, CHUNK_DOCS, BUCKET_BYTES = 2_000_000, 100_000, 8_000_000
OWN, WORDS, PAIRS = 0, 1, 2
CHUNKS = "chunk long, kind int, bucket int, keys binary, background binary, target binary, tokens long, target_tokens long, docs long, target_docs long"
REQUESTS = "chunk long, kind int, bucket int, keys binary, background binary, target binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers, their first bytes together, then their second ones, and so on, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], n * 8, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view(kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def pair_keys(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key for each word and the one before it; the start mark stands before the words at starts."""
    if not len(words):
        return words
    before = np.concatenate([[START], words[:-1]])
    before[starts] = START
    with np.errstate(over="ignore"):
        return mix64(mix64(before) * np.uint64(0x9E3779B97F4A7C15) + words)


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where the texts that have words begin."""
    return (np.cumsum(sizes) - sizes)[sizes > 0]


def _requests(chunk: int, kind: int, keys: np.ndarray, which: np.ndarray, target: np.ndarray, buckets: int) -> list[tuple]:
    """keys are distinct and in order; which says for each token the place of its key."""
    counts = np.bincount(which, minlength=len(keys)), np.bincount(which[target], minlength=len(keys))
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    bounds = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    return [(chunk, kind, b, _pack_sorted(keys[x:y]), _pack(counts[0][x:y]), _pack(counts[1][x:y])) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if x < y]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _chunk(chunk: int, ids: list, targets: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """The chunk's own row: its distinct words, the number of each token's word; size, id, and flags of each document."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    good = np.array([bool(t) for t in targets])
    words, which = np.unique(np.concatenate(hashes), return_inverse=True)
    flags = good.astype(np.int64) + 2 * np.array([i is not None for i in ids], np.int64)
    about = np.concatenate([sizes, np.array([0 if i is None else i for i in ids], np.int64), flags])
    return _batch([(chunk, OWN, -1, _pack(words), _pack(which.astype(np.int64)), _pack(about), int(sizes.sum()), int(sizes[good].sum()), int((sizes > 0).sum()), int((sizes[good] > 0).sum()))], CHUNKS)


def chunks_of(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """All chunks of docs (doc_id, text, target; a null target counts as false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = TaskContext.get().partitionId() << 32, 0
        ids, targets, hashes = [], [], []
        for b in slices(batches, "text"):
            found = word_hashes_of(b.column("text"))
            ids += b.column("doc_id").to_pylist()
            targets += b.column("target").to_pylist()
            hashes += found
            n += sum(map(len, found))
            if n >= chunk_tokens or len(ids) >= CHUNK_DOCS:
                yield _chunk(chunk, ids, targets, hashes)
                chunk, n, ids, targets, hashes = chunk + 1, 0, [], [], []
        if ids:
            yield _chunk(chunk, ids, targets, hashes)

    return docs.select("doc_id", "text", "target").mapInArrow(run, CHUNKS)


def requests(own: DataFrame, kinds: tuple[int, ...], buckets: int) -> DataFrame:
    """What the chunks ask for; made again from their own rows whenever it's read, so it's never stored but in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                chunk, keys, which, about = (b.column(c)[row].as_py() for c in ("chunk", "keys", "background", "target"))
                words, which = _unpack(keys, np.uint64), _unpack(which)
                sizes, _, flags = _unpack(about).reshape(3, -1)
                target = np.repeat(flags % 2 == 1, sizes)
                for kind in kinds:
                    found, place = (words, which) if kind == WORDS else np.unique(pair_keys(words[which], _starts(sizes)), return_inverse=True)
                    out = _requests(chunk, kind, found, place, target, buckets)
                    for k in range(0, len(out), 500):
                        yield _batch(out[k : k + 500], REQUESTS)

    return own.select("chunk", "keys", "background", "target").mapInArrow(run, REQUESTS)


def _total(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row of a bucket, all distinct keys in order, and their counts in all chunks: background, target."""
    keys = [_unpack_sorted(x) for x in table.column("keys").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros((2, len(distinct)), np.int64)
    for row, name in enumerate(("background", "target")):
        np.add.at(counts[row], place, np.concatenate([_unpack(x) for x in table.column(name).to_pylist()]))
    return keys, distinct, counts


def distinct_words(own: DataFrame, buckets: int) -> int:
    def run(table: pa.Table) -> pa.Table:
        keys = [_unpack_sorted(x) for x in table.column("keys").to_pylist()]
        return pa.table({"n": pa.array([len(np.unique(np.concatenate(keys)))], pa.int64())})

    return requests(own, (WORDS,), buckets).select("bucket", "keys").groupBy("bucket").applyInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def answers(asked: DataFrame) -> DataFrame:
    """For each request the counts of its keys in all documents, in the request's order."""

    def run(table: pa.Table) -> pa.Table:
        keys, distinct, counts = _total(table)
        at = [np.searchsorted(distinct, k) for k in keys]
        packed = [pa.array([_pack(counts[row][k]) for k in at], pa.binary()) for row in (0, 1)]
        return pa.table([table.column("chunk"), table.column("kind"), table.column("bucket"), pa.nulls(len(at), pa.binary()), *packed], names=["chunk", "kind", "bucket", "keys", "background", "target"])

    return asked.groupBy("kind", "bucket").applyInArrow(run, REQUESTS)


def score(own: DataFrame, buckets: int, weight: float = WEIGHT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means over the tokens), difference of every document of the chunks.

    A null text or one without words has 0 tokens, and null losses and difference. Rows that repeat each get a score."""
    sums = own.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "target_tokens", "docs", "target_docs"))).first()
    totals, opened = (sums["tokens"], sums["target_tokens"]), (sums["docs"], sums["target_docs"])
    size = distinct_words(own, buckets) + 1

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        words, which, about = _unpack(rows[0]["keys"], np.uint64), _unpack(rows[0]["background"]), _unpack(rows[0]["target"]).reshape(3, -1)
        sizes, ids, flags = about
        starts, owner = _starts(sizes), np.repeat(np.arange(len(sizes)), sizes)
        place = np.unique(pair_keys(words[which], starts), return_inverse=True)[1]
        means = []
        for row, name in enumerate(("background", "target")):
            single, pair = (np.concatenate([np.zeros(0, np.int64), *(_unpack(r[name]) for r in rows if r["kind"] == k)]) for k in (WORDS, PAIRS))
            context = np.concatenate([[0], single[which[:-1]]]) if len(which) else which
            context[starts] = opened[row]
            smooth = (single[which] + 1.0) / (totals[row] + size)
            loss = -np.log((pair[place] + weight * smooth) / (context + weight))
            means.append(np.bincount(owner, loss, len(sizes)) / np.maximum(sizes, 1))
        none = sizes == 0
        values = [pa.array(v, pa.float64(), mask=none) for v in (means[1], means[0], means[1] - means[0])]
        return pa.table([pa.array(ids, pa.int64(), mask=flags < 2), pa.array(sizes, pa.int64()), *values], names=[c.split()[0] for c in SCORES.split(", ")])

    mine = own.select("chunk", "kind", "bucket", "keys", "background", "target")
    return mine.unionByName(answers(requests(own, (WORDS, PAIRS), buckets))).groupBy("chunk").applyInArrow(run, SCORES)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, slots: int | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Score all documents against the target domain of those with labels.quality = 1.

    A label of a null doc_id counts for nothing; a document is in the target if any label of its id says so. Without any target
    the target model is uniform. Columns other than ids, texts and labels aren't read. An empty table gives an empty result.
    slots, once the size of a hashed model, is accepted and changes nothing: all counts are exact.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(labels["doc_id"].cast("long").alias("__id")).distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    # Texts stay where they are if the ids of the target are few.
    marked = rows.join(small_side(good.select(F.col("__id").alias("doc_id"), F.lit(True).alias("target"))), "doc_id", "left")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return score(cut(chunks_of(marked, chunk_tokens)), max(8, math.ceil(size / BUCKET_BYTES)))
