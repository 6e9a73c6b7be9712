"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Inner products as angles. Vectors are sorted into classes of norms that differ by a factor of two at most. In a class with largest
norm M, a vector x becomes (x / M, sqrt(1 - |x|^2 / M^2)), which has length one, and a query q becomes (q / |q|, 0), so the larger the
inner product, the smaller the angle.

Codes. Rotations are learned on a bounded sample by iterative quantisation (Gong and Lazebnik, 2011): centred vectors are turned so
that their signs lose as little as can be. Several rotations, from different starts, give `bits` signs, the code.

Index. Rows are dealt into shards. A shard cuts its codes into substrings of about log2(rows) bits and has for each a table from
value to the rows that have it. Two codes within Hamming distance r agree within r // tables bits in one substring at least
(pigeonhole), so looking up all values that near in each table finds every code within r. The substrings' radius grows from 0 by one
until the codes that are found for certain are enough; then exactly the codes within the smallest sufficient radius r are ranked by
the inner product of the original vectors in double precision. If the next radius would ask for more values than an eighth of
the shard's rows, the codes are compared one by one instead, which finds the same rows; on data without any structure, where
neighbours are hardly nearer than others, that is what happens.

Effort. A class of n distinct vectors gives about effort * sqrt(n) + least rows to rank, over all its shards; so what is ranked
grows with the root of the rows. A shard holds equal vectors once, with the smallest ids as many as can be wanted, so a vector that
a third of all rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._common import cut, give_back

RESULT = "query_id long, query_row int, vec_id long, score double"
#: Bytes of vectors that a shard or a sample holds at most.
SHARD_BYTES, SAMPLE_BYTES = 8_000_000, 32_000_000


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The mean and a matrix (dimensions x bits): the sample's principal directions, rotated by iterative quantisation as often,
    from different starts, as it takes to have enough columns."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, directions = np.linalg.svd(x.T @ x)
    basis = directions[:bits].T
    v, rng, made = x @ basis, np.random.default_rng(seed), []
    for _ in range(-(-bits // basis.shape[1])):
        rotation, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        made.append(basis @ rotation)
    return mean, np.concatenate(made, axis=1)[:, :bits]


def bits_of(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The code of each row as a row of zeros and ones."""
    return ((x - mean) @ matrix >= 0).astype(np.uint8)


def packed(bits: np.ndarray) -> np.ndarray:
    """Codes as rows of uint64."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


@cache
def flips(width: int, n: int) -> np.ndarray:
    """All numbers of `width` bits of which n are set."""
    return np.array([sum(1 << i for i in on) for on in combinations(range(width), n)], np.int64)


class MultiIndex:
    """Tables of code substrings. In table j, the rows of value v are rows[j][starts[j][v]:starts[j][v + 1]].

    looked_at counts the rows whose codes were compared with a query's, by tables or one by one."""

    def __init__(self, bits: np.ndarray):
        self.codes, self.length, n = packed(bits), bits.shape[1], len(bits)
        width = int(np.clip(round(np.log2(max(n, 2))), 4, 16))
        self.places = np.array_split(np.arange(self.length), max(1, -(-self.length // width)))
        self.rows, self.starts = [], []
        for j, places in enumerate(self.places):
            v = self.substring(bits, j)
            self.rows.append(np.argsort(v, kind="stable").astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << len(places)))]))
        self.seen = np.zeros(n, bool)
        self.looked_at = self.asked = self.found = 0

    def substring(self, bits: np.ndarray, j: int) -> np.ndarray:
        places = self.places[j]
        return bits[..., places].astype(np.int64) @ (1 << np.arange(len(places)))

    def distances(self, code: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)

    def probes(self, near: int) -> int:
        """How many values all tables have at a distance of exactly `near`."""
        return sum(len(flips(len(p), near)) for p in self.places)

    def at(self, values: list[int], near: int) -> np.ndarray:
        """Rows that weren't seen yet of which a substring is exactly `near` bits from the query's."""
        new = []
        for j, places in enumerate(self.places):
            if near <= len(places):
                v = values[j] ^ flips(len(places), near)
                first = self.starts[j][v]
                n = self.starts[j][v + 1] - first
                rows = self.rows[j][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                rows = rows[~self.seen[rows]]
                self.seen[rows] = True
                new.append(rows)
        return np.concatenate(new) if new else np.zeros(0, np.int32)

    def by_tables(self, bits: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows found and their distances, among them all within the smallest radius that holds enough; None if that would
        ask for too many values."""
        code, values = packed(bits[None, :])[0], [int(self.substring(bits, j)) for j in range(len(self.places))]
        rows, distances, asked = [], [], 0
        try:
            for near in range(max(map(len, self.places)) + 1):
                asked += self.probes(near)
                if asked > max(len(self.codes) // 8, 2 * len(self.places)):
                    return None
                rows.append(self.at(values, near))
                distances.append(self.distances(code, rows[-1]))
                self.looked_at += len(rows[-1])
                certain = len(self.places) * (near + 1) - 1
                if sum(int((d <= certain).sum()) for d in distances) >= enough:
                    break
            return np.concatenate(rows), np.concatenate(distances)
        finally:
            for r in rows:
                self.seen[r] = False

    def nearest(self, bits: np.ndarray, enough: int) -> np.ndarray:
        """Every row within the smallest radius of the code that holds enough rows, or all rows."""
        enough = min(enough, len(self.codes))
        # Where tables have hardly ever sufficed, they are asked for every 32nd query only.
        got = self.by_tables(bits, enough) if self.asked < 16 or 8 * self.found > self.asked or self.asked % 32 == 0 else None
        self.asked += 1
        if got is None:
            got = np.arange(len(self.codes)), self.distances(packed(bits[None, :])[0], slice(None))
            self.looked_at += len(self.codes)
        else:
            self.found += 1
        rows, distances = got
        return rows[distances <= np.partition(distances, enough - 1)[enough - 1]]

    def within(self, bits: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within radius, by the tables alone."""
        values = [int(self.substring(bits, j)) for j in range(len(self.places))]
        rows = np.concatenate([self.at(values, near) for near in range(radius // len(self.places) + 1)])
        self.seen[rows] = False
        return np.sort(rows[self.distances(packed(bits[None, :])[0], rows) <= radius])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length without nulls, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def on_sphere(x: np.ndarray, most: float | np.ndarray) -> np.ndarray:
    """Vectors of norms up to `most` as vectors of length one with one dimension more."""
    y = x / most
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))[:, None]], axis=1)


def largest_norm(of_class: np.ndarray | int) -> np.ndarray:
    return np.exp2(np.asarray(of_class, float) + 0.5)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), d (its size) and scale (its norm's class) of the rows that take part, equal rows once."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    # The largest component first, so that no square is too large or too small.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / top) * (x / top))
    return good.select("vec_id", "v", F.size("v").alias("d"), F.rint(F.log2(top) + F.log2(squares) / 2).cast("int").alias("scale")).distinct()


def search(vectors: DataFrame, every: int = 20, k: int = 20, bits: int = 256, effort: float = 4.0, least: int = 64, sample: int = 20_000, shard_rows: int = 16_384, block: int = 4096) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, its k nearest other rows: query_id, rank, vec_id, score, query_row.

    score: the inner product in double precision; ties go to the smaller vec_id. About effort * sqrt(n) + least of n vectors are
    ranked for a query; at the defaults recall against brute force is above 0.93 on the test tables and on vectors of skewed
    norms. Fewer than k rows come back only if there are fewer others. Vectors that are null, empty, all zero or that hold null or
    non-finite values take no part, nor does a null vec_id. Vectors meet those of their own length. Rows equal in id and vector
    are one row; where rows share an id but not a vector, each is a row, and if it's a query's, query_row tells the queries apart, from 0 on
    in the order of their vectors. Other columns aren't read; an empty table gives none.

    Rotations are learned on at most `sample` vectors of each length, by a hash. Every query visits all shards of its length,
    in blocks, so work on codes grows with queries times rows, eight bytes for every 64 signs.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    # Equal vectors once, with their k + 1 smallest ids: no more can be among the k nearest others of a query.
    # In two steps, so that a vector that many rows share is dealt out first; windows with a limit keep k + 1 rows of each task.
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (("v", "salt"), ("v",)):
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    placed = cut(few.groupBy("v", "d", "scale").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    # A row for each length and class of norms; classes are some dozens at most, lengths are taken to be few.
    groups, models, shards = [], {}, []
    for g in placed.groupBy("d", "scale").agg(F.count("*").alias("n")).orderBy("d", "scale").collect():
        d, n = g["d"], g["n"]
        if d not in models:
            models[d] = _learned(placed, d, bits, min(sample, max(1, SAMPLE_BYTES // (8 * d))))
        parts = -(-n // max(1, min(shard_rows, SHARD_BYTES // (8 * d))))
        share = (effort * np.sqrt(n) + least) * max(1.0, k / 20) / parts
        groups.append((d, g["scale"], len(shards), parts))
        shards += [(d, len(shards) + i, float(largest_norm(g["scale"])), int(share + 2 * np.sqrt(share) + 8)) for i in range(parts)]
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row int")
    shared = spark.sparkContext.broadcast((models, [s[2:] for s in shards]))
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asking.select("vec_id", "v", "d", (F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1).alias("query_row"))
    blocks = max(1, -(-asking.count() // block))
    at = spark.createDataFrame(groups, "d int, scale int, first int, parts int")
    left = placed.join(F.broadcast(at), ["d", "scale"])  # a row for each group
    left = left.select((F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("query_row"), "v", "ids")
    of_length = at.groupBy("d").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("parts") - 1).alias("high"))
    right = queries.join(F.broadcast(of_length), "d")
    right = right.select(F.explode(F.sequence("low", "high")).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), "query_row", "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, (models, about) = table.combine_chunks(), shared.value
        is_query = table.column("query_id").is_valid()
        own, asked = table.filter(pc.invert(is_query)), table.filter(is_query)
        found = list(_ranked(own, asked, models, *about[key[0].as_py()], k)) if own.num_rows and asked.num_rows else []
        give_back()
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.table([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=names)

    found = left.unionByName(right).groupBy("shard", "block").applyInArrow(run, RESULT)
    # At most k rows for each query and shard.
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")


def _learned(placed: DataFrame, d: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = placed.where(F.col("d") == d).select("v", "scale").orderBy(F.xxhash64("v")).limit(most).toArrow().combine_chunks()
    scale = drawn.column("scale").to_numpy()
    return learn_rotations(on_sphere(_matrix(drawn.column("v").combine_chunks()), largest_norm(scale)[:, None]), bits)


def _ranked(own: pa.Table, asked: pa.Table, models: dict, most: float, enough: int, k: int) -> Iterator[tuple]:
    """(query_id, query_row, vec_id, score) of the k best rows of a shard for each query."""
    x, q = (_matrix(t.column("v").combine_chunks()) for t in (own, asked))
    mean, matrix = models[x.shape[1]]
    ids = own.column("ids").to_pylist()
    index = MultiIndex(bits_of(on_sphere(x, most), mean, matrix))
    length = np.abs(q).max(axis=1, keepdims=True)
    length = length * np.sqrt(((q / length) ** 2).sum(axis=1, keepdims=True))
    codes = bits_of(np.concatenate([q / length, np.zeros((len(q), 1))], axis=1), mean, matrix)
    for query, row, code, vector in zip(asked.column("query_id").to_pylist(), asked.column("query_row").to_pylist(), codes, q, strict=True):
        near = index.nearest(code, enough)
        scores = (x[near] * vector).sum(axis=1)
        if len(near) > k + 1:
            edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            near, scores = near[scores >= edge], scores[scores >= edge]
        best = sorted((-s, i) for s, at in zip(scores.tolist(), near.tolist(), strict=True) for i in ids[at] if i != query or (x[at] != vector).any())
        for s, i in best[:k]:
            yield query, row, i, -s
