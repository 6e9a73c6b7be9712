"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. How many pieces have each length, a
histogram of at most `capacity` numbers, is all that planning needs. The program over configurations (multisets of lengths
that fit one sequence) covers the histogram by as few sequences as it can.

Multiplicative weights. Each length has a weight that falls exponentially with the share of its pieces that is covered so far.
Weights make prices, and in each round one knapsack by dynamic programming over the capacity prices all columns at once: its
tables hold, for each length, the configuration of largest value in which that length is the largest. Columns whose value is near the best and that fill a sequence enter the
solution. Amounts are rounded as they enter: as many whole sequences as the pieces that are left allow, so nothing is
covered twice and nothing has to be taken back. When no column fills a sequence to the last token, a few tokens of room are
allowed.

Rounding leaves some pieces; best-fit places them, longest first. Since a poor rest costs sequences, several shorter
prefixes of the solution are tried with best-fit for the rest, and the one that needs fewest sequences is kept, the longest at
a tie. The empty prefix is among them, so a plan is never worse than best-fit alone.

A plan says which ranks of each length stand where, so pieces are placed by their rank within their length, without any
gathering of pieces: ranks come from counts by (length, bucket).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._common import cut, give_back
from tidemill.llm.tokens import crc, encoder, strings

#: How fast weights fall with cover, and how much longer pieces are favoured, so that short ones are left to fill gaps.
RATE, TILT = 0.1, 0.1
#: A column's value may be this much below the best one's; and the rooms, in tokens, that are allowed one after another.
NEAR, ROOMS = 0.02, (0, 1, 2, 4, 8, 16)

#: A configuration: (which lengths, how many of each), and its number of sequences.
Column = tuple[np.ndarray, np.ndarray, int]


@dataclass
class Knapsack:
    """All best configurations under prices: for each length, the one in which it is the largest.

    Lengths are ascending. Each length may be taken up to `most` times: it stands as 1, 2, 4, ... copies, each of which is
    taken or not. last[e, c] is the last of the first e entries that the best filling of c tokens takes, or -1."""

    lengths: np.ndarray
    prices: np.ndarray
    most: np.ndarray
    capacity: int
    entries: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.first = np.zeros(len(self.lengths), np.int64)  # each length's first entry
        for i, most in enumerate(self.most.tolist()):
            self.first[i] = len(self.entries)
            copies = 1
            while most > 0:
                self.entries.append((i, min(copies, most)))
                most -= copies
                copies *= 2
        best = np.zeros(self.capacity + 1)
        self.last = np.empty((len(self.entries) + 1, self.capacity + 1), np.int16)
        self.last[0] = -1
        for e, (i, copies) in enumerate(self.entries):
            size = copies * int(self.lengths[i])
            self.last[e + 1] = self.last[e]
            if size <= self.capacity:
                value = best[: self.capacity + 1 - size] + self.prices[i] * copies
                better = value > best[size:]
                self.last[e + 1, size:][better] = e
                best[size:] = np.where(better, value, best[size:])
        self.value = float(best[self.capacity])

    def largest(self, i: int) -> tuple[dict[int, int], int, float]:
        """One piece of length i with the best filling by shorter ones: copies of each length, room left, value."""
        used, room, value = {i: 1}, self.capacity - int(self.lengths[i]), float(self.prices[i])
        e = int(self.last[self.first[i], room])
        while e >= 0:
            k, copies = self.entries[e]
            used[k] = copies + used.get(k, 0)
            room -= copies * int(self.lengths[k])
            value += copies * float(self.prices[k])
            e = int(self.last[e, room])
        return used, room, value


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> list[Column]:
    """Columns in the order in which they entered the solution. No length is used more often than it occurs."""
    left, out, rooms = counts.copy(), [], list(ROOMS)
    for _ in range(rounds):
        on = np.flatnonzero(left)
        if not len(on) or not rooms:
            break
        own = lengths[on]
        weights = np.exp(-RATE * (1 - left[on] / counts[on]))
        sack = Knapsack(own, own * (1 + TILT * own / capacity) * weights, np.minimum(left[on], capacity // own), capacity)
        entered = False
        for i in range(len(on) - 1, -1, -1):
            if not left[on[i]]:
                continue
            used, room, value = sack.largest(i)
            which, copies = on[list(used)], np.array(list(used.values()), np.int64)
            sequences = int((left[which] // copies).min())
            if room <= rooms[0] and value >= (1 - NEAR) * sack.value and sequences:
                left[which] -= copies * sequences
                out.append((which, copies, sequences))
                entered = True
        if not entered:
            rooms.pop(0)
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Column]:
    """Best-fit over a histogram, longest first: a sequence takes the longest pieces that still fit; equal ones are made at once."""
    which = [i for i in np.argsort(lengths, kind="stable").tolist() if counts[i]]
    sizes, left, out = [int(lengths[i]) for i in which], counts.tolist(), []
    while sizes:
        used, room, top = [], capacity, len(sizes)
        while (top := bisect_right(sizes, room, 0, top) - 1) >= 0:
            copies = min(left[which[top]], room // sizes[top])
            used.append((top, copies))
            room -= copies * sizes[top]
        sequences = min(left[which[at]] // copies for at, copies in used)
        out.append((np.array([which[at] for at, _ in used]), np.array([c for _, c in used], np.int64), sequences))
        for at, copies in used:  # from the longest on, so places stay right
            left[which[at]] -= copies * sequences
            if not left[which[at]]:
                del sizes[at], which[at]
    return out


def without(counts: np.ndarray, columns: list[Column]) -> np.ndarray:
    left = counts.copy()
    for which, copies, sequences in columns:
        left[which] -= copies * sequences
    return left


def covered(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, tries: int = 12) -> tuple[list[Column], int]:
    """Columns that cover the histogram, those of the program first, and how many are the program's."""
    program = solve(lengths, counts, capacity, rounds)
    made = np.cumsum([0, *(c[2] for c in program)])
    best: tuple[int, list[Column], int] | None = None
    for share in [1 - 0.5 * (k / (tries - 2)) ** 2 for k in range(tries - 1)] + [0.0]:
        n = int(np.searchsorted(made, made[-1] * share, side="right")) - 1
        rest = best_fit(lengths, without(counts, program[:n]), capacity)
        total = int(made[n]) + sum(c[2] for c in rest)
        if best is None or total < best[0]:
            best = total, program[:n] + rest, n
    return best[1], best[2]


@dataclass
class Plan:
    """For each length, runs of ranks: a run starts at rank `first`, has `copies` pieces in each of its sequences from number
    `sequence` on, and these start at `offset` there. Sorted by (length, first). by_program: tokens in the program's columns."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    by_program: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and offset of each piece."""
        big = np.int64(1) << np.int64(44)
        at = np.searchsorted(self.length * big + self.first, length * big + rank, side="right") - 1
        inside = rank - self.first[at]
        return self.sequence[at] + inside // self.copies[at], self.offset[at] + inside % self.copies[at] * length


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> Plan:
    """Where the pieces of each length go. The plan has some ten thousand runs at most, whatever the counts."""
    order = np.argsort(lengths, kind="stable")
    order = order[counts[order] > 0]
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    columns: list[Column] = []
    if len(lengths) and lengths[-1] == capacity:  # whole sequences need no program
        columns.append((np.array([len(lengths) - 1]), np.ones(1, np.int64), int(counts[-1])))
    short = lengths < capacity
    n = 0
    if short.any():
        more, n = covered(lengths[short], counts[short], capacity, rounds)
        n += len(columns)
        columns += more
    rows, done, sequence, by_program = [], np.zeros(len(lengths), np.int64), 0, 0
    for k, (which, copies, sequences) in enumerate(columns):
        offset = 0
        for i, c in zip(which.tolist(), copies.tolist(), strict=True):
            rows.append((int(lengths[i]), int(done[i]), c, sequence, offset))
            done[i] += c * sequences
            offset += c * int(lengths[i])
        sequence += sequences
        by_program += offset * sequences if k < n else 0
    rows.sort()
    return Plan(*(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5)), sequence, by_program)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text; the end id follows each text."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = {"piece": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, code = np.array([end], "<u4").tobytes(), encoder(tokenizer)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), code.encode(strings(b.column("text"))), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(one) // 4, crc(one)))
            if rows:
                columns = zip(names, zip(*rows, strict=True), strict=True)
                yield pa.record_batch([pa.array(c, kinds.get(n, pa.int64())) for n, c in columns], names=names)
            del b, rows
            give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, rounds: int = 400, buckets: int = 256) -> DataFrame:
    """Pack all documents (null text: empty, so only the end id) into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece. Only documents of more than capacity
    tokens are cut, so very long ones give many pieces. Null doc_ids and repeated rows are packed like others, one by one;
    which of several equal rows stands where isn't told. Other columns aren't read. An empty table gives an empty result.
    The driver holds the histogram, at most capacity numbers; rounds bounds the program's knapsacks, of which some 50 are used.
    """
    made_of = pieces(docs, tokenizer, capacity, end)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    rows = cut(made_of.withColumn("bucket", bucket))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("length", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    histogram = starts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    lengths, counts = (np.array([r[c] for r in histogram], np.int64) for c in ("length", "n"))
    shared = docs.sparkSession.sparkContext.broadcast(plan(lengths, counts, capacity, rounds))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    # At most capacity * buckets rows of 24 bytes: as the window, so the join is on (length, bucket), without another shuffle.
    ranked = numbered.join(starts.select("length", "bucket", "first").hint("merge"), ["length", "bucket"])
    rank = (F.col("first") + F.col("place")).cast("long").alias("rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", rank)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = shared.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
