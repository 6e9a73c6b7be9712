"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of bags of word shingles, banded and verified.

Signature (after Ertl, BagMinHash, 2018). A shingle that occurs w times has weight w. Each shingle carries one Poisson
process over time and weight: bands of weight (0,1], (1,2], (2,4], (4,8], ... are the top of a hierarchy, a band of width u has
points at rate u * m, and a point's place in its band, found by halving, tells at which unit of weight it lies. A point
counts if that unit is not above w, and belongs to one of m components drawn evenly. A component's value is the earliest
point that counts; two bags agree in a component with a chance equal to their weighted Jaccard similarity. Few points are ever made:
the earliest points of all components are almost surely before T = (ln m + c) / W, where W is the bag's total weight, so
points are drawn up to T, and only bags with an empty component are drawn again with T doubled. That's exact.

Duplicates. Equal texts first become one. Signatures are cut into bands; in each bucket of equal bands, every member is paired
with the smallest, and pairs are verified by their bags' exact weighted Jaccard similarity. Components of verified pairs are
found by contraction. In a bucket whose members are then still in several components, those of the largest component stay in
blocks, and all others visit these blocks and each other's, where they are compared by signature and then by bags. So each
pair that shares a bucket is in one component or has been compared, a stray member costs one pass over its bucket, no bucket is
capped, and no pairs are written but those that are similar.

Hot groups. A text with very many copies is found by a partial aggregate and told to its copies by a broadcast of at most a
thousand texts. All other joins are between written tables, so that Spark can split what is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import bag_similarity, bags_of, cut, give_back, mix64, parts_of, slices, small_side

ROWS, BANDS = 6, 32
#: Members and shingles of a block of a bucket; blocks are compared with blocks.
BLOCK, BLOCK_WEIGHT = 512, 300_000
#: Documents without a doc_id of their own, because it's null, repeated or out of range, are numbered from here on.
UNNAMED = 1 << 62
#: Bytes of text whose bags are made at once.
TEXT_BYTES = 1_000_000

_GOLDEN, _STEP, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xE7037ED1A0B428DB))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int, seed: int = 1, slack: float = 3.0) -> np.ndarray:
    """A row of m uint32 for each bag of (hashes, counts); empty bags get zeros."""
    sizes = np.array([len(b[0]) for b in bags], np.int64)
    out = np.zeros((len(bags), m), np.uint32)
    if not sizes.sum():
        return out
    totals = np.array([b[1].sum() for b in bags], float)
    limit = np.full(len(bags), np.inf)
    limit[totals > 0] = (np.log(m) + slack) / totals[totals > 0]
    todo = np.flatnonzero(sizes)
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        hashes = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        best = np.full(len(todo) * m, np.inf)
        level = 0
        while len(owner):
            low = 0 if level == 0 else 1 << (level - 1)
            width = max(1, low)
            _earliest(best, owner, hashes, weight, limit[todo], m, seed, level, low, width)
            more = weight > low + width
            owner, hashes, weight, level = owner[more], hashes[more], weight[more], level + 1
        best = best.reshape(-1, m)
        full = np.isfinite(best).all(axis=1)
        out[todo[full]] = (mix64(best[full].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        todo = todo[~full]
        limit[todo] *= 2
    return out


def _earliest(best, owner, hashes, weight, limit, m, seed, level, low, width) -> None:
    """Put the points of one band up to each bag's limit into best, where they count and are earlier.

    The k-th point of a shingle comes from the k-th hash of a counter, and its time from a running sum, so it doesn't matter
    how many points are drawn at once: one for bags of many shingles, many for bags of few."""
    bound = limit[owner]
    many = m * width * bound > 12
    for some, at_once in ((~many, 1), (many, 48)):
        chosen, step = np.flatnonzero(some), 400_000 // at_once
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            _points(best, owner[part], hashes[part], weight[part], bound[part], m, seed, level, low, width, at_once)


def _points(best, owner, hashes, weight, bound, m, seed, level, low, width, at_once) -> None:
    with np.errstate(over="ignore"):
        state = mix64(hashes ^ (np.uint64(seed) * _GOLDEN) ^ (np.uint64(level + 1) * _STEP))
        time = np.zeros((len(hashes), 1))
        first = 1
        while len(state):
            # One hash for each point: 40 bits tell its time, 24 its component.
            drawn = mix64(state[:, None] + np.arange(first, first + at_once, dtype=np.uint64)[None, :] * _GOLDEN)
            gaps = -np.log(((drawn >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / (m * width)
            times = np.cumsum(np.concatenate([time, gaps], axis=1), axis=1)[:, 1:]
            row, column = np.nonzero(times <= bound[:, None])
            drawn, when = drawn[row, column], times[row, column]
            place = owner[row] * m + ((drawn & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            if width == 1:  # a band of one unit: every element that is here reaches it
                np.minimum.at(best, place, when)
            else:
                # Where a point lies in its band: one bit of a hash halves the band at a time, down to a unit of weight.
                counts = low + (mix64(drawn ^ _PLACE) & np.uint64(width - 1)).astype(np.int64) < weight[row]
                np.minimum.at(best, place[counts], when[counts])
            on = np.flatnonzero(times[:, -1] <= bound)
            state, time, bound, owner, weight = state[on], times[on, -1:], bound[on], owner[on], weight[on]
            first += at_once


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """An int64 key for each band of each signature."""
    n, m = rows.shape
    per = m // bands
    keys = np.zeros((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        keys += np.arange(1, bands + 1, dtype=np.uint64) * _STEP
        for i in range(per):
            keys = mix64((keys ^ rows[:, i::per][:, :bands].astype(np.uint64)) + _GOLDEN)
    return keys.view(np.int64)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = 5) -> DataFrame:
    """The columns node, doc_id and text_key of docs, and weight (shingles), signature and keys of its texts."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            bags = bags_of(b.column("text"), words)
            signed = signatures(bags, m)
            keys = band_keys(signed, bands)
            weights = np.array([int(x[1].sum()) for x in bags], np.int64)
            ends = np.arange(len(bags) + 1, dtype=np.int32)
            none = pa.array(weights == 0)
            data = pa.Array.from_buffers(pa.binary(), len(bags), [None, pa.py_buffer(ends * np.int32(4 * m)), pa.py_buffer(signed.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(ends * np.int32(bands)), pa.array(keys.reshape(-1)))
            empty = [pa.scalar(None, data.type), pa.scalar(None, lists.type)]
            made = [pc.if_else(none, empty[0], data), pc.if_else(none, empty[1], lists)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "doc_id", "text_key")), pa.array(weights), *made], names=["node", "doc_id", "text_key", "weight", "signature", "keys"])

    return docs.select("node", "doc_id", "text_key", "text").mapInArrow(run, "node long, doc_id long, text_key binary, weight long, signature binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b): the smallest node of its component, by contraction.

    In each round every node points to its smallest neighbour or itself, and edges move to what their ends point to, until
    none is left. Each round is written to the shared folder; no node's neighbours are ever gathered."""
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        maps.append(parents)
        moved = edges.join(parents.select("a", F.col("p").alias("pa")), "a").join(parents.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0].select(F.col("a").alias("node"), F.col("p").alias("label"))
    for parents in maps[1:]:
        step = parents.select(F.col("a").alias("label"), "p")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return cut(labels)


def text_key(text: Column) -> Column:
    """A 128-bit hash of a text; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text for each of wanted's rows (node, text_key). docs has the texts, some of them many times."""
    found = docs.select(text_key(docs["text"]).alias("text_key"), docs["text"].alias("text")).where("text is not null")
    return found.join(small_side(wanted), "text_key").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, threshold: float, words: int = 5) -> DataFrame:
    """The pairs (a, b) of nodes whose bags have at least the similarity, with it. heads: node, text_key.

    Texts are joined to the pairs, so only texts in need move; what a task keeps is a few bags."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cut(texts_of(heads.select("node", "text_key").join(wanted, "node"), docs))
    joined = pairs
    for end in ("a", "b"):
        joined = joined.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")).hint("merge"), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, "text_b", TEXT_BYTES):
            for part in parts_of(one.column("text_a"), TEXT_BYTES):
                pairs_in = list(zip(*(one.column(c)[part].to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True))
                distinct = list({i: t for a, b, x, y in pairs_in for i, t in ((a, x), (b, y))}.items())
                bags = dict(zip((i for i, _ in distinct), bags_of([t for _, t in distinct], words), strict=True))
                rows = [(a, b, s) for a, b, _, _ in pairs_in if (s := bag_similarity(bags[a], bags[b])) >= threshold]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return cut(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double"))


def _links(first: list, second: list, bucket: int, m: int, bands: int, least: int, threshold: float, words: int) -> Iterator[tuple[int, int, float]]:
    """Verified pairs between two lists of (id, label, weight, signature, text) of one bucket, as many as join what belongs together.

    A pair is looked at if its labels differ, its signatures and weights don't rule it out, and this is the first bucket that it
    shares; so each pair is verified once. Pairs that found links have joined already aren't verified."""
    left, right = (np.frombuffer(b"".join(x[3] for x in side), np.uint32).reshape(-1, m) for side in (first, second))
    keys_a, keys_b = band_keys(left, bands), band_keys(right, bands)
    label_b, weight_b = np.array([x[1] for x in second]), np.array([x[2] for x in second])
    looked_at = []
    for i, (_, label, weight, _, _) in enumerate(first):
        agree = (right == left[i]).sum(axis=1)
        near = np.flatnonzero((label_b != label) & (agree >= least) & (np.minimum(weight_b, weight) >= threshold * np.maximum(weight_b, weight)))
        shared = (keys_b[near] == keys_a[i]).argmax(axis=1)
        near = near[keys_b[near, shared] == bucket]
        looked_at += [(-int(agree[j]), i, int(j)) for j in near]
    texts = {x[0]: x[4] for side, k in ((first, 1), (second, 2)) for x in (side[c[k]] for c in looked_at)}
    bags = {}
    for at in range(0, len(texts), 64):
        some = list(texts)[at : at + 64]
        bags |= zip(some, bags_of([texts[i] for i in some], words), strict=True)
    parent: dict[int, int] = {}

    def root(label: int) -> int:
        while (up := parent.get(label, label)) != label:
            label = up
        return label

    for _, i, j in sorted(looked_at):  # the most promising first
        (a, label_a, *_), (b, label_b_, *_) = first[i], second[j]
        x, y = root(label_a), root(label_b_)
        if x != y and (s := bag_similarity(bags[a], bags[b])) >= threshold:
            parent[max(x, y)] = min(x, y)
            yield min(a, b), max(a, b), s


def across(members: DataFrame, labels: DataFrame, signed: DataFrame, docs: DataFrame, m: int, bands: int, threshold: float, words: int) -> DataFrame:
    """Verified pairs (a, b, similarity) across components within buckets that have several; enough of them to join whatever
    a pair of similar members of one bucket would join.

    members: bucket, node, weight. The members of a bucket's largest component are dealt to blocks and don't move; the others
    are dealt to blocks of their own, visit all blocks of the largest component, and meet each other. A task holds two blocks."""
    placed = members.join(labels.select("node", "label").hint("merge"), "node", "left").select("bucket", "node", "weight", F.coalesce("label", "node").alias("label"))
    placed = cut(placed)
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    by_bucket = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "label", "w")).alias("top")).where("labels > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_WEIGHT)).cast("int")
    mixed = by_bucket.select("bucket", F.col("top.label").alias("largest"), blocks(F.col("top.n"), F.col("top.w")).alias("own"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("other"))
    rows = placed.join(small_side(mixed), "bucket").withColumn("stays", F.col("label") == F.col("largest"))
    rows = cut(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("stays"), F.col("own")).otherwise(F.col("other"))).cast("int")))
    mine = cut(signed.select("node", "text_key", "signature").join(small_side(rows.select("node").distinct()), "node"))
    texts = mine.select("node", "signature").join(texts_of(mine.select("node", "text_key"), docs).hint("merge"), "node")
    rows = rows.join(cut(texts).hint("merge"), "node")
    # (kind, x, y): block x of the others meets block y of the largest component, or one of the others' blocks, x <= y.
    to = lambda n: F.sequence(F.lit(0), n - 1)
    meeting = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    stays = F.transform(to(F.col("other")), lambda x: meeting(0, x, F.col("block")))
    visits = F.transform(to(F.col("own")), lambda y: meeting(0, F.col("block"), y))
    others = F.transform(to(F.col("other")), lambda y: meeting(1, F.least(F.col("block"), y), F.greatest(F.col("block"), y)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("stays"), stays).otherwise(F.concat(visits, others))))
    rows = rows.select("bucket", "at.kind", "at.x", "at.y", "stays", "block", "node", "label", "weight", "signature", "text")
    # 6 standard deviations below the threshold: a similar pair is missed with a chance of about one in a billion.
    least = int(np.floor(m * threshold - 6 * np.sqrt(m * threshold * (1 - threshold))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, kind, x, y = (k.as_py() for k in key)
        got = list(zip(*(table.column(c).to_pylist() for c in ("node", "label", "weight", "signature", "text", "block", "stays")), strict=True))
        first = [g[:5] for g in got if not g[6] and g[5] == x]
        second = [g[:5] for g in got if g[6] or kind == 1 and g[5] == y]
        found = list(_links(first, second, bucket, m, bands, least, threshold, words)) if first and second else []
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return cut(rows.groupBy("bucket", "kind", "x", "y").applyInArrow(run, "a long, b long, similarity double"))


def named(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """node, doc_id, text_key, text of all rows, and the doc_ids that can't name a row, or None where all can.

    A row's node is its doc_id if no other row has it, else a number from UNNAMED on; so no two rows share a node."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(f"n > 1 or doc_id is null or doc_id not between 0 and {UNNAMED - 1}")
    odd = cut(odd.select("doc_id"))
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("node"), "*"), None
    marks = small_side(odd.where("doc_id is not null").select("doc_id", F.lit(True).alias("odd")))
    rows = rows.join(marks, "doc_id", "left")
    unnamed = F.col("doc_id").isNull() | F.col("odd").isNotNull()
    number = F.monotonically_increasing_id() + F.lit(UNNAMED)
    return rows.select(F.when(unnamed, number).otherwise(F.col("doc_id")).alias("node"), "doc_id", "text_key", "text"), odd


def with_head(rows: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """rows with the column head: the first node that has their text, where several have it.

    heads: text_key, head, n. Texts that more than `most` rows have are broadcast; others join, so none fills a task."""
    hot = F.broadcast(heads.where(F.col("n") > most).select("text_key", F.col("head").alias("hot")))
    told = rows.join(hot, "text_key", "left")
    rest = told.where("hot is null").drop("hot").join(small_side(heads.where(F.col("n") <= most).select("text_key", "head")), "text_key", "left")
    return told.where("hot is not null").withColumnRenamed("hot", "head").unionByName(rest)


def _classes(rows: DataFrame, docs: DataFrame, threshold: float, bands: int, per_band: int, words: int) -> DataFrame:
    """node, doc_id, text_key, class_id (the smallest node of the class), links of all rows of named()."""
    signed = cut(sign(rows, bands, per_band, words))
    copies = signed.where("text_key is not null").groupBy("text_key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = cut(copies)
    # At most a thousand texts have more than a thousandth of all rows; where that's less than a hundred rows, they have a hundred.
    most = max(100, signed.count() // 1000)
    told = cut(with_head(signed.select("node", "doc_id", "text_key"), heads, most).select("node", "doc_id", "text_key", F.coalesce("head", "node").alias("head")))
    # One row for each text that has a word: the row of its head.
    alone = cut(with_head(signed.where("weight > 0"), heads, most).where("head is null or head = node").select("node", "text_key", "weight", "signature", "keys"))
    buckets = alone.select("node", "weight", F.explode("keys").alias("bucket"))
    leaders = cut(buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader"))
    members = cut(buckets.join(leaders.hint("merge"), "bucket"))
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    edges = verified(stars, alone, docs, threshold, words)
    labels = components(edges)
    more = across(members.select("bucket", "node", "weight"), labels, alone, docs, bands * per_band, bands, threshold, words)
    if not more.isEmpty():
        edges = cut(edges.unionByName(more))
        labels = components(edges)
    links = cut(edges.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("pairs")))
    about = labels.select(F.col("node").alias("head"), "label").join(links, "head")  # every node of a component has a pair
    found = told.join(small_side(about), "head", "left")
    copy = F.when(F.col("node") != F.col("head"), 1).otherwise(0)
    return found.select("node", "doc_id", "text_key", F.coalesce("label", "head").alias("class_id"), (F.coalesce("pairs", F.lit(0)) + copy).cast("long").alias("links"))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, words: int = 5) -> DataFrame:
    """doc_id, class_id, representative, links of every row.

    Rows are in one class if they are linked, directly or through others, by an equal text or by a weighted Jaccard similarity
    of at least threshold. class_id is the smallest doc_id of the class's rows; only ids that one row alone has count, and a class
    without such an id has a number from 2**62 on. representative: the row that gives its class the id; each class has one. links:
    verified pairs that a row's text is in, as the search compared them, plus 1 for a copy of another row's text.

    Texts of fewer words than a shingle have one shingle, the whole. Texts without any word are linked to equal texts only; a null
    text to none, so each is a class of its own. Null and repeated doc_ids are rows like others, by their own texts; negative ids
    count as repeated. Very long texts are compared as a whole. Other columns aren't read; an empty table gives none.
    """
    found = _classes(named(docs)[0], docs, threshold, bands, rows, words)
    return found.select("doc_id", "class_id", (F.col("node") == F.col("class_id")).alias("representative"), "links")


def deduplicated(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, words: int = 5) -> DataFrame:
    """docs, all columns whatever their names, with one row of each class of classes(): its representative.

    Rows with null texts are classes of their own and stay. Of equal rows one stays; of several rows with one doc_id and one text
    but other columns, the one whose columns come first as text. An empty table stays empty."""
    every, odd = named(docs)
    found = _classes(every, docs, threshold, bands, rows, words)
    own = docs["doc_id"].cast("long")
    if odd is None:
        gone = small_side(found.where("node <> class_id").select(F.col("doc_id").alias("__gone")))
        return docs.join(gone, own == gone["__gone"], "left_anti")
    # Rows that a doc_id names are judged by it, the others by doc_id and text.
    found = cut(found)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}")
    marks = small_side(odd.select(F.col("doc_id").alias("__odd")))
    by_id = plain.join(marks, doc_id == F.col("__odd"), "left_anti").where(doc_id.isNotNull())
    gone = small_side(found.where(f"node <> class_id and node < {UNNAMED}").select(F.col("doc_id").alias("__gone")))
    by_id = by_id.join(gone, doc_id == F.col("__gone"), "left_anti")
    others = plain.where(doc_id.isNull()).unionByName(plain.join(marks, doc_id == F.col("__odd"), "left_semi"))
    kept = small_side(found.where(f"node = class_id and node >= {UNNAMED} and text_key is not null").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")))
    chosen = others.join(kept, doc_id.eqNullSafe(F.col("__id")) & (text_key(text) == F.col("__key")), "left_semi")
    row = F.struct(*plain.columns)
    one = chosen.groupBy(doc_id.alias("__id"), text_key(text).alias("__key")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return by_id.unionByName(others.where(text.isNull())).unionByName(one).toDF(*names)
