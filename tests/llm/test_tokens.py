import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemill.llm import packing, queries, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_gives_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "ß", "İ", "'s", "'", ".", " ", ",", "1", "²", "ª", "̇", "\x1c", "Σ", "ς", "<|endoftext|>", "-", "|", "中", "\n", "re", "ﬁ", "Å", "ǅ", "\x85", "\xa0", "..", ",.", "!", "word", "Ab", "3", "µ", "½", "\xad", "_", "%%%", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, ""]
    for t, got in zip(texts, tokens.Encoder(PATH, memory=50).encode(texts, most=900), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(t, 0)[:-1], repr(t)


def test_added_tokens_in_any_case():
    """Only the file's own spelling of an added token is one id; look-alikes are text."""
    added = [t.content for t in TOKENIZER.get_added_tokens_decoder().values()]
    assert added
    texts = [f"{a}{f(t)}{b}" for t in added for f in (str, str.upper, str.title, str.swapcase) for a in ("", "a", "A ", "é", "中") for b in ("", "b", " B", "²")]
    for t, got in zip(texts, tokens.Encoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(t, 0)[:-1], repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_encoder_with_another_vocabulary(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = ["Two words, and  three.", "\n x", "", "it's"]
    assert [np.frombuffer(g, "<u4").tolist() for g in tokens.Encoder(path).encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def check_files(got, docs):
    want, start = [], 0
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = ids_of(text, 2)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files_round_trip(spark, messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    check_files(tokens.token_file_digests(messy, PATH, length=64).collect(), docs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_files_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_files(queries.op8_token_files(spark, f"/root/testdata/{sf}").collect(), docs)


def test_files_of_rows_without_ids_of_their_own(spark):
    """Most rows share one doc_id or have none: they spread over tasks, and the order stays."""
    docs = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k * 37 % 101} of {k}") for k in range(120)] + [(7, None), (None, None), (7, "x"), (7, "x")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    check_files(tokens.token_file_digests(rows, PATH, length=64).collect(), docs)


def test_sequences_are_equal_and_masked(spark, messy, tmp_path):
    files = tokens.write_token_files(messy, PATH, f"file://{tmp_path}", length=64, partitions=1).collect()
    table = tokens.read_sequences(f"file://{tmp_path}", files[0]["name"])
    ids = np.array(table.column("ids").to_pylist())
    mask = np.array(table.column("mask").to_pylist())
    assert ids.shape == mask.shape and ids.shape[1] == 64
    assert mask.sum() == files[0]["tokens"] and mask.ravel()[: files[0]["tokens"]].all()
    assert table.schema.field("ids").type.value_type == "uint16"


def test_files_empty(empty):
    assert tokens.token_file_digests(empty, PATH).count() == 0


def check_packing(got, docs, capacity):
    want = []
    for doc_id, text in docs:
        ids = ids_of(text, 0)
        want += [(doc_id, k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in got) // capacity)


def test_packing_messy(messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    got = packing.pack_documents(messy, PATH, capacity=100, rounds=50, buckets=3).collect()
    used, least = check_packing(got, docs, 100)
    assert used <= least + 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_packing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(queries.op6_packing(spark, f"/root/testdata/{sf}").collect(), docs, 2048)
    assert used == least


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_program_does_the_packing(sf):
    """Nearly all tokens of the test tables stand in the program's configurations, and best-fit alone needs as many sequences."""
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    sizes = np.array([len(g) // 4 + 1 for g in tokens.Encoder(PATH).encode(texts)])
    rest = sizes % 2048
    lengths, counts = np.unique(rest[rest > 0], return_counts=True)
    made = packing.plan(lengths, counts, 2048)
    assert made.by_program >= 0.9 * (lengths * counts).sum()
    assert made.sequences <= sum(m for _, _, m in packing.best_fit(lengths, counts, 2048))
    assert made.sequences == -(-(lengths * counts).sum() // 2048)


def test_large_counts_make_a_small_plan():
    rng = np.random.default_rng(8)
    lengths, counts = np.arange(1, 2048), rng.integers(1, 10_000, 2047) * 1000
    made = packing.plan(lengths, counts, 2048)
    assert len(made.length) < 40_000
    assert made.sequences <= 1.001 * sum(m for _, _, m in packing.best_fit(lengths, counts, 2048))


def test_packing_empty(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


def test_knapsack_against_brute_force():
    """The best value of each length as the largest, with no more copies than there are."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 12, 4))
        values, most = rng.random(len(lengths)), rng.integers(1, 4, len(lengths))
        sack = packing.Knapsack(lengths, values, most, 12)
        for i in range(len(lengths)):
            choices = itertools.product(*(range(m + 1) for m in most[:i]))
            want = max(values[i] + np.dot(c, values[:i]) for c in choices if lengths[i] + np.dot(c, lengths[:i]) <= 12)
            used, room, value = sack.largest(i)
            assert np.isclose(value, want) and np.isclose(value, sum(values[k] * n for k, n in used.items()))
            assert room == 12 - sum(lengths[k] * n for k, n in used.items()) >= 0
            assert all(n <= most[k] or k == i for k, n in used.items())


def test_plan_covers_all_pieces_once():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 65, 20))
        counts = rng.integers(1, 300, len(lengths))
        made = packing.plan(lengths, counts, 64, rounds=300)
        piece = np.repeat(lengths, counts)
        rank = np.concatenate([np.arange(c) for c in counts])
        sequence, offset = made.place(piece, rank)
        seen = np.zeros((made.sequences, 64), int)
        for s, o, n in zip(sequence, offset, piece, strict=True):
            seen[s, o : o + n] += 1
        assert seen.max() == 1 and seen.sum() == piece.sum()
        assert made.sequences <= sum(m for _, _, m in packing.best_fit(lengths, counts, 64))
