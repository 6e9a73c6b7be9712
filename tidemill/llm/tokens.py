"""Token ids of whole texts, and token files: Arrow stream files of fixed-size lists.

Encoding. The tokenizers library encodes each run of non-space characters once and the runs' ids are joined. That gives the
ids of the whole text: the vocabulary's pre-tokenizer drops white space and none of its patterns crosses it, and neither
NFC nor lower case looks across a space. A text with a control character that Python and the library class differently as
space is encoded whole, and so is one that holds a token that the file adds to the vocabulary, in whatever case.

Token files. Each task writes one range of documents in order: `<name>.arrow` has record batches of fixed-size lists, `ids`
and `mask`, all of one sequence length, and `<name>.docs.arrow` has each document's id, start and length in that stream. Ids
are stored as uint16 where the vocabulary allows, else uint32. The last sequence of a file is padded with the end id and has
mask false there. The batches aren't compressed, so a memory map gives any sequence without copying.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._common import give_back, hash_strings, shared_dir

#: Space to str.split() but not to the library's \s.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

# The vocabulary's pre-tokens as Python's patterns say them within Latin-1, but for numerals that aren't digits.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_NUMERALS = re.compile("[\u00b2\u00b3\u00b9\u00bc\u00bd\u00be]")


class Known:
    """Strings and their ids, as arrays: looked up by hash and compared in full. Beyond `most` bytes it starts anew."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, and which row each is
        self.strings = pa.array([], pa.large_string())
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.barred = np.zeros(0, "<u4"), np.zeros(0, bool)

    @property
    def bytes(self) -> int:
        arrays = (self.hashes, self.rows, self.starts, self.sizes, self.ids, self.barred)
        return sum(x.nbytes for x in arrays) + self.strings.nbytes

    def find(self, strings: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The row of each string, or -1."""
        if not len(self.hashes):
            return np.full(len(strings), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        row = np.where(self.hashes[at] == hashes, self.rows[at], -1)
        on = np.flatnonzero(row >= 0)
        same = pc.equal(self.strings.take(pa.array(row[on])), strings.take(pa.array(on))).to_numpy(zero_copy_only=False)
        row[on[~same]] = -1
        return row

    def add(self, strings: pa.Array, hashes: np.ndarray, ids: list[bytes | None]) -> np.ndarray:
        """Rows for new strings. None for ids bars whatever text holds the string."""
        first = len(self.sizes)
        sizes = np.array([len(x or b"") // 4 for x in ids], np.int64)
        rows = np.arange(first, first + len(ids))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(x or b"" for x in ids), "<u4")])
        self.barred = np.concatenate([self.barred, np.array([x is None for x in ids], bool)])
        self.strings = pa.concat_arrays([self.strings, strings])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.rows = np.insert(self.hashes, at, hashes[order]), np.insert(self.rows, at, rows[order])
        return rows


class Encoder:
    """encode(texts) -> for each text the bytes of its ids as little-endian uint32.

    Where the vocabulary file drops white space, lowers case and byte-encodes runs of letters, runs are encoded once and
    remembered, in at most about `memory` bytes; any other file gets whole texts."""

    def __init__(self, path: str, memory: int = 36_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.runs = Known(memory // 2), Known(memory // 2)
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        file = json.loads(self.tokenizer.to_str())
        before, split = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in before.get("normalizers", ())], [x["type"] for x in split.get("pretokenizers", ())]
        self.by_run = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and split["pretokenizers"][0]["invert"] and "\\s" in split["pretokenizers"][0]["pattern"].get("Regex", "")
        if self.by_run:
            self.model = self.tokenizer.model
            self.stops = {c: self._whole([c])[0] for c in ".,"}
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.spelling = {i: spell.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
            self.pieces = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[str]) -> list[bytes | None]:
        """Ids of runs of lower-case texts whose stops stand alone. None for a run with punctuation at an end: next to a stop it
        might be one pre-token with it, so such a text is cut at spaces only."""
        pieces, tokenize, spelling, stops = self.pieces, self.model.tokenize, self.spelling, self.stops
        out: list[bytes | None] = []
        other = []
        for w in new:
            if w.isalpha():  # normal, and one pre-token: the library's model takes it as it is
                out.append(b"".join([pieces[t.id] for t in tokenize(w if w.isascii() else w.translate(spelling))]))
            elif not w or w in stops:
                out.append(stops.get(w, b""))
            else:
                out.append(None)
                if w[0].isalnum() and w[-1].isalnum():
                    other.append(len(out) - 1)
        for i, ids in zip(other, self._whole([new[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _runs(self, new: list[str]) -> list[bytes]:
        """Ids of runs of characters between spaces. In Latin-1 the vocabulary's pre-tokens can be told apart here."""
        parts, other = {}, []
        for run in new:
            if not run or ((run.isascii() or max(run) < "\u0100") and not self._adds(run) and not _NUMERALS.search(run)):
                parts[run] = _PRE_TOKENS.findall(run.lower())
            else:
                other.append(run)
        distinct = list({p for some in parts.values() for p in some})
        letters = [p for p in distinct if p.isalpha()]
        marks = [p for p in distinct if not p.isalpha()]
        ids = dict(zip(letters, self._words(letters), strict=True)) | dict(zip(marks, self._whole(marks), strict=True))
        whole = dict(zip(other, self._whole(other), strict=True))
        return [whole[run] if run in whole else b"".join([ids[p] for p in parts[run]]) for run in new]

    def _adds(self, text: str) -> bool:
        """Whether a token that the file adds stands in the text, in whatever case."""
        low = text.lower()
        return any(t in low for t in self.added)

    def _texts_by_words(self, texts: list[str]) -> list[bytes | None]:
        """Ids of Latin-1 texts, in which lower case is the same everywhere; None where a text has to be cut at spaces only."""
        apart = pa.array(texts, pa.large_string())
        for stop in self.stops:
            apart = pc.replace_substring(apart, stop, f" {stop} ")
        return self._assembled(pc.utf8_lower(apart), self.words, self._words)

    def _texts_by_runs(self, texts: list[str]) -> list[bytes | None]:
        return self._assembled(pa.array(texts, pa.large_string()), self.runs, self._runs)

    def _assembled(self, texts: pa.Array, known: Known, learn: Callable[[list[str]], list]) -> list[bytes | None]:
        """Split at spaces, look each distinct run up once, and join the ids of the runs of each text as arrays."""
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        which, distinct, bounds = coded.indices.to_numpy(), coded.dictionary, lists.offsets.to_numpy()
        if known.bytes > known.most:
            known.clear()
        hashes = hash_strings(distinct)
        row = known.find(distinct, hashes)
        new = np.flatnonzero(row < 0)
        if len(new):
            strings = distinct.take(pa.array(new))
            row[new] = known.add(strings, hashes[new], learn(strings.to_pylist()))
        each = known.sizes[row][which]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = known.ids[np.repeat(known.starts[row][which] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[bounds]).tolist()
        bad = np.concatenate([[0], np.cumsum(known.barred[row][which])])[bounds]
        return [None if y > x else flat[c:d] for c, d, x, y in zip(cuts, cuts[1:], bad, bad[1:], strict=False)]

    def encode(self, texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[bytes]:
        """Texts are taken in blocks of about `most` characters."""
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= most:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        if not self.by_run:
            return self._whole(texts)
        collecting = gc.isenabled()
        gc.disable()  # many short-lived objects and no cycles
        odd = [bool(_ODD_SPACE.search(t)) or self._adds(t) for t in texts]
        plain = [not x and _latin(t) and not any(p in t for p in ("..", ",,", ".,", ",.")) for t, x in zip(texts, odd, strict=True)]
        out: list[bytes | None] = [None] * len(texts)

        def fill(some: list[int], how) -> None:
            if not some:
                return
            for i, ids in zip(some, how([texts[i] for i in some]), strict=True):
                out[i] = ids

        fill([i for i, x in enumerate(plain) if x], self._texts_by_words)
        fill([i for i, x in enumerate(odd) if x], self._whole)
        fill([i for i, x in enumerate(out) if x is None], self._texts_by_runs)
        if collecting:
            gc.enable()
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def strings(column: pa.Array, size: int = 256) -> Iterator[str | None]:
    """The values of a column, a few of them in Python's memory at a time."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python process."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


SUMMARY = "name string, part int, docs long, tokens long"


class TokenFileWriter:
    """Writes one stream file and its document file; close() gives (docs, tokens)."""

    def __init__(self, folder: str, name: str, length: int, end: int, wide: bool, batch: int = 64):
        self.store, base = open_store(folder)
        self.store.create_dir(base, recursive=True)
        self.length, self.end, self.batch = length, end, batch
        self.kind = np.dtype("<u4" if wide else "<u2")
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.store.open_output_stream(f"{base}/{name}{x}") for x in (".arrow", ".docs.arrow")]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.out_docs = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = self.docs = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.tokens, len(ids)))
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        if self.n_held >= self.length * self.batch:
            self._sequences(self.n_held // self.length)
        if len(self.rows) >= 4096:
            self._documents()

    def _sequences(self, n: int, real: int | None = None) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        size = n * self.length
        now, rest = flat[:size], flat[size:]
        mask = np.ones(size, bool)
        if real is not None:
            mask[real:] = False
        for at in range(0, n, self.batch):
            one = slice(at * self.length, min(n, at + self.batch) * self.length)
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(now[one]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask[one]), self.length)], schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def _documents(self) -> None:
        if self.rows:
            self.out_docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.docs_schema))
            self.rows = []

    def close(self) -> tuple[int, int]:
        if self.n_held >= self.length:
            self._sequences(self.n_held // self.length)
        if real := self.n_held:
            self.held.append(np.full(self.length - real, self.end, self.kind))
            self._sequences(1, real)
        self._documents()
        for x in (self.out, self.out_docs, *self.sinks):
            x.close()
        return self.docs, self.tokens


#: The bytes of text that one task encodes, as a rule.
FILE_BYTES = 64_000_000


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, length: int = 2048, partitions: int | None = None) -> DataFrame:
    """Encode every whole text (null: empty), append the end id, and write token files in ascending doc_id order.

    Returns one row for each file: name, part (files in order of doc_id), docs, tokens. A file's name is new for each attempt
    of a task, and only files that are named in the result count, so a task that is run again does no harm. Null doc_ids
    come first; rows with equal doc_ids are ordered by text, null first, and equal rows stand side by side. Very long texts take a
    task's memory once, like others. Other columns aren't read. An empty table writes none.

    Tasks get ranges of (doc_id, first characters of the text), so rows that share a doc_id, or have none, spread over tasks as
    far as their texts differ; there are as many ranges as the texts' bytes ask for, and spark.sql.shuffle.partitions at least.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(partitions, "doc_id", F.substring("text", 1, 48)).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, name, code = None, f"part-{part:06d}-{uuid.uuid4().hex}", encoder(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            if writer is None:
                writer = TokenFileWriter(folder, name, length, end, max(code.tokenizer.get_vocab_size(), end + 1) > 65_536)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), code.encode(strings(b.column("text"))), strict=True):
                writer.add(doc_id, np.frombuffer(ids + last, "<u4"))
            del b
            give_back()
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.record_batch([[name], pa.array([part], pa.int32()), [n_docs], [n_tokens]], names=["name", "part", "docs", "tokens"])

    return rows.mapInArrow(write, SUMMARY)


def read_sequences(folder: str, name: str) -> pa.Table:
    """The sequences and masks of one file; memory-mapped, without copies, where the store is a local file system."""
    store, base = open_store(folder)
    path = f"{base}/{name}.arrow"
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return pa.ipc.open_file(source).read_all()


def read_documents(folder: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document of one file, a few batches in memory at a time."""
    store, base = open_store(folder)

    def source(suffix: str):
        path = f"{base}/{name}{suffix}"
        return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))

    data, table = source(".arrow"), source(".docs.arrow")
    blocks = (data.get_batch(i).column("ids").values.to_numpy(zero_copy_only=True) for i in range(data.num_record_batches))
    held, first = np.zeros(0, np.uint16), 0  # held starts at position first
    for i in range(table.num_record_batches):
        b = table.get_batch(i)
        for doc_id, start, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens")), strict=True):
            parts = [held[start - first :]]
            have = len(parts[0])
            while have < n:
                parts.append(next(blocks))
                have += len(parts[-1])
            held, first = np.concatenate(parts) if len(parts) > 1 else parts[0], start
            yield doc_id, start, held[:n]


def token_digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Read token files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document.

    Gathers one row for each file in the driver, to add up where each file starts; a file holds one task's documents."""
    found = sorted(files.select("part", "name", "tokens").collect())
    starts, total = [], 0
    for _, name, tokens in found:
        starts.append((name, total))
        total += tokens

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column("name").to_pylist(), b.column("first").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, ids in read_documents(folder, name):
                    rows.append((doc_id, first + start, len(ids), crc(ids.astype("<u4").tobytes())))
                    if len(rows) >= 8192:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(starts, "name string, first long")
    return table.coalesce(1).repartition(max(1, len(starts))).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 2048) -> DataFrame:
    """Write token files to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    # The list of files is written down: were it only planned, a second run of it would write the files again.
    files = write_token_files(docs, tokenizer, f"{folder}/files", end, length)
    files.write.parquet(f"{folder}/list")
    return token_digests(spark, f"{folder}/files", spark.read.schema(files.schema).parquet(f"{folder}/list"))
