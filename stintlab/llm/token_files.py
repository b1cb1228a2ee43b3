"""Token ids in Arrow stream files of fixed-size lists.

A file holds the ids of a range of documents, in ascending doc_id order and each with the end id after it, cut
into sequences of equal length; only a file's last sequence is padded, which the mask column marks. Since every
batch is a fixed-size list over one flat buffer, sequence ``k`` or token ``k`` of a memory-mapped file is at a
computed place and is read without a copy. An index (Parquet) has each document's file, place and length.

Ids are stored in 16 bits if the vocabulary allows, else in 32. Null and empty texts have the end id alone;
null doc_ids come first, and documents of equal doc_id lie next to each other in the order of their text.

A file is written under a name of its attempt and then renamed, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.llm.common import id_text, kept, shared_dir, slices

SEQUENCE, BATCH_SEQUENCES, END_ID = 2048, 512, 1
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps with their ids; then it starts again.
MAX_WORDS = 600_000
#: Files whose totals are added up in one task.
BLOCK_FILES = 10_000
#: Documents of one file, about.
DOCS_A_FILE = 8192

#: The character that stands for each byte in a byte-level vocabulary: itself where Latin-1 has a visible one, else
#: the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}

INDEX = "doc_id long, file string, at long, n_tokens long"


class Encoder:
    """Ids of whole texts, by way of their words: the pre-tokenizer never joins what a space or newline parts.

    Words are kept with their ids' bytes. A full table is set aside rather than dropped, so that frequent words
    come back from it and only words that neither table has are encoded.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_words, self.words, self.older = max_words, {"": b""}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids' bytes, without an end id."""
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > self.max_words:
            self.words, self.older = {"": b""}, self.words
        self._learn({w for words in cut for w in words if w not in self.words})
        known = self.words
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def _learn(self, new: set[str]) -> None:
        known, older, rest = self.words, self.older, []
        for word in new:
            if (got := older.get(word)) is not None:
                known[word] = got
            elif self._is_plain(word):
                known[word] = self._plain(word)
            elif word[-1] in ",.;:!?" and self._is_plain(word[:-1]):
                known[word] = self._plain(word[:-1]) + self._plain(word[-1])
            else:
                rest.append(word)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = np.array(got.ids, self.dtype).tobytes()

    @staticmethod
    def _is_plain(word: str) -> bool:
        """Letters that the normalizer only lowers, one for one: ASCII, or composed Latin ones."""
        if not word.isalpha():
            return False
        return word.isascii() or max(word) < "\u0250" and len(word.lower()) == len(word) and unicodedata.is_normalized("NFC", word)

    def _plain(self, piece: str) -> bytes:
        """Of plain letters, or one mark: one piece to the pre-tokenizer, whose bytes the model knows as characters."""
        low = piece.lower()
        got = self.words.get(low) if low != piece else None
        if got is not None:
            return got
        if not low.isascii():
            low = "".join(map(_BYTE_CHARS.__getitem__, low.encode()))
        return np.array([t.id for t in self.model.tokenize(low)], self.dtype).tobytes()


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return kept(("encoder", path), lambda: Encoder(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    value = pa.from_numpy_dtype(dtype)
    return pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Collects ids and writes full batches; what it holds is at most one batch and one document."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int = BATCH_SEQUENCES):
        self.dtype, self.length, self.batch = dtype, length, batch
        self.schema = file_schema(dtype, length)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.total = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        full = self.batch * self.length
        if self.held >= full:
            flat = np.frombuffer(b"".join(self.parts), self.dtype)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i : i + full], full)
            rest = flat[len(flat) // full * full :]
            self.parts, self.held = [rest.tobytes()], len(rest)

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.frombuffer(b"".join(self.parts), self.dtype)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.stream.close()


class SequenceFile:
    """Random access to a file: all its batches but the last have the same number of sequences."""

    def __init__(self, store: fs.FileSystem, path: str):
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1
        self.flat = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        self.full = len(self.flat[0]) if self.flat else 1

    def tokens(self, at: int, n: int) -> np.ndarray:
        """n ids from place ``at``: a view, or a copy where they span batches."""
        first, last = at // self.full, (at + max(n, 1) - 1) // self.full
        if first == last:
            return self.flat[first][at % self.full : at % self.full + n]
        return np.concatenate(self.flat[first : last + 1])[at - first * self.full :][:n]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        per = self.full // self.length
        batch = self.batches[k // per]
        ids = self.flat[k // per][k % per * self.length :][: self.length]
        return ids, batch.column(1)[k % per].values.to_numpy(zero_copy_only=False)


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary_path: str | None = None,
    length: int = SEQUENCE,
    end_id: int = END_ID,
    docs_a_file: int = DOCS_A_FILE,
) -> DataFrame:
    """Writes the files below ``folder`` (a URI) and their index, and gives the index."""
    path = vocabulary_path or default_vocabulary()
    rows = id_text(docs)
    files = max(1, -(-rows.count() // docs_a_file))
    # the text's hash and the text break ties: rows of one id, or of none, spread over files, and a task that runs again
    # writes the same file
    ties = rows.withColumn("tie", F.xxhash64("text"))
    ordered = ties.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():010d}.arrows"
        attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as sink:
            writer = SequenceWriter(sink, enc.dtype, length)
            index = []
            for batch in batches:
                for part in slices(batch):
                    for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                        index.append((doc, name, writer.total, len(ids) // enc.dtype.itemsize + 1))
                        writer.add(ids + end)
            writer.close()
        store.move(attempt, f"{base}/{name}")
        columns = list(zip(*index, strict=True)) or [()] * 4
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "file", "at", "n_tokens"]
        )

    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``, a document's place in the whole stream of ids: file totals are added up in order of the
    files' names, first within blocks of ``BLOCK_FILES`` files, then over the blocks, a row each."""
    number = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("block", F.floor(number / BLOCK_FILES))
    before = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total"))
    first = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = totals.withColumn("inside", F.coalesce(F.sum("total").over(before), F.lit(0))).join(blocks.select("block", first.alias("first")), "block")
    base = rows.select("file", (F.col("first") + F.col("inside")).alias("base"))
    return index.join(base, "file").withColumn("start", F.col("base") + F.col("at"))


def read_back(folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        held: dict[str, SequenceFile] = {}
        for batch in batches:
            out = []
            for name, at, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                if name not in held:
                    held.clear()
                    held[name] = SequenceFile(store, f"{base}/{name}")
                out.append(zlib.crc32(held[name].tokens(at, n).astype("<u4").tobytes()))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = with_starts(index).sortWithinPartitions("file", "at")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_back(folder, write_tokens(docs, folder))
