"""Token ids as Arrow files of equal-length sequences.

The id streams of all documents, in ascending order of their key, are cut into sequences of
one length. A file holds record batches with two fixed-size-list columns: ``ids`` and
``mask`` (false on the padding behind a file's last document). Since buffers are not
compressed and lists are of fixed size, a reader that maps the file gets any sequence by
its number without reading or copying the others. Ids take the narrowest unsigned type
that holds the vocabulary. A second Arrow file beside it says where each document starts.

Files carry a name that is unique to the task attempt. Only a table of the files written by
successful attempts says what belongs to the result, so a lost or repeated task leaves at
most an unnamed file behind.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.pieces import LazyMemory
from courierlens.llm.shared import new_folder, running_total, saved, spread

#: Sequences in a record batch.
BATCH_SEQUENCES = 64


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it is visible in Latin-1, else as one of the
    characters from U+0100 on, in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LibraryEncoder:
    """Texts to id bytes with the tokenizers library and a byte-level BPE file.

    The library's model encodes every piece of the splitting pattern by itself, so pieces seen
    before are looked up. Strings of the file's added tokens are ordinary text, or with ``added``
    become these tokens' ids, as the library does by default: texts that may hold one are encoded
    by the library as a whole.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)  # owns the model
        model, table = self._tokenizer.model, str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.kind = np.dtype("<u2") if self._tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

        def encode(piece: str) -> bytes:
            found = model.tokenize(piece.encode().decode("latin-1").translate(table))
            return np.array([t.id for t in found], self.kind).tobytes()

        self._ordinary = LazyMemory(encode).ids
        names = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()] if added else []
        # A normalizer may turn other strings into an added token.
        everywhere = names and self._tokenizer.normalizer is not None
        self._added = re.compile("" if everywhere else "|".join(map(re.escape, names))) if names else None

    def ids(self, text: str | None) -> bytes:
        if text and self._added and self._added.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return self._ordinary(text)


_encoders: dict[tuple[str, bool], LibraryEncoder] = {}


def library_encoder(path: str, added: bool = False) -> LibraryEncoder:
    """One per worker process, tokenizer file and way with added tokens."""
    if (path, added) not in _encoders:
        _encoders[path, added] = LibraryEncoder(path, added)
    return _encoders[path, added]


def _sequences(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Writes one file of sequences and its document index, holding one record batch at a time."""

    def __init__(self, folder: str, kind: np.dtype, length: int, key: pa.DataType):
        self.name = f"tokens-{uuid.uuid4().hex}"
        self._files, place = arrow_fs.FileSystem.from_uri(folder)
        self._files.create_dir(place, recursive=True)
        self._streams = [self._files.open_output_stream(f"{place}/{self.name}{end}.arrow") for end in ("", "-index")]
        self._kind, self._length, self._schema = kind, length, _sequences(kind, length)
        self._index_schema = pa.schema([("key", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._out = pa.ipc.new_file(self._streams[0], self._schema)
        self._index = pa.ipc.new_file(self._streams[1], self._index_schema)
        self._held: list[bytes] = []
        self._held_bytes = 0
        self.tokens = self.documents = self.sequences = 0

    def add(self, keys: pa.Array, ids: list[bytes]) -> None:
        counts = np.array([len(x) // self._kind.itemsize for x in ids], np.int64)
        starts = self.tokens + np.cumsum(counts) - counts
        self._index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(counts)], schema=self._index_schema))
        self.tokens += int(counts.sum())
        self.documents += len(ids)
        self._held += ids
        self._held_bytes += sum(map(len, ids))
        self._put(BATCH_SEQUENCES * self._length)

    def _put(self, most: int, last: bool = False) -> None:
        if not last and self._held_bytes < most * self._kind.itemsize:
            return
        ids = np.frombuffer(b"".join(self._held), self._kind)
        whole = len(ids) if last else len(ids) // most * most
        for at in range(0, whole, most):
            self._batch(ids[at:min(at + most, whole)])
        self._held = [ids[whole:].tobytes()]
        self._held_bytes = len(self._held[0])

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self._length)
        padded = np.zeros(rows * self._length, self._kind)
        padded[:len(ids)] = ids
        mask = pa.array(np.arange(len(padded)) < len(ids))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(padded), self._length), pa.FixedSizeListArray.from_arrays(mask, self._length)]
        self._out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))
        self.sequences += rows

    def close(self) -> None:
        self._put(BATCH_SEQUENCES * self._length, last=True)
        for writer in (self._out, self._index, *self._streams):
            writer.close()


def write_token_files(df: DataFrame, key: str, text: str, make_encoder: Callable[[], LibraryEncoder], end_id: int,
                      folder: str, length: int = 2048) -> DataFrame:
    """Encodes whole texts, ends each with ``end_id`` and writes all ids in ascending order of ``key``.

    Returns the table of files: part, file, first_key, documents, tokens, sequences, start (ids in all
    files before it). A null or empty text is its end id alone. Null keys come first; rows with
    equal keys are ordered by a hash of their text, and equal rows as they lie in the table. No
    rows, no files. Other columns are not read. The rows are range-partitioned by key, hash and place,
    one shuffle, so a key that fills the table goes to many files; a task holds one batch of rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, own, first = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                own = make_encoder()
                end = own.kind.type(end_id).tobytes()
                writer, first = _Writer(folder, own.kind, length, batch.schema.field(0).type), batch.column(0)[:1]
            writer.add(batch.column(0), [own.ids(t) + end for t in batch.column(1).to_pylist()])
        if writer:
            writer.close()
            counts = [pa.array([n], pa.int64()) for n in (writer.documents, writer.tokens, writer.sequences)]
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([writer.name]), first, *counts], ["part", "file", "first_key", "documents", "tokens", "sequences"])

    files = ordered.mapInArrow(run, f"part long, file string, first_key {kind}, documents long, tokens long, sequences long")
    return running_total(saved(files, "token-files"), ["part"], "tokens", "start")


def open_token_file(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A token file, or with ``-index`` behind its name its index. On a local file system it is mapped."""
    files, place = arrow_fs.FileSystem.from_uri(f"{folder}/{name}.arrow")
    source = pa.memory_map(place) if isinstance(files, arrow_fs.LocalFileSystem) else files.open_input_file(place)
    return pa.ipc.open_file(source)


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of one sequence, by its number, without a copy of the ids."""
    batch = reader.get_batch(number // BATCH_SEQUENCES)
    row = number % BATCH_SEQUENCES
    return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values


def _stream(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """All ids of a file, padding left out, batch by batch."""
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        mask = batch.column(1).flatten()
        yield ids if not mask.false_count else ids[:mask.true_count]


def read_token_files(files: DataFrame, folder: str, key_type: str, key: str = "doc_id") -> DataFrame:
    """Reads the files back: ``key``, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), file.

    One task per file, which holds one record batch of sequences and one of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, index = _stream(open_token_file(folder, name)), open_token_file(folder, f"{name}-index")
                held = np.empty(0, np.uint16)
                for i in range(index.num_record_batches):
                    rows, sums = index.get_batch(i), []
                    for n in rows.column(2).to_numpy():
                        crc = 0
                        while n:
                            if not len(held):
                                held = next(ids)
                            crc = zlib.crc32(held[:n].astype("<u4").tobytes(), crc)
                            taken = min(n, len(held))
                            held, n = held[taken:], n - taken
                        sums.append(crc)
                    starts = pa.array(rows.column(1).to_numpy() + start)
                    yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(2), pa.array(sums, pa.int64()), pa.array([name] * len(sums))], ["key", "start", "n_tokens", "ids_crc32", "file"])

    work = spread(files.select("file", "start"), files.count())
    schema = f"key {key_type}, start long, n_tokens long, ids_crc32 long, file string"
    return work.mapInArrow(run, schema).withColumnRenamed("key", key)


def token_files(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, length: int = 2048, added: bool = False) -> DataFrame:
    """Writes the token files of a table into a new shared folder and reads them back. For ``added`` see LibraryEncoder."""
    folder = new_folder(df.sparkSession, "tokens")
    files = saved(write_token_files(df, key, text, lambda: library_encoder(tokenizer, added), end_id, folder, length), "token-file-list")
    return read_token_files(files, folder, df.schema[key].dataType.simpleString(), key)
