"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds equal-length sequences of ids and their masks.  All batches but the last have the same
number of sequences, hence the same number of bytes, so any sequence is found by arithmetic and
mapped without a copy.  A file per task holds a range of ids in order; documents follow each other
without gaps and only the last sequence of a file is padded, with its mask unset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_key, stored, texts_of
from .files import new_folder, open_to_write, own_name
from .tokens import encoder

SEQUENCE = 2048
BATCH_SEQUENCES = 256


def schema_of(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([pa.field("input_ids", pa.list_(kind, length)), pa.field("attention_mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to a stream of full sequences; ``close`` pads the last one."""

    def __init__(self, sink, length: int, wide: bool, pad: int):
        self.schema, self.length, self.pad = schema_of(length, wide), length, pad
        self.kind = np.uint32 if wide else np.uint16
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.written = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        full = self.length * BATCH_SEQUENCES
        while self.n_held >= full:
            line = np.concatenate(self.held)
            self._write(line[:full], full)
            self.held, self.n_held = [line[full:]], len(line) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([flat, mask], schema=self.schema))
        self.written += real

    def close(self) -> None:
        if self.n_held:
            line = np.concatenate(self.held)
            short = -len(line) % self.length
            self._write(np.concatenate([line, np.full(short, self.pad, self.kind)]), len(line))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.memory_map(path) if local else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.file)
        self.first = self.file.tell()
        self.length = self.schema.field(0).type.list_size
        self.stride = 0
        self.cached: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, number: int) -> pa.RecordBatch:
        if self.cached[0] != number:
            if number and not self.stride:
                self.file.seek(self.first)
                pa.ipc.read_message(self.file)
                self.stride = self.file.tell() - self.first
            self.file.seek(self.first + number * self.stride)
            self.cached = (number, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema))
        return self.cached[1]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence; the ids are a view of the file."""
        b = self.batch(number // BATCH_SEQUENCES)
        i = number % BATCH_SEQUENCES
        return b.column(0)[i].values.to_numpy(), b.column(1)[i].values.to_numpy(zero_copy_only=False)

    def slices(self, begin: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from ``begin`` on, ``n`` in all."""
        full = self.length * BATCH_SEQUENCES
        while n > 0:
            ids = self.batch(begin // full).column(0).flatten().to_numpy()
            part = ids[begin % full : begin % full + n]
            if not len(part):
                raise EOFError("the file ends before the document does")
            yield part
            begin, n = begin + len(part), n - len(part)

    def close(self) -> None:
        self.cached = (-1, None)
        self.file.close()


@dataclass(frozen=True)
class TokenFiles:
    """A folder of files and the index of its documents: doc_id, shard, file, begin, n_tokens."""

    folder: str
    index: DataFrame


def write(docs: DataFrame, path: str, kind: str = "word", end_id: int = 2, length: int = SEQUENCE) -> TokenFiles:
    """Encode ``text`` (NULL: empty), append ``end_id`` and write all ids in ascending doc_id order.

    Documents are dealt out by ranges of (doc_id, text hash), so no source or id can be hot; NULL ids
    come first, and rows of one id stand in the order of their text hash.  Ids take 16 bits where
    the vocabulary allows it.  An empty table gives an empty index.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    folder = new_folder(spark, "tokens")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", row_key(F.col("text")).alias("_row"))
    ordered = rows.repartitionByRange(shards, "doc_id", "_row").sortWithinPartitions("doc_id", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, sink, at = TaskContext.get().partitionId(), None, None, 0
        enc, end = encoder(path, kind), np.array([end_id], dtype="<u4")
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                name = own_name("tokens", "arrows")
                sink = open_to_write(folder, name)
                writer = SequenceWriter(sink, length, wide, end_id)
            begins, sizes = [], []
            for found in enc.encode_all(texts_of(b.column(1))):
                ids = np.concatenate([found, end])
                writer.append(ids)
                begins.append(at)
                sizes.append(len(ids))
                at += len(ids)
            n = b.num_rows
            columns = [b.column(0), pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "file", "begin", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, shard int, file string, begin long, n_tokens long"
    return TokenFiles(folder, stored(in_arrow(ordered, run, kinds), "index"))


def read(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it.  The totals of the shards, one row each,
    are summed on the driver; each task maps the files of its shards one after the other.
    """
    spark = files.index.sparkSession
    totals = sorted(tuple(r) for r in files.index.groupBy("shard").agg(F.sum("n_tokens")).collect())
    offsets, upto = [], 0
    for shard, n in totals:
        offsets.append((shard, upto))
        upto += n
    shard_starts = spark.createDataFrame(offsets, "shard int, shard_start long")
    folder = files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            crcs = []
            for f, begin, n in zip(*(b.column(c).to_pylist() for c in ("file", "begin", "n_tokens")), strict=True):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, SequenceFile(fs, f"{root}/{f}")
                crc = 0
                for part in file.slices(begin, n):
                    crc = zlib.crc32(part.astype("<u4"), crc)
                crcs.append(crc)
            start = pa.array(b.column("begin").to_numpy() + b.column("shard_start").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), start, b.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if file is not None:
            file.close()

    dealt = files.index.repartition(max(1, len(totals)), "shard").join(F.broadcast(shard_starts), "shard").sortWithinPartitions("shard", "begin")
    kind = dict(files.index.dtypes)["doc_id"]
    return in_arrow(dealt, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
