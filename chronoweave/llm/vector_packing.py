"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths).  A
piece needs some of each.  Pieces go in by falling need; of all open bins that satisfy every
constraint, the one with the largest weighted dot product of need and residual, or with the least
residual norm after placing, takes the piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_rows, stored, texts_of
from .tokens import encoder

# Pieces one packing task gets on average; waste is at most a few open bins a task.
PIECES_PER_TASK = 20_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and how much each residual weighs in the choice of a bin."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"  # or "dot"

    def scale(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


def cut(total: int, size: int) -> list[int]:
    """Lengths of a document's pieces: ``size`` each, the first one may be shorter."""
    return ([total % size] if total % size else []) + [size] * (total // size)


def pieces(docs: DataFrame, path: str, kind: str, end_id: int, capacity: Capacity, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids with ``end_id`` appended.

    A NULL text counts as empty and gives one piece of the end id; documents of equal key are
    separate documents.  Only documents over the token capacity are cut.
    """

    def run(c: dict):
        enc = encoder(path, kind)
        out: dict[str, list] = {key: [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        end = np.array([end_id], dtype="<u4")
        for doc, found in zip(c[key].to_pylist(), enc.encode_all(texts_of(c["text"])), strict=True):
            ids = np.concatenate([found, end])
            at = 0
            for n, length in enumerate(cut(len(ids), capacity.tokens)):
                for k, v in zip(out, (doc, n, at, length, zlib.crc32(ids[at : at + length])), strict=True):
                    out[k].append(v)
                at += length
        return out

    kind_of_key = dict(docs.dtypes)[key]
    return map_rows(docs.select(key, "text"), run, f"{key} {kind_of_key}, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece.

    A piece over a capacity by itself (a capacity below what one document needs) gets a bin of its
    own, which then holds that one piece only.
    """
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1).astype(np.float64)
    scale, weights = capacity.scale(), np.array(capacity.weights)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((256, 3))  # residuals of open bins, dense
    name = np.empty(256, np.int64)
    n_open, made = 0, 0
    least = need.min(axis=0) if len(lengths) else None
    for i in order.tolist():
        v = need[i]
        best = -1
        if n_open:
            fits = np.flatnonzero((room[:n_open] >= v).all(axis=1))
            if len(fits):
                left = room[fits]
                if capacity.rule == "dot":
                    score = -((left / scale) @ (weights * v / scale))
                else:
                    score = (weights * ((left - v) / scale) ** 2).sum(axis=1)
                best = int(fits[score.argmin()])
        if best < 0:
            if n_open == len(name):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            room[n_open], name[n_open], best = scale, made, n_open
            n_open, made = n_open + 1, made + 1
        bins[i], offsets[i] = name[best], scale[0] - room[best, 0]
        room[best] -= v
        if (room[best] < least).any():  # full: nothing that comes can fit
            n_open -= 1
            room[best], name[best] = room[n_open], name[n_open]
    return bins, offsets


def pack(items: DataFrame, capacity: Capacity, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``items`` (with a ``length``) plus ``sequence_id`` and gapless ``offset``.

    Pieces are dealt out evenly, whatever their document or source, so no key can be hot; each task
    packs its share and numbers its bins in a range of its own.  ``items`` should be stored: their
    number fixes the number of tasks.
    """
    n = items.count()
    tasks = max(1, -(-n // per_task))
    schema = items.schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        bins, offsets = place(table["length"].to_numpy().astype(np.int64), capacity)
        base = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        yield from table.select([*names, "sequence_id", "offset"]).to_batches(max_chunksize=10_000)

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["sequence_id long", "offset long"])
    dealt = items.repartition(tasks)
    return in_arrow(dealt.sortWithinPartitions(F.desc("length"), *[x for x in names if x != "length"]), run, out)


def pack_documents(
    docs: DataFrame, path: str, kind: str = "byte", end_id: int = 2, capacity: Capacity = Capacity(), key: str = "doc_id"
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Empty table: no rows.  Repeated rows are packed as often as they occur.  Columns besides the key
    and ``text`` are left out, whatever their names.
    """
    return pack(stored(pieces(docs, path, kind, end_id, capacity, key), "pieces"), capacity)
