"""Helpers that several operators share: stored tables, row keys, bounded sieves, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; this cuts the lineage.

    Lost executors do not matter afterwards, and work that made ``df`` is done once.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name`` or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(text: Column) -> Column:
    """64-bit hash of the whole text; with the document's id it names a row.

    Rows with equal id and equal text have equal results, so they may share a key.
    """
    return F.xxhash64(text)


_shipped: set[str] = set()


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` after sending this package to the Python workers, once an application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for ``fn(columns) -> dict of columns``, called once a batch.

    ``columns`` maps names to Arrow arrays; a result of no rows is left out.  ``fn`` may also be a
    generator function, for several results a batch.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn({f.name: batch.column(i) for i, f in enumerate(batch.schema)})
            for columns in [made] if isinstance(made, dict) else made:
                yield to_batch(columns, arrow)

    return in_arrow(df, run, target)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        c = columns[f.name]
        arrays.append(c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python texts of an Arrow column; NULL becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


# Look-up tables that a Python worker keeps from task to task, by operator.
_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """The worker's own cache for one operator.

    Workers outlive stages, so a cache of another operator is dropped when the next one starts:
    together they would take more memory than a worker has.
    """
    for other in [n for n in _caches if n != name]:
        del _caches[other]
    return _caches.setdefault(name, {})


_numbered = {"task": -1, "rows": 0}


def row_number_base(n: int) -> np.ndarray:
    """Numbers for the next ``n`` rows of this task, unlike those of any other task of the stage.

    They hold within one run only, so a result that carries them is stored before it is used twice.
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    if _numbered["task"] != context.taskAttemptId():
        _numbered.update(task=context.taskAttemptId(), rows=0)
    first = (context.partitionId() << 36) + _numbered["rows"]
    _numbered["rows"] += n
    return np.arange(first, first + n, dtype=np.int64)


# -- bounded sieves ---------------------------------------------------------------------------


class Sieve:
    """Bitmap of ``2**bits`` slots.  A key whose slot is clear is surely absent.

    Its size depends on ``bits`` only, so it may be broadcast whatever the input.  Set slots prove
    nothing: every use is followed by an exact equi join, so more keys cost shuffle, not results.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def sieve(df: DataFrame, key: str, bits: int = 23) -> Sieve:
    """Sieve over the 64-bit hashes in ``key``; NULLs are left out.

    Each of the ``2**(bits - 6)`` words is a partial OR, so at most that many short rows come back.
    """
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    slot = F.shiftrightunsigned(F.col(key), 64 - bits)
    rows = (
        df.where(F.col(key).isNotNull())
        .select(slot.alias("slot"))
        .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    )
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    if got.num_rows:
        words[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Sieve(words, bits)


# -- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the undirected ``edges`` (a, b); root is the least node reachable.

    Alternates large-star and small-star steps, each an aggregation by node and an equi join, until
    the edges no longer change; the number of rounds grows with the logarithm of the largest
    component's width.  Hot nodes are aggregated before the shuffle, joins may be split on skew.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    sign = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = stored(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == (now.n, now.s):
            break
        sign = (now.n, now.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
