"""First/last per key, numbering without a single task, salted pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key under ``order``.  Partial aggregation, so a hot key costs one row per task."""
    return _extreme(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], order, F.min, F.min_by)


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _extreme(df, keys, [F.col(o) for o in order], order, F.max, F.max_by)


def _extreme(df: DataFrame, keys: list[str], rank: list[Column], order: list, pick, pick_by) -> DataFrame:
    """The row of each key that ``pick`` finds by ``rank``.  One struct holds the rank and the columns it
    doesn't name, so nothing is moved twice; maps can't be compared and go beside the rank."""
    rest = [c for c in df.columns if c not in keys]
    named = {o: f"o{i}" for i, o in enumerate(order) if isinstance(o, str) and o in rest}
    more = [c for c in rest if c not in named]
    ranked = [r.alias(f"o{i}") for i, r in enumerate(rank)]
    if any(t in df.schema[c].dataType.simpleString() for c in more for t in ("map<", "variant")):
        got, named = df.groupBy(*keys).agg(pick_by(F.struct(*rest), F.struct(*ranked)).alias("_row")), {}
        more_at = {c: c for c in rest}
    else:
        more_at = {c: f"m{i}" for i, c in enumerate(more)}
        got = df.groupBy(*keys).agg(pick(F.struct(*ranked, *[F.col(c).alias(more_at[c]) for c in more])).alias("_row"))
    place = more_at | named
    return got.select(*keys, *[F.col("_row")[place[c]].alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Ranked first ``n`` rows per key.

    The rank filter lets the optimiser keep at most ``n`` rows per key in every task before the
    shuffle, so a hot key moves ``n`` rows per task and not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def ordered_distinct(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Distinct values per key with the position of their first occurrence."""
    return df.groupBy(*keys, value).agg(F.min(pos).alias(pos))


def number_rows(df: DataFrame, order: list, name: str = "row_no", start: int = 1) -> DataFrame:
    """Consecutive numbers in a total order, computed in parallel.

    The rows are range-sorted and materialised once; the number is the task's offset plus the place
    inside the task.  Only one count per task meets in a single place.
    """
    mono = F.monotonically_increasing_id()
    placed = cut_lineage(df.orderBy(*order).withColumn("_mono", mono))
    part = F.shiftright("_mono", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # one row per task of the sort: bounded by the shuffle partition count
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, (F.col("_before") + local + start).cast("bigint"))
        .drop("_part", "_before", "_mono")
    )


def running_total(df: DataFrame, order: list, weight: str, name: str) -> DataFrame:
    """Sum of ``weight`` over the rows before each row in a total order, computed in parallel.

    The rows are range-sorted and materialised once, as in ``number_rows``; a window runs inside each
    task's rows, and only one sum per task meets in a single place.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per task of the sort: bounded by the shuffle partition count
    offsets = F.broadcast(sums.select("_part", before.alias("_before")))
    local = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_local", local).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def salted_pairs(df: DataFrame, key: str, item: str, payload: list[str], chunk: int = 1000) -> DataFrame:
    """Pairs ``a < b`` of items that share ``key``, with both payloads suffixed ``_a`` / ``_b``.

    A key held by many items is cut into chunks of about ``chunk`` items on the left side and
    repeated once per chunk on the right, so no task builds all pairs of a hot key.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    sized = df.join(sizes, key)
    left = sized.select(
        key,
        F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int").alias("_salt"),
        F.col(item).alias(f"{item}_a"),
        *[F.col(p).alias(f"{p}_a") for p in payload],
    )
    right = sized.select(
        key,
        F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_salt"),
        F.col(item).alias(f"{item}_b"),
        *[F.col(p).alias(f"{p}_b") for p in payload],
    )
    return (
        left.join(right, [key, "_salt"])
        .filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
        .drop("_salt")
    )


def lookup(df: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a dimension; Spark broadcasts it when its measured size allows."""
    return df.join(dim, on, how)
