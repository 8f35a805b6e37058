"""Key-based merges of a large base table with a batch.

The batch is reduced to one row per key and stored first.  Spark knows its size then: while it is
small enough to broadcast, the base is only probed and never moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .relational import first_per, last_per


def upsert_replace(base: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch replace those of the base; the last batch row per key wins."""
    newest = cut_lineage(last_per(batch, keys, order).select(*base.columns))
    kept = base.join(newest.select(*keys), keys, "left_anti")
    return kept.select(*base.columns).unionByName(newest)


def upsert_coalesce(
    base: DataFrame, batch: DataFrame, keys: list[str], order: list[str], keep_when_null: list[str]
) -> DataFrame:
    """Upsert that overwrites every column except ``keep_when_null``, which never turn NULL."""
    newest = cut_lineage(last_per(batch, keys, order).select(*base.columns))
    values = [c for c in base.columns if c not in keys]
    renamed = newest.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("hit"))
    merged = base.join(renamed, keys, "left")

    def value(c: str):
        fresh = F.coalesce(f"new_{c}", c) if c in keep_when_null else F.col(f"new_{c}")
        return F.when(F.col("hit"), fresh).otherwise(F.col(c)).alias(c)

    updated = merged.select(*keys, *[value(c) for c in values])
    return updated.select(*base.columns).unionByName(missing_rows(base, newest, keys))


def missing_rows(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is not in the base."""
    return batch.join(base.select(*keys), keys, "left_anti").select(*batch.columns)


def insert_ignore(base: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds batch rows with a new key; the first batch row per key wins."""
    first = cut_lineage(first_per(batch, keys, order).select(*base.columns))
    return base.unionByName(missing_rows(base, first, keys))


def new_by_guid(batch: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """First row per guid of the batch whose guid is not known yet."""
    return missing_rows(known.select("guid"), first_per(batch, ["guid"], order), ["guid"])


def keep_diff(all_ids: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    """Every id tagged ``kept``, ``deleted`` or ``missing`` (asked for but absent)."""
    left = all_ids.select(*on).distinct().withColumn("here", F.lit(True))
    right = keep.select(*on).distinct().withColumn("asked", F.lit(True))
    state = (
        F.when(F.col("here").isNull(), "missing").when(F.col("asked").isNull(), "deleted").otherwise("kept")
    )
    return left.join(right, on, "full").select(*on, state.alias("state"))
