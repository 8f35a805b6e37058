"""Change log: applying, reconciling and maintaining recorded operations.

``ops(op_id, seq, op_type, entity_type, entity_id, payload map<string,string>, status,
status_reason)``; ``seq`` is the order of the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Table of each entity type, columns of a relation.
TABLES = {
    "episode": "episodes",
    "span": "time_spans",
    "place": "places",
    "entity": "entities",
    "cluster": "clusters",
    "keyword": "keywords",
    "relation": "episode_clusters",
}
ROW_OPS = ("insert", "update", "delete")
LINK_OPS = ("link", "unlink")


def target_table() -> Column:
    """Payload table, else the table of the entity type, else the type itself."""
    known = F.create_map(*[F.lit(v) for kv in TABLES.items() for v in kv])
    kind = F.lower("entity_type")
    return F.coalesce(F.try_element_at("payload", F.lit("table")), F.try_element_at(known, kind), kind)


def set_fields() -> Column:
    return F.map_filter("payload", lambda k, _: k != "table")


def rejected_ops(ops: DataFrame) -> DataFrame:
    """Operations that cannot be applied, with the reason."""
    kind = F.lower("op_type")
    empty = F.size(F.coalesce(set_fields(), F.create_map().cast("map<string,string>"))) == 0
    reason = (
        F.when(~kind.isin(*ROW_OPS, *LINK_OPS), F.concat(F.lit("unsupported op_type: "), kind))
        .when(kind.isin("insert", "update") & empty, F.concat(kind, F.lit(" without fields")))
    )
    return ops.withColumn("reason", reason).filter("reason IS NOT NULL")


@dataclass
class RowChanges:
    """``fields(id, field, value)`` of touched rows that exist, ``deleted(id)``."""

    fields: DataFrame
    deleted: DataFrame


def fold_row_ops(ops: DataFrame, base_ids: DataFrame) -> RowChanges:
    """Final effect of all row operations per id, without replaying them.

    The last insert or delete decides whether a row exists; a field keeps its last write if that
    write is not older.  Both are plain maxima, so a hot id costs one row per task.  An update of a
    row that does not exist has no effect.
    """
    kind = F.lower("op_type")
    ident = F.coalesce(F.try_element_at("payload", F.lit("id")), F.col("entity_id"))
    row_ops = ops.filter(kind.isin(*ROW_OPS)).select(
        "seq",
        kind.alias("kind"),
        F.when(kind == "insert", ident).otherwise(F.col("entity_id")).alias("id"),
        set_fields().alias("fields"),
    )
    touched = row_ops.select("id").distinct()
    existing = base_ids.select(F.col("id").cast("string").alias("id")).join(
        touched, "id", "left_semi"
    )
    life = (
        row_ops.filter("kind <> 'update'")
        .select("id", "seq", (F.col("kind") == "insert").alias("alive"))
        .unionByName(existing.select("id", F.lit(-1).cast("bigint").alias("seq"), F.lit(True).alias("alive")))
        .groupBy("id")
        .agg(F.max("seq").alias("since"), F.max_by("alive", "seq").alias("alive"))
    )
    writes = (
        row_ops.filter("kind <> 'delete'")
        .select("id", "seq", F.explode("fields").alias("field", "value"))
        .filter("field <> 'id'")
        .groupBy("id", "field")
        .agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    )
    fields = writes.join(life.filter("alive"), "id").filter(F.col("seq") >= F.col("since"))
    return RowChanges(
        fields.select("id", "field", "value", (F.col("since") >= 0).alias("fresh")),
        life.filter("NOT alive").select("id"),
    )


def apply_row_ops(ops: DataFrame, table: str, base: DataFrame) -> DataFrame:
    """Table after the log: ``base`` has an ``id`` column; values are cast to its column types."""
    mine = ops.filter(target_table() == table)
    changes = fold_row_ops(mine, base)
    folded = cut_lineage(changes.fields)
    values = [c for c in base.columns if c != "id"]
    types = dict(base.dtypes)
    per_id = folded.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("set"), F.max("fresh").alias("fresh")
    )
    keyed = base.withColumn("_id", F.col("id").cast("string"))
    gone = changes.deleted.select(F.col("id").alias("_id"))
    change = per_id.withColumnRenamed("id", "_id")

    def written(c):
        return F.try_element_at("set", F.lit(c)).try_cast(types[c])

    def merged(c):
        touched = F.array_contains(F.map_keys("set"), c)
        kept = F.when(F.coalesce("fresh", F.lit(False)), F.lit(None).cast(types[c])).otherwise(F.col(c))
        return F.when(touched, written(c)).otherwise(kept).alias(c)

    survivors = keyed.join(gone, "_id", "left_anti").join(change, "_id", "left")
    updated = survivors.select("id", *[merged(c) for c in values])
    known = keyed.select("_id").join(change, "_id", "left_semi")
    created = (
        per_id.filter("fresh").withColumnRenamed("id", "_id").join(known, "_id", "left_anti")
        .select(F.col("_id").try_cast(types["id"]).alias("id"), *[written(c).alias(c) for c in values])
    )
    return updated.unionByName(created).select(*base.columns)


def apply_link_ops(ops: DataFrame, table: str, base: DataFrame, left: str = "episode_id", right: str = "cluster_id") -> DataFrame:
    """Relation after the log: the last link or unlink of a pair decides.

    A payload may name its own columns in ``left_col`` and ``right_col``, so the sides may be
    swapped; an operation that does not name both columns of this relation is left out.
    """
    kind = F.lower("op_type")
    sides = [F.coalesce(F.nullif(F.try_element_at("payload", F.lit(f"{s}_col")), F.lit("")), F.lit(c)) for s, c in (("left", left), ("right", right))]
    ids = [F.try_element_at("payload", F.lit(f"{s}_id")) for s in ("left", "right")]

    def side(c: str):
        return F.when(sides[0] == c, ids[0]).when(sides[1] == c, ids[1]).try_cast(dict(base.dtypes)[c]).alias(c)

    named = ((sides[0] == left) & (sides[1] == right)) | ((sides[0] == right) & (sides[1] == left))
    last = (
        ops.filter(kind.isin(*LINK_OPS) & (target_table() == table) & named)
        .select(
            side(left),
            side(right),
            "seq",
            (kind == "link").alias("linked"),
        )
        .groupBy(left, right)
        .agg(F.max_by("linked", "seq").alias("linked"))
    )
    last = cut_lineage(last)
    untouched = base.join(last.select(left, right), [left, right], "left_anti")
    # a relation already present stays one row, as with an insert that ignores duplicates
    present = base.join(last.filter("linked").select(left, right), [left, right], "left_semi")
    added = last.filter("linked").select(left, right).join(present.select(left, right), [left, right], "left_anti")
    return untouched.unionByName(present).unionByName(added, allowMissingColumns=True)


def reconcile(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Status of each operation against the current data.

    ``state(entity_type, entity_id, fields map<string,string>)`` has one row per existing record;
    a relation is keyed by its episode alone, and keywords never have a record.
    """
    record = state.select("entity_type", "entity_id", F.col("fields").alias("record"))
    joined = ops.join(record, ["entity_type", "entity_id"], "left")
    here = F.col("record").isNotNull()
    wanted = F.map_entries(F.coalesce("payload", F.create_map().cast("map<string,string>")))
    matches = here & F.forall(
        wanted, lambda e: F.coalesce(F.try_element_at("record", e["key"]).eqNullSafe(e["value"]), F.lit(False))
        & F.array_contains(F.map_keys("record"), e["key"])
    )
    kind = F.col("op_type")

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    found = (
        F.when(F.col("status") == "cancelled", F.struct(F.col("status"), F.col("status_reason").alias("reason")))
        .when((kind == "update") & matches, verdict("applied", "values already match"))
        .when((kind == "update") & ~here, verdict("invalid", "target row missing"))
        .when(kind == "update", verdict("queued", "not yet applied"))
        .when((kind == "delete") & ~here, verdict("applied", "row absent"))
        .when(kind == "delete", verdict("queued", "row still present"))
        .when(kind.isin("insert", "link") & here, verdict("applied", "target exists"))
        .when(kind.isin("insert", "link"), verdict("queued", "target not found yet"))
        .when((kind == "unlink") & ~here, verdict("applied", "relation removed"))
        .when(kind == "unlink", verdict("queued", "relation still exists"))
        .otherwise(verdict("invalid", "unsupported op type"))
    )
    return (
        joined.withColumn("_v", found)
        .withColumns({"status": F.col("_v.status"), "status_reason": F.col("_v.reason")})
        .select(*ops.columns)
    )


def cancel_ops(ops: DataFrame, op_ids: DataFrame) -> DataFrame:
    hit = op_ids.select("op_id").distinct().withColumn("hit", F.lit(True))
    out = ops.join(hit, "op_id", "left")
    return out.withColumns(
        {
            "status": F.when(F.col("hit"), "cancelled").otherwise(F.col("status")),
            "status_reason": F.when(F.col("hit"), "cancelled by user").otherwise(F.col("status_reason")),
        }
    ).select(*ops.columns)


def remove_ops(ops: DataFrame, op_ids: DataFrame) -> DataFrame:
    return ops.join(op_ids.select("op_id").distinct(), "op_id", "left_anti").select(*ops.columns)


def cleanup_ops(ops: DataFrame) -> DataFrame:
    """Only what is still waiting."""
    return ops.filter(F.col("status") == "queued")


def status_counts(ops: DataFrame) -> DataFrame:
    """One row with the count of every status."""
    return ops.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "applied", "invalid", "cancelled")]
    )
