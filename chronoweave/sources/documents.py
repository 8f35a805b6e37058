"""Operation logs, manual overrides and staged entity documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OP_FIELDS = (
    "op_id string, created_at string, actor string, entity_type string, entity_id string, op_type string, "
    "payload variant, preconditions variant, status string, status_reason string"
)
OVERRIDE_FIELDS = (
    "incident_type string, persons array<string>, links array<string>, "
    "primary_time struct<kind:string,year:string,start_year:string,end_year:string>, "
    "primary_location struct<name:string>"
)


def _flat_payload(payload):
    """Scalar fields of a payload (its ``fields`` object when there is one) as text."""
    inner = F.try_variant_get(payload, "$.fields", "map<string,string>")
    return F.coalesce(inner, F.try_variant_get(payload, "$", "map<string,string>"))


def parse_ops(df: DataFrame, text: str = "value", keys: list[str] = ()) -> DataFrame:
    """Operations of log documents: a bare array or an object with ``operations``."""
    root = F.parse_json(text)
    listed = F.coalesce(
        F.try_variant_get(root, "$.operations", "array<variant>"), F.try_variant_get(root, "$", "array<variant>")
    )
    exploded = df.select(*keys, F.posexplode(listed).alias("seq", "op"))
    names = [f.split()[0] for f in OP_FIELDS.split(", ")]
    text_fields = [n for n in names if n not in ("payload", "preconditions")]
    payload = F.try_variant_get("op", "$.payload", "variant")
    flat = _flat_payload(payload)
    table = F.try_variant_get(payload, "$.table", "string")
    with_table = F.when(
        table.isNotNull() & F.try_element_at(flat, F.lit("table")).isNull(),
        F.map_concat(flat, F.create_map(F.lit("table"), table)),
    ).otherwise(flat)
    return exploded.select(
        *keys,
        F.col("seq").cast("bigint").alias("seq"),
        *[F.try_variant_get("op", f"$.{n}", "string").alias(n) for n in text_fields],
        with_table.alias("payload"),
        F.try_variant_get("op", "$.preconditions", "map<string,string>").alias("preconditions"),
    )


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return parse_ops(spark.read.text(path, wholetext=True))


def parse_overrides(df: DataFrame, key: str = "guid", text: str = "value") -> DataFrame:
    """Partial records with the set of keys present, since absent and NULL differ."""
    return df.select(
        key, F.from_json(text, OVERRIDE_FIELDS).alias("o"), F.json_object_keys(text).alias("keys")
    ).select(key, "o.*", "keys")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``guid`` and the overriding fields."""
    lines = spark.read.text(path)
    return parse_overrides(lines.select(F.get_json_object("value", "$.guid").alias("guid"), "value"))


def parse_entity_documents(df: DataFrame, key: str = "qid", text: str = "value") -> DataFrame:
    """Entity documents as variants; a dump wrapped in ``entities`` is opened by its id."""
    root = F.try_parse_json(text)
    return df.select(key, root.alias("doc")).filter("doc IS NOT NULL")


def read_entity_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one entity document each, keyed by its ``id``."""
    lines = spark.read.text(path)
    return parse_entity_documents(lines.select(F.get_json_object("value", "$.id").alias("qid"), "value"))
