"""Manual override patches on flat episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LOCATION = ("name", "country", "lat", "lon")


def apply_overrides(episodes: DataFrame, overrides: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Patch flat episodes by guid; only keys present in a record replace a value.

    A NULL list becomes an empty list.  A point keeps only its year and a range only its two years,
    zero where the record gives none.  A location is set when the gazetteer knows its name.
    ``gazetteer(lookup, name, country, lat, lon)`` is keyed by lower-cased name.
    """
    patch = overrides.select("guid", *[F.col(c).alias(f"o_{c}") for c in overrides.columns if c != "guid"])
    known = gazetteer.select("lookup", *[F.col(c).alias(f"g_{c}") for c in LOCATION])
    joined = episodes.join(patch, "guid", "left")
    joined = joined.withColumn("lookup", F.lower("o_primary_location.name")).join(known, "lookup", "left")

    def has(key):
        return F.coalesce(F.array_contains("o_keys", key), F.lit(False))

    empty = F.array().cast("array<string>")
    kind = F.coalesce("o_primary_time.kind", "primary_time_kind")
    point = has("primary_time") & (kind == "point")
    span = has("primary_time") & (kind == "range")

    def year(field):
        return F.coalesce(F.col(f"o_primary_time.{field}").try_cast("int"), F.lit(0))

    no_year = F.lit(None).cast("int")
    moved = has("primary_location") & F.col("g_name").isNotNull()
    changes = {
        "incident_type": F.when(has("incident_type"), F.coalesce("o_incident_type", F.lit("None"))).otherwise(F.col("incident_type")),
        "persons": F.when(has("persons"), F.coalesce("o_persons", empty)).otherwise(F.col("persons")),
        "links": F.when(has("links"), F.coalesce("o_links", empty)).otherwise(F.col("links")),
        "primary_time_kind": F.when(point | span, kind).otherwise(F.col("primary_time_kind")),
        "primary_time_year": F.when(point, year("year")).when(span, no_year).otherwise(F.col("primary_time_year")),
        "primary_time_start_year": F.when(span, year("start_year")).when(point, no_year).otherwise(F.col("primary_time_start_year")),
        "primary_time_end_year": F.when(span, year("end_year")).when(point, no_year).otherwise(F.col("primary_time_end_year")),
        **{
            f"primary_location_{c}": F.when(moved, F.col(f"g_{c}")).otherwise(F.col(f"primary_location_{c}"))
            for c in LOCATION
        },
    }
    return joined.withColumns(changes).select(*episodes.columns)
