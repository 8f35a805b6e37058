"""Flat ingest: text and title of an item to one classified episode row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import incident_type, plain_links
from ..functions.columns import strip
from ..functions.dates import duration_seconds
from ..operators.mentions import primary_time
from ..operators.people import person_names
from ..operators.places import dictionary_locations, primary_location
from ..sources.gazetteers import lower_dictionary, surface_forms
from .overrides import apply_overrides

EPISODE_COLUMNS = (
    "podcast_id", "guid", "title", "published_at", "description", "audio_url", "audio_length", "duration_seconds",
    "incident_type", "primary_time_kind", "primary_time_year", "primary_time_start_year", "primary_time_end_year",
    "primary_location_name", "primary_location_country", "primary_location_lat", "primary_location_lon",
    "persons", "links",
)


def ingest_flat(items: DataFrame, gazetteer: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``items(podcast_id, guid, title, published_at, description, audio_url, audio_length,
    duration_raw)`` to flat episodes.  All rules but the location scan stay inside the row."""
    text = strip(F.concat(F.col("title"), F.lit("\n\n"), F.col("description")))
    when = primary_time(F.col("text"))
    base = items.withColumn("text", text)
    places = primary_location(dictionary_locations(base.select("guid", "text"), "guid", surface_forms(gazetteer)), "guid")
    located = places.select("guid", *[F.col(c).alias(f"primary_location_{c}") for c in ("name", "country", "lat", "lon")])
    # the row's own fields first, so that the join carries no extraction input but the description
    fields = base.withColumn("_t", when).select(
        "podcast_id", "guid", "title", "published_at", "description", "audio_url", "audio_length",
        duration_seconds(F.col("duration_raw")).alias("duration_seconds"),
        incident_type(F.col("text")).alias("incident_type"),
        F.col("_t.kind").alias("primary_time_kind"),
        F.col("_t.year").alias("primary_time_year"),
        F.col("_t.start_year").alias("primary_time_start_year"),
        F.col("_t.end_year").alias("primary_time_end_year"),
        person_names(F.col("text")).alias("persons"),
        plain_links(F.col("description")).alias("links"),
    )
    rows = fields.join(located, "guid", "left").select(*EPISODE_COLUMNS)
    if overrides is None:
        return rows
    return apply_overrides(rows, overrides, lower_dictionary(gazetteer))


def episode_out(flat: DataFrame) -> DataFrame:
    """Nested API shape; the location is NULL unless both coordinates are known."""
    here = F.col("primary_location_lat").isNotNull() & F.col("primary_location_lon").isNotNull()
    place = F.struct(
        F.col("primary_location_name").alias("name"),
        F.col("primary_location_country").alias("country"),
        F.col("primary_location_lat").alias("lat"),
        F.col("primary_location_lon").alias("lon"),
    )
    return flat.select(
        "podcast_id", "guid", "title", "published_at", "description", "audio_url", "duration_seconds",
        F.coalesce(F.nullif("incident_type", F.lit("")), F.lit("other")).alias("incident_type"),
        F.struct(
            F.coalesce(F.nullif("primary_time_kind", F.lit("")), F.lit("unknown")).alias("kind"),
            F.col("primary_time_year").alias("year"),
            F.col("primary_time_start_year").alias("start_year"),
            F.col("primary_time_end_year").alias("end_year"),
        ).alias("primary_time"),
        F.when(here, place).alias("primary_location"),
        "persons",
        "links",
    )
