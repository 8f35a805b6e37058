"""Gazetteer files and their alias dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..functions.text import norm_key
from ..operators.relational import last_per

PIPE_COLUMNS = "name string, kind string, lat string, lon string, radius_km string, aliases string"
COMMA_COLUMNS = "name string, kind string, country string, lat string, lon string, aliases string"


def read_gazetteer(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Raw rows with their line order ``entry_pos``; columns may come in any order in the file."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [c.split()[0] for c in columns.split(", ")]
    picked = [F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names]
    return raw.select(*picked, F.monotonically_increasing_id().alias("entry_pos"))


def pipe_gazetteer(raw: DataFrame) -> DataFrame:
    """Entries with defaults; nameless rows drop out, aliases are split at pipes."""
    name = strip(F.coalesce("name", F.lit("")))

    def number(column: str, default: float):
        return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")).cast("double"), F.lit(default))

    return raw.filter(name != "").select(
        "entry_pos",
        name.alias("canonical_name"),
        F.coalesce(F.nullif(strip(F.col("kind")), F.lit("")), F.lit("unknown")).alias("place_kind"),
        number("lat", 0.0).alias("lat"),
        number("lon", 0.0).alias("lon"),
        number("radius_km", 50.0).alias("radius_km"),
        F.split(F.coalesce("aliases", F.lit("")), r"\|").alias("aliases"),
    )


def comma_gazetteer(raw: DataFrame) -> DataFrame:
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), strip), lambda a: a != "")
    return raw.select(
        "entry_pos",
        "name",
        F.coalesce(F.nullif("kind", F.lit("")), F.lit("unknown")).alias("kind"),
        F.coalesce("country", F.lit("")).alias("country"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        aliases.alias("aliases"),
    )


def alias_dictionary(entries: DataFrame) -> DataFrame:
    """Normalised key -> entry; on a clash the entry written last wins."""
    forms = F.concat(F.array("canonical_name"), F.filter("aliases", lambda a: strip(a) != ""))
    keyed = entries.select("*", F.posexplode(forms).alias("form_pos", "form")).withColumn("norm_key", norm_key(F.col("form")))
    won = last_per(keyed, ["norm_key"], ["entry_pos", "form_pos"])
    return won.select("norm_key", "canonical_name", "place_kind", "lat", "lon", "radius_km")


def surface_forms(entries: DataFrame) -> DataFrame:
    """Names and aliases of a comma gazetteer in file order, for the dictionary scan."""
    forms = F.concat(F.array("name"), F.col("aliases"))
    exploded = entries.select("*", F.posexplode(forms).alias("form_pos", "surface"))
    return exploded.select(
        F.struct("entry_pos", "form_pos").alias("name_pos"), "surface", "name", "kind", "country", "lat", "lon"
    )


def lower_dictionary(entries: DataFrame) -> DataFrame:
    """Lower-cased name or alias -> place, last entry wins."""
    forms = F.concat(F.array("name"), F.col("aliases"))
    keyed = entries.select("*", F.posexplode(forms).alias("form_pos", "form")).withColumn("lookup", F.lower("form"))
    won = last_per(keyed, ["lookup"], ["entry_pos", "form_pos"])
    return won.select("lookup", "name", "kind", "country", "lat", "lon")
