"""RSS feeds as DataFrames: rich, strict and merge readings of the same items.

Feeds are read by Spark's XML source with fixed schemas (never inferred, or ``01:02:03`` becomes a
timestamp).  ``parse_item_xml`` gives the same columns for item XML kept in a text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, strip
from ..functions.dates import duration_seconds, pub_timestamp, pub_timestamp_or_epoch
from ..functions.classify import merged_episode_kind
from ..functions.text import html_to_text, sanitize_description

ITEM_SCHEMA = (
    "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, pubDate string, "
    "description string, `content:encoded` string, "
    "enclosure struct<_VALUE:string,_url:string,_length:string,_type:string>, "
    "`media:content` struct<_VALUE:string,_url:string,_type:string>, `itunes:duration` string, "
    "`itunes:episodeType` string, `itunes:author` string, `podcast:guid` string"
)
CHANNEL_SCHEMA = (
    "title string, link string, description string, language string, image struct<url:string>, "
    "`itunes:image` struct<_VALUE:string,_href:string>, "
    "`atom:link` array<struct<_VALUE:string,_href:string,_rel:string>>"
)


def read_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw items with their file and the position inside it."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(ITEM_SCHEMA).load(paths)
    return raw.withColumn("feed_path", F.col("_metadata.file_path")).withColumn(
        "item_pos", F.monotonically_increasing_id()
    )


def read_channels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "channel").schema(CHANNEL_SCHEMA).load(paths)
    return raw.withColumn("feed_path", F.col("_metadata.file_path"))


def parse_item_xml(df: DataFrame, xml: str = "item_xml") -> DataFrame:
    """Item columns parsed from an XML text column; the other columns stay."""
    others = [c for c in df.columns if c != xml]
    return df.select(*others, F.from_xml(F.col(xml), ITEM_SCHEMA).alias("_item")).select(*others, "_item.*")


def _col(name: str) -> Column:
    return F.col(f"`{name}`") if ":" in name else F.col(name)


def channels(raw: DataFrame) -> DataFrame:
    """Podcast header; the feed URL is the self link, else the file."""
    self_link = F.get(F.filter(_col("atom:link"), lambda a: a["_rel"] == "self"), 0)["_href"]
    return raw.select(
        "feed_path",
        F.coalesce(strip(F.col("title")), F.lit("")).alias("title"),
        html_to_text(strip(F.col("description"))).alias("description"),
        F.coalesce(strip(F.col("language")), F.lit("")).alias("language"),
        F.coalesce(strip(F.col("link")), F.lit("")).alias("link"),
        F.coalesce(
            blank_to_null(F.col("image.url")), strip(_col("itunes:image")["_href"]), F.lit("")
        ).alias("image_url"),
        F.coalesce(self_link, F.col("feed_path")).alias("feed_url"),
        F.lit("rss").alias("feed_type"),
    )


def rich_items(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Full reading: guid falls back to link and title, the longer description wins."""
    link, title = F.coalesce(strip(F.col("link")), F.lit("")), F.coalesce(strip(F.col("title")), F.lit(""))
    return raw.select(
        *keys,
        F.coalesce(blank_to_null(F.col("guid._VALUE")), F.nullif(link, F.lit("")), title).alias("guid"),
        link.alias("page_url"),
        title.alias("title"),
        pub_timestamp_or_epoch(F.col("pubDate")).alias("pub_date"),
        duration_seconds(_col("itunes:duration")).alias("duration_sec"),
        blank_to_null(F.col("enclosure._url")).alias("audio_url"),
        blank_to_null(_col("itunes:episodeType")).alias("episode_type"),
        blank_to_null(_col("itunes:author")).alias("author"),
        F.coalesce(
            blank_to_null(_col("content:encoded")), strip(F.col("description")), F.lit("")
        ).alias("description_raw"),
    )


def strict_items(raw: DataFrame, keys: list[str], fail_fast: bool = False) -> DataFrame:
    """Plain reading.  An item without a usable date is an error: it raises with ``fail_fast``,
    otherwise it is marked in ``problem``."""
    title = F.coalesce(strip(F.col("title")), F.lit(""))
    guid = F.coalesce(blank_to_null(F.col("guid._VALUE")), title)
    published = pub_timestamp(F.col("pubDate"))
    length = F.col("enclosure._length")
    bad_length = (length != "") & strip(length).try_cast("bigint").isNull()
    problem = (
        F.when(blank_to_null(F.col("pubDate")).isNull(), F.concat(F.lit("missing pubDate for item "), guid))
        .when(published.isNull(), F.concat(F.lit("unreadable pubDate for item "), guid))
        .when(bad_length, F.concat(F.lit("unreadable enclosure length for item "), guid))
    )
    if fail_fast:
        problem = F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    return raw.select(
        *keys,
        guid.alias("guid"),
        title.alias("title"),
        published.alias("published_at"),
        F.coalesce(strip(F.col("description")), F.lit("")).alias("description"),
        F.col("enclosure._url").alias("audio_url"),
        strip(length).try_cast("bigint").alias("audio_length"),
        strip(_col("itunes:duration")).alias("duration_raw"),
        problem.alias("problem"),
    )


def merge_items(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Merge reading: audio only from audio media types; guid falls back to the one of the podcast
    namespace, then to link and title joined."""

    def audio(c: Column) -> Column:
        return F.when(c["_type"].startswith("audio/"), F.nullif(c["_url"], F.lit("")))

    guid = blank_to_null(F.col("guid._VALUE"))
    joined = F.concat(F.coalesce("link", F.lit("")), F.coalesce("title", F.lit("")))
    description = F.coalesce("description", F.lit(""))
    return raw.select(
        *keys,
        F.coalesce(guid, _col("podcast:guid"), joined).alias("guid"),
        F.col("link").alias("page_url"),
        F.nullif("title", F.lit("")).alias("title"),
        pub_timestamp(F.col("pubDate")).alias("pub_date"),
        F.coalesce(audio(F.col("enclosure")), audio(_col("media:content"))).alias("audio_url"),
        _col("itunes:episodeType").alias("episode_type"),
        merged_episode_kind(F.coalesce("title", F.lit("Episode"))).alias("kind"),
        description.alias("description_raw"),
        sanitize_description(description).alias("description_pure"),
    )
