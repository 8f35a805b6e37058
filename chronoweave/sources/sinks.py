"""JSON, table and review-sheet sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def json_lines(df: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON text per row, NULL fields kept."""
    options = {**KEEP_NULLS, "pretty": str(pretty).lower()}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("value"))


def write_sections(sections: dict[str, DataFrame], path: str, pretty: bool = False) -> None:
    """One folder of JSON text per section; every section is written by all its tasks in parallel."""
    for name, df in sections.items():
        json_lines(df, pretty).write.mode("overwrite").text(f"{path}/{name}")


def write_snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Overwrite a table with its merged snapshot."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def review_block() -> Column:
    """Markdown block of one flat episode."""

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    dash = F.lit("—")
    years = F.concat_ws("-", "primary_time_start_year", "primary_time_end_year")
    span = F.when(F.col("primary_time_kind") == "range", F.concat(F.lit(" "), years)).otherwise("")
    place = F.when(
        F.coalesce("primary_location_name", F.lit("")) != "",
        F.concat(
            F.col("primary_location_name"), F.lit(" ("), text("primary_location_country"), F.lit(") ["),
            text("primary_location_lat"), F.lit(","), text("primary_location_lon"), F.lit("]"),
        ),
    ).otherwise(dash)

    def listing(c):
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(dash)

    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("guid"), F.lit(" — "), F.col("title")),
        F.lit(""),
        F.concat(F.lit("- podcast: "), F.col("podcast_id")),
        F.concat(F.lit("- published_at: "), text("published_at")),
        F.concat(F.lit("- incident_type: "), text("incident_type")),
        F.concat(
            F.lit("- primary_time: "), text("primary_time_kind"), F.lit(" "),
            F.coalesce(F.col("primary_time_year").cast("string"), F.lit("")), span,
        ),
        F.concat(F.lit("- primary_location: "), place),
        F.concat(F.lit("- persons: "), listing("persons")),
        F.concat(F.lit("- links: "), listing("links")),
        F.lit(""),
    )


def ordered_list(df: DataFrame, *order: str) -> DataFrame:
    """A list section in its fixed order."""
    return df.orderBy(*order)


def point_lookup(df: DataFrame, guid: str) -> DataFrame:
    return df.filter(F.col("guid") == guid)


def require_row(df: DataFrame, guid: str):
    """The row of a guid; ``KeyError`` when there is none."""
    rows = point_lookup(df, guid).take(1)
    if not rows:
        raise KeyError(guid)
    return rows[0]
