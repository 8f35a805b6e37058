"""Facet counts, bounds and coverage density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import span_years

MAX_LOCATIONS = 200


def decade(year: Column) -> Column:
    """Decade truncated toward zero: -44 falls in -40."""
    return (year - year % 10).cast("int")


def representative_year() -> Column:
    return F.coalesce("primary_time_year", "primary_time_start_year", "primary_time_end_year")


def facet_total(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count(F.lit(1)).alias("total_count"))


def facet_type(episodes: DataFrame) -> DataFrame:
    kind = F.coalesce("incident_type", F.lit("other")).alias("incident_type")
    return (
        episodes.groupBy(kind)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("incident_type"))
    )


def facet_location(episodes: DataFrame, limit: int | None = MAX_LOCATIONS) -> DataFrame:
    """Top locations with coordinates (all for ``limit=None``), plus one all-NULL bucket when rows
    lack coordinates.

    Both come from one aggregation over one scan: rows without coordinates fall into a single
    flagged group, which is first of its kind.
    """
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    keyed = episodes.select(
        known.alias("known"),
        *[F.when(known, F.col(c)).alias(c) for c in ("name", "country", "lat", "lon")],
    )
    counts = keyed.groupBy("known", "name", "country", "lat", "lon").agg(F.count(F.lit(1)).alias("count"))
    return first_of(counts, ["known"], limit).drop("known")


def first_of(counts: DataFrame, group: list, limit: int | None) -> DataFrame:
    """The ``limit`` most frequent rows of each group; the rank limit runs in every task first."""
    if limit is None:
        return counts
    order = [F.desc("count"), F.asc("name"), F.asc("country"), F.asc("lat"), F.asc("lon")]
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def facet_decade(episodes: DataFrame) -> DataFrame:
    return (
        episodes.groupBy(decade(representative_year()).alias("decade"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("decade"))
    )


def facets_all(episodes: DataFrame, location_limit: int | None = MAX_LOCATIONS) -> DataFrame:
    """Total, types, locations and decades in one scan by grouping sets.

    Output ``facet`` is total | type | location | unknown_location | decade.
    """
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    base = episodes.select(
        F.coalesce("incident_type", F.lit("other")).alias("incident_type"),
        known.alias("known"),
        *[F.when(known, F.col(c)).alias(c) for c in ("name", "country", "lat", "lon")],
        decade(representative_year()).alias("decade"),
    )
    place = ["known", "name", "country", "lat", "lon"]
    keys = [F.col(c) for c in ("incident_type", *place, "decade")]
    sets = [[], [keys[0]], keys[1:6], [keys[6]]]
    grouped = base.groupingSets(sets, *keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.grouping("incident_type").alias("g_type"),
        F.grouping("known").alias("g_place"),
        F.grouping("decade").alias("g_decade"),
    )
    facet = (
        F.when(F.col("g_type") == 0, "type")
        .when(F.col("g_decade") == 0, "decade")
        .when(F.col("g_place") == 1, "total")
        .when(F.col("known"), "location")
        .otherwise("unknown_location")
    )
    flat = grouped.select(facet.alias("facet"), "incident_type", *place[1:], "decade", "count")
    # every other row is alone in its group, so one rank limit serves all facets
    alone = F.when(F.col("facet") != "location", F.concat_ws(" ", "incident_type", F.col("decade").cast("string")))
    return first_of(flat, ["facet", alone], location_limit)


def meta_bounds(episodes: DataFrame) -> DataFrame:
    """(kind, value, min_date, max_date): one row ``all``, one per incident type, one per podcast.

    Each has its first and last publication day; the distinct values are rows, so a store with many
    podcasts fills no single cell.  One scan by grouping sets.
    """
    keys = [F.col("incident_type"), F.col("podcast_id")]
    grouped = episodes.select("incident_type", "podcast_id", "published_at").groupingSets([[], keys[:1], keys[1:]], *keys)
    rows = grouped.agg(
        F.min("published_at").cast("date").alias("min_date"), F.max("published_at").cast("date").alias("max_date"),
        F.grouping("incident_type").alias("_t"), F.grouping("podcast_id").alias("_p"),
    )
    kind = F.when(F.col("_t") == 0, "incident_type").when(F.col("_p") == 0, "podcast").otherwise("all")
    out = rows.select(kind.alias("kind"), F.coalesce("incident_type", "podcast_id").alias("value"), "min_date", "max_date")
    return out.filter("kind = 'all' OR value IS NOT NULL")


def year_bounds(spans: DataFrame, *keys: str) -> DataFrame:
    """Lowest and highest span year per key (or overall); NULL without a usable span."""
    return (
        span_years(spans)
        .groupBy(*keys)
        .agg(F.min("lo").alias("min_year"), F.max("hi").alias("max_year"))
    )


def coverage_density(spans: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """Per year of the window: covering spans and their mean length in years; empty years stay.

    Each span adds at its first year and takes off after its last, so the data is reduced to two
    rows per distinct year in the map side; the running sum sees one row per year.
    """
    clipped = (
        span_years(spans)
        .filter((F.col("hi") >= min_year) & (F.col("lo") <= max_year))
        .select(
            F.greatest("lo", F.lit(min_year)).alias("first"),
            F.least("hi", F.lit(max_year)).alias("last"),
            (F.col("hi") - F.col("lo") + 1).cast("bigint").alias("length"),
        )
    )
    steps = (
        clipped.select(
            F.inline(
                F.array(
                    F.struct(F.col("first").alias("year"), F.lit(1).alias("n"), F.col("length").alias("len")),
                    F.struct((F.col("last") + 1).alias("year"), F.lit(-1).alias("n"), (-F.col("length")).alias("len")),
                )
            )
        )
        .groupBy("year")
        .agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
    )
    spark = spans.sparkSession
    spine = spark.range(min_year, max_year + 1).select(F.col("id").cast("int").alias("year"))
    running = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    dense = (
        spine.join(steps, "year", "left")
        .withColumn("count", F.sum(F.coalesce("n", F.lit(0))).over(running))
        .withColumn("total", F.sum(F.coalesce("len", F.lit(0))).over(running))
    )
    avg = F.when(F.col("count") > 0, F.col("total") / F.col("count")).otherwise(0.0)
    return dense.select("year", F.col("count").cast("bigint"), avg.alias("avg_duration"))


def window_average(density: DataFrame, low: int, high: int) -> DataFrame:
    """Mean of the yearly means over the non-empty years of a window, 0 when there are none."""
    used = density.filter(F.col("year").between(low, high) & (F.col("count") > 0))
    return used.agg(F.coalesce(F.avg("avg_duration"), F.lit(0.0)).alias("overall_avg"))


def category_counts(episodes: DataFrame) -> DataFrame:
    """Episodes per type; empty and missing types count as ``other``."""
    kind = F.coalesce(F.nullif("incident_type", F.lit("")), F.lit("other"))
    return episodes.groupBy(kind.alias("incident_type")).agg(F.count(F.lit(1)).alias("count"))


def type_profile(name: str, df: DataFrame, column: str = "incident_type") -> DataFrame:
    """Row count of one table for each type; a missing type counts as ``other``."""
    kind = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("other")).alias("type")
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "type", "row_count")


def table_profile(name: str, df: DataFrame, date_column: str | None = None) -> DataFrame:
    """Row count and date bounds of one table."""
    if date_column:
        low, high = F.min(date_column).cast("string"), F.max(date_column).cast("string")
    else:
        low = high = F.lit(None).cast("string")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), low.alias("min_date"), high.alias("max_date")
    ).select(F.lit(name).alias("table_name"), "row_count", "min_date", "max_date")
