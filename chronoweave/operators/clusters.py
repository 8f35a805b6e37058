"""Deterministic k-means of every group at once over (year, latitude, longitude).

Points of a group that share their scaled coordinates move together, so the rounds run over spots: one
materialised row per group and place with the number of its points.  One row of at most 16 centroids
per group is joined to them, the nearest one is found inside the row, and only partial sums are
shuffled, so a group with a third of all points is no bottleneck.  The points themselves are read once
more for the seeds and once for their last assignment; they are neither sorted nor written.

A full round writes every spot with its cluster and its gap, the distance to the second nearest
centroid less that to the nearest.  While no centroid of its group has moved by half the gap since, a
spot can't change sides; later rounds read only the others and correct the sums of the full round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..functions.columns import stable_id
from ..functions.dates import mid_year
from ..functions.numeric import cluster_count, unit_scale
from ..session import cut_lineage
from .relational import number_rows, running_total

MIN_POINTS = 4
MAX_ITERATIONS = 25
# Distances and means are rounded, so results do not depend on the order of floating sums.
DIGITS = 12
# A gap this much wider than needed still counts as crossed.
MARGIN = 1e-5
# All points are written again when, this many rounds or more after the last time, more than this
# share of them would have to be read.
FULL_EVERY, FULL_SHARE = 3, 0.4
AXES = ("mid_year", "lat", "lon")
SCALED = tuple(f"s_{a}" for a in AXES)


def join_best(episodes: DataFrame, spans: DataFrame, places: DataFrame) -> DataFrame:
    """Episodes with their best span and best place; incomplete ones drop out.

    Spans and places that name their episode, whose own they must be, are met by episode.
    """
    s = spans.filter("start_date IS NOT NULL AND end_date IS NOT NULL")
    p = places.filter("lat IS NOT NULL AND lon IS NOT NULL")
    found = _looked_up(episodes, s, "best_span_id", "span_id", ["start_date", "end_date"])
    return _looked_up(found, p, "best_place_id", "place_id", ["lat", "lon"])


def _looked_up(episodes: DataFrame, rows: DataFrame, best: str, key: str, values: list[str]) -> DataFrame:
    if "episode_id" not in rows.columns:
        return episodes.join(rows.select(F.col(key).alias(best), *values), best)
    met = episodes.join(rows.select("episode_id", F.col(key).alias("_id"), *values), "episode_id")
    # an equi join on the id too would move all rows once more; a range of one id leaves them by episode
    return met.where(F.col("_id").between(F.col(best), F.col(best))).drop("_id")


def cluster_points(best: DataFrame) -> DataFrame:
    """(podcast_id, episode_id, mid_year, lat, lon) of podcasts with at least four points."""
    points = best.select(
        "podcast_id", "episode_id", mid_year(F.col("start_date"), F.col("end_date")).alias("mid_year"), "lat", "lon"
    ).filter("mid_year IS NOT NULL")
    points = cut_lineage(points)
    enough = points.groupBy("podcast_id").count().filter(F.col("count") >= MIN_POINTS).select("podcast_id")
    return points.join(enough, "podcast_id", "left_semi")


def scale_points(points: DataFrame) -> DataFrame:
    """Adds scaled axes, group size ``n`` and cluster count ``k``."""
    bounds = cut_lineage(
        points.groupBy("podcast_id").agg(
            F.count(F.lit(1)).alias("n"),
            *[f(a).alias(f"{a}_{tag}") for a in AXES for f, tag in ((F.min, "lo"), (F.max, "hi"))],
        )
    )
    k = F.least(cluster_count(F.col("n")), F.col("n").cast("int"))
    scaled = [
        F.round(unit_scale(F.col(a), F.col(f"{a}_lo"), F.col(f"{a}_hi")), DIGITS).alias(f"s_{a}") for a in AXES
    ]
    return points.join(bounds, "podcast_id").select(
        *points.columns, "n", k.alias("k"), *scaled
    )


def spots_of(scaled: DataFrame) -> DataFrame:
    """(podcast_id, n, k, scaled axes, w): the places of a group's points and the number of points there."""
    return scaled.groupBy("podcast_id", "n", "k", *SCALED).agg(F.count(F.lit(1)).alias("w"))


def _arrays(seeds: DataFrame) -> DataFrame:
    """One array of centroids per group of (podcast_id, j, scaled axes)."""
    vector = F.struct(*[F.col(f"s_{a}").alias(a) for a in AXES])
    return (
        seeds.groupBy("podcast_id")
        .agg(F.array_sort(F.collect_list(F.struct("j", vector.alias("v")))).alias("seeds"))
        .select("podcast_id", F.transform("seeds", lambda s: s["v"]).alias("centroids"))
    )


def _seed_ranks(n: str, k: str) -> str:
    """SQL text: (j, rank) of the seeds among a group's points in year order."""
    step = f"({n} - 1) / greatest(1, {k} - 1)"
    return f"transform(sequence(0, {k} - 1), j -> named_struct('j', j, 'rank', bigint(rint(j * {step}))))"


def seed_centroids(numbered: DataFrame) -> DataFrame:
    """Evenly spaced points in year order, one array of centroids per group."""
    groups = numbered.groupBy("podcast_id").agg(
        F.min("row_no").alias("first_no"), F.first("n").alias("n"), F.first("k").alias("k")
    )
    seeds = groups.selectExpr("first_no", f"inline({_seed_ranks('n', 'k')})").selectExpr("j", "first_no + rank AS row_no")
    return _arrays(numbered.join(seeds, "row_no"))


def seed_spots(scaled: DataFrame, spots: DataFrame) -> DataFrame:
    """The centroids of ``seed_centroids``.  Running numbers of points by year tell which years hold a
    seed; only the points of those years are numbered."""
    years = spots.groupBy("podcast_id", "n", "k", "s_mid_year").agg(F.sum("w").alias("w"))
    years = cut_lineage(running_total(years, ["podcast_id", "s_mid_year"], "w", "before"))
    starts = years.groupBy("podcast_id").agg(F.min("before").alias("start"))
    held = years.join(starts, "podcast_id").withColumn("before", F.col("before") - F.col("start"))
    here = f"filter({_seed_ranks('n', 'k')}, x -> before <= x.rank AND x.rank < before + w)"
    seeds = held.selectExpr("podcast_id", "s_mid_year", "before", f"inline({here})")
    seeds = cut_lineage(seeds.select("podcast_id", "s_mid_year", "j", (F.col("rank") - F.col("before")).alias("place")))
    year = ["podcast_id", "s_mid_year"]
    near = scaled.select("podcast_id", *SCALED, "episode_id").join(seeds.select(*year).distinct(), year, "left_semi")
    numbered = number_rows(near, [*year, "episode_id"])
    firsts = numbered.groupBy(*year).agg(F.min("row_no").alias("first_no"))
    wanted = seeds.join(firsts, year).select("j", (F.col("first_no") + F.col("place")).alias("row_no"))
    return _arrays(numbered.join(wanted, "row_no"))


def with_nearest(rows: DataFrame, to: str = "j", gap: str | None = None) -> DataFrame:
    """Index of the nearest of ``centroids``, the lowest on ties, instead of that column, and on request
    the gap, the distance to the second nearest less that to the nearest.

    Squared distances are in units of the last kept digit.  They are taken for an Arrow batch at once,
    in a fraction of the time of a lambda over every row's array.
    """
    kept = [c for c in rows.columns if c not in ("centroids", to)]
    schema = StructType([rows.schema[c] for c in kept]).add(to, IntegerType())
    if gap:
        schema = schema.add(gap, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, second = nearest_two(
                [batch.column(a).to_numpy(zero_copy_only=False) for a in SCALED], batch.column("centroids")
            )
            made = [pa.array(near[0], pa.int32())]
            if gap:
                made.append(pa.array((np.sqrt(second) - np.sqrt(near[1])) / 10.0 ** (DIGITS // 2)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], schema.names)

    return rows.select(*kept, "centroids").mapInArrow(run, schema)


def nearest_two(axes: list[np.ndarray], centroids: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(index, squared distance) of each row's nearest centroid, and the second least squared distance."""
    ends = centroids.offsets.to_numpy()
    flat, first, size = centroids.flatten(), ends[:-1] - ends[0], np.diff(ends)
    slot = np.arange(max(2, size.max()))
    at = np.minimum(first[:, None] + slot, len(flat) - 1)
    square = np.zeros(at.shape)
    for name, values in zip(AXES, axes, strict=True):
        away = values[:, None] - flat.field(name).to_numpy(zero_copy_only=False)[at]
        square += away * away
    square = np.where(slot < size[:, None], np.rint(square * 10.0**DIGITS), np.inf)
    near = square.argmin(axis=1)
    row = np.arange(len(near))
    least = square[row, near]
    square[row, near] = np.inf
    return (near, least), square.min(axis=1)


def kmeans_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Next centroids and whether they moved; a centroid without points stays where it is."""
    old = centroids.select("podcast_id", "centroids")
    means = (
        with_nearest(points.select("podcast_id", *SCALED).join(old, "podcast_id"))
        .groupBy("podcast_id", "j")
        .agg(*[F.round(F.avg(f"s_{a}"), DIGITS).alias(a) for a in AXES])
        .groupBy("podcast_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct(*AXES)))).alias("means"))
        .join(old.withColumnRenamed("centroids", "old"), "podcast_id")
    )
    moved = F.transform("old", lambda c, i: F.coalesce(F.try_element_at("means", i), c))
    out = means.select("podcast_id", "old", moved.alias("centroids"))
    return out.select("podcast_id", "centroids", (F.col("centroids") != F.col("old")).alias("moved"))


def _weight(rows: DataFrame) -> str:
    """Number of points of a row."""
    return "w" if "w" in rows.columns else "1"


def _sums(rows: DataFrame, weight: str) -> DataFrame:
    """(podcast_id, sums): number and exact coordinate sums by cluster, in units of the last digit.

    Two sums of longs, high and low digits, can't overflow and are far cheaper than sums of decimals.
    """
    half = 10 ** (DIGITS // 2)
    whole = [f"bigint(round(s_{a} * 1e{DIGITS}))" for a in AXES]
    parts = rows.groupBy("podcast_id", "j").agg(
        F.expr(f"sum(bigint({weight}))").alias("n"),
        *[F.expr(f"sum({weight} * ({v} {op} {half}))").alias(f"{tag}_{a}") for v, a in zip(whole, AXES, strict=True) for op, tag in (("div", "high"), ("%", "low"))],
    )
    joined = ", ".join(f"'{a}', CAST(CAST(high_{a} AS DECIMAL(20, 0)) * {half} + low_{a} AS DECIMAL(30, 0))" for a in AXES)
    return parts.groupBy("podcast_id").agg(F.expr(f"map_from_entries(collect_list(struct(j, named_struct('n', n, {joined}))))").alias("sums"))


def _moved(state: DataFrame) -> DataFrame:
    """Next centroids of ``state`` (podcast_id, base, sums, change, centroids), with ``drift``, the
    farthest that one is from its base now, and ``moved``.  Without points a centroid stays."""

    def total(x: str) -> str:
        return f"(coalesce(try_element_at(sums, i).{x}, 0) + coalesce(try_element_at(change, i).{x}, 0))"

    means = ", ".join(f"'{a}', round(double({total(a)}) / {total('n')} / 1e{DIGITS}, {DIGITS})" for a in AXES)
    then = F.expr(f"transform(centroids, (c, i) -> IF({total('n')} > 0, named_struct({means}), c))")
    square = " + ".join(f"power(x.{a} - y.{a}, 2)" for a in AXES)
    drift = F.expr(f"sqrt(array_max(zip_with(next, base, (x, y) -> {square})))")
    return state.withColumn("next", then).select(
        "podcast_id", "base", "sums", F.col("next").alias("centroids"), drift.alias("drift"), F.expr("next <> centroids").alias("moved")
    )


def full_round(points: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All points or spots with their cluster and gap, and the groups' state after their centroids moved."""
    near = points.join(centroids.select("podcast_id", "centroids"), "podcast_id")
    placed = cut_lineage(with_nearest(near, "j", "gap"))
    state = centroids.select("podcast_id", F.col("centroids").alias("base"), "centroids").join(_sums(placed, _weight(placed)), "podcast_id")
    return placed, _moved(state.withColumn("change", F.create_map().cast(state.schema["sums"].dataType)))


def _restless(placed: DataFrame, state: DataFrame) -> DataFrame:
    """Points that may have changed sides since the full round, of groups that still move."""
    moving = state.where("moved").select("podcast_id", "centroids", "drift")
    # rounding of distances counts for less than the margin
    return placed.join(moving, "podcast_id").where(F.col("gap") <= 2 * F.col("drift") + MARGIN)


def next_round(placed: DataFrame, state: DataFrame) -> DataFrame:
    """State after one more round, from the points that may have changed sides."""
    weight = _weight(placed)
    near = with_nearest(_restless(placed, state), "to")
    sides = F.expr(f"array(struct(to AS j, bigint({weight}) AS v), struct(j, -bigint({weight}) AS v))")
    changed = near.where("to <> j").select("podcast_id", *SCALED, F.explode(sides).alias("side"))
    change = _sums(changed.select("podcast_id", *SCALED, "side.j", "side.v"), "v")
    going = _moved(state.where("moved").join(change.withColumnRenamed("sums", "change"), "podcast_id", "left"))
    return going.unionByName(state.where("NOT moved"))


def kmeans(points: DataFrame, iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Points with their cluster index ``j`` and label ``C1..Ck``.

    Unchanged centroids mean that no assignment can change any more, which ends the loop.  A round
    writes one row a group; all spots are written again only when most had to be read for a while.
    """
    scaled = scale_points(points)
    spots = cut_lineage(spots_of(scaled))
    placed, state = None, cut_lineage(seed_spots(scaled, spots))
    # every round reads these rows, so they are spread over as many tasks as the cluster shuffles with
    spots = cut_lineage(spots.drop("n", "k").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total, since = 0, 0
    for _ in range(iterations - 1):
        if placed is None or (since >= FULL_EVERY and _restless(placed, state).count() > total * FULL_SHARE):
            placed, state = full_round(spots, state)
            total, since = total or placed.count(), 0
        else:
            state, since = next_round(placed, state), since + 1
        state = cut_lineage(state)
        if state.where("moved").isEmpty():
            break
    # the last centroids decide for the points, which are read once here
    last = scaled.join(state.select("podcast_id", "centroids"), "podcast_id")
    return _labelled(with_nearest(last).select(*points.columns, "k", "j"))


def _labelled(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("label", F.concat(F.lit("C"), (F.col("j") + 1).cast("string")))


def cluster_table(assigned: DataFrame) -> DataFrame:
    """One row per cluster with the centroid in original units, zeros for an empty cluster."""
    groups = assigned.groupBy("podcast_id").agg(F.first("k").alias("k"))
    slots = groups.select("podcast_id", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    means = assigned.groupBy("podcast_id", "j").agg(
        *[F.avg(a).alias(f"centroid_{a}") for a in AXES], F.count(F.lit(1)).alias("n_members")
    )
    zero = {f"centroid_{a}": 0.0 for a in AXES} | {"n_members": 0}
    return slots.join(means, ["podcast_id", "j"], "left").fillna(zero).select(
        stable_id("podcast_id", "j").alias("cluster_id"),
        "podcast_id",
        "k",
        "j",
        F.concat(F.lit("C"), (F.col("j") + 1).cast("string")).alias("label"),
        *[f"centroid_{a}" for a in AXES],
        "n_members",
    )


def cluster_membership(assigned: DataFrame) -> DataFrame:
    return assigned.select("episode_id", stable_id("podcast_id", "j").alias("cluster_id"))
