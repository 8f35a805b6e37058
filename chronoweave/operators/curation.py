"""Curated deletes of time spans with their dependent rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass
class CurationResult:
    spans: DataFrame
    span_entity: DataFrame | None
    span_place: DataFrame | None
    episodes: DataFrame
    decisions: DataFrame
    report: DataFrame


def delete_episode_spans(
    requests: DataFrame,
    keep: DataFrame,
    spans: DataFrame,
    episodes: DataFrame,
    span_entity: DataFrame | None = None,
    span_place: DataFrame | None = None,
) -> CurationResult:
    """Delete all spans of the requested episodes except the kept ones, for many episodes at once.

    ``requests(episode_id)``, ``keep(episode_id, span_id)``.  Link rows of deleted spans go, and a
    deleted best span is cleared.  ``decisions`` lists every span id as kept, deleted or missing;
    ``report`` has one row of counts per request.
    """
    asked = requests.select("episode_id").distinct()
    wanted = keep.select("episode_id", "span_id").distinct().withColumn("asked", F.lit(True))
    present = (
        spans.join(asked, "episode_id", "left_semi")
        .select("episode_id", "span_id")
        .withColumn("here", F.lit(True))
    )
    state = F.when(F.col("here").isNull(), "missing").when(F.col("asked"), "kept").otherwise("deleted")
    decisions = present.join(wanted, ["episode_id", "span_id"], "full").select(
        "episode_id", "span_id", state.alias("state")
    )
    gone = decisions.filter("state = 'deleted'").select("episode_id", "span_id")
    gone = cut_lineage(gone)
    gone_ids = gone.select("span_id")

    def purge(links):
        return None if links is None else links.join(gone_ids, "span_id", "left_anti").select(*links.columns)

    def removed(links, name):
        if links is None:
            return asked.select("episode_id", F.lit(0).cast("bigint").alias(name))
        return links.join(gone, "span_id").groupBy("episode_id").agg(F.count(F.lit(1)).alias(name))

    cleared = gone.select("episode_id", F.col("span_id").alias("best_span_id")).withColumn("cleared", F.lit(True))
    marked = episodes.join(cleared, ["episode_id", "best_span_id"], "left")
    new_best = F.when(F.col("cleared").isNull(), F.col("best_span_id"))
    counts = decisions.groupBy("episode_id").agg(
        F.count_if(F.col("state") == "deleted").alias("deleted_span_count"),
        F.count_if(F.col("state") == "kept").alias("kept_span_count"),
        F.count_if(F.col("state") == "missing").alias("missing_keep_count"),
    )
    report = asked.join(counts, "episode_id", "left")
    for links, name in ((span_entity, "deleted_span_entity_count"), (span_place, "deleted_span_place_count")):
        report = report.join(removed(links, name), "episode_id", "left")
    cleared_episodes = marked.filter("cleared").select("episode_id", F.lit(True).alias("best_span_cleared"))
    report = report.join(cleared_episodes, "episode_id", "left").fillna(0).fillna(False, ["best_span_cleared"])
    return CurationResult(
        spans.join(gone_ids, "span_id", "left_anti").select(*spans.columns),
        purge(span_entity),
        purge(span_place),
        marked.withColumn("best_span_id", new_best).select(*episodes.columns),
        decisions,
        report,
    )
