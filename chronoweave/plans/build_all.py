"""Feed items to the full set of extraction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import episode_kind, link_type, narrator, trimmed_links
from ..functions.columns import stable_id
from ..functions.text import clean_description, segments
from ..operators.clusters import cluster_membership, cluster_points, cluster_table, join_best, kmeans
from ..operators.keyphrases import keyphrases, keyword_bridge, keyword_dimension
from ..operators.metrics import cluster_entities, cluster_keywords
from ..operators.mutations import new_by_guid
from ..operators.people import extract_entities
from ..operators.places import first_place, geocode, place_dimension
from ..operators.relational import top_n
from ..operators.spans import best_span, extract_spans, span_array
from ..session import cut_lineage
from ..sources.gazetteers import alias_dictionary


def new_episodes(items: DataFrame, known: DataFrame, limit: int = 0) -> DataFrame:
    """Items with an unseen guid, typed and cleaned; ``limit`` counts new episodes per feed.

    ``items(podcast_id, item_pos, guid, title, page_url, pub_date, author, description_raw)``.
    """
    fresh = new_by_guid(items, known, ["podcast_id", "item_pos"])
    if limit:
        fresh = top_n(fresh, ["podcast_id"], [F.asc("item_pos")], limit, "_r").drop("_r")
    return (
        fresh.withColumn("episode_id", stable_id("guid"))
        .withColumn("kind", episode_kind(F.col("title")))
        .withColumn("description_pure", clean_description(F.col("description_raw")))
        .withColumn("narrator", narrator(F.col("author"), F.col("description_pure")))
    )


def episode_links(episodes: DataFrame) -> DataFrame:
    urls = episodes.select(
        "episode_id", "page_url", F.posexplode(trimmed_links(F.col("description_raw"))).alias("link_pos", "url")
    )
    return urls.select("episode_id", "link_pos", "url", link_type(F.col("url"), F.col("page_url")).alias("link_type"))


def extraction_tables(episodes: DataFrame, gazetteer: DataFrame) -> dict[str, DataFrame]:
    """Segments, spans, places, entities and keywords of cleaned episodes.

    Segments are cut once and written with their spans in the row, so a segment's text is stored once
    and not beside each of its spans; places are looked up once.
    """
    keys = ["episode_id", "seg_pos"]
    cut = episodes.select(
        "episode_id", F.posexplode(segments(F.col("description_pure"))).alias("seg_pos", "s")
    ).select("episode_id", "seg_pos", "s.section", "s.text")
    segs = cut_lineage(cut.withColumn("spans", span_array(F.col("text"), F.col("section"))))
    span_id = stable_id("episode_id", "seg_pos", "span_pos")
    places = geocode(segs, keys, alias_dictionary(gazetteer)).withColumn(
        "place_id", stable_id("episode_id", "seg_pos", "canonical_name")
    )
    places = cut_lineage(places)
    main = segs.filter("section = 'main'").withColumn("segment", F.struct("episode_id", "seg_pos"))
    scored = keyphrases(main.select("segment", "text"), "segment").select(
        "segment.episode_id", "segment.seg_pos", "phrase", "score"
    )
    bridge = keyword_bridge(scored, "episode_id", "seg_pos")
    return {
        "segments": segs.drop("spans"),
        "time_spans": extract_spans(segs, keys, found="spans").withColumn("span_id", span_id),
        "best_spans": extract_spans(segs, keys, best_only=True, found="spans").withColumn("span_id", span_id),
        "places": places,
        "places_norm": place_dimension(places, ["episode_id", "seg_pos", "pos"]),
        "entities": extract_entities(segs, keys),
        "episode_keywords": bridge,
        "keywords": keyword_dimension(bridge),
    }


def build_all(
    items: DataFrame, gazetteer: DataFrame, known: DataFrame, limit: int = 0, clusters: bool = True
) -> dict[str, DataFrame]:
    """All tables of a feed build.  Episodes are materialised once and feed every branch."""
    episodes = cut_lineage(new_episodes(items, known, limit))
    tables = extraction_tables(episodes, gazetteer)
    # only what decides the best one is moved, not the segments' texts or their other spans
    rated = tables.pop("best_spans").select("episode_id", "seg_pos", "span_pos", "span_id", "score")
    placed = tables["places"].select("episode_id", "seg_pos", "pos", "place_id")
    best_s = best_span(rated, "episode_id", ["seg_pos", "span_pos"]).select(
        "episode_id", F.col("span_id").alias("best_span_id")
    )
    best_p = first_place(placed, "episode_id", ["seg_pos", "pos"]).select(
        "episode_id", F.col("place_id").alias("best_place_id")
    )
    tables["episodes"] = episodes.join(best_s, "episode_id", "left").join(best_p, "episode_id", "left")
    tables["links"] = episode_links(episodes)
    if clusters:
        tables |= recompute_clusters(tables)
    return tables


def recompute_clusters(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four cluster tables, computed anew from the current episodes."""
    best = join_best(tables["episodes"], tables["time_spans"], tables["places"])
    assigned = cut_lineage(kmeans(cluster_points(best)))
    membership = cluster_membership(assigned)
    return {
        "clusters": cluster_table(assigned),
        "episode_clusters": membership,
        "cluster_keywords": cluster_keywords(membership, tables["episode_keywords"]),
        "cluster_entities": cluster_entities(membership, tables["entities"]),
    }
