"""Episode- and cluster-level ranked views, timelines and term graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import mid_year_by_month, ordered_pair
from .relational import first_per, number_rows, top_n

TOP_SPANS, TOP_ENTITIES, TOP_KEYWORDS = 20, 40, 30


def timeline_points(spans: DataFrame, n: int, visible: tuple[float, float] | None, tie: list[str]) -> DataFrame:
    """Best ``n`` spans per episode with rank and midpoint, then cut to the visible range.

    The rank is given before the cut, so a hidden best span leaves rank 1 unused.
    """
    ranked = top_n(spans, ["episode_id"], [F.desc("score"), *tie], n)
    out = ranked.withColumn("mid_year", mid_year_by_month(F.col("start_date"), F.col("end_date")))
    out = out.filter("mid_year IS NOT NULL")
    return out.filter(F.col("mid_year").between(*visible)) if visible else out


def first_geocoded_place(places: DataFrame, order: list[str]) -> DataFrame:
    located = places.filter("lat IS NOT NULL AND lon IS NOT NULL")
    return first_per(located, ["episode_id"], order)


def episode_summary(
    spans: DataFrame, entities: DataFrame, span_tie: list[str], entity_tie: list[str],
    n_spans: int | None = TOP_SPANS, n_entities: int | None = TOP_ENTITIES,
) -> DataFrame:
    """Coverage years and mean score of the best spans, mean confidence of the best entities; None: of all."""
    best = spans if n_spans is None else top_n(spans, ["episode_id"], [F.desc("score"), *span_tie], n_spans)
    a, b = F.year("start_date"), F.year("end_date")
    cover = best.groupBy("episode_id").agg(
        F.min(F.least(a, b)).alias("cover_min"),
        F.max(F.greatest(a, b)).alias("cover_max"),
        F.avg("score").alias("avg_span_score"),
    )
    sure = entities if n_entities is None else top_n(entities, ["episode_id"], [F.desc("confidence"), *entity_tie], n_entities)
    trust = sure.groupBy("episode_id").agg(F.avg("confidence").alias("avg_entity_confidence"))
    return cover.join(trust, "episode_id", "full").select(
        "episode_id",
        "cover_min",
        "cover_max",
        F.coalesce("avg_span_score", F.lit(0.0)).alias("avg_span_score"),
        F.coalesce("avg_entity_confidence", F.lit(0.0)).alias("avg_entity_confidence"),
    )


def stack_rows(podcasts: DataFrame, episodes: DataFrame, spans: DataFrame, membership: DataFrame) -> DataFrame:
    """Episode x valid span rows; unknown podcasts drop out, episodes without spans stay.

    ``podcasts(podcast_id, podcast_title)``, ``episodes(episode_id, podcast_id, title, pub_date)``.
    """
    lo, hi = ordered_pair(F.col("start_date"), F.col("end_date"))
    usable = spans.filter("start_date IS NOT NULL AND end_date IS NOT NULL").select(
        "episode_id", "span_id", lo.alias("start_date"), hi.alias("end_date"), "score"
    )
    return (
        episodes.join(podcasts, "podcast_id")
        .join(membership, "episode_id", "left")
        .join(usable, "episode_id", "left")
    )


def stack_timeline(rows: DataFrame) -> DataFrame:
    """One row per episode with its ordered spans, sorted by podcast title and date.

    Spans nest inside their episode; podcasts stay a sort key, because one podcast may own a large
    share of all episodes.
    """
    span = F.struct("start_date", "end_date", "span_id", "score", "cluster_id")
    return (
        rows.groupBy("podcast_id", "podcast_title", "episode_id", "title", "pub_date")
        .agg(
            F.array_sort(
                F.filter(F.collect_list(span), lambda s: s["span_id"].isNotNull())
            ).alias("spans")
        )
        .orderBy("podcast_title", "pub_date", "episode_id")
    )


def stack_order(rows: DataFrame) -> DataFrame:
    """Spans by start inside each podcast: one range sort, no per-podcast task."""
    return rows.filter("span_id IS NOT NULL").orderBy("podcast_title", "start_date", "end_date", "span_id")


# Tie columns of the selectable orders.
TERM_ORDERS = {"tfidf": "lift", "lift": "tfidf", "drop_impact": "tfidf"}
CLUSTER_ORDERS = {
    "size": "cohesion",
    "cohesion": "n_members",
    "novelty": "cohesion",
    "spread": "n_members",
}


def ranked_terms(metrics: DataFrame, sort_by: str = "tfidf", n: int = 40, heaviest: int | None = 40) -> DataFrame:
    """Cluster terms by weight, lift or drop impact with a rank.

    The ``heaviest`` terms (None: all) are taken first; the chosen order then applies to those.
    """
    heavy = metrics
    if heaviest is not None:
        heavy = top_n(metrics, ["cluster_id"], [F.desc("tfidf"), "term"], heaviest, "_r").drop("_r")
    order = [F.desc(sort_by), F.desc(TERM_ORDERS[sort_by]), F.asc("term")]
    return top_n(heavy, ["cluster_id"], order, n)


def ranked_by_lift(stats: DataFrame, name: str, sort_by: str = "lift", n: int = 24) -> DataFrame:
    other = "count" if sort_by == "lift" else "lift"
    return top_n(stats, ["cluster_id"], [F.desc(sort_by), F.desc(other), F.asc(name)], n)


def cluster_index(clusters: DataFrame, stats: DataFrame, sort_by: str = "size") -> DataFrame:
    """Cluster list with cohesion, novelty and spread; zero where statistics are missing."""
    seen = stats.select(
        "cluster_id",
        "cohesion_proxy",
        F.coalesce("dominant_podcast_share", F.lit(1.0)).alias("share"),
        "temporal_span_years",
    )
    label = F.coalesce(
        F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    )
    rows = clusters.join(seen, "cluster_id", "left").select(
        "cluster_id",
        label.alias("label"),
        "n_members",
        F.coalesce("cohesion_proxy", F.lit(0.0)).alias("cohesion"),
        F.coalesce(F.round(1 - F.col("share"), 6), F.lit(0.0)).alias("novelty"),
        F.coalesce("temporal_span_years", F.lit(0)).alias("spread"),
    )
    first = "n_members" if sort_by == "size" else sort_by
    return rows.orderBy(F.desc(first), F.desc(CLUSTER_ORDERS[sort_by]), "cluster_id")


def cluster_list(clusters: DataFrame, podcast_id=None, n: int = 24) -> DataFrame:
    out = clusters if podcast_id is None else clusters.filter(F.col("podcast_id") == podcast_id)
    return out.orderBy(F.desc("n_members"), "cluster_id").limit(n)


def cluster_neighbors(correlations: DataFrame, n: int = 10) -> DataFrame:
    """Both directions of every pair, best ``n`` others per cluster."""
    value = ["jaccard", "cosine"]
    there = correlations.select(F.col("cluster_a").alias("cluster_id"), F.col("cluster_b").alias("other_id"), *value)
    back = correlations.select(F.col("cluster_b").alias("cluster_id"), F.col("cluster_a").alias("other_id"), *value)
    order = [F.desc("jaccard"), F.desc("cosine"), F.asc("other_id")]
    return top_n(there.unionByName(back), ["cluster_id"], order, n)


def cooccurrence_pairs(episode_terms: DataFrame, max_terms: int = 8) -> DataFrame:
    """Unordered term pairs per (group, episode).

    ``episode_terms(cluster_id, episode_id, term, pos)``: at most ``max_terms`` distinct terms per
    episode are used, in reading order, so an episode gives at most 28 pairs.
    """
    terms = (
        top_n(
            episode_terms.groupBy("cluster_id", "episode_id", "term").agg(F.min("pos").alias("pos")),
            ["cluster_id", "episode_id"],
            [F.asc("pos"), F.asc("term")],
            max_terms,
            "_r",
        )
        .groupBy("cluster_id", "episode_id")
        .agg(F.array_sort(F.collect_list("term")).alias("terms"))
    )

    def pairs(ts: Column) -> Column:
        return F.flatten(
            F.transform(
                ts,
                lambda a: F.transform(
                    F.filter(ts, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))
                ),
            )
        )

    return terms.select("cluster_id", "episode_id", F.explode(pairs(F.col("terms"))).alias("p")).select(
        "cluster_id", "episode_id", "p.a", "p.b"
    )


def term_graph(sorted_terms: DataFrame, episode_terms: DataFrame, nodes: int = 10, edges: int = 20) -> DataFrame:
    """Weighted edges between the first ``nodes`` terms of every cluster, best ``edges`` each.

    ``sorted_terms(cluster_id, term, rank)``; terms are compared in lower case.
    """
    node = (
        sorted_terms.filter(F.col("rank") <= nodes)
        .select("cluster_id", F.lower("term").alias("term"))
        .distinct()
    )
    used = episode_terms.withColumn("term", F.lower("term")).join(node, ["cluster_id", "term"])
    counted = cooccurrence_pairs(used).groupBy("cluster_id", "a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return top_n(counted, ["cluster_id"], [F.desc("weight"), "a", "b"], edges)


def podcast_series(episodes: DataFrame) -> DataFrame:
    """Type series with the zero-based position of the podcast in id order."""
    index = number_rows(episodes.select("podcast_id").distinct(), ["podcast_id"], "podcast_index", 0)
    kind = F.coalesce(F.nullif("incident_type", F.lit("")), F.lit("other"))
    return episodes.withColumn("incident_type", kind).join(index, "podcast_id")


def concept_drilldown(bridge: DataFrame, concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims reachable from an episode through its linked concepts."""
    known = concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept_name"))
    return bridge.join(known, "concept_id").join(claims, "concept_id").select(
        "episode_id", "concept_id", "concept_name", "property", "value"
    )
