"""Cluster analytics: statistics, histograms, lifts, similarities and suggestions.

Facts are reduced per episode before they meet the membership table where that makes them fewer.
Facts that are counted by name or year meet it as they are and are counted in the join's own tasks: a
count per episode and name hardly has fewer rows, and would be moved once more to the join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..session import cut_lineage
from .relational import salted_pairs, top_n
from .similarity import top_similar

TOP_TERMS, TOP_NAMES, BRIDGE_TERMS = 25, 50, 5
DIGITS = 6


@dataclass
class ClusterInputs:
    """``membership(cluster_id, episode_id)``, ``episodes(episode_id, podcast_id, pub_date)``,
    ``spans(episode_id, start_date, end_date, score)``, ``places(episode_id, canonical_name, lat,
    lon, pos)``, ``entities(episode_id, name, kind)``, ``keywords(episode_id, phrase, score)``."""

    membership: DataFrame
    episodes: DataFrame
    spans: DataFrame
    places: DataFrame
    entities: DataFrame
    keywords: DataFrame


def total_rows(df: DataFrame):
    """Row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def member_counts(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"))


def cluster_keywords(membership: DataFrame, keywords: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """Top phrases per cluster by summed score; ties in phrase order."""
    summed = (
        membership.join(keywords, "episode_id")
        .groupBy("cluster_id", "phrase")
        .agg(F.round(F.sum("score"), DIGITS).alias("score"))
    )
    return top_n(summed, ["cluster_id"], [F.desc("score"), F.asc("phrase")], n)


def cluster_entities(membership: DataFrame, entities: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    counted = _counts(membership, entities, ["name", "kind"])
    return top_n(counted, ["cluster_id"], [F.desc("count"), F.asc("name"), F.asc("kind")], n)


def member_facts(membership: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """How often each fact occurs in the episodes of a cluster."""
    return facts.join(membership, "episode_id").groupBy("cluster_id", *names).agg(F.count(F.lit(1)).alias("n"))


def _counts(membership: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    return member_facts(membership, facts.select("episode_id", *names), *names).withColumnRenamed("n", "count")


def term_vectors(membership: DataFrame, keywords: DataFrame) -> DataFrame:
    return cluster_keywords(membership, keywords).select("cluster_id", F.col("phrase").alias("term"), F.col("score").alias("weight"))


def cluster_stats(x: ClusterInputs, vectors: DataFrame) -> DataFrame:
    by_year = (
        x.membership.join(x.episodes, "episode_id")
        .groupBy("cluster_id", "podcast_id", F.year("pub_date").alias("pub_year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shares = (
        by_year.groupBy("cluster_id", "podcast_id")
        .agg(F.sum("n").alias("n"))
        .groupBy("cluster_id")
        .agg(
            F.sum("n").alias("episode_count"),
            F.count(F.lit(1)).alias("unique_podcast_count"),
            F.max("n").alias("largest"),
        )
    )
    median = (
        by_year.filter("pub_year IS NOT NULL")
        .groupBy("cluster_id")
        .agg(F.percentile("pub_year", 0.5, F.col("n")).cast("int").alias("median_pub_year"))
    )
    a, b = F.year("start_date"), F.year("end_date")
    episode_spans = x.spans.groupBy("episode_id").agg(
        F.min(F.least(a, b)).alias("lo"),
        F.max(F.greatest(a, b)).alias("hi"),
        F.sum("score").alias("score"),
        F.count("score").alias("n"),
    )
    spans = (
        x.membership.join(episode_spans, "episode_id")
        .groupBy("cluster_id")
        .agg(
            (F.max("hi") - F.min("lo")).alias("temporal_span_years"),
            F.round(F.sum("score") / F.sum("n"), DIGITS).alias("mean_span_confidence"),
        )
    )
    n_lat, n_lon = F.count("lat"), F.count("lon")
    spread = (F.stddev_pop("lat") + F.stddev_pop("lon")) / 2
    places = (
        x.membership.join(x.places, "episode_id")
        .groupBy("cluster_id")
        .agg(F.round(F.when((n_lat > 0) & (n_lat == n_lon), spread), DIGITS).alias("geo_dispersion"))
    )
    total = F.sum("weight")
    cohesion = vectors.groupBy("cluster_id").agg(
        F.round(F.when(total > 0, F.max("weight") / total), DIGITS).alias("cohesion_proxy")
    )
    out = shares
    for part in (median, spans, places, cohesion):
        out = out.join(part, "cluster_id", "left")
    return out.select(
        "cluster_id",
        F.col("episode_count").cast("bigint"),
        "unique_podcast_count",
        F.round(safe_div(F.col("largest"), F.col("episode_count")), DIGITS).alias("dominant_podcast_share"),
        "median_pub_year",
        "temporal_span_years",
        "mean_span_confidence",
        "geo_dispersion",
        "cohesion_proxy",
    )


def timeline_histogram(membership: DataFrame, spans: DataFrame) -> DataFrame:
    """Ten-year bins over all start and end years; negative years round down."""
    years = F.explode(F.array(F.year("start_date"), F.year("end_date"))).alias("year")
    # the join moves a span once, with both of its dates
    return (
        spans.select("episode_id", "start_date", "end_date")
        .join(membership, "episode_id")
        .select("cluster_id", years)
        .filter("year IS NOT NULL")
        .groupBy("cluster_id", (F.floor(F.col("year") / 10) * 10).cast("int").alias("start_year"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("cluster_id", "start_year", (F.col("start_year") + 9).alias("end_year"), "count")
    )


def term_support(keywords: DataFrame) -> DataFrame:
    """Distinct episodes per phrase."""
    return (
        keywords.select("episode_id", "phrase")
        .distinct()
        .groupBy("phrase")
        .agg(F.count(F.lit(1)).alias("support"))
    )


def term_metrics(x: ClusterInputs, vectors: DataFrame) -> DataFrame:
    """Support, lift and drop impact of each cluster's top terms."""
    uses = x.keywords.select("episode_id", F.col("phrase").alias("term")).distinct()
    support = x.membership.join(uses, "episode_id").groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("support"))
    everywhere = term_support(x.keywords).select(F.col("phrase").alias("term"), F.col("support").alias("global_support"))
    known = x.membership.join(x.episodes.select("episode_id"), "episode_id", "left_semi")
    sizes = member_counts(known).withColumnRenamed("n_members", "episode_count")
    total = F.greatest(F.lit(1), total_rows(x.episodes))
    rows = (
        vectors.join(support, ["cluster_id", "term"], "left")
        .join(everywhere, "term", "left")
        .join(sizes, "cluster_id", "left")
        .withColumn("total", total)
        .fillna(0, ["support", "global_support", "episode_count"])
    )
    cluster_rate = safe_div(F.col("support"), F.col("episode_count"))
    global_rate = safe_div(F.col("global_support"), F.col("total"))
    lift = safe_div(cluster_rate, global_rate)
    return rows.select(
        "cluster_id",
        "term",
        F.round("weight", DIGITS).alias("tfidf"),
        "support",
        "global_support",
        F.round(lift, DIGITS).alias("lift"),
        F.round(F.abs("weight") * lift, DIGITS).alias("drop_impact"),
    )


def _lift(membership: DataFrame, facts: DataFrame, names: list[str], n: int) -> DataFrame:
    counted = _counts(membership, facts, names)
    sizes = counted.groupBy("cluster_id").agg(F.sum("count").alias("in_cluster"))
    everywhere = facts.groupBy(*names).agg(F.count(F.lit(1)).alias("in_all"))
    top = top_n(counted, ["cluster_id"], [F.desc("count"), *[F.asc(c) for c in names]], n, "_r").drop("_r")
    rows = (
        top.join(sizes, "cluster_id")
        .join(everywhere, names)
        .withColumn("total", total_rows(facts))
    )
    lift = safe_div(F.col("count") / F.col("in_cluster"), F.col("in_all") / F.col("total"))
    return rows.select("cluster_id", *names, "count", F.round(lift, DIGITS).alias("lift"))


def entity_lift(membership: DataFrame, entities: DataFrame, n: int = TOP_NAMES) -> DataFrame:
    """Most frequent entities per cluster with their over-representation."""
    clean = entities.select(
        "episode_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind")
    )
    return _lift(membership, clean, ["name", "kind"], n)


def place_lift(membership: DataFrame, places: DataFrame, order: list[str], n: int = TOP_NAMES) -> DataFrame:
    """Most frequent places per cluster with over-representation and first-seen coordinates."""
    lifted = _lift(membership, places, ["canonical_name"], n)
    coords = (
        membership.join(places, "episode_id")
        .groupBy("cluster_id", "canonical_name")
        .agg(F.min_by(F.struct("lat", "lon"), F.struct(*order)).alias("at"))
        .select("cluster_id", "canonical_name", "at.lat", "at.lon")
    )
    return lifted.join(coords, ["cluster_id", "canonical_name"])


def next_steps(metrics: DataFrame) -> DataFrame:
    """One suggestion per cluster: its term with the highest lift."""
    rank = F.struct((-F.col("lift")).alias("l"), (-F.col("tfidf")).alias("w"), "term")
    best = metrics.groupBy("cluster_id").agg(F.min_by("term", rank).alias("term"))
    return best.select(
        "cluster_id",
        F.concat(F.lit("Investigate high-lift term: "), F.col("term")).alias("title"),
        F.lit("This term is unusually concentrated in this cluster.").alias("rationale"),
        F.lit("apply_term_filter").alias("action_type"),
        F.to_json(F.struct("term", "cluster_id")).alias("action_payload"),
    )


def pair_terms(vectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, term) of clusters sharing a term: of ``pairs`` (a, b) only, or of all, hot terms salted."""
    if pairs is not None:
        a = vectors.select(F.col("cluster_id").alias("cluster_a"), "term", F.col("weight").alias("weight_a"))
        b = vectors.select(F.col("cluster_id").alias("cluster_b"), "term", F.col("weight").alias("weight_b"))
        found = pairs.select("cluster_a", "cluster_b").join(a, "cluster_a").join(b, ["cluster_b", "term"])
        return found.select("cluster_a", "cluster_b", "term", "weight_a", "weight_b")
    return salted_pairs(vectors, "term", "cluster_id", ["weight"]).select(
        F.col("cluster_id_a").alias("cluster_a"), F.col("cluster_id_b").alias("cluster_b"), "term", "weight_a", "weight_b"
    )


def pair_cosine(vectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    norms = vectors.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = pair_terms(vectors, pairs).groupBy("cluster_a", "cluster_b").agg(F.sum(F.col("weight_a") * F.col("weight_b")).alias("dot"))
    na = norms.select(F.col("cluster_id").alias("cluster_a"), F.col("norm").alias("na"))
    nb = norms.select(F.col("cluster_id").alias("cluster_b"), F.col("norm").alias("nb"))
    rows = dots.join(na, "cluster_a").join(nb, "cluster_b")
    return rows.select("cluster_a", "cluster_b", safe_div(F.col("dot"), F.col("na") * F.col("nb")).alias("cosine"))


def pair_jaccard(membership: DataFrame) -> DataFrame:
    """Overlap of member sets of clusters that share an episode."""
    members = membership.distinct()
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    shared = (
        salted_pairs(members, "episode_id", "cluster_id", [])
        .groupBy(F.col("cluster_id_a").alias("cluster_a"), F.col("cluster_id_b").alias("cluster_b"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    na = sizes.select(F.col("cluster_id").alias("cluster_a"), F.col("n").alias("na"))
    nb = sizes.select(F.col("cluster_id").alias("cluster_b"), F.col("n").alias("nb"))
    rows = shared.join(na, "cluster_a").join(nb, "cluster_b")
    ratio = safe_div(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared"))
    return rows.select("cluster_a", "cluster_b", ratio.alias("jaccard"))


def bridge_terms(vectors: DataFrame, n: int = BRIDGE_TERMS, pairs: DataFrame | None = None) -> DataFrame:
    """Heaviest shared terms per pair as an ordered array; ties in term order."""
    shared = pair_terms(vectors, pairs).withColumn("w", F.round(F.col("weight_a") + F.col("weight_b"), DIGITS))
    entry = F.struct((-F.col("w")).alias("neg"), "term")
    # a pair shares at most the 25 terms of a cluster vector
    return (
        shared.groupBy("cluster_a", "cluster_b")
        .agg(F.array_sort(F.collect_list(entry)).alias("t"))
        .select("cluster_a", "cluster_b", F.transform(F.slice("t", 1, n), lambda e: e["term"]).alias("bridge_terms"))
    )


def cluster_correlations(membership: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with any member overlap or term similarity."""
    pair = ["cluster_a", "cluster_b"]
    rows = pair_cosine(vectors).join(pair_jaccard(membership), pair, "full").join(bridge_terms(vectors), pair, "left")
    return rows.select(
        *pair,
        F.round(F.coalesce("jaccard", F.lit(0.0)), DIGITS).alias("jaccard_episode_overlap"),
        F.round(F.coalesce("cosine", F.lit(0.0)), DIGITS).alias("cosine_term_similarity"),
        F.coalesce("bridge_terms", F.array().cast("array<string>")).alias("bridge_terms"),
    ).filter("jaccard_episode_overlap > 0 OR cosine_term_similarity > 0")


def top_correlations(membership: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` clusters with the largest member overlap per cluster, with their term similarity and
    bridge terms.  Only the pairs that are returned are looked up in the term vectors."""
    members = membership.select(F.col("cluster_id").alias("item"), F.col("episode_id").alias("feature"), F.lit(1).alias("weight"))
    near = cut_lineage(top_similar(members, n, "jaccard"))
    pair = ["cluster_a", "cluster_b"]
    near = near.withColumn("cluster_a", F.least("item", "other")).withColumn("cluster_b", F.greatest("item", "other"))
    pairs = near.select(*pair).distinct()
    rows = near.join(pair_cosine(vectors, pairs), pair, "left").join(bridge_terms(vectors, pairs=pairs), pair, "left")
    return rows.select(
        F.col("item").alias("cluster_id"),
        F.col("other").alias("other_id"),
        "rank",
        F.col("similarity").alias("jaccard_episode_overlap"),
        F.round(F.coalesce("cosine", F.lit(0.0)), DIGITS).alias("cosine_term_similarity"),
        F.coalesce("bridge_terms", F.array().cast("array<string>")).alias("bridge_terms"),
    )


def cluster_metric_bundle(x: ClusterInputs, place_order: list[str]) -> dict[str, DataFrame]:
    """The seven metric sections over shared inputs."""
    vectors = term_vectors(x.membership, x.keywords)
    terms = term_metrics(x, vectors)
    return {
        "cluster_stats": cluster_stats(x, vectors),
        "cluster_term_metrics": terms,
        "cluster_correlations": cluster_correlations(x.membership, vectors),
        "cluster_entity_stats": entity_lift(x.membership, x.entities),
        "cluster_place_stats": place_lift(x.membership, x.places, place_order),
        "cluster_timeline_histogram": timeline_histogram(x.membership, x.spans),
        "cluster_next_steps": next_steps(terms),
    }
